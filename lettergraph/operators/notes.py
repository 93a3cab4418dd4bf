"""Notes that several editors write: an edit names the version it saw, and does nothing where that is no longer so.

Edits of a note apply in the order of their numbers.  Each has one outcome: ``conflict``
where the version it saw is not the note's; with an empty text ``deleted``, or ``noop``
where there is no note; else ``created``, or ``saved``, which leaves the version alone where
the text is the same.  A note that is not there has version 0, and numbers are never used
again, so a note that went and came back is another than the one seen before.  Deleted notes
stay as marks, until ``compacted``, so that their numbers are remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettergraph.versions import Conflict, Versions

STATE = "note_id bigint, version bigint, last bigint, body string"
EDITS = "note_id bigint, nr bigint, seen bigint, body string"
_OUT = pa.schema([("note_id", pa.int64()), ("nr", pa.int64()), ("outcome", pa.string()), ("version", pa.int64()), ("last", pa.int64()), ("body", pa.string())])


def tidy(text: str | None) -> str:
    """One kind of line end, nothing blank around it."""
    return (text or "").replace("\r\n", "\n").strip()


def outcome(version: int, last: int, body: str | None, seen: int | None, text: str) -> tuple[str, int, int, str | None]:
    """One edit applied to a note's state: what came of it, and the state after."""
    if seen is not None and seen != version:
        return "conflict", version, last, body
    if not text:
        return ("deleted", 0, last, None) if version else ("noop", version, last, body)
    if not version:
        return "created", last + 1, last + 1, text
    return ("saved", version, last, body) if text == body else ("saved", last + 1, last + 1, text)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by note and number, a note's state before its edits: one row after the other, so a note of very many edits is no list."""
    note, state = None, (0, 0, None)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if note is None or r["note_id"] != note[0]:
                note, state = (r["note_id"],), (0, 0, None)
            if r["outcome"] == "state":
                state = (r["version"], r["last"], r["body"])
                out.append({**r, "nr": None})
                continue
            came, *state = outcome(*state, r["seen"], tidy(r["body"]))
            out.append({"note_id": r["note_id"], "nr": r["nr"], "outcome": came, "version": state[0], "last": state[1], "body": state[2]})
        yield pa.RecordBatch.from_pylist([{k: o[k] for k in _OUT.names} for o in out], schema=_OUT)


def applied(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """All edits with their outcome and the note's state after it (note_id, nr, outcome, version, last, body), and a row ``state``
    without a number for each note there was.  Edits without a note or a number are left out; of equal numbers the order is that of their texts."""
    before = notes.select("note_id", F.lit(None).cast("bigint").alias("nr"), F.lit(None).cast("bigint").alias("seen"), "body", F.lit("state").alias("outcome"), "version", "last")
    new = edits.where("note_id IS NOT NULL AND nr IS NOT NULL").select("note_id", "nr", "seen", "body", F.lit("edit").alias("outcome"), F.lit(0).cast("bigint").alias("version"), F.lit(0).cast("bigint").alias("last"))
    rows = before.unionByName(new).repartition("note_id").sortWithinPartitions("note_id", F.col("nr").asc_nulls_first(), "seen", "body")
    return rows.mapInArrow(_fold, "note_id bigint, nr bigint, outcome string, version bigint, last bigint, body string")


def after(rows: DataFrame) -> DataFrame:
    """The notes after all edits, marks of deleted ones among them."""
    newest = rows.groupBy("note_id").agg(F.max_by(F.struct("version", "last", "body"), F.struct(F.col("nr").isNotNull(), "nr", "last", F.col("version") == 0)).alias("s"))
    return newest.select("note_id", "s.version", "s.last", "s.body")


class Notes:
    """Notes as a versioned table; writers that meet try again on what the other left."""

    def __init__(self, versions: Versions):
        self.versions = versions

    def _state(self, version) -> DataFrame:
        return self.versions.read("notes", version) if "notes" in version.tables else self.versions.spark.createDataFrame([], STATE)

    def now(self) -> DataFrame:
        """Notes that are there: note_id, version, body."""
        return self._state(self.versions.at()).where("version > 0").select("note_id", "version", "body")

    def edit(self, edits: DataFrame, tries: int = 5) -> DataFrame:
        """Apply edits; their outcomes (note_id, nr, outcome, version)."""
        for left in reversed(range(tries)):
            base = self.versions.at()
            entry = self.versions.put(applied(self._state(base), edits), "outcomes")
            rows = self.versions.spark.read.parquet(f"{self.versions.root}/{entry['paths'][0]}")
            try:
                self.versions.commit(base, {"notes": self.versions.put(after(rows), "notes"), "outcomes": entry})
            except Conflict:
                if not left:
                    raise
                continue
            return rows.where("outcome <> 'state'").select("note_id", "nr", "outcome", "version")
        raise ValueError("tries is 1 or more")

    def compacted(self, number: int | None = None) -> None:
        """Forget the marks of deleted notes: do so once no editor can have seen them any more."""
        base = self.versions.at(number)
        self.versions.commit(base, {"notes": self.versions.put(self._state(base).where("version > 0"), "notes")})
