"""Messages taken in chunk by chunk: all tables of a chunk show at once, and a rolling vocabulary is kept by exact subtraction.

A chunk becomes messages, tables derived from them, weekly counts of terms and the changes
these make to the rolling window, each written aside; one commit then shows them all with
the chunk's number and the newest time.  A chunk that failed leaves nothing to see and is
taken again; one that was committed before its stream could note it is known by its number
and passed over.

The window holds the weeks from ``weeks`` weeks before the newest message's on.  When it
moves, the counts of the weeks that leave it are added with a minus sign, so a window is the
sum of changes and no message is read again.  ``compact`` sums the changes up; terms with
nothing left go, and so do weekly counts that no window will need.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.operators.texts import by_text
from lettergraph.operators.vocabulary import bag
from lettergraph.versions import Manifest, Versions

SEGMENTS = 8  # changes of the window that are read together before they are summed up
Derived = Callable[[DataFrame], DataFrame]
_KEY = ("who", "kind", "term")


def week_of(ts: str) -> Column:
    """Days from 1970 to the Monday of a time."""
    return F.datediff(F.date_trunc("week", F.col(ts)).cast("date"), F.lit("1970-01-01").cast("date"))


def term_rows(m: DataFrame) -> DataFrame:
    """(who, kind, term, week, n): messages that came in, by term and by phrase."""
    rows = m.where("NOT is_sent AND sender_addr <> '' AND sent_ts IS NOT NULL").select(F.col("sender_addr").alias("who"), "sent_ts", "body")
    b = by_text(rows, "body", "bag", bag).select("who", "sent_ts", "bag.*")
    of = lambda kind, column: F.transform(column, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))
    one = F.explode(F.concat(of("term", "terms"), of("phrase", "phrases")))
    return b.select("who", week_of("sent_ts").alias("week"), one.alias("t")).groupBy("who", "t.kind", "t.term", "week").agg(F.count("*").alias("n"))


class Ingest:
    """Chunks of messages into versioned tables ``messages``, those of ``derived``, ``term_weeks`` and ``term_changes``."""

    def __init__(self, versions: Versions, derived: Mapping[str, Derived] | None = None, weeks: int = 26, terms: Derived = term_rows, written: Callable[[str], None] = lambda table: None):
        self.versions, self.derived, self.weeks, self.terms, self.written = versions, dict(derived or {}), weeks, terms, written

    def _put(self, changes: dict[str, dict], table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        changes[table] = self.versions.put(df, table, partition_by)
        self.written(table)
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.versions.root}/{changes[table]['paths'][0]}").select(df.columns)

    def take(self, rows: DataFrame, number: int, source: str = "") -> Manifest:
        """One chunk; of rows with one message id the first to arrive counts, and none that is there already.

        Rows without a message id are all taken.  Messages without a time move no window and enter no week.
        """
        base = self.versions.at()
        if base.facts.get("source") == source and int(base.facts.get("chunk", -1)) >= number:
            return base
        nth = F.row_number().over(Window.partitionBy("message_id").orderBy("seq", "id"))
        named = rows.where("message_id IS NOT NULL").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
        fresh = named.unionByName(rows.where("message_id IS NULL"))
        if "messages" in base.tables:
            fresh = fresh.join(self.versions.read("messages", base).select("message_id"), "message_id", "left_anti").select(rows.columns)
        changes: dict[str, dict] = {}
        new = self._put(changes, "messages", fresh)
        for name, derive in self.derived.items():
            self._put(changes, name, derive(new))
        counts = self._put(changes, "term_weeks", self.terms(new), ("week",))

        times = new.agg(F.max("sent_ts").cast("string").alias("last"), F.max(week_of("sent_ts")).alias("week")).first()
        old = int(base.facts["since"]) if "since" in base.facts else None
        since = old if times.week is None else max(times.week - 7 * (self.weeks - 1), old if old is not None else -(2**31))
        if since is not None:
            change = counts.where(F.col("week") >= since).select(*_KEY, "n")
            if old is not None and since > old:
                leaving = self.versions.read("term_weeks", base).where((F.col("week") >= old) & (F.col("week") < since))
                change = change.union(leaving.select(*_KEY, (-F.col("n")).alias("n")))
            self._put(changes, "term_changes", change.groupBy(*_KEY).agg(F.sum("n").alias("n")).where("n <> 0"))
        facts = {"chunk": str(number), "source": source}
        if times.last is not None:
            facts["last_sync"] = max(times.last, base.facts.get("last_sync", ""))
        if since is not None:
            facts["since"] = str(since)
        return self.versions.commit(base, changes, facts, add=True)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take in all that a stream has; a micro-batch is a chunk."""

        def chunk(rows: DataFrame, number: int) -> None:
            self.take(rows, number, checkpoint)
            if len(self.versions.at().tables.get("term_changes", {"paths": []})["paths"]) > SEGMENTS:
                self.compact()

        stream.writeStream.foreachBatch(chunk).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def window(self, version: Manifest | None = None) -> DataFrame:
        """(who, kind, term, df): messages of the window that hold the term."""
        changes = self.versions.read("term_changes", version)
        return changes.groupBy(*_KEY).agg(F.sum("n").alias("df")).where("df <> 0")

    def compact(self) -> Manifest:
        """The changes as one segment without empty terms, and the weeks that a window still holds."""
        base = self.versions.at()
        if "term_changes" not in base.tables:
            return base
        changes = {"term_changes": self.versions.put(self.window(base).select(*_KEY, F.col("df").alias("n")), "term_changes")}
        weeks = self.versions.read("term_weeks", base).where(F.col("week") >= int(base.facts["since"])).groupBy(*_KEY, "week").agg(F.sum("n").alias("n"))
        changes["term_weeks"] = self.versions.put(weeks.select(self.versions.read("term_weeks", base).columns), "term_weeks", ("week",))
        return self.versions.commit(base, changes)

