"""Chunked ingest: whole chunks or nothing, and a window kept by subtraction."""
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lettergraph.shared import shared_path
from lettergraph.streaming.chunks import SEGMENTS, Ingest, term_rows
from lettergraph.versions import Conflict, Versions

SCHEMA = "id long, message_id string, seq long, thread_id long, sender_addr string, is_sent boolean, sent_ts timestamp_ntz, body string"
START = datetime(2024, 1, 1)


def message(i, day, body="alpha bravo", sent=False, who="a@x", mid=None):
    return (i, mid or f"<{i}>", i, 1, who, sent, None if day is None else START + timedelta(days=day, hours=i % 24), body)


def window(ingest, version=None):
    return {(r.who, r.kind, r.term): r.df for r in ingest.window(version).collect()}


def fresh(spark, **options):
    return Ingest(Versions(spark, shared_path(spark, "chunks")), **options)


def test_window_after_each_chunk_equals_recounting(spark):
    r = random.Random(1)
    ingest, weeks, seen = fresh(spark, weeks=3), 3, {}
    for chunk in range(5):
        rows = []
        for k in range(40):
            day = None if k == 7 else chunk * 11 + r.randrange(-25, 11)  # many arrive late, some from before the window
            i = chunk * 40 + k
            mid = f"<{r.randrange(i + 1)}>" if k % 9 == 0 else f"<n{i}>"
            rows.append(message(i, max(day, 0) if day is not None else None, " ".join(r.choice(["alpha", "bravo", "delta"]) for _ in range(r.randrange(4))), k % 10 == 3, r.choice(["a@x", "b@x"]), mid))
        ingest.take(spark.createDataFrame(rows, SCHEMA), chunk)
        for m in rows:
            seen.setdefault(m[1], m)
        monday = lambda t: (t - timedelta(days=t.weekday())).date()
        since = max(monday(m[6]) for m in seen.values() if m[6]) - timedelta(days=7 * (weeks - 1))
        want = Counter()
        for m in seen.values():
            if m[6] and not m[5] and monday(m[6]) >= since:
                words = m[7].split()
                want.update({(m[4], "term", w) for w in words} | {(m[4], "phrase", f"{x} {y}") for x, y in zip(words, words[1:], strict=False) if x != y})
        assert window(ingest) == dict(want), chunk
        if chunk == 3:
            before = ingest.versions.at()
            after = ingest.compact()
            assert window(ingest, before) == window(ingest, after) and len(after.tables["term_changes"]["paths"]) == 1
            assert ingest.versions.read("term_changes", after).where("n <= 0").isEmpty()
            assert ingest.versions.read("term_weeks", after).where(F.col("week") < int(after.facts["since"])).isEmpty()
    assert {x.message_id for x in ingest.versions.read("messages").collect()} == set(seen)


@pytest.mark.parametrize("at", ["messages", "signals", "term_weeks", "term_changes"])
def test_a_chunk_that_dies_shows_nothing(spark, at):
    dies = []

    def written(table):
        if table == at and not dies:
            dies.append(table)
            raise RuntimeError(table)

    derived = {"signals": lambda m: m.select("id", F.length("body").alias("n"))}
    ingest = fresh(spark, derived=derived, written=written)
    rows = spark.createDataFrame([message(i, i) for i in range(5)], SCHEMA)
    with pytest.raises(RuntimeError):
        ingest.take(rows, 0)
    assert ingest.versions.at().number == 0 and ingest.versions.at().tables == {}
    ingest.take(rows, 0)
    now = ingest.versions.at()
    assert now.number == 1 and ingest.versions.read("messages", now).count() == ingest.versions.read("signals", now).count() == 5
    # The stream may not have noted the commit: the chunk comes again and is known.
    assert ingest.take(rows, 0).number == 1
    # Another stream's chunk of the same number is not; its messages are known by their ids.
    assert ingest.take(rows, 0, "other").number == 2 and ingest.versions.read("messages").count() == 5
    assert window(ingest, now) == window(ingest)
    assert len(ingest.versions.expire(keep=1)) >= 1  # what the dead chunk had written


def test_two_writers(spark):
    ingest = fresh(spark)
    rows = lambda i: spark.createDataFrame([message(i, 1)], SCHEMA)
    ingest.take(rows(1), 0)
    taken = []

    def other(table):
        if table == "messages" and not taken:
            taken.append(1)
            Ingest(ingest.versions).take(rows(2), 1)

    with pytest.raises(Conflict):
        Ingest(ingest.versions, written=other).take(rows(3), 1, "x")
    assert {r.id for r in ingest.versions.read("messages").collect()} == {1, 2}


def test_stream_of_many_small_chunks(spark):
    ingest, inbox = fresh(spark, weeks=1), shared_path(spark, "inbox")
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(inbox)
    for i in range(SEGMENTS + 2):
        spark.createDataFrame([message(i, i, f"word{'abcdefghijkl'[i]} same")], SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
    ingest.run(stream, shared_path(spark, "state"))
    assert len(ingest.versions.at().tables["term_changes"]["paths"]) <= SEGMENTS
    assert window(ingest)["a@x", "term", "same"] == 3  # the eighth to the tenth of January
    assert ("a@x", "term", "worda") not in window(ingest)
    assert ingest.versions.at().facts["last_sync"].startswith("2024-01-10")


def test_nothing_and_nulls(spark):
    ingest = fresh(spark)
    assert ingest.compact().number == 0
    ingest.take(spark.createDataFrame([], SCHEMA), 0)
    assert ingest.versions.read("messages").isEmpty() and "since" not in ingest.versions.at().facts
    rows = [(1, None, 1, 1, "a@x", False, START, None), (2, None, 2, 1, None, False, START, "alpha"), (3, "<3>", 3, 1, "a@x", False, None, "alpha")]
    ingest.take(spark.createDataFrame(rows, SCHEMA), 1)
    assert ingest.versions.read("messages").count() == 3 and window(ingest) == {}
    assert term_rows(spark.createDataFrame(rows, SCHEMA)).isEmpty()
