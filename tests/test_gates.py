"""Version gates: what runs for each change, and results equal to a full rebuild; fingerprints of sets."""
import dataclasses

from pyspark.sql import functions as F

from lettergraph.operators.gates import Gates, Stage, changed_sums, fingerprint, same_rows, set_fingerprints, set_sums
from lettergraph.shared import shared_path
from lettergraph.versions import Versions

ROWS = [(i, f"2024-0{i % 3 + 1}", f"Text {i % 5}", i % 4) for i in range(30)]
SCHEMA = "id long, part string, body string, thread_id long"
STAGES = [
    Stage("content", lambda t, s: t["source"].withColumn("body", F.lower("body")).select("id", "part", "thread_id", "body")),
    Stage("signals", lambda t, s: t["content"].select("id", "part", "thread_id", F.contains("body", F.lit(s["name"])).alias("hit")), ("content",), ("name",)),
    Stage("fold", lambda t, s: t["signals"].where(~F.col("thread_id").isin(s["ignored"])).groupBy("thread_id").agg(F.count_if("hit").alias("n")), ("signals",), ("ignored",), whole=True),
]


def test_what_runs_and_what_comes_out(spark):
    gates = Gates(Versions(spark, shared_path(spark, "gates")), STAGES)
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)

    def step(rows, settings, stages=STAGES):
        gates.stages = list(stages)
        ran = gates.refresh(table(rows), settings)
        full = Gates(Versions(spark, shared_path(spark, "full")), stages)
        full.refresh(table(rows), settings)
        for s in stages:
            assert sorted(map(str, gates.read(s.name).collect())) == sorted(map(str, full.read(s.name).collect())), s.name
        return {s.name: sorted(p for n, p in ran if n == s.name) for s in stages if any(n == s.name for n, _ in ran)}

    months, settings = ["2024-01", "2024-02", "2024-03"], {"name": "text 1", "ignored": [9]}
    assert step(ROWS, settings) == {"content": months, "signals": months, "fold": ["all"]}
    assert step(ROWS[::-1], settings) == {} and gates.versions.at().number == 1
    settings = {**settings, "ignored": [1]}
    assert step(ROWS, settings) == {"fold": ["all"]}
    settings = {**settings, "name": "text 2"}
    assert step(ROWS, settings) == {"signals": months, "fold": ["all"]}
    more = [*ROWS, (99, "2024-02", "TEXT 2", 0)]
    assert step(more, settings) == {"content": ["2024-02"], "signals": ["2024-02"], "fold": ["all"]}
    # A body that reads the same after the first stage goes no further.
    louder = [(i, p, b.upper() if i == 4 else b, t) for i, p, b, t in more]
    assert step(louder, settings) == {"content": ["2024-02"]}
    newer = [dataclasses.replace(STAGES[0], version="2"), *STAGES[1:]]
    assert step(louder, settings, newer) == {"content": months}
    fewer = [r for r in louder if r[1] != "2024-03"]
    assert step(fewer, settings, newer) == {"fold": ["all"]} and {r.part for r in gates.read("signals").collect()} == set(months[:2])
    # Earlier versions are the backup until they expire.
    before = gates.versions.numbers()
    assert len(before) == 7 and gates.versions.expire(keep=2) and len(gates.versions.numbers()) == 2
    assert gates.read("content").count() == len(fewer) and step(fewer, settings, newer) == {}


def test_fingerprints_of_sets(spark):
    rows = [(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "a", "x"), (3, "b", "x"), (3, "a", "y"), (4, "y", "b"), (4, "x", "a"), (5, None, "x"), (6, "x", None), (7, "b", "y"), (7, "a", "x")]
    got = {r.k: r.fingerprint for r in set_fingerprints(spark.createDataFrame(rows, "k int, u string, v string").orderBy(F.rand(2)), ["k"], ["u", "v"]).collect()}
    assert got[1] == got[7]  # the same set in another order
    assert len(set(got.values())) == 6  # a row twice, values swapped between rows or columns, nulls in other places: all differ


def test_fingerprints_follow_rows_that_come_and_leave(spark):
    table = lambda ids: spark.createDataFrame([(i % 3, i) for i in ids], "k long, id long")
    sums = lambda ids: table(ids).groupBy("k").agg(*set_sums("id"))
    told = lambda df: {r.k: r.f for r in df.select("k", fingerprint().alias("f")).collect()}
    after = changed_sums(sums(range(40)), sums([100, 100, 5]), sums([7, 8, *range(2, 40, 3)]), ["k"])
    left = [*range(40), 100, 100, 5]
    for gone in [7, 8, *range(2, 40, 3)]:
        if gone in left:
            left.remove(gone)
    assert told(after)[0] == told(sums(left))[0] and told(after)[1] == told(sums(left))[1]
    empty = changed_sums(sums([1, 2]), sums([]), sums([1, 2]), ["k"])
    assert empty.isEmpty()


def test_same_rows_counts_them(spark):
    table = lambda rows: spark.createDataFrame(rows, "k long, v string")
    rows = [(1, "a"), (1, "a"), (2, None)]
    assert same_rows(table(rows), table(rows[::-1])) and same_rows(table([]), table([]))
    assert not same_rows(table(rows), table(rows[1:])) and not same_rows(table(rows[1:]), table(rows))
    assert not same_rows(table(rows), table([(1, "a"), (2, None), (2, None)])) and not same_rows(table(rows), table([(1, "a"), (1, "b"), (2, None)]))
