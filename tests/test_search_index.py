"""Search through the trigram index against scanning."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettergraph.functions.query import parse
from lettergraph.operators import search, search_index
from lettergraph.operators.search_index import SearchIndex, trigrams_of
from lettergraph.shared import shared_path
from lettergraph.versions import Versions

COLUMNS = "id long, sent_ts timestamp_ntz, subject string, body string, sender_addr string"
LINES = ["model test", '"model test"', "Model", "검토 요청", "mo te", "mod te", "nothing-here", '"test mod" x', "model nothing-here", "from:u1@x model", "from:u1@x", "", "🙂 pla", "plan plan", '"a b"', "İst model"]


def letters(n, seed):
    r = random.Random(seed)
    words = ["model", "test", "te", "a", "b", "검토", "요청드립니다", "Plan", "🙂", "mo", "x", "İstanbul", "modtest"]
    for i in range(n):
        text = lambda k: None if r.random() < 0.05 else " ".join(r.choice(words) for _ in range(r.randrange(k)))
        yield (i * r.choice([1, 1, 40_000]) if i % 7 else i + 70_000 * i, None, text(4), text(12), f"u{i % 3}@x")


@pytest.fixture(scope="module")
def indexed(spark):
    rows = list({r[0]: r for r in letters(300, 1)}.values())
    m = spark.createDataFrame(rows, COLUMNS)
    index = SearchIndex(Versions(spark, shared_path(spark, "index")))
    index.add(m.where("id % 2 = 0"))
    index.add(m.where("id % 2 = 1"))
    return m, index


@pytest.mark.parametrize("line", LINES)
def test_same_as_the_scan(indexed, line):
    m, index = indexed
    got, want = ([tuple(r) for r in found.select("id", "tier").collect()] for found in (index.search(m, line, 40), search.search(m, line, 40)))
    assert got == want
    assert {r.id for r in index.matches(m, line).collect()} == {r.id for r in search.matches(m, line).collect()}


@pytest.mark.parametrize("terms", [["model", "test"], ["요청드", "nothing-here"], ["te"], ["plan"]])
def test_ranks_are_those_of_the_scan(indexed, terms):
    m, index = indexed
    got, want = ({r.id: round(r.score, 9) for r in f.collect()} for f in (index.ranked(m, terms), search.ranked(m, terms)))
    assert got == want


def test_only_the_blocks_of_its_trigrams_are_read(indexed):
    m, index = indexed
    blocks = index.blocks_of(trigrams_of("model"))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1]
    assert "In(gram" in plan
    assert {r.gram for r in blocks.select("gram").distinct().collect()} == set(trigrams_of("model"))


def test_merging_keeps_the_rows_and_readers_their_version(spark, indexed):
    m, _ = indexed
    index = SearchIndex(Versions(spark, shared_path(spark, "index")))
    index.add(m.where("id % 3 = 0"))
    before = index.add(m.where("id % 3 > 0 OR id % 6 = 0"))  # some messages come twice
    after = index.merge()
    assert len(after.tables["postings"]["paths"]) == 1 and len(before.tables["postings"]["paths"]) == 2
    ids = lambda v: sorted(r.id for r in index.candidates(["model"], v).collect())
    assert ids(before) == ids(after)
    blocks = index.versions.read("postings", after)
    assert blocks.groupBy("gram", "high").count().where("count > 1").isEmpty()
    index.versions.expire(keep=1)
    assert [tuple(r) for r in index.search(m, "model test").select("id", "tier").collect()] == [tuple(r) for r in search.search(m, "model test").select("id", "tier").collect()]


def test_many_hits_are_joined(indexed, monkeypatch):
    m, index = indexed
    monkeypatch.setattr(search_index, "FEW", 3)
    assert {r.id for r in index.matches(m, "model").collect()} == {r.id for r in search.matches(m, "model").collect()}


def test_coded_ids_come_back(spark):
    r = random.Random(3)
    lists = [sorted(r.sample(range(65_536), k)) for k in (0, 1, 2, 500, 65_536)] + [[0], [65_535], [0, 65_535]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>").repartition(2)
    back = df.select("i", search_index._lows(search_index._gaps(F.col("x"))).alias("y"), F.length(search_index._gaps(F.col("x"))).alias("n")).collect()
    assert {b.i: list(b.y) for b in back} == dict(enumerate(lists)) and all(b.n == 2 * len(lists[b.i]) for b in back)


def test_trigrams_are_those_of_slices(spark):
    texts = ["", None, "ab", "abc", "AbcabC", "검토합니다🙂x", "x" * 100_000]
    df = spark.createDataFrame([(t, "Zz z") for t in texts], "a string, b string").coalesce(1)
    for row in df.select("a", search_index.trigrams(F.col("a"), F.col("b")).alias("g")).collect():
        assert sorted(row.g) == sorted({*trigrams_of(row.a or ""), *trigrams_of("Zz z")})
    assert search.needles(parse('"a b" model te from:x')) == ["a b", "model"]
    assert pa.array(np.array(trigrams_of("\U0010ffff" * 3))).type == pa.int64()
