"""Mixing and sharding laws."""
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lettergraph.llm.mixing import mix, mix_plan
from lettergraph.llm.sharding import even_tree, shard_of, with_shards


def targets(sizes):
    """Share by weight; stop at three times the size; share the rest again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def corpus(seed, sources):
    r = random.Random(seed)
    rows = [(i, r.choice(sources), "w " * r.randrange(60)) for i in range(900)]
    return [*rows, (900, sources[0], None), (901, sources[0], ""), (5, sources[0], "a b"), (5, sources[0], "a b"), (None, sources[0], "x y z"), *[(1000 + i, "hot", "same words here") for i in range(500)]]


@pytest.mark.parametrize("sources", [["a", "b", "c", None], ["z", "Z", "é", "", None, "q"]])
def test_mix(spark, sources):
    rows = corpus(len(sources), sources)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    plan = mix_plan(docs).cache()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = targets(sizes), Counter()
    got = plan.collect()
    assert len(got) == len(rows) and plan.columns == [*docs.columns, "mix"]
    for r in got:
        assert r.mix.source_size == sizes[r.source] and abs(r.mix.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.mix.copies <= 3
        taken[r.source] += r.mix.copies * r.mix["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 130
    again = mix_plan(docs.repartition(7)).select("doc_id", "mix.copies").collect()
    assert sorted(map(str, again)) == sorted(map(str, plan.select("doc_id", "mix.copies").collect()))
    out = mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.mix.copies for r in got)


def test_mix_empty(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix_plan(none).collect() == []
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [(r.mix.copies, r.mix.target) for r in mix_plan(blank).collect()] == [(0, 0.0)] * 2


def test_shards_and_slots(spark):
    rows = [(i, f"t{i}", 0) for i in range(4000)] + [(7, "again", 0)] * 3 + [(None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    out = with_shards(docs, even_tree(16))
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(180 < len(s) < 330 for s in slots.values())
    assert with_shards(docs.limit(0), even_tree(16)).collect() == []


@pytest.mark.parametrize("more", [17, 18, 21])
def test_one_more_shard_takes_rows_only_into_itself(spark, more):
    ids = spark.range(6000)
    a, b = shard_of(F.col("id"), even_tree(more - 1)), shard_of(F.col("id"), even_tree(more))
    moved = ids.select(a.alias("a"), b.alias("b")).where("a <> b").collect()
    assert moved and {r.b for r in moved} == {more - 1}
    assert len(moved) < 2 * 6000 / more


def test_movement_stays_in_subtrees_whose_weight_changes(spark):
    tree = {"g0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 1.0, 3: 1.0}}, "g1": {"k0": {4: 1.0, 5: 1.0}}}
    heavy = {"g0": {"k0": {0: 1.0, 1: 3.0}, "k1": {2: 1.0, 3: 1.0}}, "g1": {"k0": {4: 1.0, 5: 1.0}}}
    rows = spark.range(8000).select(shard_of(F.col("id"), tree).alias("a"), shard_of(F.col("id"), heavy).alias("b")).collect()
    assert all(r.b in (0, 1, 2, 3) for r in rows if r.a != r.b)  # nothing moves into the region that stays as it was
    count = Counter(r.b for r in rows)
    assert 2500 < count[1] < 3500 and 800 < count[4] < 1200
    assert {shard_of(F.col("id"), {"g": {"k": {3: 1.0, 4: 0.0}}}) is not None}
