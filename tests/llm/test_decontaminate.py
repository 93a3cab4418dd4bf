"""Decontamination against a scan of all windows, by broadcast and by join."""
import random
import re

import pytest
from pyspark.sql import functions as F

from lettergraph.llm.decontaminate import benchmark_windows, clean_documents, contaminated, decontaminate, without_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, seen = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    seen |= wins[tuple(w[k : k + size])]
        out.append((d, len(w), len(hit), sorted(seen), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def tables(seed):
    r = random.Random(seed)
    say = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(["Ab", "cD", "é", "x1", "漢字"]) + str(r.randrange(9)) for _ in range(n))
    items = [(i, say(r.choice([1, 5, 12, 13, 20]))) for i in range(12)] + [(12, None), (13, ""), (None, say(14)), (3, say(15))]
    docs = [(i, say(r.randrange(200)) + " " + r.choice(["", items[r.randrange(12)][1].upper()]) + " " + say(r.randrange(9))) for i in range(60)]
    return [*docs, (60, None), (61, ""), (62, "-- !"), (63, items[4][1]), (63, items[4][1]), (None, items[5][1])], items


@pytest.mark.parametrize("limit", [10_000, 0])
def test_same_as_scanning(spark, limit):
    docs, items = tables(limit)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, hash string")
    out = decontaminate(d, b, broadcast_windows=limit).withColumn("c", contaminated())
    assert out.columns == ["doc_id", "text", "n_hit", "decon", "c"]
    got = sorted(((r.doc_id, r.decon.n_words, r.decon.n_hit, sorted(r.decon["items"]), r.c) for r in out.collect()), key=str)
    assert got == brute(docs, items)
    want = sorted((x[0] for x in brute(docs, items) if not x[4]), key=str)
    kept = clean_documents(d, b, broadcast_windows=limit)
    assert kept.columns == d.columns and sorted((r.doc_id for r in kept.collect()), key=str) == want


def test_spans_are_cut_out(spark):
    d = spark.createDataFrame([(1, "Keep this: one TWO three! and that"), (2, "nothing"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two, three")], "item_id long, text string")
    got = {r.doc_id: r.text for r in without_spans(d, b).collect()}
    assert got == {1: "Keep this: ! and that", 2: "nothing", 3: None}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(d, b).first().decon.n_hit == 0
    assert decontaminate(d.limit(0), b).collect() == []


def test_a_window_of_very_many_items(spark):
    """One passage in all items, on the join path: rows of windows and items, no list of items beside a window that is not hit."""
    passage = " ".join(f"p{i}" for i in range(13))
    bench = spark.range(20_000).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("item_id"), F.concat(F.lit(passage + " own"), F.col("id").cast("string")).alias("text"))
    docs = spark.createDataFrame([(1, "x " + passage + " y"), (2, passage.upper() + " own7"), (3, "nothing"), (4, None), (5, "x " + passage + " y")], "doc_id long, text string")
    pairs = benchmark_windows(bench)
    assert pairs.columns == ["size", "hash", "words", "item"] and pairs.count() == 40_000
    out = {r.doc_id: r for r in decontaminate(docs, bench, broadcast_windows=10).select("doc_id", "decon.n_words", "decon.n_hit", F.size("decon.items").alias("n"), "decon.items").collect()}
    assert [(r.n_words, r.n_hit, r.n) for _, r in sorted(out.items())] == [(15, 13, 20_000), (14, 14, 20_000), (1, 0, 0), (0, 0, 0), (15, 13, 20_000)]
    assert out[1]["items"] == sorted(f"i{k}" for k in range(20_000))
