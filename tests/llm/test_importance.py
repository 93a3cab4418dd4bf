"""Importance resampling against counting features one by one."""
import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from lettergraph.llm.importance import bucket_counts, draw, importance, resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def features(text, longest):
    w = words(text)
    return [b" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, longest, buckets, percent, least, seed=7):
    ours, theirs = (Counter(crc32(f) % buckets for t in texts for f in features(t, longest)) for texts in ([t for _, t in rows], target))
    n, m = sum(ours.values()) + buckets, sum(theirs.values()) + buckets
    gain = [math.floor(1000 * math.log((theirs[b] + 1) * n / ((ours[b] + 1) * m))) for b in range(buckets)]
    out = []
    for i, t in rows:
        f = features(t, longest)
        weight = sum(gain[crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(t)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = able[: len(able) * percent // 100]
    return out, drawn


def corpus(seed):
    r = random.Random(seed)
    text = lambda pool, n: "".join(r.choice(pool) + r.choice([" ", " ", ", ", "\n"]) for _ in range(n))
    common, special = ["the", "The", "é", "x9", "of", "naïve", "ß"], ["proof", "lemma", "Ab", "of"]
    rows = [(i, text(common + special * (i % 3), r.randrange(40))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " .,! "), (503, "z" * 5000), (None, rows[7][1]), (None, rows[8][1] + " more"), (7, rows[7][1]), (7, rows[7][1]), (7, "other text of seven")]
    return rows, [text(special, 30) for _ in range(10)] + [None, ""]


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(2, 10_000, 25, 20), (1, 16, 100, 1), (3, 50, 60, 5)])
def test_same_as_counting(spark, longest, buckets, percent, least):
    rows, target = corpus(longest)
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, rank int, bucket string, importance int")
    scored = importance(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets)
    assert scored.columns == docs.columns
    out = draw(scored, percent=percent, least_words=least)
    want, drawn = brute(rows, target, longest, buckets, percent, least)
    got = [(r.doc_id, *r.importance, r["rank"]) for r in out.collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((g[:5] for g in got), key=key) == sorted(map(tuple, want), key=key)
    ranked = sorted((g for g in got if g[5] is not None), key=lambda g: g[5])
    assert [g[5] for g in ranked] == list(range(1, len(drawn) + 1))
    assert [g[:5] for g in ranked] == [tuple(d) for d in drawn]


def test_target_texts_are_drawn_more_often(spark):
    rows, target = corpus(9)
    docs = spark.createDataFrame([(i, t, i % 3 > 0) for i, t in rows if i is not None and i < 400], "doc_id long, text string, special boolean")
    kept = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=50, least_words=10)
    assert kept.columns == docs.columns
    counts = {r.special: r["count"] for r in kept.groupBy("special").count().collect()}
    all_ = {r.special: r["count"] for r in docs.where(F.size(F.split("text", r"\s+")) > 10).groupBy("special").count().collect()}
    assert counts[True] / all_[True] > counts.get(False, 0) / all_[False]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert draw(importance(none, none)).collect() == []
    some = spark.createDataFrame([(1, "a b " * 30)], "doc_id long, text string")
    assert draw(importance(some, none), percent=100).first()["rank"] == 1
    assert bucket_counts(none).collect() == []


def test_one_score_for_a_third_of_the_rows(spark):
    """Rows of one id and text share a score; they are dealt over the parts and numbered without a gap."""
    text = "a b c " * 10
    docs = spark.createDataFrame([(5, text)] * 400 + [(i, f"w{i} " * 25) for i in range(100, 900)], "doc_id long, text string")
    scored = importance(docs, spark.createDataFrame([("a b c",)], "text string"))
    out = draw(scored, percent=75)
    ranks = [r["rank"] for r in out.collect() if r["rank"] is not None]
    assert sorted(ranks) == list(range(1, 901))


def test_very_long_text(spark):
    r = random.Random(2)
    rows = [(1, " ".join(f"w{r.randrange(50_000)}" for _ in range(300_000))), (2, "a " * 200_000)]
    want, _ = brute(rows, ["a a w7"], 2, 10_000, 25, 20)
    out = importance(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a a w7",)], "text string"))
    assert sorted([x.doc_id, *x.importance] for x in out.collect()) == want
