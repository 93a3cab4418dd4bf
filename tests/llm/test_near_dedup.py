"""Near-dedup against all pairs; components against union-find."""
import random

import pytest

from lettergraph.llm.components import components
from lettergraph.llm.near_dedup import keep_one, near_duplicates


def shingles(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = low.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(8):
        base = [f"w{r.randrange(900)}" for _ in range(r.choice([30, 80, 150]))]
        for _ in range(r.choice([1, 2, 25])):
            copy = list(base)
            for _ in range(r.randrange(5)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    return [*texts, texts[0], texts[0].upper(), None, "", "  ", "one two", "ONE two", "one two three", "x " * 300, "x " * 5]


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80), (3, 92)])
def test_same_as_all_pairs(spark, seed, percent):
    texts = corpus(seed)
    ids = list(range(100, 100 + len(texts)))
    sets = dict(zip(ids, map(shingles, texts), strict=True))
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(zip(ids, texts, [1] * len(ids), strict=True)), "doc_id long, text string, component int")
    got = {r.id: (r.n_shingles, r.component) for r in near_duplicates(docs, percent=percent).collect()}
    want = union(pairs, ids)
    assert got == {i: (len(sets[i]), want[i]) for i in ids}
    kept = keep_one(docs, percent=percent)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_chain_and_off_centre_groups(spark):
    r = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(12):  # each text is close to its neighbours only
        base = list(base)
        for _ in range(2):
            base[r.randrange(200)] = f"c{k}{r.randrange(10**6)}"
        texts.append(" ".join(base))
    ids = list(range(len(texts)))
    sets = dict(zip(ids, map(shingles, texts), strict=True))
    pairs = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert {x.id: x.component for x in near_duplicates(docs).collect()} == union(pairs, ids)


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "other words here")], "doc_id long, text string")
    got = sorted(((x.id, x.component) for x in near_duplicates(docs).collect()), key=str)
    assert got == [(4, 4), (4, 4), (5, 5), (None, 4)]
    assert keep_one(docs).count() == 4
    assert near_duplicates(docs.limit(0)).collect() == []


def test_components_of_random_links(spark):
    r = random.Random(3)
    nodes = list(range(300))
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(250, 290)] + [(7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(pairs, nodes)
    linked = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == {n: want[n] for n in linked}


def test_complementary_words_are_not_linked(spark):
    """Letters in Thue-Morse order and their complement: sums of powers modulo 2**64 take the two for one word."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85)
    assert sorted(tuple(r) for r in out.select("id", "n_shingles", "component").collect()) == [(1, 1, 1), (2, 1, 2)]
