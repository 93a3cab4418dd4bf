"""Periodic runs against looking at every period of every stretch."""
import random
import zlib

import numpy as np
import pytest

from lettergraph.llm import queries
from lettergraph.llm.runs import Extensions, periodic_runs


def brute(words, least):
    """Maximal stretches by period, kept where no smaller period has the same stretch."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed):
    r = random.Random(seed)
    out = []
    for _ in range(60):
        alphabet = ["a", "b", "é", "d,"][: r.randrange(1, 5)]
        words = []
        for _ in range(r.randrange(5)):
            piece = [r.choice(alphabet) for _ in range(r.randrange(1, 12))]
            words += (piece * r.randrange(1, 7))[: r.randrange(1, 60)]
            words += [f"w{r.randrange(9)}" for _ in range(r.randrange(4))]
        out.append(" ".join(words))
    fib, last = "a", "b"
    while len(fib) < 150:
        fib, last = fib + last, fib
    return [*out, " ".join(fib), "x " * 100, "x\ty\n" * 40, None, "", " \n", "one", "x x " * 12, "A a " * 6, "a A a a " * 6, out[0], out[0]]


@pytest.mark.parametrize("least", [12, 4, 2])
def test_same_as_every_period(spark, least):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts(least))]
    out = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, periodic int, runs string"), least=least)
    assert out.columns == ["doc_id", "text", "periodic", "runs"]
    got = {r.doc_id: r.periodic for r in out.collect()}
    assert sum(len(r.runs) for r in got.values()) > 60
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        want = brute(words, least)
        assert [tuple(x) for x in got[i].runs] == want and got[i].n_words == len(words), (i, t)
        assert got[i].collapsed == collapsed([w.decode() for w in words], want)


def test_extensions_are_those_of_comparing_words():
    r = random.Random(4)
    for n in (1, 2, 3, 17, 64, 90):
        words = np.array([r.randrange(2) for _ in range(n)])
        ext = Extensions(words)
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        if not pairs:
            continue
        i, j = map(np.array, zip(*pairs, strict=True))
        for a, b, got in zip(i, j, ext.at(i, j), strict=True):
            k = 0
            while max(a, b) + k < n and words[a + k] == words[b + k]:
                k += 1
            assert got == k


def test_very_long_texts_and_empty_table(spark):
    word = lambda i: f"w{i * 2654435761 % 999983}"
    part = [word(i) for i in range(30_000)]
    rows = [(1, " ".join(part + part[:29_000] + ["end"])), (2, "z " * 200_000), (3, " ".join(part))]
    got = {r.doc_id: [tuple(x) for x in r.p.runs] for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), out="p").collect()}
    assert got == {1: [], 2: [(0, 200_000, 1)], 3: []}
    twice = [(1, " ".join(part + part + part[:5] + ["end"]))]
    assert [tuple(x) for x in periodic_runs(spark.createDataFrame(twice, "doc_id long, text string"), out="p").first().p.runs] == [(0, 60_005, 30_000)]
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_words(spark):
    """The words that the query looks at: tails of every tenth checksum go round in a period of their own."""
    rows = [(i, " ".join(f"w{k}" for k in range(i % 70))) for i in range(300)]
    got = {r.doc_id: r.text for r in queries.with_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for i, t in rows:
        w, h = t.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += 1
        assert (got[i] or "").split() == w
    assert changed > 10
