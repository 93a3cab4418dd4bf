"""Substring dedup against a count of all windows."""
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lettergraph.llm import substring_dedup
from lettergraph.llm._words import SPACED, Chunk
from lettergraph.llm.substring_dedup import SuffixAutomaton, remove_repeats


def brute(texts, length):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "é", "dd", "e."]) + str(r.randrange(4))
    shared = [" ".join(word() for _ in range(30)) for _ in range(3)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(r.randrange(12))) for _ in range(4)]
        texts.append("\n ".join(p + " " + r.choice(["", *shared]) for p in parts))
    # Empty, null, short, one word over and over, with and without other text, no-break space inside a word, repeated rows.
    return [*texts, None, "", " \t\n", "x", "z " * 40, "q z z z z z z z z z z z z z z q", "u v w", texts[0], texts[0], *["hot " + shared[0] + f" {i}" for i in range(12)]]


@pytest.mark.parametrize(("length", "gram", "limit"), [(9, 3, 1500), (9, 3, 2), (12, 6, 4), (3, 3, 1)])
def test_same_as_counting_windows(spark, length, gram, limit):
    texts = corpus(length + limit)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, dedup int, k string")
    out = remove_repeats(docs, length=length, gram=gram, stretch_limit=limit, shard_words=50)
    assert set(out.columns) == {"doc_id", "text", "dedup", "k"}
    got = [tuple(r) for r in out.select("dedup.n_words", "dedup.n_removed", "dedup.kept_text").collect()]
    assert sorted(got) == brute(texts, length)


def test_spans_are_the_removed_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e f x"), (2, "y a b c d e z")], "doc_id long, text string")
    rows = {r.doc_id: r.dedup for r in remove_repeats(docs, length=4, gram=2).collect()}
    assert [tuple(s) for s in rows[1].removed] == [(0, 5)] and rows[1].kept_text == "f x"
    assert [tuple(s) for s in rows[2].removed] == [(1, 6)] and rows[2].kept_text == "y z"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).collect() == []


def test_automaton_counts():
    sam = SuffixAutomaton()
    sam.add(list("abcabcd"), 1)
    sam.add(list("bcd"), 2)
    sam.close()
    assert sam.repeats(list("abcabcd"), 3) == [True, False, False, True, True]
    assert sam.repeats(list("xbcdx"), 3) == [False, True, False]


def thue_morse(n):
    """Letters a and b by the parity of ones, and the same the other way round: sums of powers modulo 2**64 take them for equal."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_complementary_words_and_runs_differ(spark):
    one, other = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(34))
    texts = [f"{one} {rest}", f"{other} {rest}"]
    out = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("dedup.n_words", "dedup.n_removed").collect()
    assert [tuple(r) for r in out] == [(35, 0), (35, 0)]
    words = Chunk(np.frombuffer(" ".join([*one, *other, one, other]).encode(), dtype=np.uint8), np.array([0, 4096 + 2050 - 1]), SPACED, False)
    grams = words.grams(1024)
    assert grams[0] != grams[1024] and words.hashes[-1] != words.hashes[-2]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 13, 35, 40])
def test_runs_are_equal_as_their_words_are(k):
    r = random.Random(k)
    text = b" ".join(r.choice([b"a", b"b"]) if i < 150 else b"a" for i in range(240))
    c = Chunk(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), SPACED, False)
    words, grams = c.words(0), c.grams(k)
    runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    assert len(grams) == len(runs) and len({*zip(runs, grams.tolist(), strict=True)}) == len(set(runs)) == len(set(grams.tolist()))


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(120_000)]
    texts = [" ".join(words), " ".join(words[50_000:90_000]), "x " * 60_000]
    out = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select("dedup.n_words", "dedup.n_removed").collect()
    assert [tuple(r) for r in out] == [(120_000, 40_000), (40_000, 40_000), (60_000, 60_000)]


def test_words_are_kept_without_a_list_a_word(spark, monkeypatch):
    r = random.Random(8)
    texts = [None, "", " \t", *["  ".join(r.choice(["a", "한", "zz"]) for _ in range(r.randrange(40))) + r.choice(["", "\n"]) for _ in range(60)]]
    found, want = [], []
    for t in texts:
        words, gone = (t or "").split(), set()
        _, at, n, _, d = substring_dedup._stretches(Chunk(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]), SPACED, False), 1, 5, 3)
        places = {}
        for i in range(len(at)):
            some = places.setdefault(int(d[i].view(np.int64)), [k for k in range(int(n[i])) if r.random() < 0.4])
            gone |= {int(at[i]) + k + j for k in some for j in range(5)}
        entries = [{"d": k, "recurs": v} for k, v in places.items()]
        spans = [{"start": i, "end": next(j for j in range(i, len(words) + 1) if j not in gone)} for i in sorted(gone) if i - 1 not in gone]
        found.append(entries or None)
        want.append({"n_words": len(words), "n_removed": len(gone), "removed": spans, "kept_text": " ".join(w for i, w in enumerate(words) if i not in gone)})
    monkeypatch.setattr(Chunk, "words", None)
    kind = pa.list_(pa.struct([("d", pa.int64()), ("recurs", pa.list_(pa.int32()))]))
    got = substring_dedup._kept(5, 3).func(pa.array(texts), pa.array(found, type=kind))
    assert got.to_pylist() == want and sum(x["n_removed"] for x in want) > 100
