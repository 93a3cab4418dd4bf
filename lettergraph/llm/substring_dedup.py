"""Substring dedup: suffix automata of reference shards, matching statistics, maximal spans.

A window is ``length`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document.  Each
word covered by a window whose word sequence starts at another place too, in any
document, is removed.

Every window is placed by its minimizer, the smallest fingerprint among its runs
of ``gram`` words, so equal windows always share one.  Neighbouring windows with
their minimizer at one place form a stretch.  Stretches whose minimizer occurs once are done.
Of the others, each different word sequence goes once, with its count, to the
reference shard of its minimizer.  A shard builds the suffix automaton of its
stretches, with occurrence counts, and streams the stretches through it: where
the match that ends at a word is at least ``length`` long and its state occurs
twice, a window recurs.  The automata are sent to the stretches that can match
them, not to all documents: the reference is the corpus itself, so broadcasting
every shard to every document would grow with its square.

A shard holds about ``shard_words`` words and groups of at most ``stretch_limit``
stretches.  A minimizer with more different stretches than that is split: its
stretches are cut anew by the two smallest fingerprints of each window, then by
the four smallest and so on, at last by the window's own, until every group
fits.  Equal windows agree in all of these, so they still meet in one shard, and
every verdict comes from an automaton over the words themselves.  Which stretches
are equal is told by minimizer and digest together, 128 bits of a hash without
short identities.

Defined cases: null and empty texts have no words; repeated rows are documents
of their own, so their windows recur; a text shorter than the window keeps all;
texts of any length are read whole; an empty table has no rows; the result column
replaces one of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettergraph.llm._shared import free_name
from lettergraph.llm._words import SPACED, Chunk, chunks, joined, lists
from lettergraph.shared import discard, written

LENGTH = 35
GRAM = 6
SHARD_WORDS = 20_000
STRETCH_LIMIT = 1_500


class SuffixAutomaton:
    """Suffix automaton of word sequences; ``count`` tells how often a state's words occur."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.count = [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        self.count.append(0)
        return len(self.len) - 1

    def add(self, words: list, times: int) -> None:
        """Add one sequence that occurs ``times`` times."""
        last, nxt, link, length = 0, self.next, self.link, self.len
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
            else:
                p, last = last, self._state(length[last] + 1, {}, 0)
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = last
                    p = link[p]
                if p != -1:
                    q = nxt[p][w]
                    link[last] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            self.count[last] += times

    def _split(self, p: int, w, q: int) -> int:
        nxt, link = self.next, self.link
        new = self._state(self.len[p] + 1, dict(nxt[q]), link[q])
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        link[q] = new
        return new

    def close(self) -> None:
        """Pass the counts on to the states of shorter suffixes."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeats(self, words: list, length: int) -> list[bool]:
        """For each window of ``words``: does it occur at least twice?  Matching statistics, cut off at ``length``."""
        state, matched, out = 0, 0, []
        nxt, link, size = self.next, self.link, self.len
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = size[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            while state and size[link[state]] >= length:
                state = link[state]
                matched = min(matched, size[state])
            if i >= length - 1:
                out.append(matched >= length and self.count[state] > 1)
        return out


def _stretches(c: Chunk, rows: int, length: int, gram: int):
    """Maximal runs of windows with one minimizer at one place: row, first word, number of windows, minimizer, digest of the words."""
    n, total = np.diff(c.first), len(c.hashes)
    if total < length:
        return [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64)] * 2
    grams, wide = c.grams(gram), length - gram + 1
    low, step = np.arange(len(grams)), 1  # where the smallest run of each window starts, the leftmost of equal ones, by doubling
    while step < wide:
        step = min(step * 2, wide)
        left, right = low[: len(grams) - step + 1], low[len(low) - (len(grams) - step + 1) :]
        low = np.where(grams[left] <= grams[right], left, right)
    count = total - length + 1
    doc = np.repeat(np.arange(rows), n)[:count]
    valid = np.arange(count) + length <= c.first[1:][doc]
    start = valid.copy()
    start[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    at, ends = np.flatnonzero(start), np.flatnonzero(valid & ~np.append(valid[1:] & ~start[1:], False))
    words = ends + length - at
    digest = words.astype(np.uint64)
    for step in range(0, int(words.max(initial=0)), gram):  # the runs one behind the other, at most twice ``length`` words
        some = np.flatnonzero(words - step >= gram)
        digest[some] = joined(digest[some], grams[at[some] + step])
    digest = joined(digest, grams[ends + length - gram])  # and the last one
    return doc[at], at, ends + 1 - at, grams[low[at]], digest


def _anchors(length: int, gram: int):
    @F.arrow_udf("array<struct<m:bigint,d:bigint>>")
    def run(text: pa.Array) -> pa.Array:
        ms, ds, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi, c in chunks(text):
            doc, _, _, m, d = _stretches(c, hi - lo, length, gram)
            ms.append(m.view(np.int64))
            ds.append(d.view(np.int64))
            sizes.append(np.bincount(doc, minlength=hi - lo))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(ms)), pa.array(np.concatenate(ds))], names=["m", "d"])
        return pa.ListArray.from_arrays(lists(np.zeros(len(flat), np.int8), np.concatenate(sizes)).offsets, flat)

    return run


def _carried(length: int, gram: int):
    """Words of the wanted stretches of a text, with what was asked along with them."""
    kind = pa.list_(pa.struct([("m", pa.int64()), ("d", pa.int64()), ("n", pa.int64()), ("crowded", pa.bool_()), ("words", pa.binary())]))

    @F.arrow_udf("array<struct<m:bigint,d:bigint,n:bigint,crowded:boolean,words:binary>>")
    def run(text: pa.Array, wanted: pa.Array) -> pa.Array:
        out, asked = [], wanted.to_pylist()
        for lo, hi, c in chunks(text):
            doc, at, n, m, d = _stretches(c, hi - lo, length, gram)
            bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
            for row in range(hi - lo):
                want, found = {w["d"]: w for w in asked[lo + row] or ()}, []
                if want:
                    words, base = c.words(row), int(c.first[row])
                    for i in range(bounds[row], bounds[row + 1]):
                        w = want.pop(int(d[i].view(np.int64)), None)
                        if w:
                            a = int(at[i]) - base
                            found.append({"m": int(m[i].view(np.int64)), "d": w["d"], "n": w["n"], "crowded": w["crowded"], "words": b" ".join(words[a : a + int(n[i]) + length - 1])})
                out.append(found)
        return pa.array(out, type=kind)

    return run


def _split(length: int, gram: int, depth: int | None):
    """Stretches cut into runs of windows whose ``depth`` smallest fingerprints agree; without a depth, into single windows."""
    kind = pa.schema([("m", pa.int64()), ("d", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("of_m", pa.int64()), ("of_d", pa.int64()), ("at", pa.int32())])

    def keys(raw: bytes) -> np.ndarray:
        c = Chunk(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), SPACED, False)
        if depth is None:
            return c.grams(length)
        low = np.sort(np.lib.stride_tricks.sliding_window_view(c.grams(gram), length - gram + 1), axis=1)[:, :depth]
        return reduce(joined, low.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m, d, n, raw in zip(*(batch.column(k).to_pylist() for k in ("m", "d", "n", "words")), strict=True):
                words, key = raw.split(b" "), keys(raw)
                edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
                for s, e in zip(edges, edges[1:], strict=False) if depth else ((i, i + 1) for i in range(len(key))):
                    own = b" ".join(words[s : e + length - 1])
                    digest = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)
                    out.append({"m": int(key[s].view(np.int64)), "d": digest, "n": n, "words": own, "of_m": m, "of_d": d, "at": s})
                if len(out) > 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return run


def _matched(length: int, shard_words: int):
    """Over stretches sorted by key: the places of those windows that recur."""
    kind = pa.schema([("m", pa.int64()), ("d", pa.int64()), ("recurs", pa.list_(pa.int32()))])

    def verdicts(shard: list) -> Iterator[dict]:
        sam = SuffixAutomaton()
        for _, _, times, words in shard:
            sam.add(words, times)
        sam.close()
        for m, d, _, words in shard:
            recurs = [i for i, twice in enumerate(sam.repeats(words, length)) if twice]
            if recurs:
                yield {"m": m, "d": d, "recurs": recurs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, current, out = [], 0, None, []
        for batch in batches:
            for m, d, n, raw in zip(*(batch.column(k).to_pylist() for k in ("m", "d", "n", "words")), strict=True):
                if m != current:
                    current = m
                    if held >= shard_words:
                        out.extend(verdicts(shard))
                        shard, held = [], 0
                shard.append((m, d, n, raw.split(b" ")))
                held += len(shard[-1][3])
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        out.extend(verdicts(shard))
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    return run


def _covered(c: Chunk, rows: int, owners: np.ndarray, digests: np.ndarray, recurs: pa.Array, length: int, gram: int) -> np.ndarray:
    """Which words lie under a window that recurs: text ``owners[i]`` holds a stretch ``digests[i]``, whose windows ``recurs[i]`` do."""
    gone = np.zeros(len(c.starts), dtype=bool)
    if not len(owners):
        return gone
    doc, at, _, _, d = _stretches(c, rows, length, gram)
    known, of = np.unique(digests, return_inverse=True)
    asked = owners * len(known) + of
    order = np.argsort(asked)
    near = np.minimum(np.searchsorted(known, d.view(np.int64)), len(known) - 1)
    place = np.minimum(np.searchsorted(asked[order], doc * len(known) + near), len(asked) - 1)
    hit = (known[near] == d.view(np.int64)) & (asked[order[place]] == doc * len(known) + near)
    entry, at = order[place[hit]], at[hit]
    sizes = np.asarray(pc.list_value_length(recurs)).astype(np.int64)
    begins, n = (np.cumsum(sizes) - sizes)[entry], sizes[entry]
    starts = np.repeat(at, n) + np.asarray(pc.list_flatten(recurs))[np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    marks = np.bincount(starts, minlength=len(gone) + 1) - np.bincount(starts + length, minlength=len(gone) + 1)
    return np.cumsum(marks)[:-1] > 0


def _results(c: Chunk, gone: np.ndarray) -> pa.StructArray:
    """Counts, spans of what is ``gone`` and the other words joined by one space, a row a text."""
    def a_text(x: np.ndarray) -> np.ndarray:  # sums over each text's words
        return np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[c.first])

    n = np.diff(c.first)
    doc = np.repeat(np.arange(len(n)), n)
    edge = np.append(np.ones(min(len(doc), 1), dtype=bool), doc[1:] != doc[:-1])  # a text's first word
    opens = gone & (edge | ~np.append(False, gone)[:-1])
    closes = gone & np.append((edge | ~gone)[1:], np.ones(min(len(doc), 1), dtype=bool))
    base = c.first[:-1][doc]
    span = pa.StructArray.from_arrays([pa.array(np.flatnonzero(opens) - base[opens]), pa.array(np.flatnonzero(closes) + 1 - base[closes])], names=["start", "end"])

    starts, ends, of = c.starts[~gone], c.ends[~gone], doc[~gone]
    gaps = ends[:-1][of[1:] == of[:-1]]  # the byte behind a word that another of its text follows
    step = np.zeros(len(c.buf) + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    stays = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    stays[gaps] = True
    letters = c.buf.copy()
    letters[gaps] = 0x20
    sizes = a_text(np.where(gone, 0, c.ends - c.starts + 1))
    bounds = np.zeros(len(n) + 1, dtype=np.int32)
    np.cumsum(np.maximum(sizes - 1, 0), out=bounds[1:])
    kept = pa.StringArray.from_buffers(len(n), pa.py_buffer(bounds), pa.py_buffer(letters[stays]))
    removed = pa.ListArray.from_arrays(lists(np.zeros(len(span), np.int8), a_text(opens)).offsets, span)
    return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(a_text(gone)), removed, kept], names=["n_words", "n_removed", "removed", "kept_text"])


def _kept(length: int, gram: int):
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,removed:array<struct<start:bigint,end:bigint>>,kept_text:string>")
    def run(text: pa.Array, found: pa.Array) -> pa.Array:
        owners, entries = np.asarray(pc.list_parent_indices(found)), pc.list_flatten(found)
        digests, recurs, out = np.asarray(pc.struct_field(entries, "d")), pc.struct_field(entries, "recurs"), []
        for lo, hi, c in chunks(text):
            a, b = np.searchsorted(owners, [lo, hi]).tolist()
            out.append(_results(c, _covered(c, hi - lo, owners[a:b] - lo, digests[a:b], recurs[a:b], length, gram)).cast(kind))
        return pa.concat_arrays(out) if out else pa.array([], type=kind)

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard_words: int = SHARD_WORDS,
                   stretch_limit: int = STRETCH_LIMIT, out: str = "dedup") -> DataFrame:
    """``docs`` with struct ``out``: n_words, n_removed, removed (word spans) and kept_text (kept words joined by one space)."""
    key, verdict = free_name(docs, "_text_key"), free_name(docs, "_verdict")
    text_key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))  # 128 bits, so no two texts share one
    keyed = docs.select(text_key.alias("k"), F.col(text_col).alias("t"))
    places = keyed.select("k", F.explode(_anchors(length, gram)("t")).alias("s")).select("k", "s.m", "s.d")
    often = places.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m")
    places = places.groupBy("m", "d", "k").agg(F.count("*").alias("n")).join(often, "m", "left_semi")
    places = written(places, "stretches")

    carriers = written(places.groupBy("m", "d").agg(F.sum("n").alias("n"), F.min("k").alias("k")), "carriers")
    crowded = carriers.groupBy("m").agg(F.count("*").alias("c")).where(F.col("c") > stretch_limit).select("m", F.lit(True).alias("crowded"))
    asked = carriers.join(crowded, "m", "left").groupBy("k").agg(F.collect_list(F.struct("d", "n", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("wanted"))
    # Copies of a text answer alike: one of each, found before the shuffle, is asked.
    texts = keyed.dropDuplicates(["k"]).join(asked, "k")
    found = written(texts.select(F.explode(_carried(length, gram)("t", "wanted")).alias("s")).select("s.*"), "found")
    calm, parts = _fitting(found, length, gram, stretch_limit)
    shards = calm.repartition("m").sortWithinPartitions("m", "d")
    verdicts = written(shards.mapInArrow(_matched(length, shard_words), "m bigint, d bigint, recurs array<int>"), "verdicts")
    discard(carriers, found)
    if parts is not None:  # from the pieces back to the stretches they were cut from
        back = parts.join(verdicts, ["m", "d"]).select(F.col("root_m").alias("m"), F.col("root_d").alias("d"), F.transform("recurs", lambda i: i + F.col("at")).alias("recurs"))
        back = back.groupBy("m", "d").agg(F.array_distinct(F.flatten(F.collect_list("recurs"))).alias("recurs"))
        verdicts = verdicts.union(back)
    per_text = places.select("m", "d", "k").join(verdicts, ["m", "d"]).groupBy(F.col("k").alias(key)).agg(F.collect_list(F.struct("d", "recurs")).alias(verdict))

    marked = docs.withColumn(key, text_key)
    return marked.join(per_text, key, "left").withColumn(out, _kept(length, gram)(F.col(text_col), F.col(verdict))).drop(key, verdict)


def _fitting(found: DataFrame, length: int, gram: int, stretch_limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(stretches of groups that fit a shard, where the cut ones lie in the stretches they come from: m, d, root_m, root_d, at)."""
    calm, hot = found.where("NOT crowded").select("m", "d", "n", "words"), found.where("crowded").select("m", "d", "n", "words")
    all_parts, lie, depth = [], None, 2
    while not hot.isEmpty():
        last = depth >= length - gram + 1
        cut = written(hot.mapInArrow(_split(length, gram, None if last else depth), "m bigint, d bigint, n bigint, words binary, of_m bigint, of_d bigint, at int"), "cut")
        places = cut.select("m", "d", "of_m", "of_d", "at")
        if lie is None:
            lie = places.withColumnsRenamed({"of_m": "root_m", "of_d": "root_d"})
        else:
            upper = lie.select(F.col("m").alias("of_m"), F.col("d").alias("of_d"), "root_m", "root_d", F.col("at").alias("from"))
            lie = places.join(upper, ["of_m", "of_d"]).select("m", "d", "root_m", "root_d", (F.col("at") + F.col("from")).alias("at"))
        lie = written(lie, "parts")
        pieces = written(cut.groupBy("m", "d").agg(F.sum("n").alias("n"), F.first("words").alias("words")), "pieces")
        discard(cut)
        crowded = pieces.groupBy("m").agg(F.count("*").alias("c")).where((F.col("c") > stretch_limit) & F.lit(not last)).select("m")
        fits = pieces.join(crowded, "m", "left_anti")
        calm, hot = calm.union(fits), pieces.join(crowded, "m", "left_semi")
        all_parts.append(lie.join(crowded, "m", "left_anti"))
        depth *= 2
    return calm, reduce(DataFrame.union, all_parts) if all_parts else None
