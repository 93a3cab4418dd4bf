"""Periodic run detection: a harmonic grid of longest common extensions.

A run is a stretch of consecutive words with smallest period q, at least
``max(least, 2 * q)`` words long, that no neighbouring word extends keeping q.

For each period p the grid points 0, p, 2p, ... of a text are taken in pairs: any
stretch of 2p words holds two neighbouring ones, jp and (j+1)p.  How far the words
from both on agree (forward) and how far the words before both agree (backward)
gives the whole stretch of period p around them.  Both lengths come from a suffix
array of the text, one of its reverse, and range minima over the common prefixes
of neighbours.  A stretch found for several periods has the smallest of them.

Over all periods that is n ln n pairs a text of n words, made in blocks of bounded
size.  A run makes words p apart agree at some number of neighbouring places, the
grid point among them; pairs where not even three words on one side agree lie in no
run, and texts all of whose pairs are of that kind need no suffix array.  Both
steps are exact.

Texts are taken in chunks of about one megabyte, their words numbered by a
dictionary of the chunk, so nothing travels between tasks.

Defined cases: null and empty texts have no words and no runs; repeated rows are
judged alike; a text of one word over and over is one run of period 1; texts of any
length are read whole, one in one task with some 30 words of memory for a word; an
empty table has no rows; the result column replaces one of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettergraph.llm._words import Chunk, chunks

LEAST = 12
BLOCK = 1 << 20  # grid pairs looked at together
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_REPORT = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_REPORT_TYPE = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


class Extensions:
    """How far the suffixes of a word sequence agree: suffix array by doubling, common prefixes of neighbours, range minima."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        rank, size = np.unique(words, return_inverse=True)[1], 1
        levels = [rank.astype(np.int32)]  # rank of each run of 1, 2, 4, ... words
        while size < n and rank.max(initial=0) < n - 1:
            after = np.zeros(n, dtype=np.int64)
            after[:-size] = rank[size:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            levels.append(rank.astype(np.int32))
            size *= 2
        self.n, self.rank = n, rank
        order = np.empty(n, dtype=np.int64)
        order[rank] = np.arange(n)
        # Common prefix of each suffix with its neighbour, longest blocks first; a block cut off by the text's end equals no other.
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(n - 1, 0), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero(np.maximum(a, b) < n)
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            for place in (common, a, b):
                place[same] += 1 << k
        self.minima = [common.astype(np.int32)]
        while 1 << len(self.minima) < n:
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            if len(last) <= half:
                break
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that agree from i and from j on; i and j differ and lie inside."""
        x, y = self.rank[i], self.rank[j]
        low, span = np.minimum(x, y), np.abs(x - y)
        level = np.frexp(span)[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for k in np.unique(level):
            here = np.flatnonzero(level == k)
            table = self.minima[k]
            out[here] = np.minimum(table[low[here]], table[low[here] + span[here] - (1 << int(k))])
        return out


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text, period, point): pairs point, point + period inside texts of ``sizes`` words."""
    text = np.repeat(np.arange(len(sizes)), sizes // 2)
    period = np.arange(len(text)) - np.repeat(np.cumsum(sizes // 2) - sizes // 2, sizes // 2) + 1
    pairs = (sizes[text] - 1) // period
    done = np.cumsum(pairs)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] - pairs[lo] + BLOCK, side="right")))
        n, first = pairs[lo:hi], done[lo] - pairs[lo]
        step = np.arange(done[hi - 1] - first) - np.repeat(done[lo:hi] - n - first, n)
        p = np.repeat(period[lo:hi], n)
        yield np.repeat(text[lo:hi], n), p, step * p
        lo = hi


def _candidates(words: np.ndarray, first: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of those pairs (text, period, place) that a run can hold: the two words agree, and so do the next few on one side."""
    reach = min(3, (least + 1) // 4)  # a run makes (least + 1) // 2 places in a row agree
    for text, p, point in _grid(np.diff(first)):
        i = first[text] + point
        same = np.flatnonzero(words[i] == words[i + p])
        text, p, i = text[same], p[same], i[same]
        ahead, behind = np.ones(len(i), dtype=bool), np.ones(len(i), dtype=bool)
        for k in range(1, reach + 1):
            on = i + p + k < first[text + 1]
            ahead &= on & (words[i + np.where(on, k, 0)] == words[i + np.where(on, p + k, 0)])
            on = i - k >= first[text]
            behind &= on & (words[i - np.where(on, k, 0)] == words[i + np.where(on, p - k, 0)])
        near = np.flatnonzero(ahead | behind)
        yield text[near], p[near], i[near] - first[text[near]]


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, period) of the runs of each text that has some, by start and end; word numbers of text d lie from first[d] to first[d + 1]."""
    out: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    held, ahead, behind = -1, None, None
    for text, period, place in _candidates(words, first, least):
        edges = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            d, p, i = int(text[lo]), period[lo:hi], place[lo:hi]
            own = words[first[d] : first[d + 1]]
            if d != held:
                held, ahead, behind = d, Extensions(own), Extensions(own[::-1])
            n = len(own)
            right, left = ahead.at(i, i + p), np.zeros(len(i), dtype=np.int64)
            inner = np.flatnonzero(i > 0)
            left[inner] = behind.at(n - i[inner], n - i[inner] - p[inner])
            start, end = i - left, i + p + right
            long = np.flatnonzero(end - start >= np.maximum(least, 2 * p))
            if len(long):
                found = start[long], end[long], p[long]
                out[d] = _smallest(*(np.concatenate(x) for x in zip(out[d], found, strict=True)) if d in out else found)
    return out


def _report(c: Chunk, texts: int, least: int) -> list[dict]:
    out = []
    found = runs_of(c.ids[0], c.first, least)
    for d in range(texts):
        words, runs = c.words(d), found.get(d)
        kept, spans = words, []
        if runs:
            start, end, period = runs
            marks = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(marks, start + period, 1)
            np.subtract.at(marks, end, 1)
            kept = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]
            spans = [{"start": s, "length": e - s, "period": p} for s, e, p in zip(start.tolist(), end.tolist(), period.tolist(), strict=True)]
            spans.sort(key=lambda r: (r["start"], r["period"]))
        out.append({"n_words": len(words), "runs": spans, "collapsed": b" ".join(kept).decode()})
    return out


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, out: str = "periodic") -> DataFrame:
    """``docs`` with struct ``out``: n_words, runs (start, length, period by start, then period) and collapsed.

    ``collapsed`` has each run cut down to its first period: a word goes if any run holds it after that run's first period.
    """

    @F.arrow_udf(_REPORT_TYPE)
    def run(text: pa.Array) -> pa.Array:
        return pa.array([r for lo, hi, c in chunks(text) for r in _report(c, hi - lo, least)], type=_REPORT)

    return docs.withColumn(out, run(F.col(text_col)))
