"""Vectorised word tables over Arrow string columns.

Texts are handled as UTF-8 bytes in chunks of about one megabyte.  A byte class
table finds the words.  A word is hashed eight bytes at a time, a long one by XXH3,
and a run of words by pairs of shorter runs; each step is a nonlinear mix, so no
identity of sums or powers makes two different ones equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20
_LEFT, _RIGHT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_U = np.uint64


def _byte_class(separators: list[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[separators] = False
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = _byte_class([0x20, *range(0x09, 0x0E)])
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = _byte_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit over the whole word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Fingerprint of what ``left`` stands for followed by what ``right`` stands for."""
    return mix(left * _U(_LEFT) + mix(right + _U(_RIGHT)))


_STEP = 8
_LONG = 64  # bytes of a word from which on it is hashed by itself


def _word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One fingerprint a word: its length, then eight bytes after eight, zeros behind the last."""
    padded = np.concatenate([buf, np.zeros(_STEP, dtype=np.uint8)])
    eight = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = mix(size.astype(np.uint64))
    rest = np.flatnonzero(size <= _LONG)
    for at in range(0, _LONG, _STEP):
        rest = rest[size[rest] > at]
        if not len(rest):
            break
        left = np.minimum(size[rest] - at, _STEP)
        out[rest] = joined(out[rest], eight[starts[rest] + at] & (_U(0xFFFFFFFFFFFFFFFF) >> ((_STEP - left) * 8).astype(np.uint64)))
    long = np.flatnonzero(size > _LONG)
    if len(long):
        raw = buf.tobytes()
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


class Chunk:
    """The words of a few consecutive texts.

    ``starts``/``ends`` are byte positions in ``buf``; words of text ``d`` are
    ``first[d]`` to ``first[d + 1]``; ``hashes`` has one fingerprint a word.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool):
        self.buf = LOWER[buf] if lower else buf
        n = len(buf)
        inside = word_bytes[self.buf]
        edge = offsets[offsets < n]
        before = np.empty(n, dtype=bool)
        before[1:] = inside[:-1]
        before[edge] = False
        after = np.empty(n, dtype=bool)
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        if n:
            before[0] = after[-1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.offsets = offsets
        self._ids: tuple[np.ndarray, pa.Array] | None = None
        self._hashes: np.ndarray | None = None

    @property
    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words, and the words by number."""
        if self._ids is None:
            sizes = self.ends - self.starts
            bounds = np.zeros(len(sizes) + 1, dtype=np.int32)
            np.cumsum(sizes, out=bounds[1:])
            letters = self.buf[np.repeat(self.starts - bounds[:-1], sizes) + np.arange(bounds[-1])] if len(sizes) else self.buf[:0]
            coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
            self._ids = np.asarray(coded.indices), coded.dictionary
        return self._ids

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = _word_hashes(self.buf, self.starts, self.ends)
        return self._hashes

    def grams(self, k: int) -> np.ndarray:
        """Fingerprint of the ``k`` words from each word on; runs past a text's end mean nothing."""
        block, done = self.hashes, 0  # block: of runs of a power of two
        whole: np.ndarray | None = None
        size = 1
        while size <= k and len(self.hashes) >= k:
            if k & size:
                whole = block if whole is None else joined(whole[: len(self.hashes) - done - size + 1], block[done:])
                done += size
            if size * 2 <= k:
                block = joined(block[:-size], block[size:])
            size *= 2
        return whole if whole is not None else np.zeros(0, dtype=np.uint64)

    def words(self, d: int) -> list[bytes]:
        """Words of text ``d``."""
        raw = self.buf.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        lo, hi = self.first[d], self.first[d + 1]
        return [raw[s:e] for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True)]


def chunks(texts: pa.Array, word_bytes: np.ndarray = SPACED, lower: bool = False) -> Iterator[tuple[int, int, Chunk]]:
    """Cut a string column into chunks: (first row, row after the last, words). Null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Chunk(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], word_bytes, lower)
        lo = hi


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    bounds = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, type=kind))
