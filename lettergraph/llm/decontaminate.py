"""Benchmark decontamination: hash set of test n-grams, verified on hits.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
A window is 13 consecutive words of a benchmark item; an item of 1 to 12 words
is one window.  While there are at most ``broadcast_windows`` pairs of a window and
an item that holds it (some 150 bytes each), they are broadcast as sorted
fingerprints; a larger benchmark is joined to the documents' windows by fingerprint
instead, with the same results: windows travel under a number, and items are joined
to the numbers that were hit, so a window of very many items is no long list.  Each
hit is confirmed on the words themselves.

Defined cases: a null or empty text has no words, no hits and is clean; a
null item id reads as the text ``null``; repeated rows are judged alike; an empty
benchmark hits nothing; the result column replaces one of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettergraph.llm._shared import free_name
from lettergraph.llm._words import ALNUM, chunks
from lettergraph.shared import written

WINDOW = 13
BROADCAST_WINDOWS = 200_000
_WINDOW_TYPE = "array<struct<size:int,hash:bigint,words:string,item:string>>"
_REPORT = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()),
    ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])
_REPORT_TYPE = "struct<n_words:bigint,n_hit:bigint,hits:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def benchmark_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct pairs of a window and an item that holds it: size, hash, words, item."""
    kind = pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("words", pa.string()), ("item", pa.string())]))

    @F.arrow_udf(_WINDOW_TYPE)
    def windows(item: pa.Array, text: pa.Array) -> pa.Array:
        out, names = [], item.to_pylist()
        for lo, hi, c in chunks(text, ALNUM, lower=True):
            grams = {size: c.grams(size).view(np.int64) for size in range(1, window + 1)}
            for d in range(hi - lo):
                words, at = c.words(d), int(c.first[d])
                size = min(window, len(words))
                out.append([
                    {"size": size, "hash": int(grams[size][at + i]), "words": b" ".join(words[i : i + size]).decode(errors="replace"), "item": names[lo + d]}
                    for i in range(len(words) - size + 1) if size
                ])
        return pa.array(out, type=kind)

    name = F.coalesce(F.col(item_col).cast("string"), F.lit("null"))
    return bench.select(F.explode(windows(name, F.col(text_col))).alias("w")).select("w.*").distinct()


class _Table:
    """Windows looked up by fingerprint: a bitmap first, then a sorted list, then the words."""

    def __init__(self, rows: list[tuple[int, int, str, list[str]]]):
        self.texts: dict[tuple[int, int], list[tuple[bytes, list[str]]]] = {}
        for size, h, words, items in rows:
            self.texts.setdefault((size, h), []).append((words.encode(), items))
        self.by_size = {}
        for size in sorted({r[0] for r in rows}):
            hashes = np.unique(np.array([r[1] for r in rows if r[0] == size], dtype=np.int64).view(np.uint64))
            shift = np.uint64(64 - min(22, len(hashes).bit_length() + 5))  # some 32 places a window: a row's own few take no more room than they need
            bits = np.zeros(1 << (64 - int(shift)), dtype=bool)
            bits[(hashes >> shift).astype(np.int64)] = True
            self.by_size[size] = (hashes, bits, shift)

    def candidates(self, grams: np.ndarray, size: int) -> np.ndarray:
        hashes, bits, shift = self.by_size[size]
        at = np.flatnonzero(bits[(grams >> shift).astype(np.int64)])
        spot = np.minimum(np.searchsorted(hashes, grams[at]), len(hashes) - 1)
        return at[hashes[spot] == grams[at]]


def _judge(words: list[bytes], spots: list[tuple[int, int, int]], texts: dict) -> tuple[list[dict], list[str], int]:
    """Confirm (start, size, hash) spots on the words; spans hit, items seen and words hit."""
    marks, items = np.zeros(len(words) + 1, dtype=np.int64), set()
    for at, size, h in spots:
        here = b" ".join(words[at : at + size])
        for window, names in texts.get((size, h), ()):
            if window == here:
                marks[at] += 1
                marks[at + size] -= 1
                items.update(names)
    hit = np.cumsum(marks[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)], sorted(items), int(hit.sum())


def _scan(text: pa.Array, table_of, name: pa.DataType = pa.string()) -> pa.Array:
    """table_of(row) gives the windows for a row, with what names them; rows that share one are looked up chunk by chunk."""
    out = []
    for lo, hi, c in chunks(text, ALNUM, lower=True):
        shared = table_of(None)
        spots: dict[int, list[tuple[int, int, int]]] = {}
        for d_lo, d_hi, table in [(0, hi - lo, shared)] if shared else [(d, d + 1, table_of(lo + d)) for d in range(hi - lo)]:
            for size in table.by_size if table else ():
                at0, at1 = int(c.first[d_lo]), int(c.first[d_hi])
                grams = c.grams(size)[at0:at1]
                if not len(grams):
                    continue
                at = table.candidates(grams, size) + at0
                docs = np.searchsorted(c.first, at, side="right") - 1
                for p, d in zip(at.tolist(), docs.tolist(), strict=True):
                    if p + size <= c.first[d + 1]:
                        spots.setdefault(d, []).append((p - int(c.first[d]), size, int(grams[p - at0].view(np.int64))))
        for d in range(hi - lo):
            spans, items, n_hit = [], [], 0
            if d in spots:
                spans, items, n_hit = _judge(c.words(d), spots[d], (shared or table_of(lo + d)).texts)
            out.append({"n_words": int(c.first[d + 1] - c.first[d]), "n_hit": n_hit, "hits": spans, "items": items})
    return pa.array(out, type=pa.struct([*list(_REPORT)[:3], pa.field("items", pa.list_(name))]))


def _joined(docs: DataFrame, pairs: DataFrame, text_col: str, out: str) -> DataFrame:
    """For a benchmark too large to broadcast: windows meet by fingerprint in a shuffle, items the windows that were hit."""
    key, found, items = (free_name(docs, k) for k in ("_text_key", "_windows", "_items"))
    pairs = written(pairs, "pairs")
    windows = written(pairs.groupBy("size", "hash", "words").agg(F.count("*").alias("n")).select("size", "hash", "words", F.monotonically_increasing_id().alias("w")), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # 1 to WINDOW
    kind = pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64())]))

    @F.arrow_udf("array<struct<size:int,hash:bigint>>")
    def fingerprints(text: pa.Array) -> pa.Array:
        rows = []
        for lo, hi, c in chunks(text, ALNUM, lower=True):
            grams = {s: c.grams(s).view(np.int64) for s in sizes}
            for d in range(hi - lo):
                a, b = int(c.first[d]), int(c.first[d + 1])
                rows.append([{"size": s, "hash": h} for s in sizes for h in np.unique(grams[s][a : max(a, b - s + 1)]).tolist()])
        return pa.array(rows, type=kind)

    @F.arrow_udf(_REPORT_TYPE.replace("items:array<string>", "items:array<bigint>"))
    def judge(text: pa.Array, found: pa.Array) -> pa.Array:
        tables = [_Table([(w["size"], w["hash"], w["words"], [w["w"]]) for w in ws]) if ws else None for ws in found.to_pylist()]
        return _scan(text, lambda row: None if row is None else tables[row], pa.int64())

    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    met = (
        keyed.select(key, F.explode(fingerprints(text_col)).alias("w")).select(key, "w.size", "w.hash").distinct()
        .join(windows, ["size", "hash"])
        .groupBy(key).agg(F.collect_list(F.struct("size", "hash", "words", "w")).alias(found))
    )
    met = written(met, "met")
    hit = keyed.select(key, text_col).dropDuplicates([key]).join(met, key).select(key, F.explode(judge(F.col(text_col), F.col(found))["items"]).alias("w"))
    named = hit.join(windows, "w").join(pairs, ["size", "hash", "words"]).groupBy(key).agg(F.sort_array(F.collect_set("item")).alias(items))
    judged = keyed.join(met, key, "left").join(named, key, "left").withColumn(out, judge(F.col(text_col), F.col(found)))
    none = F.array().cast("array<string>")
    return judged.withColumn(out, F.struct(*[F.col(f"{out}.{k}") for k in ("n_words", "n_hit", "hits")], F.coalesce(F.col(items), none).alias("items"))).drop(key, found, items)


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text",
                  out: str = "decon", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with column ``out``: struct of n_words, n_hit, hits (word spans) and items."""
    spark = docs.sparkSession
    pairs = benchmark_windows(bench, item_col, bench_text_col, window)
    items: dict[tuple, list[str]] = {}
    rows = pairs.limit(broadcast_windows + 1).collect()
    if len(rows) > broadcast_windows:
        return _joined(docs, pairs, text_col, out)
    for r in rows:
        items.setdefault((r.size, r.hash, r.words), []).append(r.item)
    sent = spark.sparkContext.broadcast([(*window, names) for window, names in items.items()])
    held: list[_Table] = []

    @F.arrow_udf(_REPORT_TYPE)
    def scan(text: pa.Array) -> pa.Array:
        if not held:
            held.append(_Table(sent.value))
        return _scan(text, lambda row: held[0])

    return docs.withColumn(out, scan(text_col))


def contaminated(report: str = "decon", share: int = 20) -> Column:
    """At least one word in ``share`` lies in a benchmark window."""
    n, hit = F.col(f"{report}.n_words"), F.col(f"{report}.n_hit")
    return (hit > 0) & (hit * share >= n)


def clean_documents(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Documents that are not contaminated, unchanged."""
    out = free_name(docs, "decon")
    return decontaminate(docs, bench, text_col, out=out, **options).where(~contaminated(out)).drop(out)


def without_spans(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Documents with the hit spans cut out of their text, from the first letter of a span to its last."""
    out = free_name(docs, "decon")

    @F.arrow_udf("string")
    def cut(text: pa.Array, report: pa.Array) -> pa.Array:
        rows, reports, values = [], report.to_pylist(), text.to_pylist()
        for lo, hi, c in chunks(text, ALNUM, lower=True):
            for d in range(hi - lo):
                spans = (reports[lo + d] or {}).get("hits") or []
                if not spans:
                    rows.append(values[lo + d])
                    continue
                whole, base, first = (values[lo + d] or "").encode(), int(c.offsets[d]), int(c.first[d])
                pieces, at = [], 0
                for s in spans:
                    pieces.append(whole[at : int(c.starts[first + s["start"]]) - base])
                    at = int(c.ends[first + s["end"] - 1]) - base
                rows.append(b"".join([*pieces, whole[at:]]).decode(errors="replace"))
        return pa.array(rows, type=pa.string())

    marked = decontaminate(docs, bench, text_col, out=out, **options)
    return marked.withColumn(text_col, F.when(F.col(f"{out}.n_hit") > 0, cut(F.col(text_col), F.col(out))).otherwise(F.col(text_col))).drop(out)
