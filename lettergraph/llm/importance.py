"""Target-distribution importance resampling over hashed word n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; the
features of a text are all its runs of 1 to ``longest`` words, joined by one space,
repeats counted.  A feature's bucket is the CRC-32 of its bytes modulo ``buckets``.
The gain of a bucket is 1000 times the logarithm of its smoothed share among the
target's features over its share among the documents', rounded down; a document's
weight is the mean gain of its features, rounded down.  Gumbel noise drawn from the
id makes the highest scores a sample without replacement in proportion to exp(weight).

Features are counted through an integer dictionary: a chunk's different words get
numbers, an n-gram is a tuple of numbers packed into one, and only different tuples
are spelt out and hashed, each once, starting from the checksum of the tuple one word
shorter; their counts and places are joined back to the buckets by number.  The
dictionary is a chunk's own (about one megabyte of text), since a dictionary of the
whole corpus would grow with it, and so nothing but bucket counts leaves a task.
The two tables of ``buckets`` counts are all that the driver sees.

Ranks come from a range partitioning by score: rows are sorted inside each part and
numbered from where the part begins, so no task holds all rows or all of one score.

Defined cases: null and empty texts have no words, no features and weight 0; repeated
rows count as often as they occur and, with the same id, draw the same noise, so they
stand side by side in the ranking; a null id draws as the text ``null`` and comes first
among ties; an empty target or an empty table gives gains from the smoothing alone; texts
of any length are read whole; the result column replaces one of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.llm._shared import free_name
from lettergraph.llm._words import ALNUM, Chunk, chunks
from lettergraph.shared import written

LONGEST = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
_FACTS = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def _features(c: Chunk, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: first words, number of the different run at each, bucket by such number."""
    words, spelt = c.ids
    ends = np.repeat(c.first[1:], np.diff(c.first))
    letters = spelt.to_pylist()
    at, number = np.arange(len(words)), words.astype(np.int64)
    sums = [crc32(w) for w in letters]
    joint = [b" " + w for w in letters]
    for size in range(1, longest + 1):
        if size > 1:
            inside = np.flatnonzero(at + size <= ends[at])
            at = at[inside]
            tuples, number = np.unique(number[inside] * max(len(letters), 1) + words[at + size - 1], return_inverse=True)
            sums = [crc32(joint[last], sums[before]) for before, last in zip(*(x.tolist() for x in divmod(tuples, max(len(letters), 1))), strict=True)]
        yield at, number, np.array(sums, dtype=np.int64) % buckets


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of all rows: each task adds up its own, so at most ``buckets`` rows a task are shuffled."""
    kind = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, c in chunks(batch.column(0), ALNUM, lower=True):
                for _, number, bucket in _features(c, longest, buckets):
                    np.add.at(total, bucket, np.bincount(number, minlength=len(bucket)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=kind)

    return docs.select(text_col).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket; ``buckets`` rows of each table reach the driver."""
    ours, theirs = ({r.bucket: r.n for r in bucket_counts(t, c, longest, buckets).collect()} for t, c in ((docs, text_col), (target, target_text_col)))
    all_ours, all_theirs = float(sum(ours.values()) + buckets), float(sum(theirs.values()) + buckets)
    return [math.floor(1000 * math.log(float(theirs.get(b, 0) + 1) * all_ours / (float(ours.get(b, 0) + 1) * all_theirs))) for b in range(buckets)]


def _facts(gains: list[int], longest: int):
    table = np.array(gains, dtype=np.int64)

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def run(text: pa.Array) -> pa.Array:
        parts: list[tuple] = [(np.zeros(0, dtype=np.int64),) * 3]
        for _, _, c in chunks(text, ALNUM, lower=True):
            n, gain = np.zeros((2, len(c.first)), dtype=np.int64)
            for at, number, bucket in _features(c, longest, len(table)):
                sums = np.concatenate([[0], np.cumsum(table[bucket][number])])
                edges = np.searchsorted(at, c.first)
                n[:-1] += np.diff(edges)
                gain[:-1] += np.diff(sums[edges])
            parts.append((np.diff(c.first), n[:-1], gain[:-1] // np.maximum(n[:-1], 1)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)], fields=list(_FACTS))

    return run


def noise(name: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths, from 32 bits of a SHA-256."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296)))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
               seed: int = SEED, out: str = "importance") -> DataFrame:
    """``docs`` with struct ``out``: n_words, n_features, weight and score.  Two passes over the texts, no shuffle of rows."""
    gains = bucket_gains(docs, target, text_col, target_text_col, longest, buckets)
    facts = free_name(docs, "_facts")
    told = docs.withColumn(facts, _facts(gains, longest)(F.col(text_col)))
    each = [F.col(f"{facts}.{k}").alias(k) for k in ("n_words", "n_features", "weight")]
    return told.withColumn(out, F.struct(*each, (F.col(f"{facts}.weight") + noise(F.col(id_col), seed)).alias("score"))).drop(facts)


def draw(scored: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, report: str = "importance", rank: str = "rank") -> DataFrame:
    """``scored`` with column ``rank``: 1, 2, 3, ... for the drawn rows, null for the others.

    Of the N rows of ``least_words`` words or more the floor(percent * N / 100) best scores are drawn, ties to smaller ids.
    Scores are whole numbers from a bounded range, some ten thousands of them, so their counts fit one task.
    """
    spark = scored.sparkSession
    key, place, part = (free_name(scored, k) for k in ("_score", "_place", "_part"))
    if rank in scored.columns:
        scored = scored.drop(rank)
    rows = written(scored, "scored")
    named = rows.withColumn(key, F.when(F.col(f"{report}.n_words") >= least_words, F.col(f"{report}.score")))
    counts = named.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    wanted = counts.agg(F.floor(F.sum("n") * percent / 100).alias("k")).first().k or 0
    above = Window.orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, -1)
    lowest = counts.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))).where(F.col("before") < wanted).agg(F.min(key).alias("low")).first().low
    chosen = F.coalesce(F.col(key) >= F.lit(lowest), F.lit(False)) if lowest is not None else F.lit(False)

    order = [F.col(key).desc(), F.col(id_col).asc_nulls_first(), F.col(f"{report}.n_features"), F.col(place)]  # the last deals out equal rows
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.where(chosen).withColumn(place, F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = written(dealt.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33)), "ranked")
    begins = at.groupBy(part).agg(F.count("*").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    nth = F.col("begin") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = at.join(F.broadcast(begins), part)  # one row a part
    ranked = ranked.select(*[F.col(c) for c in scored.columns], F.when(nth <= wanted, nth).alias(rank))
    return ranked.unionByName(named.where(~chosen).select(*[F.col(c) for c in scored.columns]).withColumn(rank, F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The drawn documents, with their columns alone."""
    report, rank = free_name(docs, "importance"), free_name(docs, "rank")
    scored = importance(docs, target, id_col, out=report, **options)
    return draw(scored, id_col, percent, least_words, report, rank).where(F.col(rank).isNotNull()).drop(report, rank)
