"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``.  Sources, by code
point with null last, take the weights in turn and share the whole size by
weight; a source's target stops at ``max_repeat`` times its size and the excess
goes to the others by weight, until none is above.

Each document of a source is expected ``target / source size`` times.  Its
source's documents stand in order of size class, the expected copies are summed
up to each, one random offset a source is added, and the document is emitted
once for each integer boundary that the sum crosses at it.  Ordering by size
makes the words taken follow the target closely.

The prefix sum needs no task that holds a source: rows are counted by source,
size class and one of 4096 hash buckets; the counts give each bucket's first
position, and rows are numbered within their bucket only.

Defined cases: null text has size 0; null source is a source; a source of size
0 has target 0 and takes nothing; rows that repeat an id are documents of their
own; empty tables give empty results; result columns replace those of the same
name.  Draws come from md5 of seed and id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.llm._shared import free_name, md5_int
from lettergraph.shared import written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 17
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    """Words with the space after them shrink to one letter each; no word is copied, which counting matches would do."""
    left = F.ltrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.coalesce(F.length(F.regexp_replace(left, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(src, source_size, target) from rows with columns src and size: one row a source, so the windows are small."""
    totals = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.get(cycle, (F.row_number().over(everything.orderBy(F.col("src").asc_nulls_last())) - 1) % len(weights)))
    cap = F.col("source_size") * float(max_repeat)
    order = everything.orderBy(F.col("cap") / F.col("weight"), F.col("src").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("cap", cap).withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("turn", F.row_number().over(order))
    )
    # The level at the first source, by cap and weight, that stays below its cap holds for all.
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("turn", "level"))).over(everything)
    return filled.withColumn("level", F.coalesce(first["level"], F.lit(0.0))).select("src", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = WEIGHTS,
             max_repeat: int = MAX_REPEAT, seed: int = SEED, out: str = "mix") -> DataFrame:
    """``docs`` with struct ``out``: size, source_size, target and copies."""
    names = {k: free_name(docs, f"_{k}") for k in ("src", "none", "size", "band", "slot", "tie", "seat", "first", "r")}
    src, none, size, band, slot, tie, seat, first, ratio = (names[k] for k in names)
    digits = F.length(F.bin(F.col(size)))
    sized = (
        docs.withColumn(src, F.coalesce(F.col(source_col), F.lit(""))).withColumn(none, F.col(source_col).isNull()).withColumn(size, n_words(F.col(text_col)))
        .withColumn(band, (digits * 16 + F.floor(F.col(size) * 16 / F.pow(F.lit(2.0), digits))).cast("int"))
        .withColumn(slot, md5_int(F.lit(f"slot {seed}"), F.col(id_col), digits=BUCKET_DIGITS).cast("int"))
        .withColumn(tie, F.xxhash64(F.col(text_col)))
    )
    bare = sized.select(F.col(src).alias("s"), F.col(none).alias("z"), F.col(size).alias("size"), F.col(band).alias("b"), F.col(slot).alias("k"))
    # One pass over the texts gives a row a bucket; the sums by source and by size class come from these rows.
    counts = written(bare.groupBy("s", "z", "b", "k").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "buckets")
    shares = source_targets(counts.select(F.when(~F.col("z"), F.col("s")).alias("src"), "size"), weights, max_repeat).select(
        F.coalesce("src", F.lit("")).alias("s"), F.col("src").isNull().alias("z"), "source_size", "target"
    )
    bands = counts.groupBy("s", "z", "b").agg(F.sum("n").alias("n"))
    up_to = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("s", "z", "b", F.coalesce(F.sum("n").over(up_to("s", "z", by="b")), F.lit(0)).alias("band_first"))
    starts = counts.select("s", "z", "b", "k", F.coalesce(F.sum("n").over(up_to("s", "z", "b", by="k")), F.lit(0)).alias("slot_first"))
    starts = starts.join(bands, ["s", "z", "b"]).join(shares, ["s", "z"]).select(
        F.col("s").alias(src), F.col("z").alias(none), F.col("b").alias(band), F.col("k").alias(slot), (F.col("band_first") + F.col("slot_first")).alias(first),
        F.struct("source_size", "target").alias(ratio),
    )
    within = Window.partitionBy(src, none, band, slot).orderBy(F.col(size), F.col(id_col).asc_nulls_first(), F.col(tie))
    placed = sized.withColumn(seat, F.row_number().over(within)).join(starts, [src, none, band, slot])
    offset = md5_int(F.lit(f"offset {seed}"), F.when(~F.col(none), F.col(src))).cast("double") / float(16**13)
    each = F.when(F.col(f"{ratio}.source_size") > 0, F.col(f"{ratio}.target") / F.col(f"{ratio}.source_size")).otherwise(0.0)
    place = (F.col(first) + F.col(seat)).cast("double")
    copies = F.floor(place * each + offset) - F.floor((place - 1) * each + offset)
    return placed.withColumn(out, F.struct(
        F.col(size).alias("size"), F.col(f"{ratio}.source_size").alias("source_size"), F.col(f"{ratio}.target").alias("target"), copies.cast("bigint").alias("copies")
    )).drop(*names.values())


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixed documents: each row as often as it is drawn, columns unchanged."""
    out, copy = free_name(docs, "_mix"), free_name(docs, "_copy")
    plan = mix_plan(docs, id_col, source_col, text_col, out=out, **options).where(F.col(f"{out}.copies") > 0)
    return plan.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(f"{out}.copies")))).select(*docs.columns)
