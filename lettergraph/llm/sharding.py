"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards with weights; a subtree weighs what its
shards weigh.  A document descends level by level: each child draws
``-ln(u) / weight`` with u hashed from the document's key and the child's path,
and the smallest draw wins.  A child is chosen in proportion to its weight, and
when a weight changes, only the draws of the subtrees above it change, so rows
move into or out of those alone.  A shard that opens a region of its own changes
no other subtree's weight: rows move into it only.

Slots number a shard's rows from 0 without gaps: rows are counted by shard and
hash bucket, the counts give each bucket's first slot, and rows are numbered
within their bucket, so no task holds a shard.

Beyond ``base`` shards the tree of ``even_tree`` is flat: each further shard is a
region of its own.  ``text_col`` only orders rows that repeat a key; any column
that tells them apart will do, so callers need not move texts.

Defined cases: the key alone decides, rows that repeat it share a shard and get
slots of their own; a null key is a key; null, empty and very long texts are
placed like others; empty tables give empty results; result columns replace
those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.llm._shared import free_name, md5_int

SEED = 23
BUCKET_DIGITS = 3

#: A tree: {region: {rack: {shard: weight}}}.
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int, base: int = 16, regions: int = 2, racks: int = 2) -> Tree:
    """``base`` shards over regions and racks, and each further shard in a region of its own."""
    tree: Tree = {}
    for s in range(min(base, shards)):
        region, rack = s * regions // base, s * regions * racks // base % racks
        tree.setdefault(f"g{region}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    for s in range(base, shards):
        tree[f"g{regions + s - base}"] = {"k0": {s: 1.0}}
    return tree


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _descend(key: Column, node, path: str, seed: int) -> Column:
    """The shard below ``node`` that wins the draws for ``key``."""
    if not isinstance(node, dict):
        return F.lit(int(path.rpartition("/")[2]))
    children = [(name, child) for name, child in node.items() if _weight(child) > 0]
    if len(children) == 1:
        name, child = children[0]
        return _descend(key, child, f"{path}/{name}", seed)
    draws = [
        F.struct((-F.log((md5_int(F.lit(f"{seed}{path}/{name}"), key).cast("double") + 0.5) / float(16**13)) / _weight(child)).alias("draw"), F.lit(i).alias("child"))
        for i, (name, child) in enumerate(children)
    ]
    won = F.array_min(F.array(*draws))["child"]
    if all(not isinstance(child, dict) for _, child in children):
        return F.get(F.array(*[F.lit(int(name)) for name, _ in children]), won)
    chosen = None
    for i, (name, child) in enumerate(children):
        below = _descend(key, child, f"{path}/{name}", seed)
        chosen = F.when(won == i, below) if chosen is None else chosen.when(won == i, below)
    return chosen


def shard_of(key: Column, tree: Tree, seed: int = SEED) -> Column:
    """The shard for a key."""
    return _descend(key, tree, "", seed).cast("int")


def with_shards(docs: DataFrame, tree: Tree, key_col: str = "doc_id", text_col: str = "text", seed: int = SEED, out: str = "shard", slot: str = "slot") -> DataFrame:
    """``docs`` with shard and slot."""
    bucket, tie, first = free_name(docs, "_bucket"), free_name(docs, "_tie"), free_name(docs, "_first")
    keyed = (
        docs.withColumn(out, shard_of(F.col(key_col), tree, seed)).withColumn(bucket, md5_int(F.lit(f"slot {seed}"), F.col(key_col), digits=BUCKET_DIGITS).cast("int"))
        .withColumn(tie, F.xxhash64(F.col(text_col)))
    )
    counts = keyed.groupBy(out, bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy(out).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(out, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(out, bucket).orderBy(F.col(key_col).asc_nulls_first(), F.col(tie))
    placed = keyed.withColumn(slot, F.row_number().over(within)).join(starts, [out, bucket])
    return placed.withColumn(slot, (F.col(first) + F.col(slot) - 1).cast("bigint")).select(*[c for c in docs.columns if c.lower() not in (out.lower(), slot.lower())], out, slot)


def write_shards(sharded: DataFrame, path: str, out: str = "shard") -> None:
    """One folder a shard."""
    sharded.write.mode("overwrite").partitionBy(out).parquet(path)
