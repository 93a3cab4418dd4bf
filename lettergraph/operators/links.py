"""Groups of rows that share keys, directly or through others, and connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettergraph.shared import discard, written


def linked(pairs: DataFrame, row: str, key: str, rounds: int = 50) -> DataFrame:
    """(row, component) from (row, key) pairs: the least label spreads from rows to keys and back until nothing changes.

    Every step is an aggregation by key or row with partial minima, so a key that many rows share is no burden; labels
    jump to the label of their label too, which halves long chains.  Each round is written to the shared folder.
    """
    labels = pairs.select(row).distinct().withColumn("component", F.col(row))
    for _ in range(rounds):
        by_key = pairs.join(labels, row).groupBy(key).agg(F.min("component").alias("low"))
        after = pairs.join(by_key, key).groupBy(row).agg(F.min("low").alias("component"))
        jumps = after.select(F.col(row).alias("component"), F.col("component").alias("further"))
        after = after.join(jumps, "component", "left").select(row, F.least("component", "further").alias("component"))
        after = written(after, "labels")
        changed = after.join(labels.withColumnRenamed("component", "old"), row).where("component <> old").limit(1).count()
        if hasattr(labels, "_shared_path"):
            discard(labels)
        labels = after
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has a link; component is the smallest node reachable.

    Every node points to a node that is no larger.  A round lets each node learn the smallest grandparent among its
    neighbours; the node itself and its parent take it over, and pointers jump to their own targets, so depth halves.
    All steps are aggregations with partial minima and joins on node, so a node with many links is no burden.  Pointers
    are written to the shared folder every round, the last round's removed: lineage stays short, and a lost executor costs
    one round.
    Null ends are ignored.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = written(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    at = pointers = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("up")), "pointers")
    for _ in range(rounds):
        far = at.join(at.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", "up", "far")
        near = edges.join(far.select(F.col("node").alias("v"), F.col("far").alias("heard")), "v").groupBy("u").agg(F.min("heard").alias("heard"))
        news = far.join(near, far["node"] == near["u"]).select("node", "up", F.least("far", "heard").alias("low"))
        told = news.select(F.explode(F.array(F.struct("node", "low"), F.struct(F.col("up").alias("node"), "low"))).alias("t")).select("t.*").groupBy("node").agg(F.min("low").alias("low"))
        after = written(at.join(told, "node").select("node", F.least("up", "low").alias("up"), (F.col("low") < F.col("up")).alias("moved")), "pointers")
        discard(pointers)
        pointers, at = after, after.select("node", "up")
        if after.where("moved").isEmpty():
            discard(edges)
            return at.withColumnRenamed("up", "component")
    raise RuntimeError("components did not settle")
