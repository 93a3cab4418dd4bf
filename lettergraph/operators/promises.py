"""Promises in own messages, what followed, and claims on days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions import rules
from lettergraph.functions.dates import resolve_when
from lettergraph.functions.text import collapsed, own_text


def followups(m: DataFrame) -> DataFrame:
    """For each own message: later answers in its thread, by id, and whether I wrote again."""
    # Newest first, so that what came later is a running count.
    later = Window.partitionBy("thread_id").orderBy(F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = m.withColumn("replies_after", F.coalesce(F.count_if(~F.col("is_sent")).over(later), F.lit(0))).withColumn("followed_up", F.coalesce(F.bool_or("is_sent").over(later), F.lit(False)))
    return rows.where("is_sent").select("id", "thread_id", "sent_ts", "replies_after", "followed_up")


def done_key(*parts) -> F.Column:
    """The key under which an item is marked done: 20 hex digits of a digest of its parts."""
    return F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 20)


def promises(m: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The first promise of each own message: a sentence of 8 to 120 letters with a fixed ending and no request or denial."""
    pieces = F.transform(F.split(own_text(F.coalesce("body", F.lit(""))), r"(?U)(?<=[.!?다요])\s+"), collapsed)
    said = F.get(F.filter(pieces, lambda s: F.length(s).between(8, 120) & s.rlike(rules.PROMISE) & ~s.rlike(rules.NO_PROMISE)), F.lit(0))
    after = followups(m)
    rows = m.where("is_sent").withColumn("quote", said).where("quote IS NOT NULL").select("id", "subject", "quote").join(after, "id")
    when = F.regexp_extract("quote", rules.WHEN, 1)
    rows = rows.withColumn("due", F.when(when != "", resolve_when(when, F.col("sent_ts").cast("date")))).withColumn("key", done_key(F.col("id"), F.col("quote")))
    if done is None:
        return rows.withColumn("marked_done", F.lit(False))
    return rows.join(done.select("key", F.lit(True).alias("marked_done")).distinct(), "key", "left").withColumn("marked_done", F.coalesce("marked_done", F.lit(False)))


def open_promises(found: DataFrame, today: str, days: int = 14) -> DataFrame:
    """Within ``days``, nothing followed and not marked done; by due date, none last, older first."""
    age = F.datediff(F.lit(today).cast("date"), F.col("sent_ts"))
    return found.withColumn("days", age).where(~F.col("followed_up") & ~F.col("marked_done") & F.col("days").between(0, days)).orderBy(F.col("due").asc_nulls_last(), F.col("days").desc(), "id")


def without_done(items: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Items not marked done."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def calendar(signals: DataFrame, done: DataFrame) -> DataFrame:
    """Day by day the first deadline that is not done claims its thread, even where its date does not resolve; then
    nothing shows. ``signals``: thread_id, day, id, due, key."""
    first = without_done(signals, done).groupBy("thread_id").agg(F.min_by(F.struct("id", "day", "due"), F.struct("day", "id")).alias("s"))
    return first.select("thread_id", "s.*").where("due IS NOT NULL").orderBy("due", "thread_id")
