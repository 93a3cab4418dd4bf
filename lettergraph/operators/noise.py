"""Who and what counts as noise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettergraph.functions.text import normalised_subject


def _either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def hard_sender(addr: Column, ignored: list[str], blocked: list[str] = ()) -> Column:
    """The address holds an ignored or blocked piece, in any case."""
    low = F.lower(F.coalesce(addr, F.lit("")))
    return _either([F.contains(low, F.lit(p.lower())) for p in (*ignored, *blocked) if p])


def external_sender(addr: Column, internal: list[str], allowed: list[str] = ()) -> Column:
    """Internal domains are set, and the domain is neither one of them, nor below one, nor allowed."""
    if not internal:
        return F.lit(False)
    domain = F.substring_index(F.lower(F.coalesce(addr, F.lit(""))), "@", -1)
    known = [(domain == d.lower()) | domain.endswith("." + d.lower()) for d in (*internal, *[a for a in allowed if "@" not in a])]
    return F.contains(addr, F.lit("@")) & ~_either([*known, *[F.lower(addr) == a.lower() for a in allowed if "@" in a]])


def strong_subject(subject: Column, patterns: list[str]) -> Column:
    """``[tag]`` anywhere; any other pattern as a prefix ``p:``, as ``[p]``, or as the whole subject without reply marks."""
    low = F.lower(F.coalesce(subject, F.lit("")))
    bare = normalised_subject(subject)
    tests = []
    for p in (x.strip().lower() for x in patterns):
        if p.startswith("[") and p.endswith("]"):
            tests.append(F.contains(low, F.lit(p)))
        elif p:
            tests += [F.contains(low, F.lit(p + ":")), F.contains(low, F.lit(f"[{p}]")), bare == p]
    return _either(tests)


def weak_subject(subject: Column, patterns: list[str]) -> Column:
    return _either([F.contains(F.lower(F.coalesce(subject, F.lit(""))), F.lit(p.lower())) for p in patterns if p])


def noise_threads(m: DataFrame, noisy: Column) -> DataFrame:
    """Threads with received messages all of which are noise."""
    got = m.where(~F.col("is_sent")).groupBy("thread_id").agg(F.bool_and(noisy).alias("all_noise"))
    return got.where("all_noise").select("thread_id")


def thread_kind(m: DataFrame, noisy: Column, strong: Column, weak: Column, broadcast_to: int = 15) -> DataFrame:
    """spam, notice or work for each thread, in one aggregation."""
    n_to = F.size("to_addrs") + F.size("cc_addrs")
    rows = m.groupBy("thread_id").agg(
        F.bool_and(F.when(~F.col("is_sent"), noisy)).alias("all_noise"), F.bool_or(strong).alias("strong"), F.bool_or(weak).alias("weak"), F.bool_and(n_to >= broadcast_to).alias("wide"),
        F.bool_or("is_sent").alias("mine"), F.max(n_to).alias("n_to"),
    )
    kind = (
        F.when(F.coalesce("all_noise", F.lit(False)) | F.col("strong"), "spam")
        .when(~F.col("mine") & (F.col("wide") | (F.col("weak") & (F.col("n_to") >= 3))), "notice").otherwise("work")
    )
    return rows.select("thread_id", kind.alias("kind"))


def top_senders(m: DataFrame, limit: int = 30) -> DataFrame:
    """Who writes most and is written to least: candidates for the ignore list."""
    sent = m.where("is_sent").select(F.explode(F.array_distinct(F.concat("to_addrs", "cc_addrs"))).alias("addr")).groupBy("addr").agg(F.count("*").alias("to_count"))
    got = m.where(~F.col("is_sent")).groupBy(F.col("sender_addr").alias("addr")).agg(F.count("*").alias("from_count"))
    return got.join(sent, "addr", "left").select("addr", "from_count", F.coalesce("to_count", F.lit(0)).alias("to_count")).orderBy(F.col("from_count").desc(), "to_count", "addr").limit(limit)
