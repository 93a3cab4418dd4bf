"""People: who wrote to whom, relations, cohorts, directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions.dates import stamp
from lettergraph.operators.threads import key

def recipients() -> Column:
    return F.array_distinct(F.concat("to_addrs", "cc_addrs"))


def people(m: DataFrame, me: str) -> DataFrame:
    """The directory: counts both ways, the latest name that is not blank, first seen by arrival, last seen by time."""
    got = m.where(~F.col("is_sent")).select(F.col("sender_addr").alias("addr"), "seq", "sent_ts", F.col("sender_name").alias("name"), F.lit(1).alias("f"), F.lit(0).alias("t"))
    sent = m.where("is_sent").select(F.explode(recipients()).alias("addr"), "seq", "sent_ts", F.lit("").alias("name"), F.lit(0).alias("f"), F.lit(1).alias("t"))
    return got.unionByName(sent).where(F.col("addr") != me).groupBy("addr").agg(
        F.sum("f").alias("from_count"), F.sum("t").alias("to_count"), F.coalesce(F.max_by("name", F.when(F.col("name") != "", F.col("seq"))), F.lit("")).alias("name"),
        stamp(F.min_by("sent_ts", "seq")).alias("first_seen"), stamp(F.max("sent_ts")).alias("last_seen"),
    )


def badge(directory: DataFrame, m: DataFrame) -> DataFrame:
    """Relation of each received message's sender: first mail, one way (three or more in, none out), else nothing."""
    got = m.where(~F.col("is_sent")).select("id", F.col("sender_addr").alias("addr"), stamp(F.col("sent_ts")).alias("sent_on"))
    rows = got.join(directory, "addr")
    mark = F.when(F.col("sent_on") == F.col("first_seen"), "first").when((F.col("to_count") == 0) & (F.col("from_count") >= 3), "one_way").otherwise("")
    return rows.select("id", mark.alias("badge"))


def correspondence(m: DataFrame, addr: str, limit: int = 100) -> DataFrame:
    """Messages from a person or sent to them, newest first; addresses are compared whole."""
    hit = (F.col("sender_addr") == addr) | (F.col("is_sent") & (F.array_contains("to_addrs", addr) | F.array_contains("cc_addrs", addr)))
    return m.where(hit).orderBy(F.col("sent_ts").desc(), F.col("id").desc()).limit(limit).select("id", "thread_id", stamp(F.col("sent_ts")).alias("sent_on"), "is_sent", "subject")


def relation(m: DataFrame, me: str) -> DataFrame:
    """Facts on every counterpart at once: mail to me, in copy only, from me, threads, threads I answered in, who began them."""
    first = m.groupBy("thread_id").agg(F.min_by("sender_addr", key()).alias("starter"), F.bool_or("is_sent").alias("i_wrote"))
    got = m.where(~F.col("is_sent")).select("thread_id", F.col("sender_addr").alias("addr"), "sent_ts", F.array_contains("to_addrs", me).alias("direct"), F.lit(False).alias("mine"))
    sent = m.where("is_sent").select("thread_id", F.explode(recipients()).alias("addr"), "sent_ts", F.lit(False).alias("direct"), F.lit(True).alias("mine"))
    rows = got.unionByName(sent).where(F.col("addr") != me)
    per_thread = rows.groupBy("addr", "thread_id").agg(
        F.count_if(~F.col("mine") & F.col("direct")).alias("to_me"), F.count_if(~F.col("mine") & ~F.col("direct")).alias("cc_only"), F.count_if("mine").alias("from_me"),
        F.min("sent_ts").alias("a"), F.max("sent_ts").alias("b"),
    )
    return per_thread.join(first, "thread_id").groupBy("addr").agg(
        F.sum("to_me").alias("to_me"), F.sum("cc_only").alias("cc_only"), F.sum("from_me").alias("from_me"), F.count("*").alias("threads"), F.count_if("i_wrote").alias("replied_threads"),
        F.count_if(F.col("starter") == F.col("addr")).alias("they_started"), F.count_if(F.col("starter") == me).alias("i_started"), stamp(F.min("a")).alias("first_on"), stamp(F.max("b")).alias("last_on"),
    )


def cohorts(m: DataFrame, addr: str, me: str, least: int = 2, limit: int = 3) -> DataFrame:
    """Who else is in one person's threads, by number of threads; the person's threads are the small side."""
    everyone = m.select("thread_id", F.explode(F.array_distinct(F.concat(F.array("sender_addr"), "to_addrs", "cc_addrs"))).alias("who")).distinct()
    theirs = everyone.where(F.col("who") == addr).select("thread_id")
    met = everyone.where(~F.col("who").isin(addr, me)).join(theirs, "thread_id", "left_semi")
    return met.groupBy("who").agg(F.count("*").alias("threads")).where(F.col("threads") >= least).orderBy(F.col("threads").desc(), "who").limit(limit)


def thread_context(m: DataFrame, addr: str, me: str, threads: int = 8, excerpts: int = 2) -> DataFrame:
    """One person's busiest threads with their newest messages in each."""
    hit = m.where((F.col("sender_addr") == addr) | (F.col("is_sent") & F.array_contains(recipients(), addr)))
    busy = hit.groupBy("thread_id").agg(F.count_if(F.array_contains("to_addrs", me) | F.col("is_sent")).alias("weight"), F.max("sent_ts").alias("last_ts")).orderBy(F.col("weight").desc(), F.col("last_ts").desc(), "thread_id").limit(threads)
    newest = Window.partitionBy("thread_id").orderBy(F.col("sent_ts").desc(), F.col("id").desc())
    rows = hit.where(F.col("sender_addr") == addr).join(F.broadcast(busy.select("thread_id", "weight")), "thread_id").withColumn("nr", F.row_number().over(newest))  # at most ``threads`` rows
    return rows.where(F.col("nr") <= excerpts).select("thread_id", "weight", "id", "nr", "body")


def homonyms(directory: DataFrame) -> DataFrame:
    """Names that several addresses share get their address's local part as a suffix; without a name the address stands.

    Names are counted in partial sums, and the many people without one take no part in that.
    """
    named = directory.where("name <> ''")
    shared = named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit(True).alias("several"))
    label = F.when(F.col("several"), F.concat("name", F.lit(" ("), F.substring_index("addr", "@", 1), F.lit(")"))).otherwise(F.col("name"))
    blank = directory.where("coalesce(name, '') = ''").select("addr", F.col("addr").alias("label"))
    return named.join(shared, "name", "left").select("addr", label.alias("label")).unionByName(blank)
