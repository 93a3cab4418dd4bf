"""Response times, volumes, rhythms and rankings over the message stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions.dates import week_start

MAX_HOURS = 720


def _hours(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 3.6e9


def volume_trend(m: DataFrame, weeks: int = 12) -> DataFrame:
    """Sent and received a week, weeks without mail included, up to the newest message's week."""
    counts = m.groupBy(week_start(F.col("sent_ts")).alias("week")).agg(F.count_if("is_sent").alias("sent"), F.count_if(~F.col("is_sent")).alias("received"))
    span = counts.agg(F.max("week").alias("last"), F.min("week").alias("first"))
    dense = span.select(F.explode(F.sequence(F.greatest(F.col("first"), F.date_sub("last", 7 * (weeks - 1))), F.col("last"), F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return dense.join(counts, "week", "left").select(F.date_format("week", "yyyy-MM-dd").alias("week"), F.coalesce("sent", F.lit(0)).alias("sent"), F.coalesce("received", F.lit(0)).alias("received"))


def heatmap(m: DataFrame) -> DataFrame:
    """Messages by weekday (Monday 0) and hour, one row a weekday and hour with mail."""
    return m.groupBy(F.weekday("sent_ts").alias("weekday"), F.hour("sent_ts").alias("hour")).agg(F.count_if("is_sent").alias("sent"), F.count_if(~F.col("is_sent")).alias("received"))


def reply_pairs(m: DataFrame, mine: bool) -> DataFrame:
    """Each waiting message with the first answer after it: mine to what came in, or theirs to what I sent."""
    # Newest first: the least answer so far is the next one in time, kept up as a running minimum.
    later = Window.partitionBy("thread_id").orderBy(F.col("sent_ts").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    answer = F.col("is_sent") if mine else ~F.col("is_sent")
    reply = F.min(F.when(answer, F.struct("sent_ts", "id", "sender_addr"))).over(later)
    pairs = m.select("thread_id", "id", "sent_ts", "is_sent", F.get("to_addrs", F.lit(0)).alias("first_to"), "sender_addr", reply.alias("r")).where(~answer & F.col("r").isNotNull())
    who = F.col("sender_addr") if mine else F.col("first_to")
    return pairs.select("thread_id", "id", F.col("r.id").alias("reply_id"), who.alias("who"), F.col("r.sent_ts").alias("reply_ts"), _hours(F.col("sent_ts"), F.col("r.sent_ts")).alias("hours")).where((F.col("hours") > 0) & (F.col("hours") < MAX_HOURS))


def medians(rows: DataFrame, keys: list[str], value: str, step: float = 1 / 3600) -> DataFrame:
    """Exact median and number of a value for each key, without a task that holds a key's values.

    Equal values are counted first, then steps of ``step``; running counts over a key's steps, of which there are as many as the
    value's range holds, lead to the one or two in which the middle lies, and only their values are ordered.
    """
    counts = rows.groupBy(*keys, F.floor(F.col(value) / step).alias("_step"), F.col(value).alias("_value")).agg(F.count("*").alias("_c"))
    along = Window.partitionBy(*keys).orderBy("_step")
    steps = counts.groupBy(*keys, "_step").agg(F.sum("_c").alias("_in")).withColumn("_to", F.sum("_in").over(along)).withColumn("n", F.sum("_in").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)  # places of the middle values, from 0
    start = F.col("_to") - F.col("_in")
    middle = steps.where((low < F.col("_to")) & (high >= start)).withColumn("_first", start).drop("_in", "_to")
    inside = Window.partitionBy(*keys, "_step").orderBy("_value")
    placed = counts.join(middle, [*keys, "_step"]).withColumn("_end", F.col("_first") + F.sum("_c").over(inside)).withColumn("_begin", F.col("_end") - F.col("_c"))
    held = lambda at: F.max(F.when((F.col("_begin") <= at) & (at < F.col("_end")), F.col("_value")))
    return placed.groupBy(*keys).agg(((held(low) + held(high)) / 2).alias("median"), F.max("n").alias("n"))


def latency_by_week(pairs: DataFrame) -> DataFrame:
    """Median hours by the week of the answer."""
    weeks = pairs.withColumn("week", F.date_format(week_start(F.col("reply_ts")), "yyyy-MM-dd"))
    return medians(weeks, ["week"], "hours").select("week", F.col("median").alias("median_hours"), "n")


def response_summary(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Median and number of both directions; a direction without answers has no row but n 0."""
    both = mine.select(F.lit("mine").alias("side"), "hours").unionByName(theirs.select(F.lit("theirs").alias("side"), "hours"))
    sides = mine.sparkSession.createDataFrame([("mine",), ("theirs",)], "side string")
    return sides.join(medians(both, ["side"], "hours"), "side", "left").select("side", F.col("median").alias("median_hours"), F.coalesce("n", F.lit(0)).alias("n"))


def inbox_mix(m: DataFrame, me: str, noisy: Column, broadcast_to: int = 3) -> DataFrame:
    """Received mail as spam, notice, direct or cc; the first that holds."""
    n_to = F.size("to_addrs") + F.size("cc_addrs")
    kind = F.when(noisy, "spam").when(n_to >= broadcast_to, "notice").when(F.array_contains("to_addrs", me), "direct").otherwise("cc")
    return m.where(~F.col("is_sent")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def pingpong(m: DataFrame, least: int = 2, top: int = 8) -> DataFrame:
    """Threads that went back and forth: direction changes, the most first."""
    order = Window.partitionBy("thread_id").orderBy("sent_ts", "id")
    turned = m.where(~F.coalesce("hidden", F.lit(False))).withColumn("turn", F.coalesce((F.lag("is_sent").over(order) != F.col("is_sent")).cast("int"), F.lit(0)))
    rows = turned.groupBy("thread_id").agg(F.sum("turn").alias("turns"), F.count("*").alias("messages")).where(F.col("turns") >= least)
    return rows.orderBy(F.col("turns").desc(), F.col("messages").desc(), "thread_id").limit(top)


def rank_people(m: DataFrame, weeks: int = 26, limit: int = 50, noisy: Column | None = None) -> DataFrame:
    """People by mail in a window that ends at the newest message: received counts 1, sent one half."""
    # One row, the newest time, is the only thing joined to all messages.
    edge = m.agg((F.max("sent_ts") - F.make_dt_interval(F.lit(7 * weeks))).alias("since"))
    recent = m.join(F.broadcast(edge), F.col("sent_ts") >= F.col("since"))
    if noisy is not None:
        recent = recent.where(F.col("is_sent") | ~noisy)
    who = F.when(F.col("is_sent"), F.array_distinct(F.concat("to_addrs", "cc_addrs"))).otherwise(F.array("sender_addr"))
    rows = recent.select(F.explode(who).alias("addr"), "is_sent").groupBy("addr").agg(F.count_if(~F.col("is_sent")).alias("received"), F.count_if("is_sent").alias("sent"))
    return rows.select("addr", "received", "sent", (F.col("received") * 1.0 + F.col("sent") * 0.5).alias("score")).orderBy(F.col("score").desc(), "addr").limit(limit)


def daily_coverage(m: DataFrame, noted: DataFrame) -> DataFrame:
    """Each day from first to last with mail and notes (``noted``: day), gaps included."""
    days = m.groupBy(F.col("sent_ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    notes = noted.groupBy("day").agg(F.count("*").alias("notes"))
    grid = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return grid.join(days, "day", "left").join(notes, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("messages"), F.coalesce("notes", F.lit(0)).alias("notes"))


def week_scores(m: DataFrame, start: str, end: str, me: str, direct_to: int = 3) -> DataFrame:
    """Threads of a period by involvement: named 5, answers to me 4, direct 3, sent 2, decisions and deadlines up to twice."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))
    rows = m.where((F.col("sent_ts") >= lo) & (F.col("sent_ts") < hi) & ~F.coalesce("hidden", F.lit(False)))
    before = Window.partitionBy("thread_id").orderBy("sent_ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("answers", ~F.col("is_sent") & F.coalesce(F.max("is_sent").over(before), F.lit(False)))
    got = ~F.col("is_sent")
    per = rows.groupBy("thread_id").agg(
        F.count_if(got & F.col("mentions_me")).alias("named"), F.count_if("answers").alias("replies"),
        F.count_if(got & F.array_contains("to_addrs", me) & (F.size("to_addrs") <= direct_to)).alias("direct"), F.count_if("is_sent").alias("sent"),
        F.count_if(got & F.col("has_decision")).alias("decisions"), F.count_if(got & F.col("has_deadline")).alias("deadlines"), F.max("sent_ts").alias("last_ts"),
    )
    score = (
        F.col("named") * 5 + F.col("replies") * 4 + F.col("direct") * 3 + F.col("sent") * 2 + F.least("decisions", F.lit(2)) * 3 + F.least("deadlines", F.lit(2)) * 2
    )
    return per.where((F.col("named") + F.col("replies") + F.col("direct") + F.col("sent")) > 0).withColumn("score", score)


def week_states(scored: DataFrame, actions: DataFrame, tails: DataFrame, end: str, stuck_days: int = 5) -> DataFrame:
    """Where each thread of a period stands: mine (a request is open), stuck, waiting (my message is last) or done."""
    from lettergraph.functions.dates import workdays_since

    rows = scored.select("thread_id", "score").join(actions.select("thread_id", F.lit(True).alias("asked")), "thread_id", "left").join(tails.select("thread_id", "is_sent", "sent_on"), "thread_id", "left")
    idle = workdays_since(F.to_timestamp_ntz("sent_on", F.lit("yyyy-MM-dd HH:mm:ss")), F.lit(end).cast("date"))
    state = F.when(F.coalesce("asked", F.lit(False)), "mine").when(F.coalesce("is_sent", F.lit(False)) & (idle >= stuck_days), "stuck").when(F.coalesce("is_sent", F.lit(False)), "waiting").otherwise("done")
    return rows.select("thread_id", "score", state.alias("state"))
