"""Evidence: quotes checked against what was written, rows sampled to show a thread, conversations of questions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions.text import own_text, squashed
from lettergraph.shared import written


def verified_quotes(claims: DataFrame, m: DataFrame, least: int = 10, most: int = 300) -> DataFrame:
    """Claims (mid, quote) whose quote stands, white space aside, in the message they name; an equi-join on the message."""
    named = claims.withColumn("q", squashed(F.substring(F.trim("quote"), 1, most))).where(F.length("q") >= least)
    rows = named.join(m.select(F.col("id").alias("mid"), "thread_id", "body"), "mid")
    return rows.where(F.contains(squashed(F.col("body")), F.col("q"))).drop("q", "body")


def resolved_quotes(claims: DataFrame, m: DataFrame, start: str, end: str, least: int = 10, most: int = 300) -> DataFrame:
    """Claims (claim, thread_id, mid, mine, quote) of a period with the message that holds their quote, white space aside.

    The message is of the claim's thread and of days ``start`` to ``end``, mine or not where the claim says so (null: either).
    Without a message named, the quote stands only if one message alone holds it.  Quotes below ``least`` letters fall, of
    longer ones ``most`` are compared; a preserved tail is no part of a message.  Claims meet the messages of their thread by
    equality, so nothing is compared across threads.
    """
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))
    rows = m.where((F.col("sent_ts") >= lo) & (F.col("sent_ts") < hi)).select("thread_id", "id", "is_sent", squashed(own_text(F.coalesce("body", F.lit("")))).alias("t"))
    named = claims.withColumn("q", F.substring(squashed(F.col("quote")), 1, most)).where(F.length("q") >= least)
    hit = named.join(rows, "thread_id").where(
        F.contains("t", F.col("q")) & (F.col("mine").isNull() | (F.col("mine") == F.col("is_sent"))) & (F.col("mid").isNull() | (F.col("mid") == F.col("id")))
    )
    found = hit.groupBy("claim").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.max("mid").alias("mid"))
    return found.where("n = 1 OR mid IS NOT NULL").select("claim", "id")


RUN = 5  # letters of a fingerprint
SENT = 200_000  # fingerprints of quotes that are sent to the tasks


def _fingerprints(text: str, least: int) -> np.ndarray:
    """Winnowed fingerprints: of each ``least`` letters in a row the smallest hash among their runs of ``RUN``.

    Two texts that share so many letters in a row share that one; about two runs in ``least - RUN + 2`` are kept.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(c) < least:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(len(c) - RUN + 1, dtype=np.uint64)
    for i in range(RUN):  # a nonlinear step a letter
        h = (h ^ c[i : len(c) - RUN + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h.view(np.int64), least - RUN + 1).min(axis=1))


def _winnowed(text: Column, least: int, wanted: Broadcast | None = None) -> Column:
    """Fingerprints of a text, or those of them that are wanted."""

    @F.arrow_udf("array<bigint>")
    def run(batch: pa.Array) -> pa.Array:
        found, sizes = [np.zeros(0, dtype=np.int64)], []
        for t in batch.to_pylist():
            own = _fingerprints(t or "", least)
            if wanted is not None and len(own):
                list_ = wanted.value
                own = own[list_[np.minimum(np.searchsorted(list_, own), len(list_) - 1)] == own] if len(list_) else own[:0]
            found.append(own)
            sizes.append(len(own))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(found)))

    return run(text)


def located_quotes(quotes: DataFrame, m: DataFrame, least: int = 10, sent: int = SENT) -> DataFrame:
    """(quote_id, id) for quotes that name no message, white space aside; quotes below ``least`` letters, at least 10, stand nowhere.

    Quotes and messages are winnowed to fingerprints alike; of a quote's the one rarest in the messages finds candidates by
    equality, the text decides.  Up to ``sent`` fingerprints of quotes are sent to the tasks, so that only hits leave a message;
    more of them meet the messages' in a join.
    """
    if least < 2 * RUN:
        raise ValueError(f"least is {2 * RUN} or more")
    spark = m.sparkSession
    keyed = written(quotes.select("quote_id", squashed(F.col("quote")).alias("q")).where(F.length("q") >= least).select("quote_id", "q", F.explode(_winnowed(F.col("q"), least)).alias("run")), "quotes")
    asked = keyed.select("run").distinct()
    few = [r.run for r in asked.limit(sent + 1).collect()]
    wanted = spark.sparkContext.broadcast(np.array(sorted(few), dtype=np.int64)) if len(few) <= sent else None
    each = m.select("id", F.explode(_winnowed(squashed(F.col("body")), least, wanted)).alias("run"))
    held = written(each if wanted is not None else each.join(asked, "run", "left_semi"), "runs")
    n = held.groupBy("run").agg(F.count("*").alias("n"))
    # A run that no message has is the rarest: its quote stands nowhere.
    rarest = keyed.join(n, "run", "left").groupBy("quote_id", "q").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    met = held.join(rarest, "run").select("quote_id", "q", "id").distinct()
    return met.join(m.select("id", "body"), "id").where(F.contains(squashed(F.col("body")), F.col("q"))).select("quote_id", "id").distinct()


def unique_source(found: DataFrame) -> DataFrame:
    """Quotes that one message alone holds: these may stand without naming it."""
    return found.groupBy("quote_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("quote_id", "id")


def quote_context(body: Column, quote: Column, pad: int = 120) -> Column:
    """struct(pre, quote, post): the quote as written with what stands around it, up to sentence bounds within ``pad``."""
    at = F.position(quote, body)
    start = at - 1
    before = F.substring(body, F.greatest(start - pad, F.lit(0)) + 1, F.least(start, F.lit(pad)))
    after = F.substring(body, start + F.length(quote) + 1, F.lit(pad))
    pre = F.regexp_replace(before, r"(?s)^.*[.!?\n]\s+", "")
    post = F.regexp_extract(after, r"(?s)^(.*?(?:[.!?](?=\s|$)|\n|$))", 1)
    return F.when(at > 0, F.struct(pre.alias("pre"), quote.alias("quote"), post.alias("post")))


def evidence_sample(m: DataFrame, last: int = 6, most: int = 12) -> DataFrame:
    """Rows that show each thread: the first, the last six, and signal rows from the newest until twelve."""
    up, down = Window.partitionBy("thread_id").orderBy("sent_ts", "id"), Window.partitionBy("thread_id").orderBy(F.col("sent_ts").desc(), F.col("id").desc())
    signal = F.col("has_decision") | F.col("has_deadline") | F.col("has_withdrawal") | F.col("has_completion")
    rows = m.withColumn("from_start", F.row_number().over(up)).withColumn("from_end", F.row_number().over(down))
    fixed = (F.col("from_start") == 1) | (F.col("from_end") <= last)
    rows = rows.withColumn("fixed", fixed).withColumn("extra", F.when(signal & ~fixed, 1).otherwise(0))
    room = most - F.count_if("fixed").over(Window.partitionBy("thread_id"))
    nth = F.sum("extra").over(down)
    return rows.withColumn("room", room).withColumn("nth", nth).where(F.col("fixed") | ((F.col("extra") == 1) & (F.col("nth") <= F.col("room")))).select("thread_id", "id", "from_start")


def uncut_quotes(m: DataFrame, probe: int = 200, least: int = 120, long_body: int = 2000, limit: int = 10) -> DataFrame:
    """Threads whose messages seem to repeat the one before: its first 200 characters stand in the next, long one."""
    order = Window.partitionBy("thread_id").orderBy("seq", "id")
    flat = m.withColumn("flat", squashed(F.coalesce("body", F.lit(""))))
    rows = flat.withColumn("before", F.substring(F.lag("flat").over(order), 1, probe))
    suspect = (F.length("before") >= least) & (F.length("flat") >= long_body) & F.contains("flat", F.col("before"))
    per = rows.groupBy("thread_id").agg(F.count("*").alias("n"), F.count_if(suspect).alias("pairs")).where((F.col("n") >= 3) & (F.col("pairs") > 0))
    return per.select("thread_id", "n", "pairs").orderBy(F.col("pairs").desc(), "thread_id").limit(limit)


def conversation_roots(asked: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, root) of questions that follow others (id, parent_id): pointers double each round, cycles end at their least id.

    After so many rounds a path of 2**rounds questions has ended, and what still moves goes round in a cycle no longer than that;
    longer ones raise.
    """
    links = asked.select("id", F.coalesce("parent_id", "id").alias("up"))
    known = links.select(F.col("id").alias("up_id"))
    links = links.join(known, F.col("up") == F.col("up_id"), "left").select("id", F.coalesce("up_id", "id").alias("up"))
    low = links.select("id", "up", F.least("id", "up").alias("low"))
    for _ in range(rounds):
        jump = low.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("next_low"))
        after = low.join(jump, "up").select("id", F.col("next").alias("up"), F.least("low", "next_low").alias("low"), (F.col("up") != F.col("next")).alias("moved"))
        after = written(after, "roots")
        if not after.where("moved").limit(1).count():
            low = after.drop("moved")
            break
        low = after.drop("moved")
    else:
        # What is pointed at now and is no root lies in a cycle, where all must have met the same least id.
        inner = low.where("id <> up").join(low.select(F.col("up").alias("id")).distinct(), "id", "left_semi")
        ahead = low.select(F.col("id").alias("up"), F.col("low").alias("next_low"))
        if not inner.join(ahead, "up").where("low <> next_low").isEmpty():
            raise RuntimeError("conversations did not settle")
    # Where a path ends in a root, that is it; where it ends in a cycle, the least id of the cycle.
    first = links.select(F.col("id").alias("up"), (F.col("id") == F.col("up")).alias("is_root"))
    ends = low.select(F.col("id").alias("up"), F.col("low").alias("cycle")).join(first, "up")
    return low.select("id", "up").join(ends, "up").select("id", F.when(F.col("is_root"), F.col("up")).otherwise(F.col("cycle")).alias("root"))


def stale_since(m: DataFrame, basis: DataFrame, width: int = 1_000_000) -> DataFrame:
    """How many messages arrived after each cached answer (key, basis): counted by arrival, never by id.

    Whole ranges of ``width`` arrivals come from one count a range; only the answer's own range is compared row by row.
    """
    ranged = lambda c: F.floor(F.col(c) / width)
    asked = basis.withColumn("range", ranged("basis"))
    inside = asked.join(m.select("seq", ranged("seq").alias("range")), "range").where("seq > basis").groupBy("key").agg(F.count("*").alias("inside"))
    sizes = m.groupBy(ranged("seq").alias("later")).agg(F.count("*").alias("n"))
    above = asked.join(sizes, F.col("later") > F.col("range")).groupBy("key").agg(F.sum("n").alias("above"))
    return basis.select("key").join(inside, "key", "left").join(above, "key", "left").select("key", (F.coalesce("inside", F.lit(0)) + F.coalesce("above", F.lit(0))).alias("newer"))


def newer_than(m: DataFrame, basis: int) -> DataFrame:
    """Messages that arrived after one answer."""
    return m.where(F.col("seq") > basis).agg(F.count("*").alias("newer"))


def kept_by_role(claims: DataFrame) -> DataFrame:
    """Claims in the order conclusion, evidence, background."""
    rank = F.array_position(F.array(F.lit("conclusion"), F.lit("evidence"), F.lit("background")), F.col("role"))
    return claims.orderBy(F.when(rank == 0, 9).otherwise(rank), "mid")
