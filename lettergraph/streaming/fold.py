"""The open request of each thread as a stream: one state a thread, of the newest message of each sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettergraph.operators.state import open_actions

COLUMNS = ("id", "sent_ts", "is_sent", "is_trivial", "has_withdrawal", "has_completion", "has_strong_request", "has_weak_request", "has_decision", "has_question", "has_deadline", "mentions_me")


def step(state: tuple, r) -> tuple:
    """One message applied to (source, strong, decide, deadline, completion)."""
    if r.is_sent:
        return state if r.is_trivial else (0, False, False, False, False)
    if r.has_withdrawal:
        state = (0, False, False, False, False)
    if r.has_strong_request or r.has_weak_request or r.has_decision or r.has_question or r.has_deadline or r.mentions_me:
        return (r.id, bool(state[1] or r.has_strong_request or r.has_decision), bool(state[2] or r.has_decision), bool(state[3] or r.has_deadline), False)
    return (*state[:4], True) if r.has_completion and state[0] else state


def open_actions_stream(m: DataFrame) -> DataFrame:
    """A row a thread and micro-batch with the thread's slot (no source: closed).

    What ``step`` keeps follows from the newest message of each sort, so a thread's state is a few maxima of (time, id) that
    Spark's own streaming aggregation merges: in whatever order messages come, the order of events decides.  ``late`` marks
    rows whose micro-batch brought a thread nothing newer than it had; their slots are right as well.
    """
    key = F.struct("sent_ts", "id")
    flag = lambda *names: reduce(lambda a, b: a | b, [F.coalesce(F.col(n), F.lit(False)) for n in names])
    mine = flag("is_sent")
    asks = ~mine & flag("has_strong_request", "has_weak_request", "has_decision", "has_question", "has_deadline", "mentions_me")
    newest = {
        "cleared": (mine & ~flag("is_trivial")) | (~mine & flag("has_withdrawal")), "asked": asks, "pressed": asks & flag("has_strong_request", "has_decision"),
        "decided": asks & flag("has_decision"), "due": asks & flag("has_deadline"), "done": ~mine & ~asks & flag("has_completion"),
    }
    # The time of a micro-batch is one value in all its rows, and the same if it is done again.
    rows = m.select("thread_id", *COLUMNS).withColumn("batch_ts", F.current_timestamp())
    kept = rows.groupBy("thread_id").agg(
        *[F.max(F.when(holds, key)).alias(name) for name, holds in newest.items()], F.max(F.struct("sent_ts", "id", "batch_ts")).alias("newest"), F.max("batch_ts").alias("batch_ts"),
    )
    since = lambda name: F.col(name).isNotNull() & (F.col("cleared").isNull() | F.coalesce(F.col(name) >= F.col("cleared"), F.lit(False)))
    slot = kept.withColumn("open", since("asked"))
    return slot.select(
        "thread_id", F.when(F.col("open"), F.col("asked.id")).alias("source_id"), F.when(since("pressed"), "strong").otherwise("weak").alias("strength"),
        F.when(since("decided"), "decide").otherwise("respond").alias("kind"), since("due").alias("has_deadline"),
        F.coalesce(F.col("open") & (F.col("done") > F.col("asked")), F.lit(False)).alias("completion_after"), (F.col("newest.batch_ts") < F.col("batch_ts")).alias("late"),
    )


def refolded(newest: DataFrame, m: DataFrame) -> DataFrame:
    """Open requests from the stream's newest rows, with threads marked late folded again from all their messages: a check of the stream, which needs it no more."""
    late = newest.where("late").select("thread_id")
    kept = newest.where("NOT late AND source_id IS NOT NULL").drop("late")
    return kept.unionByName(open_actions(m.join(late, "thread_id", "left_semi")).select(*[F.col(c) for c in kept.columns]))
