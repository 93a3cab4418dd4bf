"""The open request of a thread: fold, ladder of levels, closings, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions.dates import days_between, stamp, workdays_since
from lettergraph.operators.threads import key

EVIDENCE = ("has_strong_request", "has_weak_request", "has_decision", "has_question", "has_deadline", "mentions_me")


def _any(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col(n)
    return out


def fold_steps(m: DataFrame) -> DataFrame:
    """Each message with the window that its request belongs to.

    My own message that says something clears the slot, and so does a withdrawal, which may open it anew; messages in
    between form one window, in which strength, kind and deadline only grow.  Written with running sums, so a thread
    needs no list and Catalyst sees plain windows over one sort.
    """
    order = Window.partitionBy("thread_id").orderBy("sent_ts", "id")
    clears = (F.col("is_sent") & ~F.col("is_trivial")) | (~F.col("is_sent") & F.col("has_withdrawal"))
    evidence = ~F.col("is_sent") & _any(*EVIDENCE)
    steps = m.withColumn("clears", clears).withColumn("evidence", evidence)
    return steps.withColumn("window", F.sum(F.col("clears").cast("int")).over(order))


def open_actions(m: DataFrame, is_hard_noise: Column | None = None) -> DataFrame:
    """Threads with an open request: source, strength, kind, deadline, completion after it.

    Only the last window of a thread counts, so the rows meet in one aggregation with partial sums; hard noise is
    skipped before it.
    """
    rows = m if is_hard_noise is None else m.where(~is_hard_noise)
    steps = fold_steps(rows)
    source = F.max_by("id", F.when(F.col("evidence"), key()))
    grouped = steps.groupBy("thread_id", "window").agg(
        source.alias("source_id"), F.bool_or(F.col("evidence") & _any("has_strong_request", "has_decision")).alias("strong"), F.bool_or(F.col("evidence") & F.col("has_decision")).alias("decide"),
        F.bool_or(F.col("evidence") & F.col("has_deadline")).alias("has_deadline"), F.max(F.when(F.col("evidence"), key())).alias("last_evidence"),
        F.max(F.when(~F.col("is_sent") & F.col("has_completion") & ~F.col("evidence"), key())).alias("last_completion"),
    )
    last = grouped.groupBy("thread_id").agg(F.max_by(F.struct("source_id", "strong", "decide", "has_deadline", "last_evidence", "last_completion"), "window").alias("s")).select("thread_id", "s.*")
    return last.where(F.col("source_id").isNotNull()).select(
        "thread_id", "source_id", F.when(F.col("strong"), "strong").otherwise("weak").alias("strength"), F.when(F.col("decide"), "decide").otherwise("respond").alias("kind"),
        "has_deadline", F.coalesce(F.col("last_completion") > F.col("last_evidence"), F.lit(False)).alias("completion_after"),
    )


def closed_by_me(m: DataFrame, day: str) -> DataFrame:
    """Threads in which an own message of that day took the request from open to closed, even if it opened again."""
    order = Window.partitionBy("thread_id", "window")
    steps = fold_steps(m)
    before = steps.withColumn("was_open", F.max(F.col("evidence")).over(order))
    opened = before.groupBy("thread_id", (F.col("window") + 1).alias("window")).agg(F.bool_or("was_open").alias("open_before"))
    closing = steps.where(F.col("is_sent") & F.col("clears") & (F.col("sent_ts").cast("date") == F.lit(day).cast("date"))).select("thread_id", "window")
    return closing.join(opened.where("open_before"), ["thread_id", "window"], "left_semi").select("thread_id").distinct()


def levels(actions: DataFrame, m: DataFrame, me: list[str], hard_noise: Column, external: Column, direct_to: int = 3, broadcast_to: int = 15, dismissed: Column | None = None) -> DataFrame:
    """Required, maybe or none for each open request, with the reasons in order.

    The source message gives the recipients and its flags; ``hard_noise`` and ``external`` are conditions over it.
    """
    sources = m.select(
        F.col("id").alias("source_id"), F.coalesce("hidden", F.lit(False)).alias("hidden"), "sender_addr", "subject", "to_addrs", "cc_addrs", "has_question", "has_request", "mentions_me", "mentions_group", "subject_has_request"
    )
    mine = m.groupBy("thread_id").agg(F.bool_or("is_sent").alias("participated"))
    rows = actions.join(sources, "source_id").join(mine, "thread_id")
    own = F.array(*map(F.lit, me))
    to_me, cc_me = F.arrays_overlap("to_addrs", own), F.arrays_overlap("cc_addrs", own)
    direct, named = to_me & (F.size("to_addrs") <= direct_to), F.col("mentions_me")
    addressed = to_me | cc_me
    strong = F.col("strength") == "strong"
    case = (
        F.when(F.col("hidden"), "hidden").when(dismissed if dismissed is not None else F.lit(False), "user_dismissed").when(hard_noise, "hard_noise")
        .when(strong & direct, "strong_direct").when(strong & named & addressed, "strong_named").when(strong & to_me & F.col("participated"), "strong_participated")
        .when(strong & to_me & F.col("mentions_group"), "group_call").when(strong & to_me, "group_to").when(strong & cc_me, "cc_only").when(strong, "list_recipient")
        .when(F.col("has_question") & direct, "question_direct").when(F.col("subject_has_request") & direct, "subject_request")
        .when(named & addressed & (F.col("has_request") | F.col("has_question")), "named_request").when(named & addressed, "named_only")
        .when(direct, "weak_direct").when(addressed, "weak_group").otherwise("weak_unaddressed")
    )
    first = {
        "none": ("hidden", "user_dismissed", "hard_noise", "weak_unaddressed"),
        "required": ("strong_direct", "strong_named", "strong_participated", "group_call", "question_direct", "subject_request", "named_request"),
    }
    rows = rows.withColumn("case", case)
    out, must = F.col("case").isin(*first["none"]), F.col("case").isin(*first["required"])
    done, wide = F.col("completion_after"), (F.size("to_addrs") + F.size("cc_addrs") >= broadcast_to) & ~named
    outside = external & ~named
    required = must & ~done & ~wide
    level = F.when(out, "none").when(outside & ~required, "none").when(required & ~outside, "required").otherwise("maybe")
    reasons = F.array_compact(F.array(
        F.col("case"), F.when(~out & done, F.lit("completion_after")), F.when(~out & wide, F.lit("broadcast")), F.when(~out & outside, F.lit("external"))
    ))
    return rows.select("thread_id", "source_id", level.alias("level"), F.when(level == "none", "").otherwise(F.col("kind")).alias("kind"), "has_deadline", reasons.alias("reasons"))


def audit(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Confusion counts of the newest truth label a thread against the current level."""
    newest = truth.groupBy("thread_id").agg(F.max_by("label", "labelled_at").alias("truth"))
    return newest.join(predicted, "thread_id", "left").groupBy("truth", F.coalesce("level", F.lit("none")).alias("level")).agg(F.count("*").alias("n"))


def stalled(tails: DataFrame, today: str, stall_days: int = 3, stale_days: int = 5, max_days: int = 21, holidays: list[str] | None = None) -> DataFrame:
    """Threads that wait: mine (my message is last) or the other side's, by working days, up to ``max_days``."""
    end, last = F.lit(today).cast("date"), F.to_timestamp_ntz("sent_on", F.lit("yyyy-MM-dd HH:mm:ss"))
    work = workdays_since(last, end, holidays)
    category = F.when(F.col("is_sent") & (work >= stall_days), "stalled_mine").when(~F.col("is_sent") & (F.col("message_count") >= 2) & (F.col("sent_count") > 0) & (work >= stale_days), "stalled_thread")
    return tails.select("thread_id", category.alias("category"), work.alias("workdays"), days_between(last, end).alias("days")).where(F.col("category").isNotNull() & (F.col("days") <= max_days))


def intervention_queue(tails: DataFrame, levels_: DataFrame, today: str, **limits) -> DataFrame:
    """What needs me: open requests first, then candidates, then what waits; ordered by kind and age."""
    asked = levels_.where("level <> 'none'").join(tails.select("thread_id", "sent_on"), "thread_id").select(
        "thread_id", F.when(F.col("level") == "required", F.col("kind")).otherwise("candidate").alias("category"),
        days_between(F.to_timestamp_ntz("sent_on", F.lit("yyyy-MM-dd HH:mm:ss")), F.lit(today).cast("date")).alias("days"),
    )
    waits = stalled(tails, today, **limits).join(asked.select("thread_id"), "thread_id", "left_anti").select("thread_id", "category", "days")
    both = asked.unionByName(waits)
    rank = F.array_position(F.array(*map(F.lit, ("decide", "respond", "stalled_mine", "stalled_thread", "candidate"))), F.col("category"))
    return both.where(F.col("days") <= limits.get("max_days", 21)).withColumn("rank", rank.cast("int")).orderBy("rank", F.col("days").desc(), "thread_id")


def state_shift(before: DataFrame, now: DataFrame) -> DataFrame:
    """Two boards (thread_id, state) compared: what appeared, changed or was resolved."""
    both = before.withColumnRenamed("state", "old").join(now.withColumnRenamed("state", "new"), "thread_id", "full_outer")
    change = (
        F.when((F.col("new") == "mine") & ~F.col("old").eqNullSafe("mine"), "new_mine").when((F.col("new") == "stuck") & ~F.col("old").eqNullSafe("stuck"), "new_stuck")
        .when(F.col("old").isin("mine", "stuck") & ~F.coalesce(F.col("new").isin("mine", "stuck"), F.lit(False)), "resolved")
    )
    return both.select("thread_id", change.alias("shift")).where("shift IS NOT NULL")


def latest_stamp(m: DataFrame) -> DataFrame:
    return m.groupBy("thread_id").agg(stamp(F.max("sent_ts")).alias("last_on"))
