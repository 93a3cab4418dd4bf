"""Thread aggregates, tails, lists and the overlays a reader sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettergraph.functions.dates import stamp

def key() -> Column:
    """Messages in time order, ids deciding ties."""
    return F.struct("sent_ts", "id")


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def thread_aggregates(m: DataFrame) -> DataFrame:
    """One row a thread: first and latest message and the counters, in one partial aggregation."""
    got = ~F.col("is_sent")
    return m.groupBy("thread_id").agg(
        F.min_by("id", key()).alias("first_id"), F.max_by("id", key()).alias("latest_id"), F.min("sent_ts").alias("first_ts"), F.max("sent_ts").alias("last_ts"),
        F.count("*").alias("message_count"), _count(F.col("is_sent")).alias("sent_count"), _count(got).alias("received_count"),
        _count(got & ~F.col("read")).alias("unread_received"), _count(got & F.col("addressed_to_me")).alias("addressed_count"), _count(got & F.col("has_deadline")).alias("deadline_count"),
    )


def first_last(m: DataFrame) -> DataFrame:
    """Sender and subject of each thread's first and latest message."""
    row = F.struct("id", "sender_addr", "subject", "is_sent")
    ends = m.groupBy("thread_id").agg(F.min_by(row, key()).alias("f"), F.max_by(row, key()).alias("l"))
    return ends.select("thread_id", F.col("f.id").alias("first_id"), F.col("f.subject").alias("first_subject"), F.col("l.id").alias("last_id"),
                       F.col("l.sender_addr").alias("last_sender"), F.col("l.is_sent").alias("last_is_sent"))


def thread_tails(m: DataFrame) -> DataFrame:
    """Latest message of each visible thread with the thread's counters; messages gone from the mailbox do not count."""
    here = m.where(~F.col("gone") & ~F.coalesce("hidden", F.lit(False)))
    tail = F.max_by(F.struct("id", "sent_ts", "is_sent", "sender_addr", "subject", "has_question", "has_deadline"), key()).alias("t")
    tails = here.groupBy("thread_id").agg(tail, F.count("*").alias("message_count"), _count("is_sent").alias("sent_count"))
    return tails.select(
        "thread_id", F.col("t.id").alias("latest_id"), stamp(F.col("t.sent_ts")).alias("sent_on"), F.col("t.is_sent").alias("is_sent"), F.col("t.sender_addr").alias("sender_addr"),
        F.col("t.subject").alias("subject"), F.col("t.has_question").alias("has_question"), F.col("t.has_deadline").alias("has_deadline"), "message_count", "sent_count",
    )


def unanswered(m: DataFrame, me: str, asof: Column, days: int = 14, max_recipients: int = 50) -> DataFrame:
    """Visible threads whose latest message came in, addressed to me among few, within ``days`` of ``asof``."""
    last = m.where(~F.coalesce("hidden", F.lit(False))).groupBy("thread_id").agg(F.max_by(F.struct("id", "sent_ts", "is_sent", "gone", "to_addrs", "subject"), key()).alias("l")).select("thread_id", "l.*")
    seconds = F.unix_seconds(asof.cast("timestamp")) - F.unix_seconds(F.col("sent_ts").cast("timestamp"))
    return last.where(
        ~F.col("is_sent") & ~F.col("gone") & F.array_contains("to_addrs", me) & (F.size("to_addrs") < max_recipients) & (F.col("sent_ts") >= asof - F.make_dt_interval(F.lit(days)))
    ).select("thread_id", "id", stamp(F.col("sent_ts")).alias("sent_on"), "subject", F.floor(seconds / 86_400).cast("bigint").alias("days_old"))


def on_day(m: DataFrame, day: str, sent: bool) -> DataFrame:
    """Messages of one day in one direction; a half-open range, so the scan can prune."""
    start = F.lit(day).cast("timestamp_ntz")
    return m.where((F.col("sent_ts") >= start) & (F.col("sent_ts") < start + F.make_dt_interval(F.lit(1))) & (F.col("is_sent") == sent))


def active_between(m: DataFrame, start: str, end: str) -> DataFrame:
    """Threads with a message from ``start`` to the end of day ``end``."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))
    return m.where((F.col("sent_ts") >= lo) & (F.col("sent_ts") < hi)).select("thread_id").distinct()


def tab_counts(m: DataFrame, noise_threads: DataFrame, flagged: Column, noted: Column) -> DataFrame:
    """Mailbox tabs in one pass over the threads: all, unread, flagged, noted, hidden; noise threads are left out."""
    got = m.where(~F.col("is_sent")).groupBy("thread_id").agg(F.bool_or(~F.col("read")).alias("unread"), F.bool_or(F.coalesce("hidden", F.lit(False))).alias("hidden"))
    kept = got.join(noise_threads.select("thread_id"), "thread_id", "left_anti").withColumns({"flagged": flagged, "noted": noted})
    shown = ~F.col("hidden")
    return kept.agg(_count(shown).alias("n_all"), _count(shown & F.col("unread")).alias("n_unread"), _count(shown & F.col("flagged")).alias("n_flagged"),
                    _count(shown & F.col("noted")).alias("n_noted"), _count(F.col("hidden")).alias("n_hidden"))


def thread_page(m: DataFrame, limit: int, offset: int = 0, tab: Column | None = None) -> DataFrame:
    """One page of the thread list, newest first; hot when three or more messages or five days long.

    ``tab`` narrows the list: a condition over thread_id, n, unread_n, first_ts and last_ts.
    """
    rows = m.where(~F.coalesce("hidden", F.lit(False))).groupBy("thread_id").agg(
        F.min_by("subject", key()).alias("first_subject"), F.max_by("sender_addr", key()).alias("last_sender"), F.count("*").alias("n"), _count(~F.col("is_sent") & ~F.col("read")).alias("unread_n"),
        F.min("sent_ts").alias("first_ts"), F.max("sent_ts").alias("last_ts"),
    )
    hot = (F.col("n") >= 3) | (F.datediff("last_ts", "first_ts") >= 5)
    page = (rows if tab is None else rows.where(tab)).orderBy(F.col("last_ts").desc(), "thread_id").offset(offset).limit(limit)
    return page.select("thread_id", "first_subject", "last_sender", "n", "unread_n", stamp(F.col("last_ts")).alias("last_on"), hot.alias("hot"))


def thread_messages(m: DataFrame, thread_id: int, author: str | None = None) -> DataFrame:
    """A thread's messages in time order, of one author if named."""
    rows = m.where(F.col("thread_id") == thread_id)
    return (rows if author is None else rows.where(F.lower("sender_addr") == author.lower())).orderBy("sent_ts", "id")


def overlay(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Flags a reader set (hide, flag, dismiss, done): the newest row of a key wins over all older ones."""
    both = current.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("s")).select(*keys, "s.*")


def still_hidden(m: DataFrame, hides: DataFrame) -> DataFrame:
    """Threads hidden after their last received message: new mail brings a thread back. ``hides``: thread_id, hidden_ts."""
    last = m.where(~F.col("is_sent")).groupBy("thread_id").agg(F.max("sent_ts").alias("last_in"))
    return hides.join(last, "thread_id", "left").where(F.col("last_in").isNull() | (F.col("last_in") <= F.col("hidden_ts"))).select("thread_id")


def related_threads(m: DataFrame, thread_id: int, terms: list[str], limit: int = 5) -> DataFrame:
    """Visible threads that share a subject term with a thread or its first counterpart; the newest ones."""
    here = m.where((F.col("thread_id") == thread_id) & ~F.col("is_sent"))
    partner = here.groupBy().agg(F.min_by("sender_addr", key()).alias("who"))
    term = F.lit(False)
    for t in terms[:3]:
        term = term | F.contains(F.lower("subject"), F.lit(t.lower()))
    other = m.where((F.col("thread_id") != thread_id) & ~F.coalesce("hidden", F.lit(False))).join(F.broadcast(partner))  # one row
    hit = other.where(term | (F.col("sender_addr") == F.col("who")))
    return hit.groupBy("thread_id").agg(F.max("sent_ts").alias("last_ts"), F.max_by("body", key()).alias("excerpt")).orderBy(F.col("last_ts").desc(), "thread_id").limit(limit)


def recipient_label(addrs: Column, names: Column, me: str) -> Column:
    """"First and N more" over an address list; me is named last."""
    shown = F.filter(addrs, lambda a: a != me)
    shown = F.when(F.size(shown) < F.size(addrs), F.array_append(shown, F.lit("me"))).otherwise(shown)
    named = F.transform(shown, lambda a: F.coalesce(F.element_at(names, a), a))
    return F.when(F.size(named) == 0, "").when(F.size(named) == 1, F.get(named, F.lit(0))).otherwise(F.concat(F.get(named, F.lit(0)), F.lit(" +"), (F.size(named) - 1).cast("string")))
