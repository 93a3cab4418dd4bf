"""Chat formatting: event-sourced conversations folded into messages and rendered.

The log has one row an event: ``conv_id, seq, msg, branch, kind, role, text``.
A sequence is a number or anything else that has an order.  Kind ``message`` opens message ``msg`` with a role and a first text, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` empties it and drops
the later messages that were there at that time.  The log is grouped by message
first, its events sorted by sequence and folded; then by conversation.

The template is ``<|turn|>ROLE<|text|>TEXT<|end|>`` and a newline a turn.  In
roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so that no
content can hold a marker, and ``unescape`` gives the content back.  Assistant
texts are under the loss mask, as code point spans of the output.

Defined cases: null text and role are empty; a null sequence, message number or
conversation sorts first and is a value; events of one sequence number apply in
the order message, edit, regenerate, delta, then by text; an event that comes
twice applies twice, and rows of a turn table that repeat are turns of their own;
an empty log has no conversations; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
KIND_ORDER = ("message", "edit", "regenerate", "delta")


def escape(content: Column) -> Column:
    return F.replace(F.replace(content, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(content: Column) -> Column:
    return F.replace(F.replace(content, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def turn_events(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of turns as a log of ``message`` events; rows of one turn number become branches side by side."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("msg"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    ).groupBy("conv_id", "msg", "role", "text").agg(F.count("*").alias("copies"))
    each = rows.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    return each.select("conv_id", F.col("msg").alias("seq"), "msg", F.xxhash64("role", "text", "copy").alias("branch"), F.lit("message").alias("kind"), "role", "text")


def turn_log(turns: DataFrame, pieces: int = 4, **columns) -> DataFrame:
    """A table of turns as the log of a chat service that came to the same end: by a hash of the turn it was written at once,
    streamed as deltas, drafted wrongly and edited before the rest was streamed, or answered wrongly, followed by a further
    message, and regenerated, which drops that one.

    A sequence number is the turn's number and the event's, so turn numbers of any size and type do; turns without a number,
    and one with the largest of all, are written at once.
    """
    whole = turn_events(turns, **columns).withColumn("msg", F.col("msg").cast("bigint"))
    way = F.when(F.expr("try_add(msg, 1)").isNull(), 0).otherwise(F.pmod(F.xxhash64("conv_id", "msg", "branch"), F.lit(4)))
    text, size = F.col("text"), F.length("text")

    def event(kind: str, what, msg=F.col("msg"), branch=F.col("branch")):
        return F.struct(F.lit(kind).alias("kind"), (what if not isinstance(what, str) else F.lit(what)).alias("text"), msg.alias("msg"), branch.alias("branch"))

    def deltas(start: Column):
        """What follows the first ``start`` letters, in pieces."""
        step = F.greatest(F.ceil((size - start) / pieces), F.lit(1)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, start + i * step + 1, step))
        return F.transform(F.filter(cut, lambda p: p != ""), lambda p: event("delta", p))

    half = F.floor(size / 2).cast("int")
    events = (
        F.when(way == 0, F.array(event("message", text)))
        .when(way == 1, F.concat(F.array(event("message", "")), deltas(F.lit(0))))
        .when(way == 2, F.concat(F.array(event("message", F.concat(F.lit("draft "), F.reverse(text))), event("delta", " more"), event("edit", F.substring(text, F.lit(1), half))), deltas(half)))
        .otherwise(F.concat(
            F.array(event("message", "wrong"), event("delta", " answer"), event("message", "gone with it", F.expr("try_add(msg, 1)"), F.col("branch").bitwiseXOR(F.lit(1))), event("regenerate", "")), deltas(F.lit(0))
        ))
    )
    each = whole.select("conv_id", F.col("msg").alias("turn"), "role", F.posexplode(events).alias("i", "e"))
    return each.select(
        "conv_id", F.struct("turn", "i").alias("seq"), "e.msg", "e.branch", "e.kind", F.when(F.col("e.kind") == "message", F.col("role")).alias("role"), "e.text"
    )


def fold_messages(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, branch, role, text."""
    rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    event = F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role"))
    logs = events.groupBy("conv_id", "msg", "branch").agg(F.sort_array(F.collect_list(event)).alias("log"))
    resets = F.filter(F.transform("log", lambda e, i: F.when(e["rank"] < len(KIND_ORDER), i + 1).otherwise(0)), lambda i: i > 0)
    since = F.greatest(F.coalesce(F.array_max(resets), F.lit(1)), F.lit(1))
    redone = F.array_max(F.transform(F.filter("log", lambda e: e["rank"] == KIND_ORDER.index("regenerate") + 1), lambda e: e["seq"]))
    messages = logs.select(
        "conv_id", "msg", "branch", F.col("log")[0]["seq"].alias("opened"), redone.alias("redone"),
        F.coalesce(F.get(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform(F.slice("log", since, F.size("log")), lambda e: e["text"]), "").alias("text"),
    )
    # A message goes when an earlier one was regenerated after it was opened.
    earlier = Window.partitionBy("conv_id").orderBy(F.col("msg").cast("decimal(20)").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    return (
        messages.withColumn("cut", F.max("redone").over(earlier)).where(F.col("cut").isNull() | F.coalesce(F.col("opened") > F.col("cut"), F.lit(False)))
        .select("conv_id", "msg", "branch", "role", "text")
    )


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row a conversation: formatted text and loss mask (code point spans)."""
    parts = messages.select(
        "conv_id", F.struct(F.col("msg"), F.col("role"), F.col("text"), F.col("branch")).alias("place"),
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == learn_role).alias("learn"),
    ).withColumn("size", F.length("head") + F.length("body") + len(END))
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(so_far), F.lit(0)) + F.length("head")
    placed = parts.withColumn("start", start)
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "head", "body", "learn"))).alias("t"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["body"])).alias("end"))).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role,text>>."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    inner = lambda p: F.substring(p, F.lit(len(TURN) + 1), F.length(p))
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(inner(p), TEXT, 1)).alias("role"),
        unescape(F.substring(inner(p), F.length(F.substring_index(inner(p), TEXT, 1)) + len(TEXT) + 1, F.length(p))).alias("text"),
    ))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped and joined."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def format_conversations(turns: DataFrame, **columns) -> DataFrame:
    """Turn table to formatted conversations, by way of the event log."""
    return render(fold_messages(turn_events(turns, **columns)))
