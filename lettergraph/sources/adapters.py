"""The message schema, and tables presented in it.

A message has: id, thread_id, seq (arrival order), sent_ts, is_sent, sender_addr,
sender_name, to_addrs, cc_addrs, subject, body, read, gone, and the signal flags
of ``FLAGS``.  Every operator is written against these names; an adapter gives
another table that shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ME = "me@home.test"
FLAGS = (
    "has_deadline", "has_decision", "has_request", "has_strong_request", "has_weak_request", "has_question", "has_completion", "has_withdrawal",
    "mentions_me", "mentions_group", "is_trivial", "subject_has_request", "addressed_to_me",
)


def _peer(user: Column) -> Column:
    return F.concat(F.lit("u"), user.cast("string"), F.lit("@d"), (user % 7).cast("string"), F.lit(".test"))


def event_messages(events: DataFrame) -> DataFrame:
    """Events as messages between me and one peer a user: purchases and signups are mine, the rest comes in."""
    kind, value, user = F.col("event_type"), F.col("value"), F.col("user_id")
    mine = kind.isin("purchase", "signup")
    flags = {
        "has_deadline": (kind == "error") & (value >= 60),
        "has_decision": (kind == "click") & (value >= 100),
        "has_request": kind == "click",
        "has_strong_request": (kind == "click") & (value >= 35),
        "has_weak_request": (kind == "click") & (value < 35),
        "has_question": (kind == "view") & (value < 20),
        "has_completion": (kind == "view") & (value >= 60),
        "has_withdrawal": (kind == "error") & (value < 10),
        "mentions_me": (kind == "click") & (value < 2),
        "mentions_group": (kind == "view") & (value < 5),
        "is_trivial": (kind == "signup") & (value < 20),
        "subject_has_request": (kind == "click") & (value >= 200),
        "addressed_to_me": ~mine,
    }
    everyone = F.array(F.lit(ME), _peer(user + 1), F.lit("list@home.test"))
    return events.select(
        F.col("event_id").alias("id"), user.alias("thread_id"), (F.col("event_id") + 1).alias("seq"), F.col("ts").alias("sent_ts"), mine.alias("is_sent"),
        F.when(mine, F.lit(ME)).otherwise(_peer(user)).alias("sender_addr"),
        F.when(mine, F.lit("")).otherwise(F.concat(F.lit("User "), user.cast("string"))).alias("sender_name"),
        F.when(mine, F.array(_peer(user))).when(kind == "view", everyone).otherwise(F.array(F.lit(ME))).alias("to_addrs"),
        F.when(kind == "click", F.array(_peer(user + 2))).otherwise(F.array().cast("array<string>")).alias("cc_addrs"),
        F.concat_ws(" ", kind, user.cast("string")).alias("subject"), F.col("props").alias("body"),
        (mine | (value < 30)).alias("read"), F.lit(False).alias("gone"), (user % 29 == 0).alias("hidden"),
        *[v.alias(k) for k, v in flags.items()],
    )


def document_messages(docs: DataFrame) -> DataFrame:
    """Documents as messages: the source is the sender, the first line the subject."""
    return docs.select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 97).alias("thread_id"), (F.col("doc_id") + 1).alias("seq"), F.col("source").alias("sender_addr"),
        F.substring_index("text", "\n", 1).alias("subject"), F.col("text").alias("body"), F.col("lang").alias("folder"),
    )


def conversation_messages(turns: DataFrame) -> DataFrame:
    """Conversations as threads: the user is me."""
    return turns.select(
        F.col("conv_id").alias("thread_id"), (F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), F.col("turn").alias("seq"),
        (F.col("role") == "user").alias("is_sent"), F.col("role").alias("sender_addr"), F.col("text").alias("body"),
    )


def order_messages(orders: DataFrame) -> DataFrame:
    """Orders as messages of one thread a customer."""
    cust = F.col("o_custkey")
    mine = F.col("o_orderkey") % 3 == 0
    return orders.select(
        F.col("o_orderkey").alias("id"), cust.alias("thread_id"), F.col("o_orderdate").alias("sent_ts"), mine.alias("is_sent"),
        F.when(mine, F.lit(ME)).otherwise(_peer(cust)).alias("sender_addr"), F.array(F.when(mine, _peer(cust)).otherwise(F.lit(ME))).alias("to_addrs"),
        F.array().cast("array<string>").alias("cc_addrs"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("body"),
    )


def _peer_sql(user: str) -> str:
    return f"'u' || ({user})::VARCHAR || '@d' || (({user}) % 7)::VARCHAR || '.test'"


_MINE = "event_type IN ('purchase', 'signup')"

#: The same adapters as DuckDB common table expressions named ``m``.
EVENT_SQL = f"""m AS (SELECT event_id AS id, user_id AS thread_id, event_id + 1 AS seq, ts AS sent_ts, {_MINE} AS is_sent,
  CASE WHEN {_MINE} THEN '{ME}' ELSE {_peer_sql('user_id')} END AS sender_addr, CASE WHEN {_MINE} THEN '' ELSE 'User ' || user_id::VARCHAR END AS sender_name,
  CASE WHEN {_MINE} THEN [{_peer_sql('user_id')}] WHEN event_type = 'view' THEN ['{ME}', {_peer_sql('user_id + 1')}, 'list@home.test'] ELSE ['{ME}'] END AS to_addrs,
  CASE WHEN event_type = 'click' THEN [{_peer_sql('user_id + 2')}] ELSE []::VARCHAR[] END AS cc_addrs,
  event_type || ' ' || user_id::VARCHAR AS subject, props AS body, ({_MINE} OR value < 30) AS read, user_id % 29 = 0 AS hidden,
  event_type = 'error' AND value >= 60 AS has_deadline, event_type = 'click' AND value >= 100 AS has_decision, event_type = 'click' AS has_request,
  event_type = 'click' AND value >= 35 AS has_strong_request, event_type = 'click' AND value < 35 AS has_weak_request, event_type = 'view' AND value < 20 AS has_question,
  event_type = 'view' AND value >= 60 AS has_completion, event_type = 'error' AND value < 10 AS has_withdrawal, event_type = 'click' AND value < 2 AS mentions_me,
  event_type = 'view' AND value < 5 AS mentions_group, event_type = 'signup' AND value < 20 AS is_trivial, event_type = 'click' AND value >= 200 AS subject_has_request,
  NOT {_MINE} AS addressed_to_me FROM events)"""
DOCUMENT_SQL = "m AS (SELECT doc_id AS id, doc_id % 97 AS thread_id, source AS sender_addr, split_part(text, chr(10), 1) AS subject, text AS body, lang AS folder FROM documents)"
CONVERSATION_SQL = "m AS (SELECT conv_id AS thread_id, conv_id * 10000 + turn AS id, turn AS seq, role = 'user' AS is_sent, role AS sender_addr, text AS body FROM conversations)"
ORDER_SQL = f"""m AS (SELECT o_orderkey AS id, o_custkey AS thread_id, o_orderdate AS sent_ts, o_orderkey % 3 = 0 AS is_sent,
  CASE WHEN o_orderkey % 3 = 0 THEN '{ME}' ELSE {_peer_sql('o_custkey')} END AS sender_addr, [CASE WHEN o_orderkey % 3 = 0 THEN {_peer_sql('o_custkey')} ELSE '{ME}' END] AS to_addrs,
  []::VARCHAR[] AS cc_addrs, o_orderpriority AS subject, o_orderstatus AS body FROM orders)"""
