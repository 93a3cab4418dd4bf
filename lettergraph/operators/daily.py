"""One day's and one period's material: digests, headlines, deadline signals, last lines, a person's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions import rules
from lettergraph.functions.dates import stamp, week_start
from lettergraph.functions.text import collapsed, own_text, sentences
from lettergraph.operators.stats import medians, reply_pairs
from lettergraph.operators.threads import key, on_day


def deadline_signals(m: DataFrame, day: str, noisy: Column, few: int = 3) -> DataFrame:
    """The first received message of a day with a deadline in each thread, to few recipients, no noise."""
    rows = on_day(m, day, sent=False).where(F.col("has_deadline") & ~noisy & (F.size("to_addrs") + F.size("cc_addrs") < few))
    return rows.groupBy("thread_id").agg(F.min_by("id", key()).alias("id"))


def day_digest(m: DataFrame, day: str, kinds: DataFrame) -> DataFrame:
    """Work threads with mail on a day: messages, who wrote last; where that was me, who wrote to me last."""
    start = F.lit(day).cast("timestamp_ntz")
    today = m.where((F.col("sent_ts") >= start) & (F.col("sent_ts") < start + F.make_dt_interval(F.lit(1))))
    active = today.groupBy("thread_id").agg(F.count("*").alias("n"), F.max_by("is_sent", key()).alias("mine_last"))
    inbound = m.where(~F.col("is_sent") & (F.col("sent_ts") < start + F.make_dt_interval(F.lit(1)))).groupBy("thread_id").agg(F.max_by("sender_addr", key()).alias("who"))
    return active.join(kinds.where("kind = 'work'").select("thread_id"), "thread_id", "left_semi").join(inbound, "thread_id", "left").select("thread_id", "n", "mine_last", F.coalesce("who", F.lit("")).alias("who"))


def headlines(scored: DataFrame, active: DataFrame, promised: DataFrame, least: int = 5, top: int = 3) -> DataFrame:
    """The day's most telling threads: active, and well scored, promised in or with a deadline."""
    rows = scored.join(active.select("thread_id").distinct(), "thread_id", "left_semi").join(promised.select("thread_id", F.lit(True).alias("promised")).distinct(), "thread_id", "left")
    worth = (F.col("score") >= least) | F.coalesce("promised", F.lit(False)) | (F.col("deadlines") > 0)
    return rows.where(worth).orderBy(F.col("score").desc(), F.col("last_ts").desc(), "thread_id").limit(top).select("thread_id", "score", stamp(F.col("last_ts")).alias("last_on"))


def last_lines(m: DataFrame, most: int = 120) -> DataFrame:
    """First sentence of each thread's newest message that says something; me for my own."""
    said = F.trim(own_text(F.coalesce("body", F.lit(""))))
    rows = m.withColumn("said", said).where("said <> ''").groupBy("thread_id").agg(F.max_by(F.struct("id", "said", "is_sent", "sender_addr"), key()).alias("r"))
    first = F.get(sentences(F.col("r.said")), F.lit(0))
    return rows.select("thread_id", F.col("r.id").alias("id"), F.when(F.col("r.is_sent"), "me").otherwise(F.col("r.sender_addr")).alias("who"), F.substring(collapsed(first), 1, most).alias("line"))


def fallback_facts(m: DataFrame, least: int = 10) -> DataFrame:
    """A fact a thread when nothing better was verified: the newest message's first sentence of some length."""
    newest = m.groupBy("thread_id").agg(F.max_by(F.struct("id", "body"), key()).alias("r"))
    fact = F.get(F.filter(sentences(own_text(F.col("r.body"))), lambda s: F.length(s) >= least), F.lit(0))
    return newest.select("thread_id", F.col("r.id").alias("id"), fact.alias("fact")).where("fact IS NOT NULL")


def tone_samples(m: DataFrame, among: int = 400, least: int = 400, limit: int = 2, subject: str = r"(?iU)report|주간|보고") -> DataFrame:
    """Own reports to learn a tone from: among the last sent messages, report-like and long."""
    last = m.where("is_sent").orderBy(F.col("sent_ts").desc(), F.col("id").desc()).limit(among)
    return last.where(F.col("subject").rlike(subject) & (F.length(own_text(F.col("body"))) >= least)).orderBy(F.col("sent_ts").desc(), F.col("id").desc()).limit(limit)


def person_weeks(m: DataFrame, addr: str) -> DataFrame:
    """Messages from and to one person by week."""
    hit = (F.col("sender_addr") == addr) | (F.col("is_sent") & (F.array_contains("to_addrs", addr) | F.array_contains("cc_addrs", addr)))
    return m.where(hit).groupBy(F.date_format(week_start(F.col("sent_ts")), "yyyy-MM-dd").alias("week")).agg(F.count_if(~F.col("is_sent")).alias("received"), F.count_if("is_sent").alias("sent"))


def person_response(m: DataFrame) -> DataFrame:
    """Median hours both ways with every counterpart."""
    one = lambda mine, name: medians(reply_pairs(m, mine).withColumnRenamed("who", "addr"), ["addr"], "hours").select("addr", F.col("median").alias(name), F.col("n").alias(f"n_{name}"))
    return one(True, "mine").join(one(False, "theirs"), "addr", "full_outer")


def totals(m: DataFrame) -> DataFrame:
    """What the store holds."""
    return m.agg(F.count("*").alias("messages"), F.count_distinct("thread_id").alias("threads"), F.count_if("is_sent").alias("sent"), F.count_if(~F.col("is_sent") & ~F.col("read")).alias("unread"),
                 stamp(F.min("sent_ts")).alias("first_on"), stamp(F.max("sent_ts")).alias("last_on"), F.max("seq").alias("basis"))


def recent(m: DataFrame, limit: int = 30) -> DataFrame:
    return m.orderBy(F.col("sent_ts").desc(), F.col("id").desc()).limit(limit).select("id", "thread_id", stamp(F.col("sent_ts")).alias("sent_on"), "subject")


def numbering_faults(m: DataFrame) -> DataFrame:
    """Ids whose day is not the day of their message, and ids used twice."""
    day = (F.year("sent_ts") % 100) * 10_000 + F.month("sent_ts") * 100 + F.dayofmonth("sent_ts")
    twice = F.count("*").over(Window.partitionBy("id"))
    return m.select("id", (F.floor(F.col("id") / 100_000) != day).alias("wrong_day"), (twice > 1).alias("twice")).where("wrong_day OR twice")


def shown_attachments(names: Column) -> Column:
    """Without images that a mail program named itself."""
    return F.filter(names, lambda n: ~n.rlike(r"(?i)^image\d{3}\.(png|jpe?g|gif)$"))


def preserved_turns(text: Column) -> Column:
    """Quoted history cut into turns, oldest first: array<struct<who,date,subject,body>>; mail programs put the newest on top."""
    block = F.concat(F.lit("\n"), text)
    parts = F.filter(F.split(block, r"(?iU)\n(?=\s*[*_]{0,3}\s*(?:보낸\s*사람|From|De|Von|Da|Van|发件人|寄件者|差出人)\s*[*_]{0,3}\s*[:：])"), lambda p: p.rlike(rules.HEADER_FIRST))
    field = lambda p, names: F.trim(F.regexp_extract(p, rf"(?imU)^\s*[*_]{{0,3}}\s*(?:{names})\s*[*_]{{0,3}}\s*[:：]\s*(.*)$", 1))
    turns = F.transform(parts, lambda p: F.struct(
        field(p, r"보낸\s*사람|From|De|Von|Da|Van|发件人|寄件者|差出人").alias("who"), field(p, r"보낸\s*날짜|날짜|Sent|Date|Gesendet|Envoyé|Datum|Fecha|送信日時|发送时间").alias("date"),
        field(p, r"제목|Subject|Betreff|Objet|Asunto|Oggetto|件名|主题").alias("subject"), F.trim(F.array_join(F.filter(F.split(p, "\n"), lambda x: ~x.rlike(rules.HEADER_FIRST) & ~x.rlike(rules.HEADER_FOLLOW)), "\n"), F.lit(" \n")).alias("body"),
    ))
    return F.reverse(turns)
