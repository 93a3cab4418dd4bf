"""Boards and reports as rows of text; sections read back; what models say, checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions.text import collapsed
from lettergraph.operators.evidence import verified_quotes


def board_lines(states: DataFrame, top: int = 5) -> DataFrame:
    """One line a thread for the best of each state, and ``and N more`` where there are more."""
    order = Window.partitionBy("state").orderBy(F.col("score").desc(), "thread_id")
    rows = states.withColumn("nr", F.row_number().over(order))
    best = rows.where(F.col("nr") <= top).groupBy("state").agg(F.sort_array(F.collect_list(F.struct("nr", F.concat(F.lit("- #"), F.col("thread_id").cast("string"), F.lit(" ("), F.col("score").cast("string"), F.lit(")")).alias("line")))).alias("l"))
    sizes = states.groupBy("state").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > top, F.concat(F.lit("\nand "), (F.col("n") - top).cast("string"), F.lit(" more"))).otherwise("")
    return best.join(sizes, "state").select("state", "n", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), more).alias("text"))


def report_text(lines: DataFrame, title: str, order: tuple[str, ...] = ("mine", "stuck", "waiting", "done")) -> DataFrame:
    """The board as one Markdown text, sections in order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("state"))
    parts = lines.agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), F.concat(F.lit("## "), "state", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), "text").alias("part")))).alias("p"))
    return parts.select(F.lit(title).alias("name"), F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("p", lambda x: x["part"]), "\n\n")).alias("text"))


def sections(text: Column) -> Column:
    """A report's sections: map of heading to body."""
    parts = F.filter(F.split(text, r"(?m)^## "), lambda p: F.trim(p) != "")
    named = F.filter(parts, lambda p: ~p.startswith("# "))
    return F.map_from_entries(F.transform(named, lambda p: F.struct(F.trim(F.regexp_replace(F.substring_index(p, "\n", 1), r"\s*\(\d+\)$", "")), F.trim(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p)), F.lit(" \n")))))


def without_lines(text: Column, keys: Column) -> Column:
    """A saved report without the lines of items that were done since."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.exists(keys, lambda k: F.contains(line, k))), "\n")


def harvest_items(text: Column) -> Column:
    """Lines ``- [#thread] statement :: "quote"`` as array<struct<thread_id,statement,quote>>."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r'^\s*-\s*\[#\d+\].*::\s*".*"\s*$'))
    return F.transform(lines, lambda s: F.struct(
        F.regexp_extract(s, r"\[#(\d+)\]", 1).cast("bigint").alias("thread_id"), collapsed(F.regexp_extract(s, r"\]\s*(.*?)\s*::", 1)).alias("statement"), F.regexp_extract(s, r'::\s*"(.*)"\s*$', 1).alias("quote")
    ))


def kept_claims(answers: DataFrame, m: DataFrame) -> DataFrame:
    """A model's claims that stand: their quote is in the message they name.  ``answers``: key, claims array<struct<mid,role,text,quote>>."""
    rows = answers.select("key", F.posexplode("claims").alias("nr", "c")).select("key", "nr", "c.*").where(F.trim("text") != "")
    return verified_quotes(rows, m)


def harvest_window(m: DataFrame, day: str, last: str | None, days: int = 2) -> DataFrame:
    """Messages to harvest: from ``days`` before a day to its end, and after the last harvest; never backwards."""
    end = F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))
    rows = m.where((F.col("sent_ts") >= F.lit(day).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days - 1))) & (F.col("sent_ts") < end))
    return rows.where(F.col("sent_ts") > F.lit(last).cast("timestamp_ntz")) if last else rows


def merged_harvests(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two runs of one day: items by thread and statement, the newer one's wording kept."""
    both = old.withColumn("run", F.lit(0)).unionByName(new.withColumn("run", F.lit(1)))
    return both.groupBy("thread_id", F.lower(collapsed(F.col("statement"))).alias("key")).agg(F.max_by(F.struct("statement", "quote"), "run").alias("s")).select("thread_id", "s.*")


def new_candidates(found: DataFrame, known: DataFrame) -> DataFrame:
    """Knowledge candidates whose title is not pending or saved yet."""
    key = lambda df: df.withColumn("key", F.lower(collapsed(F.col("title"))))
    return key(found).dropDuplicates(["key"]).join(key(known).select("key").distinct(), "key", "left_anti").drop("key")


def newest_question(asked: DataFrame, limit: int = 20) -> DataFrame:
    """The last answer of each question, newest first."""
    rows = asked.groupBy("question").agg(F.max_by(F.struct("id", "answer", "created"), "id").alias("s")).select("question", "s.*")
    return rows.orderBy(F.col("id").desc()).limit(limit)
