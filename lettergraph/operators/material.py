"""Material for answers and reports: who is meant, which rows to show, how much of them, and in what state."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions import rules
from lettergraph.functions.query import parse
from lettergraph.functions.text import collapsed, own_text
from lettergraph.operators import search
from lettergraph.operators.people import recipients
from lettergraph.operators.threads import key

# ------------------------------------------------------------------ names and addresses


def resolved_names(directory: DataFrame, names: list[str]) -> DataFrame:
    """(name, addr): of the people whose name holds each given one, spaces aside, the busiest."""
    wanted = directory.sparkSession.createDataFrame([(n, n.replace(" ", "").lower()) for n in names if n.strip()], "name string, squeezed string")
    people = directory.select("addr", F.lower(F.replace("name", F.lit(" "), F.lit(""))).alias("own"), (F.col("from_count") + F.col("to_count")).alias("mail"))
    hit = people.join(F.broadcast(wanted), F.contains("own", F.col("squeezed")))  # one row a name of the search line
    return hit.groupBy("name").agg(F.min_by("addr", F.struct((-F.col("mail")).alias("o"), "addr")).alias("addr"))


def aliases(directory: DataFrame, titles: list[str] | None = None) -> DataFrame:
    """(addr, alias): the parts of each name of two letters or more that are no titles, lower case."""
    dropped = F.array(*[F.lit(t.lower()) for t in titles or []]).cast("array<string>")
    parts = F.filter(F.split(F.lower("name"), r"[\s/().,]+"), lambda p: (F.length(p) >= 2) & ~F.array_contains(dropped, p))
    return directory.select("addr", F.explode(F.array_distinct(parts)).alias("alias"))


def frequent_people(directory: DataFrame, limit: int = 200) -> DataFrame:
    return directory.orderBy((F.col("from_count") + F.col("to_count")).desc(), "addr").limit(limit)


def with_person(m: DataFrame, addr: str) -> DataFrame:
    """Messages from a person or sent to them."""
    return m.where((F.col("sender_addr") == addr) | (F.col("is_sent") & F.array_contains(recipients(), addr)))


def person_threads(m: DataFrame, addr: str) -> DataFrame:
    return with_person(m, addr).select("thread_id").distinct()


def person_count_since(m: DataFrame, addr: str, seq: int = 0) -> DataFrame:
    return with_person(m, addr).where(F.col("seq") > seq).agg(F.count("*").alias("n"))


def person_signals(signals: DataFrame, m: DataFrame, addr: str, name: str = "", limit: int = 20) -> DataFrame:
    """Harvested signals (id, thread_id, who, signal) in a person's threads or that name them, newest first."""
    theirs = signals.join(person_threads(m, addr), "thread_id", "left_semi")
    named = signals.where(F.contains("who", F.lit(name))) if name else signals.limit(0)
    return theirs.unionByName(named).dropDuplicates(["id"]).orderBy(F.col("id").desc()).limit(limit)


def person_texts(m: DataFrame, addr: str, weeks: int = 26, limit: int = 300) -> DataFrame:
    """A person's newest messages within a window that ends at the newest message of all."""
    edge = m.agg((F.max("sent_ts") - F.make_dt_interval(F.lit(7 * weeks))).alias("since"))
    return m.where(F.col("sender_addr") == addr).join(F.broadcast(edge)).where(F.col("sent_ts") >= F.col("since")).orderBy(F.col("sent_ts").desc(), F.col("id").desc()).limit(limit).drop("since")  # one row


# ------------------------------------------------------------------ periods


def period(weeks: int = 1, today: dt.date | None = None) -> tuple[str, str]:
    """First and last day of the last ``weeks`` weeks, the last included."""
    end = today or dt.date.today()
    return (end - dt.timedelta(days=7 * weeks - 1)).isoformat(), end.isoformat()


def last_round(report_days: list[str], before: str) -> tuple[str, str] | None:
    """The period between the two reports before a day."""
    days = sorted(d for d in set(report_days) if d < before)
    return (days[-2], days[-1]) if len(days) > 1 else None


def period_words(name: str, today: dt.date) -> str:
    """A period of the search form as words of the search line."""
    monday = today - dt.timedelta(days=today.weekday())
    start = {"today": today, "week": monday, "month": today.replace(day=1), "year": today.replace(month=1, day=1)}.get(name)
    return f"after:{start.isoformat()}" if start else ""


def promises_in(found: DataFrame, start: str, end: str) -> DataFrame:
    """Promises of a period as kept, by what followed or by mark, or open."""
    rows = found.where(F.col("sent_ts").cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.withColumn("outcome", F.when(F.col("followed_up") | F.col("marked_done"), "kept").otherwise("open"))


def candidates(scored: DataFrame, protected: DataFrame, top: int = 64) -> DataFrame:
    """Threads for a report: protected ones first, then by score."""
    marked = scored.join(protected.select("thread_id", F.lit(True).alias("protected")).distinct(), "thread_id", "left").withColumn("protected", F.coalesce("protected", F.lit(False)))
    return marked.orderBy(F.col("protected").desc(), F.col("score").desc(), "thread_id").limit(top)


def state_before(m: DataFrame, start: str) -> DataFrame:
    """Each thread's last message before a period."""
    return m.where(F.col("sent_ts") < F.lit(start).cast("timestamp_ntz")).groupBy("thread_id").agg(F.max_by(F.struct("id", "is_sent", "body"), key()).alias("r")).select("thread_id", "r.*")


# ------------------------------------------------------------------ choosing and checking


def diagnosis_pick(m: DataFrame, kinds: DataFrame, n: int = 5) -> DataFrame:
    """Work threads worth a diagnosis: newest day, most messages, most text."""
    rows = m.groupBy("thread_id").agg(F.max(F.col("sent_ts").cast("date")).alias("day"), F.count("*").alias("n"), F.sum(F.length(F.coalesce("body", F.lit("")))).alias("chars"))
    return rows.join(kinds.where("kind = 'work'").select("thread_id"), "thread_id", "left_semi").orderBy(F.col("day").desc(), F.col("n").desc(), F.col("chars").desc(), F.col("thread_id").desc()).limit(n)


def counter_search(m: DataFrame, anchor: str, threads: list[int], limit: int = 24) -> DataFrame:
    """Messages that may contradict: those of up to five threads, and hits of the anchor with a word of change."""
    inside = m.where(F.col("thread_id").isin(*threads[:5])) if threads else m.limit(0)
    # Changed, cancelled, final.
    turned = m.limit(0)
    for word in ("변경", "취소", "최종"):
        turned = turned.unionByName(search.search(m, f"{anchor} {word}", limit).where("tier <= 3").drop("tier"))
    return inside.unionByName(turned).dropDuplicates(["id"])


def clean_issues(issues: DataFrame, statuses: tuple[str, ...] = ("open", "agreed", "changed", "cancelled", "unclear")) -> DataFrame:
    """Issues with a title and a known status."""
    return issues.where((F.trim("title") != "") & F.lower(F.trim("status")).isin(*statuses)).withColumn("status", F.lower(F.trim("status")))


def demoted(answer_state: Column, n_claims: Column, n_conflicts: Column, partial: Column) -> Column:
    """An answer's state, only ever lowered: no claims leave it unknown; conflicts, or partial reading, leave it partial."""
    return F.when(n_claims == 0, "unknown").when((answer_state == "answered") & ((n_conflicts > 0) | partial), "partial").otherwise(answer_state)


def read_counts(m: DataFrame, read: DataFrame) -> DataFrame:
    """Messages read of each thread against all it has, with the span read."""
    per = read.join(m.select("id", "thread_id", "sent_ts"), "id").groupBy("thread_id").agg(F.count("*").alias("read"), F.min("sent_ts").alias("first"), F.max("sent_ts").alias("last"))
    total = m.groupBy("thread_id").agg(F.count("*").alias("total"))
    return per.join(total, "thread_id").withColumn("partial", F.col("read") < F.col("total"))


def relevant_notes(notes: DataFrame, question: str, hidden: DataFrame | None = None, top: int = 3) -> DataFrame:
    """Notes by the number of the question's words they hold, then newest; notes of hidden threads are left out."""
    words = list(dict.fromkeys(w.lower() for w in re.findall(r"[0-9A-Za-z가-힣]+", question) if len(w) >= 2))
    score = F.lit(0)
    for w in words:
        score = score + F.contains(F.lower(F.concat_ws(" ", "title", "body")), F.lit(w)).cast("int")
    rows = notes.withColumn("score", score).where("score > 0")
    if hidden is not None:
        of_hidden = rows.select("path", F.explode("threads").alias("thread_id")).join(hidden.select("thread_id"), "thread_id", "left_semi").select("path").distinct()
        rows = rows.join(of_hidden, "path", "left_anti")
    return rows.orderBy(F.col("score").desc(), F.col("mtime").desc(), "path").limit(top)


def fitted(body: Column, budget: Column) -> Column:
    """A body cut to its share of a budget, on the ladder 8000, 4000, 2000, 1000, 600, 300 letters."""
    step = F.lit(300)
    for n in (600, 1000, 2000, 4000, 8000):
        step = F.when(budget >= n, n).otherwise(step)
    return F.when(F.length(body) <= budget, body).otherwise(F.concat(F.substring(body, F.lit(1), step - 1), F.lit("…")))


def anchor_message(m: DataFrame, threads: list[int], quote: str) -> DataFrame:
    """The first message of the threads that holds a quote, else their first message."""
    rows = m.where(F.col("thread_id").isin(*threads))
    holds = F.contains(F.regexp_replace(F.coalesce("body", F.lit("")), r"(?U)\s+", ""), F.lit(re.sub(r"\s+", "", quote)))
    return rows.agg(F.coalesce(F.min_by("id", F.when(holds, key())), F.min_by("id", key())).alias("id")).where("id IS NOT NULL")


def links_in(m: DataFrame) -> DataFrame:
    """Distinct addresses of pages that messages name."""
    urls = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"https?://[^\s<>\"')\]]+"), F.lit(0))
    return m.select("thread_id", F.explode(F.transform(urls, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))).alias("url")).distinct()


def harvest_material(m: DataFrame, kinds: DataFrame, flagged: DataFrame, days: int = 2, threads: int = 40) -> DataFrame:
    """Messages of a harvest window: work threads, flagged first and then newest, a few messages of each."""
    rows = m.join(kinds.where("kind = 'work'").select("thread_id"), "thread_id", "left_semi")
    order = rows.groupBy("thread_id").agg(F.max("sent_ts").alias("last")).join(flagged.select("thread_id", F.lit(1).alias("flag")).distinct(), "thread_id", "left")
    chosen = order.orderBy(F.coalesce("flag", F.lit(0)).desc(), F.col("last").desc(), "thread_id").limit(threads).select("thread_id")
    newest = Window.partitionBy("thread_id").orderBy(F.col("sent_ts").desc(), F.col("id").desc())
    return rows.join(F.broadcast(chosen), "thread_id", "left_semi").withColumn("nr", F.row_number().over(newest)).where(F.col("nr") <= min(8, 3 * days))  # at most ``threads`` rows


def role_lines(dossiers: DataFrame, most: int = 60) -> DataFrame:
    """First bullet of each person's card."""
    return dossiers.select("addr", F.substring(F.trim(F.regexp_extract("card", r"(?m)^\s*[-*]\s+(.+)$", 1)), 1, most).alias("role")).where("role <> ''")


def preserved_label(turns: Column) -> Column:
    """What a fold of quoted history is headed: number of turns, up to three people, span of dates."""
    names = F.array_distinct(F.filter(F.transform(turns, lambda t: t["who"]), lambda n: n != ""))
    dates = F.filter(F.transform(turns, lambda t: t["date"]), lambda d: d != "")
    return F.concat_ws(" · ", F.concat(F.size(turns).cast("string"), F.lit(" turns")), F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, 3), ", ")), F.when(F.size(dates) > 0, F.concat_ws(" ~ ", F.get(dates, F.lit(0)), F.element_at(dates, -1))))


def subject_noise(strong: Column, weak: Column, i_replied: Column, n_to: Column) -> Column:
    """Strong patterns always; weak ones unless I replied or the mail went to fewer than three."""
    return strong | (weak & ~i_replied & (n_to >= 3))


def without_preamble(text: Column) -> Column:
    """A model's text without a first paragraph about itself; one that names a thread is content."""
    first = F.substring_index(text, "\n\n", 1)
    about = first.rlike(r"(?iU)^(here is|here's|below is|i have|sure|다음은|아래는|요청하신)") & ~first.rlike(r"#\d+")
    return F.when(about & F.contains(text, F.lit("\n\n")), F.trim(F.substring(text, F.length(first) + 3, F.length(text)))).otherwise(text)


def highlight_terms(line: str) -> list[str]:
    """Words and phrases of a search line to mark in results."""
    s = parse(line)
    return [*s.phrases, *s.terms]


def own_words(m: DataFrame, most: int = 4000) -> DataFrame:
    """Each message's own text, collapsed and cut, for a prompt."""
    return m.select("id", "thread_id", F.substring(collapsed(own_text(F.coalesce("body", F.lit("")))), 1, most).alias("text"))


# ------------------------------------------------------------------ configuration and model


def config_version(**settings) -> str:
    """A value that changes with any setting: materialised results kept under it are recomputed when it moves."""
    rule_texts = {k: v for k, v in vars(rules).items() if isinstance(v, (str, tuple)) and k.isupper()}
    return hashlib.sha256(json.dumps([settings, rule_texts], sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()[:16]


class Model(Protocol):
    """A language model that callers may plug in; none is called unless one is given."""

    def __call__(self, prompt: str) -> str: ...


def answered(prompts: DataFrame, model: Model | None = None) -> DataFrame:
    """(key, answer): null without a model; with one, each prompt is asked in the task that holds it."""
    if model is None:
        return prompts.select("key", F.lit(None).cast("string").alias("answer"))

    def ask(batches):
        for b in batches:
            yield b.assign(answer=[model(p) for p in b["prompt"]])[["key", "answer"]]

    return prompts.select("key", "prompt").mapInPandas(ask, f"key {prompts.schema['key'].dataType.simpleString()}, answer string")
