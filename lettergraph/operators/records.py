"""What is kept beside messages, and material gathered for a person or a report: values, cards, diagnoses, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions.text import collapsed, own_text, smart_truncated
from lettergraph.operators.people import recipients
from lettergraph.operators.threads import key, overlay

# ------------------------------------------------------------------ values and cards


def values_set(state: DataFrame, changes: DataFrame) -> DataFrame:
    """A table of (name, value, nr) after changes; the newest number of a name wins."""
    return overlay(state, changes, ["name"], "nr")


def cards_saved(cards: DataFrame, saved: DataFrame) -> DataFrame:
    """Cards (addr, card, updated, basis, version, nr) after new ones; addresses without regard to case."""
    low = lambda df: df.withColumn("addr", F.lower(F.trim("addr")))
    return overlay(low(cards), low(saved), ["addr"], "nr")


def cards_checked(cards: DataFrame, checked: DataFrame, version: int) -> DataFrame:
    """Cards after checks that brought nothing (addr, basis): a card of this version keeps its text and moves its basis; one of
    another version, or none, becomes an empty card of this version."""
    newest = checked.groupBy(F.lower(F.trim("addr")).alias("addr")).agg(F.max("basis").alias("new_basis"))
    both = cards.join(newest, "addr", "full_outer")
    stale = F.col("new_basis").isNotNull() & ~F.col("version").eqNullSafe(F.lit(version))
    return both.select(
        "addr", F.when(stale, "").otherwise(F.col("card")).alias("card"), F.when(stale, "").otherwise(F.col("updated")).alias("updated"), F.coalesce("new_basis", "basis").alias("basis"),
        F.when(stale, F.lit(version)).otherwise(F.col("version")).alias("version"),
    )


def cards_of(cards: DataFrame, version: int) -> DataFrame:
    """Cards that the present rules made."""
    return cards.where(F.col("version") == version)


def cards_due(counts: DataFrame, cards: DataFrame, version: int) -> DataFrame:
    """People (addr, n) with more mail than their card of this version rests on, or without one."""
    known = cards_of(cards, version).select("addr", "basis")
    return counts.join(known, "addr", "left").where(F.col("basis").isNull() | (F.col("n") > F.col("basis"))).select("addr", "n")


def checked_card(text: Column, verified: Column, sections: dict[str, int], proven: tuple[str, ...], most: int = 200) -> Column:
    """A model's card by its contract: known sections in order, at most so many lines each.

    Lines ``- words (#thread) "quote"`` of ``proven`` sections stay only if their quote is in ``verified`` (an array of quotes that
    were found); quotes are taken off all lines.
    """
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n##\s*"), lambda p: F.trim(p) != "")

    def section(name: str, cap: int) -> Column:
        body = F.get(F.filter(parts, lambda p: F.trim(F.substring_index(p, "\n", 1)) == name), F.lit(0))
        lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda s: s.rlike(r"^\s*[-*]\s+\S"))
        quote = lambda s: F.regexp_extract(s, r'"([^"]+)"', 1)
        if name in proven:
            lines = F.filter(lines, lambda s: (quote(s) != "") & F.array_contains(verified, quote(s)))
        bare = F.transform(lines, lambda s: F.substring(F.trim(F.regexp_replace(F.regexp_replace(s, r'^\s*[-*]\s+|"[^"]*"', ""), r"[\s·-]+$", "")), 1, most))
        kept = F.slice(F.filter(bare, lambda s: s != ""), 1, cap)
        return F.when(F.size(kept) > 0, F.concat(F.lit(f"## {name}\n- "), F.array_join(kept, "\n- ")))

    return F.array_join(F.array_compact(F.array(*[section(n, c) for n, c in sections.items()])), "\n")


# The slots of a diagnosis in their order (summary, problem, cause, course, first step, background, unknown), how many of each and how long.
DIAGNOSIS = {"정리": (1, 320), "문제": (3, 200), "원인": (2, 220), "방향": (3, 260), "먼저 할 일": (1, 180), "배경": (2, 180), "모르는 것": (2, 200)}


def diagnosis(text: Column) -> Column:
    """Lines ``slot: words | 근거: "quote"`` as array<struct<slot,words,quote>>, by slot and then as they stand; other lines and
    those past a slot's number are passed over."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    pattern = r'^[\s*_`#>-]*({})[\s*_`]*[:：]\s*(.+?)\s*(?:\|\s*(?:근거|인용)\s*[:：]\s*["“]?(.*?)["”]?\s*)?$'

    def slot(name: str, most: int, size: int) -> Column:
        mine = pattern.format(name.replace(" ", r"\s*"))
        clean = lambda s, group, cut: F.substring(collapsed(F.regexp_replace(F.regexp_extract(s, mine, group), r"^[\s*_`]+|[\s*_`]+$", "")), 1, cut)
        found = F.transform(F.filter(lines, lambda s: s.rlike(mine)), lambda s: F.struct(F.lit(name).alias("slot"), clean(s, 2, size).alias("words"), clean(s, 3, 400).alias("quote")))
        return F.slice(F.filter(found, lambda f: f["words"] != ""), 1, most)

    return F.concat(*[slot(name, most, size) for name, (most, size) in DIAGNOSIS.items()])


def diagnosis_text(items: Column) -> Column:
    """The same as text again, which ``diagnosis`` reads back."""
    return F.array_join(F.transform(items, lambda i: F.concat(i["slot"], F.lit(": "), i["words"], F.when(i["quote"] != "", F.concat(F.lit(' | 근거: "'), i["quote"], F.lit('"'))).otherwise(""))), "\n")


# ------------------------------------------------------------------ a person


def _with(addr: str) -> Column:
    """From a person, or mine to an address that holds theirs."""
    low = addr.strip().lower()
    return F.when(F.col("is_sent"), F.exists(recipients(), lambda a: F.contains(F.lower(a), F.lit(low)))).otherwise(F.lower("sender_addr") == low)


def brief_seeds(m: DataFrame, addr: str, today: str, months: int = 6, limit: int = 60) -> DataFrame:
    """Newest messages with a person within ``months`` of thirty days up to a day."""
    end = F.lit(today).cast("date")
    return m.where(_with(addr) & F.col("sent_ts").cast("date").between(F.date_sub(end, 30 * max(months, 1)), end)).orderBy(F.col("sent_ts").desc(), F.col("id").desc()).limit(limit).select("id")


def person_material(m: DataFrame, addr: str, threads: int = 12, total: int = 60_000, least: int = 800, most: int = 3_000) -> DataFrame:
    """What a person and I wrote in the threads we last shared: rows with each body cut to its share of a whole budget."""
    last = m.where(_with(addr) & ~F.coalesce("hidden", F.lit(False))).groupBy("thread_id").agg(F.max("sent_ts").alias("last")).orderBy(F.col("last").desc(), "thread_id").limit(threads)
    # At most ``threads`` rows on one side.
    rows = m.join(F.broadcast(last.select("thread_id")), "thread_id", "left_semi").where(F.col("is_sent") | (F.lower("sender_addr") == addr.strip().lower()))
    share = rows.agg(F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.lit(total) / F.greatest(F.count("*"), F.lit(1))))).cast("int").alias("share"))
    body = own_text(F.coalesce("body", F.lit("")))
    cut = F.when(F.length(body) <= F.col("share"), body).otherwise(F.concat(F.substring(body, F.lit(1), F.col("share") - 1), F.lit("…")))
    return rows.join(F.broadcast(share)).select("thread_id", "id", "sent_ts", F.when(F.col("is_sent"), "me").otherwise(F.col("sender_addr")).alias("who"), cut.alias("body"))  # one row


def term_evidence(b: DataFrame, chosen: DataFrame, most: int = 3) -> DataFrame:
    """The newest threads in which each person used each chosen term (who, term, nr, thread_id); ``b`` has sent_ts."""
    used = b.select("who", "thread_id", "sent_ts", "id", F.explode_outer("terms").alias("term")).join(chosen.select("who", "term"), ["who", "term"])
    newest = used.groupBy("who", "term", "thread_id").agg(F.max(F.struct("sent_ts", "id")).alias("last"))
    nr = F.row_number().over(Window.partitionBy("who", "term").orderBy(F.col("last").desc(), "thread_id"))
    return newest.withColumn("nr", nr).where(F.col("nr") <= most).select("who", "term", "nr", "thread_id")


def first_subjects(m: DataFrame) -> DataFrame:
    """The message whose subject counts: the first of each sender in a thread, as later ones repeat it."""
    return m.groupBy("sender_addr", "thread_id").agg(F.min_by("id", key()).alias("id"))


# ------------------------------------------------------------------ reports and counts


def queue_breakdown(queue: DataFrame) -> DataFrame:
    """The queue by category, and all of it."""
    return queue.groupBy("category").agg(F.count("*").alias("n")).unionByName(queue.agg(F.lit("all").alias("category"), F.count("*").alias("n")))


def html_lifecycle(bodies: DataFrame) -> DataFrame:
    """HTML bodies held, with images inside, and pruned to a mark."""
    html = F.coalesce("html", F.lit(""))
    return bodies.agg(F.count_if(html != "").alias("held"), F.count_if(F.contains(F.lower(html), F.lit("data:image/"))).alias("with_images"), F.count_if(html.startswith("<!-- images removed")).alias("pruned"))


def material_line(most: int) -> Column:
    """A message as a line of material, its body cut."""
    return F.concat(F.lit("[mid="), F.col("id").cast("string"), F.lit(" · thread=#"), F.col("thread_id").cast("string"), F.lit(" · "), F.date_format("sent_ts", "yyyy-MM-dd HH:mm"), F.lit(" · "),
                    F.when(F.col("is_sent"), "me").otherwise(F.col("sender_addr")), F.lit("] "), F.coalesce("subject", F.lit("")), F.lit("\n"), smart_truncated(F.col("body"), most))


def material_before(m: DataFrame, start: str, last: int = 3, most: int = 600) -> DataFrame:
    """How each thread stood before a period: its last messages that say something, oldest first, as one text."""
    rows = m.where((F.col("sent_ts") < F.lit(start).cast("timestamp_ntz")) & (F.trim(F.coalesce("body", F.lit(""))) != ""))
    nr = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.col("sent_ts").desc(), F.col("id").desc()))
    few = rows.withColumn("nr", nr).where(F.col("nr") <= last)
    return few.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("nr")).alias("o"), material_line(most).alias("line")))).alias("l")).select("thread_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("text"))


def references(anchor: DataFrame, links: DataFrame, quote: str = "") -> DataFrame:
    """Lines that a saved note ends with: the message it rests on (thread_id, sent_ts, sender_addr), quoted once, then the pages named (url)."""
    lead = F.concat(F.lit("- [#"), F.col("thread_id").cast("string"), F.lit("] "), F.date_format("sent_ts", "yyyy-MM-dd"), F.lit(" "), F.coalesce("sender_addr", F.lit("")), F.lit(f' — "{quote[:120]}"' if quote else ""))
    return anchor.select(F.lit(0).alias("nr"), lead.alias("line")).unionByName(links.select(F.lit(1).alias("nr"), F.concat(F.lit("- "), "url").alias("line")).distinct()).orderBy("nr", "line")


def board_facts(states: DataFrame, queue: DataFrame) -> DataFrame:
    """Counts that a summary must not contradict: threads by state and queue entries by category."""
    return states.groupBy(F.lit("state").alias("of"), F.col("state").alias("name")).agg(F.count("*").alias("n")).unionByName(queue.groupBy(F.lit("queue").alias("of"), F.col("category").alias("name")).agg(F.count("*").alias("n")))


def summary_bullets(text: Column, most: int = 5) -> Column:
    """A model's summary as at most so many single-line bullets, whatever marks it used."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: collapsed(F.regexp_replace(s, r"^[\s*•·-]+|^\s*\d+[.)]\s+", "")))
    kept = F.slice(F.filter(lines, lambda s: (s != "") & ~s.startswith("#")), 1, most)
    return F.array_join(F.transform(kept, lambda s: F.concat(F.lit("- "), s)), "\n")


def context_block(parts: list[tuple[str, DataFrame]], column: str = "text") -> DataFrame:
    """What a question would be asked with, without asking: named parts in order, each a small table of texts."""
    one = lambda k, name, df: df.select(F.lit(k).alias("nr"), F.lit(name).alias("part"), F.col(column).alias("text"))
    return reduce(DataFrame.unionByName, [one(k, name, df) for k, (name, df) in enumerate(parts)]).orderBy("nr", "text")


def noise_high_water(before: DataFrame, new: DataFrame, noisy: Column) -> DataFrame:
    """Per thread (thread_id, got, clean, seq) how many received messages and how many that are no noise, brought up to date with
    messages past the highest number seen; equal to counting all, as counts only grow.  Other settings start from nothing."""
    rows = new.where(~F.col("is_sent")).groupBy("thread_id").agg(F.count("*").alias("got"), F.count_if(~noisy).alias("clean"), F.max("seq").alias("seq"))
    return before.unionByName(rows).groupBy("thread_id").agg(F.sum("got").alias("got"), F.sum("clean").alias("clean"), F.max("seq").alias("seq"))


def features_synced(held: DataFrame, m: DataFrame, fresh: DataFrame, since: str, same_version: bool) -> tuple[DataFrame, DataFrame]:
    """(features that stay, messages still to be cut into features): those past the window go, new ones come; another version of the
    rules takes all anew.  ``held`` and ``fresh``: id."""
    window = m.where(F.col("sent_ts") >= F.lit(since).cast("timestamp_ntz"))
    if not same_version:
        return held.limit(0), window
    return held.join(window.select("id"), "id", "left_semi"), window.join(fresh.select("id"), "id", "left_semi").join(held.select("id"), "id", "left_anti")
