"""Search over messages: filters, four tiers from phrase to any word, ranking, facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettergraph.functions.query import Search, parse
from lettergraph.functions.rules import ENDING


def _has(needle: str, *columns: str) -> Column:
    """The needle in any column, without regard to case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.lower())) for c in columns])


def _all(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def _some(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a | b, conditions) if conditions else None


def filters(s: Search, addresses: dict[str, str] | None = None) -> Column:
    """The pairs as one condition: or within a key, and across keys. ``addresses`` gives names' addresses for to and cc."""
    out = [F.lit(True)]
    if s.fields.get("from"):
        out.append(_some([_has(v, "sender_addr") if "@" in v else _has(v, "sender_addr") | F.contains(F.replace(F.lower("sender_name"), F.lit(" "), F.lit("")), F.lit(v.replace(" ", "").lower())) for v in s.fields["from"]]))
    for key in ("to", "cc"):
        if s.fields.get(key):
            out.append(_some([_address(f"{key}_addrs", (addresses or {}).get(v, v)) for v in s.fields[key]]))
    if s.after:
        out.append(F.col("sent_ts") >= F.lit(s.after).cast("timestamp_ntz"))
    if s.before:
        out.append(F.col("sent_ts") < F.lit(s.before).cast("timestamp_ntz"))
    if s.thread is not None:
        out.append(F.col("thread_id") == s.thread)
    for flag, condition in {"unread": "NOT read", "read": "read", "sent": "is_sent", "received": "NOT is_sent", "flagged": "coalesce(flagged, false)"}.items():
        if flag in s.flags:
            out.append(F.expr(condition))
    if s.has_attachment:
        out.append(F.size("attach_names") > 0)
    out += [F.exists("attach_names", _contains(v)) for v in s.fields.get("file", ())]
    return _all(out)


def _contains(needle: str):
    return lambda a: F.contains(F.lower(a), F.lit(needle.lower()))


def _address(column: str, needle: str) -> Column:
    return F.exists(column, _contains(needle))


def levels(s: Search) -> dict[int, tuple[bool, list[str]]]:
    """What each level of a line asks for, best first: (all or any, needles); nothing for a line without words.

    1: the words stand side by side as they were typed, and so does each phrase.  2: each phrase and each word is there.
    3: the same over all of them as plain substrings, which also serves lines of short words alone.  4: a phrase or a longer
    word is there, if the line has several.  Words of one or two letters are too common to be looked for by themselves: in
    1 and 2 they are conditions beside others, in 4 they count for nothing.
    """
    longer, shorter = ([t for t in s.terms if (len(t) >= 3) == long] for long in (True, False))
    phrase = " ".join(s.terms) if len(s.terms) > 1 or s.phrases else ""
    exact, named = [*s.phrases, *([phrase] if len(phrase) >= 3 else [])], [*s.phrases, *longer]
    asked = {1: (True, [*exact, *shorter] if exact else []), 2: (True, [*named, *shorter] if named else []), 3: (True, [*s.terms, *s.phrases]), 4: (False, named if len(named) > 1 else [])}
    return {number: level for number, level in asked.items() if level[1]}


def tier(s: Search) -> Column | None:
    """How well a message fits a line: its first level that holds, null for none, None where the line has no words."""
    if not s.terms and not s.phrases:
        return None
    return F.coalesce(*[F.when((_all if every else _some)([_one(x) for x in asked]), number) for number, (every, asked) in levels(s).items()])


def _one(needle: str) -> Column:
    return _has(needle, "subject", "body")


def has_filters(s: Search) -> bool:
    """Does a line narrow by anything but words?"""
    return bool(s.fields or s.after or s.before or s.flags or s.has_attachment or s.thread is not None)


def matches(m: DataFrame, line: str, addresses: dict[str, str] | None = None) -> DataFrame:
    """All messages that a search line finds, with their tier and in no order; filters alone give tier 0, nothing for nothing."""
    s = parse(line)
    level = tier(s)
    if level is None:
        level = F.lit(0) if has_filters(s) else F.lit(None).cast("int")
    return m.where(filters(s, addresses)).withColumn("tier", level).where("tier IS NOT NULL")


def search(m: DataFrame, line: str, limit: int = 50, addresses: dict[str, str] | None = None) -> DataFrame:
    """The best ``limit`` messages for a search line: by tier, then newest first.

    One scan: the filters reach the source, the tier is computed in the same stage and the top rows are kept a task.
    """
    return best(matches(m, line, addresses), limit)


def best(found: DataFrame, limit: int) -> DataFrame:
    """The first of what was found: by tier, then newest first."""
    order = [F.col("tier"), *([F.col("sent_ts").desc_nulls_last()] if "sent_ts" in found.columns else []), F.col("id")]
    return found.orderBy(*order).limit(limit)


def needles(s: Search) -> list[str]:
    """Words and phrases of which every match of the line holds one at least; none where short words alone decide.

    All levels but the third ask for one of these outright, and the third for all of them.
    """
    return [*s.phrases, *(t for t in s.terms if len(t) >= 3)]


def weighted_size(subject_weight: float) -> Column:
    """Letters of a message, those of the subject weighted."""
    return F.length(F.coalesce("subject", F.lit(""))) * subject_weight + F.length(F.coalesce("body", F.lit("")))


def ranked(m: DataFrame, terms: list[str], subject_weight: float = 3.0, k1: float = 1.2, b: float = 0.75, facts: DataFrame | None = None) -> DataFrame:
    """BM25 over subject and body with the subject weighted: id, score; counts over all messages.

    ``facts`` (n, mean size) of all messages can be given where ``m`` holds only those with a hit.
    """
    def hits(column: str, t: str) -> Column:
        text = F.lower(F.coalesce(F.col(column), F.lit("")))
        return ((F.length(text) - F.length(F.replace(text, F.lit(t.lower()), F.lit("")))) / len(t)).cast("double")

    rows = m.select("id", weighted_size(subject_weight).alias("size"),
                    *[(hits("subject", t) * subject_weight + hits("body", t)).alias(f"f{i}") for i, t in enumerate(terms)])
    hit = [F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))]
    told = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *hit) if facts is None else rows.agg(*hit).join(F.broadcast(facts))
    scored = rows.join(F.broadcast(told))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5) + 1)
        f = F.col(f"f{i}")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("size") / F.greatest("mean", F.lit(1.0))))
    return scored.select("id", score.alias("score")).where("score > 0")


def snippet(text: Column, needle: str, before: int = 30, size: int = 90) -> Column:
    """The words around the first hit, the hit marked."""
    at = F.instr(F.lower(text), needle.lower())
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.concat(
        F.when(start > 1, "…").otherwise(""), F.substring(text, start, at - start), F.lit("⟪"), F.substring(text, at, F.lit(len(needle))), F.lit("⟫"),
        F.substring(text, at + len(needle), F.lit(size)), F.when(F.length(text) > at + len(needle) + size, "…").otherwise(""),
    )).otherwise("")


def facets(found: DataFrame, top: int = 5) -> DataFrame:
    """Senders of a result, most first; none where there is only one."""
    rows = found.groupBy("sender_addr").agg(F.count("*").alias("n"))
    several = rows.agg((F.count("*") >= 2).alias("several"))
    return rows.join(F.broadcast(several)).where("several").select("sender_addr", "n").orderBy(F.col("n").desc(), "sender_addr").limit(top)


def narrow_chips(line: str, limit: int = 3) -> list[str]:
    """Longest words of a line that found nothing, to try alone; without sentence endings."""
    import re

    stems = [re.sub(ENDING, "", t) for t in parse(line).terms]
    return sorted(dict.fromkeys(s for s in stems if len(s) >= 2), key=lambda s: -len(s))[:limit]


def all_words(m: DataFrame, line: str, columns: list[str], order: str, limit: int = 10) -> DataFrame:
    """Notes and knowledge: every word of two letters or more must occur; newest first."""
    import re

    tokens = [t for t in re.findall(r"[0-9A-Za-z가-힣]+", line) if len(t) >= 2]
    hit = _all([_has(t, *columns) for t in tokens])
    return m.where(hit if hit is not None else F.lit(False)).orderBy(F.col(order).desc(), *columns[:1]).limit(limit)
