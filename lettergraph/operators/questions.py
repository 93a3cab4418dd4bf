"""Many searches in one scan: the words of all lines in one automaton, so that each message is read once for all questions."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions.query import Search, parse
from lettergraph.operators import search

LETTERS = 2_000_000  # of all words together: what one automaton may hold


class _Lines:
    """The words of all questions as an Aho-Corasick automaton, and what each question's levels ask of them."""

    def __init__(self, asked: list[tuple[int, dict[int, tuple[bool, list[str]]]]]):
        import ahocorasick

        number: dict[str, int] = {}
        self.levels, self.questions_of = {}, {}
        for question, levels in asked:
            self.levels[question] = [(tier, every, {number.setdefault(x.lower(), len(number)) for x in needles}) for tier, (every, needles) in levels.items()]
            for _, _, wanted in self.levels[question]:
                for x in wanted:
                    self.questions_of.setdefault(x, set()).add(question)
        self.automaton = ahocorasick.Automaton()
        for needle, n in number.items():
            self.automaton.add_word(needle, n)
        if number:
            self.automaton.make_automaton()
        self.some = bool(number)

    def hits(self, *texts: str | None) -> list[dict]:
        """(question, tier) of one message; a word stands in one of the texts, not across them."""
        held = {n for t in texts if t and self.some for _, n in self.automaton.iter(t)}
        out = []
        for question in sorted({q for n in held for q in self.questions_of[n]}):
            for tier, every, wanted in self.levels[question]:
                if wanted <= held if every else wanted & held:
                    out.append({"question": question, "tier": tier})
                    break
        return out


_HIT = pa.list_(pa.struct([("question", pa.int32()), ("tier", pa.int32())]))


def _found(asked: list[tuple[int, dict]], m: DataFrame):
    sent, held = m.sparkSession.sparkContext.broadcast(asked), []

    @F.arrow_udf("array<struct<question:int,tier:int>>")
    def run(subject: pa.Array, body: pa.Array) -> pa.Array:
        if not held:
            held.append(_Lines(sent.value))
        return pa.array([held[0].hits(s, b) for s, b in zip(subject.to_pylist(), body.to_pylist(), strict=True)], type=_HIT)

    return run(F.lower("subject"), F.lower("body"))


def matches_many(m: DataFrame, lines: Mapping[int, str], addresses: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``m`` with question and tier, one for each question (a number and its search line) that finds them: what
    ``search.matches`` finds line by line, in one scan.

    The lines come from the caller; all their words together may have ``LETTERS`` letters.
    """
    parsed = {q: parse(line) for q, line in lines.items()}
    worded = [(q, search.levels(s)) for q, s in parsed.items() if s.terms or s.phrases]
    if sum(len(x) for _, levels in worded for _, needles in levels.values() for x in needles) > LETTERS:
        raise ValueError("too many words for one automaton: ask in several goes")
    # Lines of filters alone find by these.
    bare = [F.struct(F.lit(q).alias("question"), F.lit(0).alias("tier")) for q, s in parsed.items() if not s.terms and not s.phrases and search.has_filters(s)]
    hits = F.concat(_found(worded, m), F.array(*bare).cast("array<struct<question:int,tier:int>>"))
    rows = m.withColumn("_hit", F.explode(hits)).select(*m.columns, "_hit.question", "_hit.tier")
    return rows.where(_filtered(parsed, addresses))


def _filtered(parsed: dict[int, Search], addresses: dict[str, str] | None):
    """Each row by the filters of its question."""
    condition = F.lit(True)
    for q, s in parsed.items():
        if search.has_filters(s):
            condition = condition & ((F.col("question") != q) | F.coalesce(search.filters(s, addresses), F.lit(False)))
    return condition


def gathered(m: DataFrame, lines: Mapping[int, str], limit: int = 50, most_tier: int = 4, deny: DataFrame | None = None, noise: DataFrame | None = None,
             addresses: dict[str, str] | None = None) -> DataFrame:
    """The best ``limit`` rows of each question, by tier, then newest: with question, tier and place.

    ``deny`` (question, id) has what a question has seen already, a null question for all; ``noise`` (thread_id) threads that say
    nothing; tiers above ``most_tier`` are too far off.  Each task keeps its best rows of a question before the shuffle.
    """
    found = matches_many(m, lines, addresses).where(F.col("tier") <= most_tier)
    if noise is not None:
        found = found.join(noise.select("thread_id").distinct(), "thread_id", "left_anti").select(found.columns)
    if deny is not None:
        for_one, for_all = deny.where("question IS NOT NULL").select("question", "id").distinct(), deny.where("question IS NULL").select("id").distinct()
        found = found.join(for_one, ["question", "id"], "left_anti").join(for_all, "id", "left_anti").select(found.columns)
    order = [F.col("tier"), *([F.col("sent_ts").desc_nulls_last()] if "sent_ts" in m.columns else []), F.col("id")]
    return found.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy(*order))).where(F.col("place") <= limit)
