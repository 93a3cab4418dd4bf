"""Sentences, signals, subjects and cleaning of message text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettergraph.functions import rules


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, within lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squashed(text: Column) -> Column:
    """Without any white space: how quotes are compared."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised_subject(subject: Column) -> Column:
    """Without reply and forward marks, spaces collapsed, lower case."""
    return F.lower(collapsed(F.regexp_replace(F.coalesce(subject, F.lit("")), rules.REPLY_MARKS, "")))


def sentences(text: Column) -> Column:
    """Lines, and in them the pieces after . ! or ? and white space; blank ones left out."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"), F.trim)
    pieces = F.flatten(F.transform(lines, lambda s: F.split(s, r"(?U)(?<=[.!?？])\s+")))
    return F.filter(pieces, lambda s: F.trim(s) != "")


def own_text(text: Column) -> Column:
    """What stands before the mark of preserved quotes."""
    return F.when(F.contains(text, F.lit(rules.PRESERVED)), F.regexp_replace(F.substring_index(text, rules.PRESERVED, 1), r"(?U)\s+$", "")).otherwise(text)


def preserved_text(text: Column) -> Column:
    """What stands after the mark, else nothing."""
    return F.when(F.contains(text, F.lit(rules.PRESERVED)), F.regexp_replace(F.substring(text, F.instr(text, rules.PRESERVED) + len(rules.PRESERVED), F.length(text)), r"(?U)^\s+|\s+$", "")).otherwise("")


def is_trivial(text: Column) -> Column:
    """Nothing said: empty, an added recipient in a short line, or one stock phrase."""
    text = F.coalesce(text, F.lit(""))

    def judged(s: Column) -> Column:
        core = F.lower(F.trim(F.regexp_replace(s, r"[.!~^:;)]+$", "")))
        return (s == "") | ((s.startswith("++") | s.startswith("+ ")) & (F.length(s) <= rules.TRIVIAL_PLUS_MAX)) | core.isin(*rules.TRIVIAL)

    # A long text is known by its beginning; only what may be short is collapsed whole.
    longer = F.length(collapsed(F.substring(text, 1, 400))) > 300
    return F.when(longer, False).otherwise(let(collapsed(text), judged))


def _live(every: Column) -> Column:
    """Sentences that may ask for something: none that withdraws, none about something done or asked earlier unless it reminds."""
    return F.filter(every, lambda s: ~s.rlike(rules.WITHDRAWAL) & ~((s.rlike(rules.COMPLETION) | s.rlike(rules.HISTORICAL)) & ~s.rlike(rules.REMIND)))


def signals(text: Column, subject: Column, names: list[str]) -> Column:
    """The flags of one message as a struct, judged sentence by sentence and joined with or.

    Most messages hold nothing that a pattern could match: two looks at the whole text tell, and only a question mark is left
    to find there.  Sentences are cut and judged for the others.
    """
    subject = F.coalesce(subject, F.lit(""))

    def of_message(body: Column) -> Column:
        named = F.lit(False)
        for n in (x for x in names if len(x) >= 2):
            named = named | F.contains(F.lower(body), F.lit(n.lower()))
        return let(body.rlike(rules.GATE_LETTERS), lambda korean: F.struct(
            F.when(korean | F.lower(body).rlike(rules.GATE), _asked_in(sentences(body))).otherwise(
                F.struct(*[F.lit(False).alias(k) for k in _OF_SENTENCES[:5]], body.rlike("[?？]").alias("has_question"), *[F.lit(False).alias(k) for k in _OF_SENTENCES[6:]])
            ).alias("said"),
            named.alias("mentions_me"), F.when(korean, body.rlike(rules.GROUP_CALL)).otherwise(False).alias("mentions_group"),
        ))

    return let(let(own_text(F.coalesce(text, F.lit(""))), of_message), lambda f: F.struct(
        *[f["said"][k].alias(k) for k in _OF_SENTENCES], f["mentions_me"].alias("mentions_me"), f["mentions_group"].alias("mentions_group"), is_trivial(text).alias("is_trivial"),
        F.when(subject.rlike(rules.GATE_LETTERS), subject.rlike(rules.SUBJECT_REQUEST)).otherwise(False).alias("subject_has_request"),
    ))


_OF_SENTENCES = ("has_deadline", "has_decision", "has_request", "has_strong_request", "has_weak_request", "has_question", "has_completion", "has_withdrawal")


def _asked_in(said: Column) -> Column:
    """The flags that sentences decide."""
    def tones(live: Column) -> Column:
        # One strong phrase a sentence is looked up once: strong, or weak where it is hedged or only a weak phrase stands.
        tone = F.transform(live, lambda s: F.when(s.rlike(rules.STRONG_REQUEST), F.when(s.rlike(rules.HEDGE), "weak").otherwise("strong")).when(s.rlike(rules.WEAK_REQUEST) & ~s.rlike(rules.PLEASANTRY), "weak"))
        return let(F.array_distinct(F.array_compact(tone)), lambda t: F.struct(
            F.exists(live, lambda s: s.rlike(rules.DEADLINE)).alias("has_deadline"), F.exists(live, lambda s: s.rlike(rules.DECISION)).alias("has_decision"), (F.size(t) > 0).alias("has_request"),
            F.array_contains(t, F.lit("strong")).alias("has_strong_request"), F.array_contains(t, F.lit("weak")).alias("has_weak_request"), F.exists(live, lambda s: s.rlike("[?？]")).alias("has_question"),
        ))

    def judged(every: Column, plain: Column) -> Column:
        return let(let(_live(every), tones), lambda a: F.struct(
            *[a[k].alias(k) for k in _OF_SENTENCES[:5]], (a["has_question"] | plain).alias("has_question"),
            F.exists(every, lambda s: ~s.rlike(rules.WITHDRAWAL) & s.rlike(rules.COMPLETION)).alias("has_completion"), F.exists(every, lambda s: s.rlike(rules.WITHDRAWAL)).alias("has_withdrawal"),
        ))

    may = lambda s: s.rlike(rules.GATE_LETTERS) | F.lower(s).rlike(rules.GATE)
    return let(said, lambda every: let(F.filter(every, may), lambda told: judged(told, F.exists(every, lambda s: s.rlike("[?？]") & ~may(s)))))


def evidence_sentence(text: Column) -> Column:
    """The sentence that shows the request: decision, strong, deadline, weak, question, else the first line."""
    body = own_text(F.coalesce(text, F.lit("")))
    first = lambda live, pattern: F.get(F.filter(live, lambda s: s.rlike(pattern)), F.lit(0))
    best = let(_live(sentences(body)), lambda live: F.coalesce(*[first(live, p) for p in (rules.DECISION, rules.STRONG_REQUEST, rules.DEADLINE, rules.WEAK_REQUEST, "[?？]")]))
    lines = F.filter(F.transform(F.split(body, "\n"), F.trim), lambda s: s != "")
    return F.trim(F.coalesce(best, F.get(lines, F.lit(0)), F.lit("")))


def cut_line(lines: Column) -> Column:
    """0-based line at which quoted mail begins, or the number of lines.

    A labelled rule; an attribution with an address, or short and with four digits; a header line after a blank or a rule
    with three more labels in the next twelve lines that are not blank.
    """
    def starts(line: Column, i: Column) -> Column:
        s = F.trim(line)
        digits = F.length(F.regexp_replace(s, r"[^0-9]", ""))
        attributed = s.rlike(rules.ATTRIBUTION) & (s.rlike(rules.ADDRESS_HINT) | ((F.length(s) <= 140) & (digits >= 4)))
        previous = F.when(i > 0, F.trim(F.get(lines, i - 1))).otherwise("")
        following = F.slice(F.filter(F.slice(lines, i + 2, F.size(lines)), lambda x: F.trim(x) != ""), 1, 12)
        labels = F.size(F.filter(following, lambda x: x.rlike(rules.HEADER_FOLLOW)))
        header = F.when(line.rlike(rules.HEADER_FIRST) & ((previous == "") | previous.rlike(rules.DASHES)), labels >= 3).otherwise(False)
        return F.when(s.rlike(rules.CUT_LINE) | attributed | header, i)

    return F.coalesce(F.array_min(F.transform(lines, starts)), F.size(lines))


def new_content(text: Column, preserve: Column | None = None) -> Column:
    """What the writer wrote: without quoted mail, quoted lines and signature; a tail already preserved stays.

    Where ``preserve`` holds, the quoted part is kept below the mark.  Applied again it changes nothing.
    """
    preserve = F.lit(False) if preserve is None else preserve
    text = F.coalesce(text, F.lit(""))
    marked = ~preserve & F.contains(text, F.lit(rules.PRESERVED))
    head_in = F.when(marked, F.substring_index(text, rules.PRESERVED, 1)).otherwise(text)
    tail_in = F.when(marked, F.substring(text, F.instr(text, rules.PRESERVED), F.length(text))).otherwise("")
    tidy = lambda a: F.regexp_replace(F.regexp_replace(F.array_join(a, "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")

    def own_part(head: Column) -> Column:
        signed = F.array_min(F.transform(head, lambda s, i: F.when((i > 0) & F.trim(s).rlike(rules.SIGNATURE), i)))
        return tidy(F.slice(head, F.lit(1), F.coalesce(signed, F.size(head))))

    def parts(lines: Column, cut: Column) -> Column:
        own = let(F.filter(F.slice(lines, F.lit(1), cut), lambda s: ~F.ltrim(s).startswith(">")), own_part)
        quoted = F.when(preserve & (cut < F.size(lines)), tidy(F.slice(lines, cut + 1, F.greatest(F.size(lines) - cut, F.lit(1))))).otherwise("")
        return F.struct(own.alias("own"), quoted.alias("quoted"))

    def joined(p: Column) -> Column:
        gap = F.when(p["own"] != "", F.concat(p["own"], F.lit("\n\n"))).otherwise("")
        return F.when(p["quoted"] != "", F.concat(gap, F.lit(rules.PRESERVED + "\n"), p["quoted"])).when(tail_in != "", F.concat(gap, tail_in)).otherwise(p["own"])

    return let(let(F.split(head_in, "\n"), lambda lines: let(cut_line(lines), lambda cut: parts(lines, cut))), joined)


def smart_truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters: three fifths from the beginning, how much is left out, and the end, where conclusions stand.

    A row of a table that a cut falls into goes whole.  A limit with no room for both parts leaves the beginning.
    """
    room = limit - 24  # the mark takes up to so much
    if room < 20:
        return F.substring(text, 1, limit)
    head = F.substring(text, 1, room * 6 // 10)
    open_row = F.substring_index(head, "\n", -1)
    head = F.when(open_row.startswith("|") & (F.length(open_row) < F.length(head)), F.substring(head, F.lit(1), F.length(head) - F.length(open_row))).otherwise(head)
    tail = F.substring(text, -(room - room * 6 // 10), room)
    torn = F.substring_index(tail, "\n", 1)
    tail = F.when(F.contains(torn, F.lit("|")) & (F.length(torn) < F.length(tail)), F.substring(tail, F.length(torn) + 2, F.length(tail))).otherwise(tail)
    both = let(F.struct(F.rtrim(head).alias("head"), F.ltrim(tail).alias("tail")), lambda p: F.concat(
        # The words of the mark, "left out" and "characters".
        p["head"], F.lit("\n…(중략 — "), F.format_number(F.length(text) - F.length(p["head"]) - F.length(p["tail"]), 0), F.lit("자)…\n"), p["tail"]
    ))
    return F.when(F.length(text) <= limit, text).otherwise(both)


def lead_line(text: Column, greeting_max: int = 12) -> Column:
    """First line that is no short greeting."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda s: s != "")
    real = F.filter(lines, lambda s: ~(s.rlike(r"(?iU)^(안녕하세요|안녕하십니까|hi|hello|dear)\b") & (F.length(s) <= greeting_max + 12)))
    return F.coalesce(F.get(real, F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))


def json_object(text: Column) -> Column:
    """The piece from the first brace to the last, if it is JSON; nothing otherwise."""
    # As the only one of a list: a parser stops behind an object, whatever follows it.
    alone = lambda held: held.isNotNull() & F.try_variant_get(held, "$[1]", "variant").isNull()
    return let(F.regexp_extract(text, r"(?s)(\{.*\})", 1), lambda piece: F.when(let(F.try_parse_json(F.concat(F.lit("["), piece, F.lit("]"))), alone) & (piece != ""), piece))


def stemmed(word: Column) -> Column:
    """A Korean word without ending, form of address and particle, each taken off where two letters stay; others as they are."""
    def shorter(w: Column, pattern: str) -> Column:
        return let(F.regexp_replace(w, pattern, ""), lambda s: F.when(F.length(s) >= 2, s).otherwise(w))

    korean = let(let(shorter(word, rules.ENDING), lambda w: shorter(w, rules.HONORIFIC)), lambda w: shorter(w, rules.PARTICLE))
    return F.when(word.rlike("^[가-힣]"), korean).otherwise(word)


def tokens(text: Column) -> Column:
    """Runs of letters that may be words, in order, once addresses and links are out."""
    linked = F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")) | F.contains(text, F.lit("www."))
    plain = F.when(linked, F.regexp_replace(text, rules.URL, " ")).otherwise(text)
    return F.regexp_extract_all(plain, F.lit(rules.WORD), F.lit(0))


def counted(word: Column, stop: list[str] | tuple[str, ...]) -> Column:
    """Is a stemmed word one of the vocabulary?"""
    return (F.length(word) >= 2) & ~F.lower(word).isin(*[s.lower() for s in stop]) if stop else F.length(word) >= 2


def words(text: Column, stop: list[str] | tuple[str, ...] = rules.STOP_WORDS) -> Column:
    """Vocabulary words in order: without addresses and links, endings, forms of address and particles; no stop words."""
    return F.filter(F.transform(tokens(own_text(F.coalesce(text, F.lit("")))), stemmed), lambda w: counted(w, stop))
