"""Vocabulary of people: terms and phrases by message, scores against everyone else, clusters, rising terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions.rules import STOP_WORDS
from lettergraph.functions.text import counted, let, normalised_subject, own_text, sentences, stemmed, tokens
from lettergraph.operators.gates import set_fingerprints
from lettergraph.shared import written

MIN_SUPPORT = 2


def bags(m: DataFrame, who: str = "sender_addr", stop: tuple[str, ...] = STOP_WORDS, people_words: list[str] | None = None) -> DataFrame:
    """Each message's distinct terms and phrases (neighbouring words of one sentence).

    A sentence ends at white space, and so within no word: terms come from the whole text, and only phrases need sentences.
    """
    terms, phrases = _bag(F.col("own"), stop, people_words)
    rows = m.withColumn("own", own_text(F.coalesce("body", F.lit(""))))
    return rows.select(F.col(who).alias("who"), "id", "thread_id", *(["sent_ts"] if "sent_ts" in m.columns else []), terms.alias("terms"), phrases.alias("phrases"))


def bag(text: Column, stop: tuple[str, ...] = STOP_WORDS, people_words: list[str] | None = None) -> Column:
    """One text's terms and phrases, as a struct."""
    def both(own: Column) -> Column:
        terms, phrases = _bag(own, stop, people_words)
        return F.struct(terms.alias("terms"), phrases.alias("phrases"))

    return let(own_text(F.coalesce(text, F.lit(""))), both)


def _bag(own: Column, stop: tuple[str, ...], people_words: list[str] | None) -> tuple[Column, Column]:
    names = [n.lower() for n in people_words or []]
    named = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    kept = lambda text: F.transform(F.filter(F.transform(tokens(text), stemmed), lambda w: counted(w, stop)), F.lower)
    beside = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.flatten(F.transform(sentences(own), lambda s: let(kept(s), beside)))
    real = F.filter(pairs, lambda p: (p["a"] != p["b"]) & ~F.array_contains(named, p["a"]) & ~F.array_contains(named, p["b"]))
    return F.array_except(F.array_distinct(kept(own)), named), F.array_distinct(F.transform(real, lambda p: F.concat_ws(" ", p["a"], p["b"])))


def document_frequency(b: DataFrame, column: str = "terms") -> DataFrame:
    """(who, term, messages that hold it), partial counts before the shuffle."""
    # Outer: for a plain explode Spark makes a filter of the array's size, which would build every array twice.
    return b.select("who", F.explode_outer(column).alias("term")).where("term IS NOT NULL").groupBy("who", "term").agg(F.count("*").alias("df"))


def term_scores(b: DataFrame, column: str = "terms", least: int = MIN_SUPPORT) -> DataFrame:
    """Support, lift against all others and score of each person's terms; texts are cut into terms once."""
    own, sizes = document_frequency(b, column), b.groupBy("who").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all_n"))
    # The frequency with everyone, beside each person's: a term's window holds one row a person that uses it.
    rows = own.withColumn("all_df", F.sum("df").over(Window.partitionBy("term"))).where(F.col("df") >= least).join(sizes, "who").join(F.broadcast(total))  # one row
    return rows.select("who", "term", "df", *_score(F.col("df"), F.col("n"), F.col("all_df") - F.col("df"), F.col("all_n") - F.col("n"), column == "phrases"))


def _score(df: Column, n: Column, other: Column, other_n: Column, phrase: bool) -> list[Column]:
    # 0.35 and 1.18, and 0.12 of the clusters; scores and groups rest on these.
    lift = F.log(((df + 0.5) / (n + 1)) / ((other + 0.5) / (other_n + 1)))
    score = F.log1p(df) * F.sqrt(df / F.greatest(n, F.lit(1))) * (F.greatest(lift, F.lit(0.0)) + 0.35) * (1.18 if phrase else 1.0)
    return [lift.alias("lift"), score.alias("score")]


def top_terms(scores: DataFrame, limit: int = 25) -> DataFrame:
    """Each person's best terms: the best ``limit`` of 64 shares by the term's hash, then the best of these."""
    best = scores.select("who", "term", "df", "lift", "score", F.pmod(F.xxhash64("term"), F.lit(64)).alias("share"))
    for keys in (["who", "share"], ["who"]):
        best = best.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(-F.col("score"), "term"))).where(F.col("nth") <= limit)
    return best.drop("share", "nth")


def npmi(b: DataFrame, chosen: DataFrame, least: int = MIN_SUPPORT) -> DataFrame:
    """Association of each person's chosen terms: normalised pointwise mutual information over messages, or adjacency.

    ``chosen`` (who, term) is at most a few dozen terms a person, so pairs are bounded by it, not by the messages' length.
    """
    kept = b.join(chosen.groupBy("who").agg(F.collect_set("term").alias("mine")), "who").withColumn("t", F.array_sort(F.array_intersect("terms", "mine")))
    sizes, df = b.groupBy("who").agg(F.count("*").alias("n")), document_frequency(kept.select("who", F.col("t").alias("terms")))
    # Which pairs stand side by side is looked up in the few phrases made of chosen terms, before pairs become rows.
    joined = lambda x, y: F.concat_ws(" ", x, y)
    close = F.array_intersect("phrases", F.flatten(F.transform("t", lambda x: F.transform(F.col("t"), lambda y: joined(x, y)))))
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"), (F.array_contains(F.col("close"), joined(x, y)) | F.array_contains(F.col("close"), joined(y, x))).alias("near"))
    of_message = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice(F.col("t"), i + 2, F.size("t")), lambda y: pair(x, y))))
    pairs = kept.withColumn("close", close).select("who", F.explode_outer(of_message).alias("p"))
    co = pairs.groupBy("who", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("p").alias("co"), F.count_if("p.near").alias("adjacent")).where(F.col("co") >= least)
    rows = co.join(df.select("who", F.col("term").alias("a"), F.col("df").alias("da")), ["who", "a"]).join(df.select("who", F.col("term").alias("b"), F.col("df").alias("db")), ["who", "b"]).join(sizes, "who")
    share = F.col("co") / F.col("n")
    assoc = F.when(share >= 1, 0.0).otherwise(F.log(share / ((F.col("da") / F.col("n")) * (F.col("db") / F.col("n")))) / -F.log(share))
    return rows.select("who", "a", "b", "co", F.greatest(assoc, F.col("adjacent") / F.least("da", "db") * 0.35).alias("weight"))


def clusters(pairs: DataFrame, largest: int = 6, least: float = 0.12) -> DataFrame:
    """Average-link groups of each person's chosen terms, merged while the best average holds ``least``.

    One group a person over at most a few hundred pairs of chosen terms.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        weight = {frozenset(p): w for *p, w in zip(rows.a, rows.b, rows.weight, strict=True)}
        groups = [[t] for t in sorted({*rows.a, *rows.b})]
        link = lambda x, y: sum(weight.get(frozenset((s, t)), 0.0) for s in x for t in y) / (len(x) * len(y))
        while True:
            options = [(link(x, y), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j and len(x) + len(y) <= largest]
            if not options or max(options)[0] < least:
                break
            _, i, j = max(options)
            groups[-i] += groups.pop(-j)
        return pd.DataFrame([(rows.who.iloc[0], k, t) for k, g in enumerate(g for g in groups if len(g) > 1) for t in sorted(g)], columns=["who", "cluster", "term"])

    return pairs.groupBy("who").applyInPandas(merge, "who string, cluster long, term string")


def rising(b: DataFrame, weeks: int = 6, least: int = 2, older: int = 3, ratio: float = 1.8) -> DataFrame:
    """Terms more frequent in the newest weeks than before; ``b`` has sent_ts."""
    edge = b.agg((F.max("sent_ts") - F.make_dt_interval(F.lit(7 * weeks))).alias("since"))
    split = b.join(F.broadcast(edge)).withColumn("new", F.col("sent_ts") >= F.col("since"))  # one row
    sizes = split.groupBy("who").agg(F.count_if("new").alias("n_new"), F.count_if(~F.col("new")).alias("n_old")).where((F.col("n_new") >= least) & (F.col("n_old") >= older))
    df = split.select("who", "new", F.explode_outer("terms").alias("term")).where("term IS NOT NULL").groupBy("who", "term").agg(F.count_if("new").alias("d_new"), F.count_if(~F.col("new")).alias("d_old"))
    rate = ((F.col("d_new") + 0.5) / (F.col("n_new") + 1)) / ((F.col("d_old") + 0.5) / (F.col("n_old") + 1))
    return df.where(F.col("d_new") >= least).join(sizes, "who").select("who", "term", "d_new", "d_old", rate.alias("ratio")).where(F.col("ratio") >= ratio)


def with_first_subjects(m: DataFrame) -> DataFrame:
    """Messages with a ``words`` column: the body, and below it the subject where it is the sender's first with that thread.

    Answers repeat a subject, so it is the writer's word once only; reply marks are not part of it.
    """
    first = m.groupBy("sender_addr", "thread_id").agg(F.min_by("id", F.struct("sent_ts", "id")).alias("_first"))
    named = m.join(first, ["sender_addr", "thread_id"], "left")
    own = own_text(F.coalesce("body", F.lit("")))
    subject = F.when(F.col("id") == F.col("_first"), F.concat(F.lit("\n"), normalised_subject(F.coalesce("subject", F.lit(""))))).otherwise("")
    return named.withColumn("words", F.concat(own, subject)).drop("_first")


def word_analysis(m: DataFrame, aliases: DataFrame | None = None, weeks: int = 6, caps: tuple[int, int, int, int] = (8, 5, 5, 5), top: int = 25, **options) -> DataFrame:
    """Everyone's vocabulary in one pass: (who, section, place, term, support, score).

    Sections are ``terms`` and ``phrases`` by score, ``rising`` by ratio among the ``top`` terms, and ``mentions`` of others by
    support (``aliases``: addr, alias), ``caps`` of each.  Texts are cut into words once; one aggregation by person, kind and word
    counts its messages, the recent ones among them, for all sections.  Recent are the last ``weeks`` weeks before a person's
    newest message; nothing rises in fewer than two recent or three older messages.
    """
    b = bags(with_first_subjects(m).withColumn("body", F.col("words")), **options)
    newest = b.groupBy("who").agg((F.max("sent_ts") - F.make_dt_interval(F.lit(7 * weeks))).alias("since"))
    of = lambda kind, column: F.transform(column, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))
    marked = b.join(newest, "who").select("who", "id", F.coalesce(F.col("sent_ts") >= F.col("since"), F.lit(False)).alias("new"), F.col("sent_ts").isNotNull().alias("timed"), F.concat(of("terms", "terms"), of("phrases", "phrases")).alias("all"))
    # A row a message without a word, so that one aggregation has the number of messages too.
    rows = marked.select("who", "new", "timed", F.explode(F.concat(F.array(F.struct(F.lit("mail").alias("kind"), F.lit("").alias("term"))), "all")).alias("t")).select("who", "new", "timed", "t.*")
    counts = written(rows.groupBy("who", "kind", "term").agg(F.count("*").alias("df"), F.count_if("new").alias("d_new"), F.count_if(F.col("timed") & ~F.col("new")).alias("d_old")), "word-counts")
    mail = counts.where("kind = 'mail'").select("who", F.col("df").alias("n"), F.col("d_new").alias("n_new"), F.col("d_old").alias("n_old"))
    everyone = counts.where("kind <> 'mail'").groupBy("kind", "term").agg(F.sum("df").alias("all_df"))
    total = mail.agg(F.sum("n").alias("all_n"))
    told = counts.where(f"kind <> 'mail' AND df >= {MIN_SUPPORT}").join(everyone, ["kind", "term"]).join(mail, "who").join(F.broadcast(total))  # one row
    scores = [_score(F.col("df"), F.col("n"), F.col("all_df") - F.col("df"), F.col("all_n") - F.col("n"), phrase)[1] for phrase in (False, True)]
    scored = told.withColumn("score", F.when(F.col("kind") == "phrases", scores[1]).otherwise(scores[0]))
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("who", "kind").orderBy(-F.col("score"), -F.col("df"), "term"))).where(F.col("place") <= top)
    listed = best.where(f"(kind = 'terms' AND place <= {caps[0]}) OR (kind = 'phrases' AND place <= {caps[1]})").select("who", F.col("kind").alias("section"), "place", "term", F.col("df").alias("support"), "score")
    ratio = ((F.col("d_new") + 0.5) / (F.col("n_new") + 1)) / ((F.col("d_old") + 0.5) / (F.col("n_old") + 1))
    risen = best.where("kind = 'terms' AND n_new >= 2 AND n_old >= 3 AND d_new >= 2").withColumn("ratio", ratio).where("ratio >= 1.8")
    place = lambda *order: F.row_number().over(Window.partitionBy("who").orderBy(*order)).alias("place")
    risen = risen.select("who", F.lit("rising").alias("section"), place(-F.col("ratio"), -F.col("d_new"), "term"), "term", F.col("d_new").alias("support"), F.col("ratio").alias("score")).where(F.col("place") <= caps[2])
    out = listed.union(risen)
    if aliases is not None:
        named = mentions(b, aliases).where(F.col("messages") >= MIN_SUPPORT)
        out = out.union(named.select("who", F.lit("mentions"), place(-F.col("messages"), "addr"), "addr", "messages", F.lit(None).cast("double")).where(F.col("place") <= caps[3]))
    return out


def mentions(b: DataFrame, aliases: DataFrame) -> DataFrame:
    """How many messages of each person name another (``aliases``: addr, alias)."""
    used = b.select("who", "id", F.explode_outer("terms").alias("alias")).join(aliases, "alias").where(F.col("addr") != F.col("who"))
    return used.groupBy("who", "addr").agg(F.count_distinct("id").alias("messages"))


def _word_rows(m: DataFrame, stop: tuple[str, ...]) -> DataFrame:
    """One row a vocabulary word; stems and stop words are settled on rows, in compiled code."""
    raw = m.select(F.explode_outer(tokens(own_text(F.coalesce("body", F.lit(""))))).alias("raw"))
    return raw.where("raw IS NOT NULL").groupBy("raw").agg(F.count("*").alias("n")).select(stemmed(F.col("raw")).alias("word"), "n").where(counted(F.col("word"), stop))


def top_words(m: DataFrame, limit: int = 25, least: int = 2, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Most used words over all texts; each spelling is stemmed once, after it was counted."""
    rows = _word_rows(m, stop).groupBy("word").agg(F.sum("n").alias("n"))
    return rows.where(F.col("n") >= least).orderBy(F.col("n").desc(), "word").limit(limit)


def display_forms(m: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The most frequent spelling of each term."""
    counts = _word_rows(m, stop).groupBy(F.lower("word").alias("term"), F.col("word").alias("surface")).agg(F.sum("n").alias("n"))
    return counts.groupBy("term").agg(F.min_by("surface", F.struct((-F.col("n")).alias("o"), F.lower("surface").alias("l"), "surface")).alias("display"))


def fingerprint(m: DataFrame) -> DataFrame:
    """One value a sender that changes with the set of their messages: cached profiles are keyed by it."""
    return set_fingerprints(m, ["sender_addr"], ["id"])
