"""PII: pattern spans, and terms that reveal a protected entity by co-occurrence.

Base spans are the leftmost non-overlapping matches of four patterns; matches
that fail a kind's check are dropped.  Every matched value is a protected
entity.  How strongly a term reveals one is measured on the corpus: with
``p(e)`` the share of different texts that hold the entity and ``p(e|t)`` the
share among texts that hold the term, the disclosure is
``log(p(e|t) / p(e)) / log(1 / p(e))``, pointwise mutual information over the
entity's own information: 1 when the term never occurs without the entity, 0
when they are unrelated.  Every run of two or more letters and digits anywhere
in a text that holds an entity is judged, however far from it.  For ``p(e|t)``
stands the lower end of its Wilson interval (one-sided, ``z``) without the one
joint text that made the pair a candidate, so rare pairs need more agreement and
a single text proves nothing.  Terms at or above ``disclosure`` become spans of
kind ``term`` in the texts that hold the entity.
``sanitised`` puts a general name in place of entities and removes terms.

Only DataFrame functions are used.  Counts cover whole texts and all of them and
are summed partially before each shuffle; copies of one text count once.

Defined cases: null text is empty; texts of any length are read whole; a term
inside a base span is covered by it; rows that repeat a text get the same spans
and count as one text; an entity of all texts is revealed by nothing; an empty
table has no rows; result columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions.text import let
from lettergraph.llm._shared import free_name
from lettergraph.shared import written

# The base patterns, written with possessive runs where these match the same text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TERM = r"[\p{L}\p{N}]{2,}"
DISCLOSURE = 0.9
Z = 1.2816  # 90 %, one-sided
BLOCK = 128


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        n = F.length(digits)
        at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
        doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        total = F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.lit(0), lambda a, i: a + F.when(i > n, 0).otherwise(F.when((n - i) % 2 == 1, doubled(at(i))).otherwise(at(i))))
        return n.between(16, 19) & F.when(n.between(16, 19), total % 10 == 0).otherwise(False)
    return F.lit(True)


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches with their place: lengths of the pieces between matches and of the matches, summed up.

    Adding a span to a list copies it, so sums run in blocks of ``BLOCK`` matches, then over the blocks: the time stays
    nearly in proportion to the matches of a long text.
    """
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.length(x["value"])).alias("at"),
        F.array_append(acc["spans"], F.struct(
            F.lit(kind).alias("kind"), (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value")
        )).alias("spans"),
    )
    summed = lambda block: F.aggregate(block, zero, step)
    moved = lambda block, at: F.transform(block["spans"], lambda s: F.struct(
        s["kind"].alias("kind"), (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value")
    ))
    far = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<kind:string,start:int,end:int,value:string>>>").alias("spans"))
    along = lambda acc, block: F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["spans"], moved(block, acc["at"])).alias("spans"))
    blocks = lambda pairs: F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda i: summed(F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK))))
    placed = lambda pairs: F.when(F.size(pairs) > BLOCK, F.flatten(F.aggregate(blocks(pairs), far, along)["spans"])).otherwise(summed(pairs)["spans"])
    gaps = lambda values: F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(values))
    pairs = lambda values: F.zip_with(gaps(values), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: F.when(F.size(values) > 0, let(pairs(values), placed)).otherwise(none))


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end,value>> by kind, then start; positions in code points, end exclusive."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    needs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), "phone": F.contains(text, F.lit("+"))}
    checked = lambda k: F.filter(_matches(text, PATTERNS[k], k), lambda s: _passes(k, s["value"]))
    found = [F.when(needs[k], checked(k)).otherwise(none) for k in KINDS]
    return F.coalesce(F.flatten(F.array(*found)), none)


def _entity(span: Column) -> Column:
    """A value under one spelling: letters in lower case, numbers by their digits."""
    plain = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _least_share(both: Column, of: Column, z: float) -> Column:
    """Lower end of the Wilson interval for ``both`` of ``of`` texts, the first joint text left out; 0 if it was the only one."""
    n, p = of - 1, (both - 1) / (of - 1)
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(both > 1, low).otherwise(0.0)


def disclosing_terms(docs: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE, z: float = Z) -> tuple[DataFrame, DataFrame]:
    """(entity, term, score) above the threshold, and (k, term): the terms to take out of each text, by its key."""
    texts = docs.select(F.xxhash64(F.lit(3), F.col(text_col)).alias("k"), F.col(text_col).alias("t"))
    holders = texts.withColumn("s", base_spans(F.col("t"))).where(F.size("s") > 0).select("k", F.array_distinct(F.transform("s", _entity)).alias("entities"), _terms(F.col("t")).alias("terms"))
    holders = written(holders.dropDuplicates(["k"]), "entities")
    places = holders.select("k", F.explode("entities").alias("entity"))
    # Entities of the same texts, such as those of two lists, have the same counts with every term: they are one, named by the
    # smallest.  Sums of two hashes of the texts tell, so no list of an entity's texts is made.  An entity of one text has pairs of
    # one joint text only, whose bound is 0.
    texts_of = [F.sum(F.xxhash64(F.lit(salt), "k").cast("decimal(20)")).alias(f"h{salt}") for salt in (1, 2)]
    known = written(places.groupBy("entity").agg(F.count("*").alias("with_entity"), *texts_of).where("with_entity > 1"), "known")
    classes = known.groupBy("with_entity", "h1", "h2").agg(F.min("entity").alias("head"))
    member = known.join(classes, ["with_entity", "h1", "h2"]).select("entity", "head")
    at = written(places.join(member, "entity").select("k", "head").distinct(), "places")
    total = texts.agg(F.count_distinct("k").alias("texts"))
    held = written(classes.crossJoin(F.broadcast(total)).select("head", (F.col("with_entity") / F.col("texts")).alias("share")).where("share < 1"), "held")  # one row
    score = lambda of: 1 - F.log(_least_share(F.col("both"), of, z)) / F.log("share")
    heads = at.groupBy("k").agg(F.collect_list("head").alias("heads"))
    pairs = heads.join(holders.select("k", "terms"), "k").select("terms", F.explode("heads").alias("head")).select("head", F.explode("terms").alias("term"))
    # A term has at least its joint texts, and the score falls with its texts: what fails on these fails on all.
    joint = pairs.groupBy("head", "term").agg(F.count("*").alias("both")).where("both > 1").join(held, "head").where(score(F.col("both")) >= disclosure)
    joint = written(joint, "joint")
    if joint.isEmpty():
        empty = docs.sparkSession.createDataFrame([], "entity string, term string, score double")
        return empty, docs.sparkSession.createDataFrame([], "k bigint, term string")
    # Each text's terms are counted where it lies, so a common term costs no group; outer, as for a plain explode Spark makes a
    # filter of the array's size, which would build every array twice.
    distinct_texts = texts.dropDuplicates(["k"]).select(F.explode_outer(_terms(F.coalesce("t", F.lit("")))).alias("term"))
    with_term = distinct_texts.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("with_term"))
    terms = written(joint.join(with_term, "term").select("head", "term", score(F.col("with_term")).alias("score")).where(F.col("score") >= disclosure), "terms")
    per_text = written(at.join(terms, "head").select("k", "term").distinct(), "per-text")
    return terms.join(member, "head").select("entity", "term", "score"), per_text


def _free_words(docs: DataFrame, text_col: str, per_text: DataFrame) -> DataFrame:
    """(k, words): of each text that has terms to take out, those of its words that no base span touches.

    Words and spans are rows in order of their place, looked at beside the furthest end before and the next start behind them,
    so a text of many words, terms and spans takes sorting them and no more.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(F.lit(3), F.col(text_col)).alias("k"), text.alias("t")).join(per_text.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])
    words = texts.select("k", F.explode(_matches(F.col("t"), TERM, "term")).alias("s")).withColumn("term", F.lower("s.value")).join(per_text, ["k", "term"], "left_semi").drop("term")
    rows = words.withColumn("base", F.lit(False)).unionByName(texts.select("k", F.explode(base_spans(F.col("t"))).alias("s"), F.lit(True).alias("base")))
    order = Window.partitionBy("k").orderBy("s.start", F.col("base").desc())
    before, behind = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    near = rows.withColumn("ended", F.max(F.when(F.col("base"), F.col("s.end"))).over(before)).withColumn("next", F.min(F.when(F.col("base"), F.col("s.start"))).over(behind))
    free = near.where("NOT base AND coalesce(ended <= s.start, true) AND coalesce(next >= s.end, true)")
    return free.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("s.start", "s.end", "s.kind", "s.value"))).alias("words"))


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii", **options) -> DataFrame:
    """``docs`` with array ``out`` of spans (kind, start, end, value): base kinds as listed, then terms."""
    key, words = free_name(docs, "_text_key"), free_name(docs, "_words")
    _, per_text = disclosing_terms(docs, text_col, **options)
    keyed = docs.withColumn(key, F.xxhash64(F.lit(3), F.col(text_col))).withColumn(out, base_spans(F.coalesce(F.col(text_col), F.lit(""))))
    free = _free_words(docs, text_col, per_text).select(F.col("k").alias(key), F.transform("words", lambda w: F.struct(w["kind"], w["start"], w["end"], w["value"])).alias(words))
    return keyed.join(free, key, "left").withColumn(out, F.when(F.col(words).isNull(), F.col(out)).otherwise(F.concat(F.col(out), F.col(words)))).drop(key, words)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities generalised to ``[KIND]`` and disclosing terms removed; of overlapping spans the first counts."""
    text = F.coalesce(text, F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    name = lambda s: F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
        s["end"].alias("at"), F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), name(s)).alias("done")
    ))
    return F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
