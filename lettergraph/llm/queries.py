"""Registered queries of the training-data operators, one an operator, and their SQL.

Each query reads its whole table, runs the operator and derives the digest
columns of its contract from the operator's own results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettergraph.llm import chat, decontaminate, exact_dedup, importance, mixing, near_dedup, packing, pii, quality, runs, secrets, sharding, substring_dedup
from lettergraph.llm._shared import small_batches
from lettergraph.shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under 35-word windows that occur twice are removed."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, out="d").select("doc_id", "d.n_words", "d.n_removed", _sha(F.col("d.kept_text")).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern and by inferred format."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("secrets", lambda s: s["kind"] != "format")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], _sha(pii.span_list(base)).alias("base_sha256"), pii.span_list(F.col("secrets")).alias("spans"),
        count("format").alias("n_format"), F.array_join(F.transform("secrets", lambda s: F.round(s["score"], 6).cast("string")), ",", "").alias("scores"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts by streaming keyed state; the largest id stays."""
    found = exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights by systematic sampling."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_plan(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the benchmark's 13-word windows."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "decon.n_words", "decon.n_hit", F.size("decon.items").cast("bigint").alias("n_items"), _sha(F.array_join(F.array_sort("decon.items"), ",")).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards by a weighted hash tree over doc_id."""
    text = F.coalesce("text", F.lit(""))
    # What the result says of a text is taken from it first, so that no text travels.
    narrow = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("tie")
    )
    placed = sharding.with_shards(narrow, sharding.even_tree(16), text_col="tie")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", sharding.shard_of(F.col("doc_id"), sharding.even_tree(17)).alias("grown_shard"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by pattern and terms that disclose it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("pii", lambda s: s["kind"] != "term")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS], _sha(pii.span_list(base)).alias("base_sha256"), pii.span_list(F.col("pii")).alias("spans"))


#: The contract's own conversation: control strings inside texts.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations folded, rendered and read back from the output."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    out = chat.render(chat.fold_messages(chat.turn_log(turns.unionByName(hard))))
    back = chat.read_turns(F.col("formatted"))
    learnt = chat.masked_text(F.col("formatted"), F.col("loss_mask"))
    return out.select("conv_id", "formatted", back.alias("back"), learnt.alias("learnt")).select(
        "conv_id", F.size("back").cast("bigint").alias("n_turns"),
        _sha(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"), _sha(F.col("learnt")).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores by positive-unlabelled learning."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components at a similarity of 0.85 over five-word shingles."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_dedup.near_duplicates(docs, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn towards the benchmark's words and pairs of words."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = importance.importance(docs, _table(spark, sf_dir, "benchmark"), out="i").select("doc_id", "i")
    return importance.draw(scored, report="i").select("doc_id", "i.n_features", "i.weight", "i.score", "rank")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 1024 by certified best fit."""
    import public_tokenizers

    small_batches(spark, 2000)
    each = packing.exploded_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    pieces = written(each.select("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pieces.join(packing.packed(pieces), "uid").drop("uid")


def with_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in texts whose id's checksum ends in 0, the words from one place on go round in a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w").cast("bigint"))
    placed = cut.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n"))).withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    round_ = F.transform("w", lambda _, i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(round_, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words by a harmonic grid of common extensions."""
    small_batches(spark)
    docs = with_tails(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    r = F.col("r.runs")
    best = F.array_min(F.transform(r, lambda x: F.struct((-x["length"]).alias("n"), x["start"].alias("start"), x["period"].alias("period"))))
    lines = F.array_join(F.transform(r, lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    found = runs.periodic_runs(docs, out="r").select("doc_id", F.size(r).cast("bigint").alias("n_runs"), best.alias("best"), _sha(lines).alias("runs_sha256"), _sha(F.col("r.collapsed")).alias("collapsed_sha256"))
    length = -F.col("best.n")
    return found.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_secret_scan, op3_exact_dedup, op4_mixing, op5_decontaminate, op6_sharding, op7_pii, op8_chat, op9_quality, op10_near_dedup, op11_importance, op12_packing, op13_periodic_runs, pipeline)
}

_WORDS = r"[x FOR x IN string_split_regex({text}, '[\x20\x09-\x0D]+') IF x <> '']"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of the sixteen half bytes, lowest bit first.
_CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[]"


def _half(u: str) -> str:
    return f"xor(({u}) >> 4, ({_CRC})[(({u}) & 15) + 1])"


def _crc32(hexed: str) -> str:
    """CRC-32 of the bytes that a string of hex digits spells."""
    return f"xor(list_reduce([4294967295::BIGINT] || [('0x' || x)::BIGINT FOR x IN regexp_extract_all({hexed}, '..')], lambda c, b: {_half(_half('xor(c, b)'))}), 4294967295::BIGINT)"


def _won(paths: list[str], weights: list[int]) -> str:
    """Number of the child whose draw is smallest; paths are SQL."""
    draws = [f"-ln((('0x' || substr(md5('{sharding.SEED}' || {p} || ':' || key), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(16**13)}) / {w}" for p, w in zip(paths, weights, strict=True)]
    return f"(SELECT list_position(d, list_min(d)) - 1 FROM (SELECT [{', '.join(draws)}] AS d))"


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
twice AS (SELECT key FROM windows GROUP BY key HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM windows SEMI JOIN twice USING (key), range(35) AS r(o)),
placed AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)""",
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER.format(text="coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256 FROM d WINDOW g AS (PARTITION BY t)""",
    "op4_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format(text="coalesce(text, '')")})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS turn, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT coalesce((SELECT level FROM l WHERE cap > level * weight ORDER BY turn LIMIT 1), 0) AS level),
t AS (SELECT source, source_size, least(cap, f.level * weight) AS target FROM l, f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)) * 16 + floor(size * 16 / power(2.0, length(bin(size)))),
      ('0x' || substr(md5('slot {mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 3))::BIGINT, size, doc_id NULLS FIRST)::DOUBLE AS place,
      ('0x' || substr(md5('offset {mixing.SEED}:' || coalesce(source, 'null')), 1, 13))::BIGINT::DOUBLE / {float(16**13)} AS u FROM d),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e, place, u FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(place * e + u) - floor((place - 1) * e + u)) * size)::BIGINT AS taken FROM c""",
    "op5_decontaminate": rf"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, [x FOR x IN string_split_regex({_LOWER.format(text="coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS key FROM (SELECT item, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, [x FOR x IN string_split_regex({_LOWER.format(text="coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hits AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw USING (n, key)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_sharding": f"""
WITH k AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, encode(coalesce(text, '')) AS bytes FROM documents),
g AS (SELECT *, {_won(["'/g0'", "'/g1'"], [8, 8])} AS region, {_won(["'/g0'", "'/g1'", "'/g2'"], [8, 8, 1])} AS grown FROM k),
r AS (SELECT *, {_won(["'/g' || region || '/k0'", "'/g' || region || '/k1'"], [4, 4])} AS rack FROM g),
s AS (SELECT *, (region * 8 + rack * 4 + {_won([f"'/g' || region || '/k' || rack || '/' || (region * 8 + rack * 4 + {i})" for i in range(4)], [1] * 4)})::INTEGER AS shard FROM r)
SELECT doc_id, octet_length(bytes)::BIGINT + 1 AS size, 'key' AS law, shard, (CASE grown WHEN 2 THEN 16 ELSE shard END)::INTEGER AS grown_shard,
  {_crc32("hex(bytes)")} AS text_crc32,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot {sharding.SEED}:' || key), 1, {sharding.BUCKET_DIGITS}))::BIGINT, doc_id NULLS FIRST) - 1 AS slot FROM s""",
    "op8_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
e AS (SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * m >= 85 * (nx.n + ny.n - m)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS low FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id <= coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op11_importance": rf"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex({_LOWER.format(text="coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM documents),
e AS (SELECT [x FOR x IN string_split_regex({_LOWER.format(text="coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM benchmark),
f AS (SELECT doc_id, unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS f FROM d),
fe AS (SELECT unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS f FROM e),
b AS (SELECT f, {_crc32("hex(encode(f))")} % 10000 AS b FROM (SELECT f FROM f UNION SELECT f FROM fe)),
s AS (SELECT b, count(*) AS s FROM f JOIN b USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM fe JOIN b USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM fe) + 10000)::DOUBLE))) AS gain FROM s LEFT JOIN t USING (b)),
w AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (b) GROUP BY doc_id),
r AS (SELECT doc_id, len(ws) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM r WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM o) * 25 // 100 THEN rank END AS rank FROM r LEFT JOIN o USING (doc_id)""",
    "op13_periodic_runs": rf"""
WITH k AS (SELECT doc_id, {_crc32("hex(encode(doc_id::VARCHAR))")} AS h, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
a AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM k),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE [ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] END AS ws FROM p),
e AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM t),
same AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND (y.i - x.i) * 2 <= x.n),
isle AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM same) GROUP BY doc_id, p, g),
run AS (SELECT doc_id, start, length, min(p) AS period FROM isle WHERE length >= greatest(12, 2 * p) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM e ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
told AS (SELECT doc_id, count(*) AS n_runs, arg_min(run, (-length, start, period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, (best.length * 1000 // best.period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
