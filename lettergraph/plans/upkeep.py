"""Queries of tables that are kept up to date: the search index, chunked ingest, the rolling vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettergraph.functions import text
from lettergraph.functions.dates import stamp
from lettergraph.operators import vocabulary
from lettergraph.operators.gates import Gates, Stage, changed_sums, fingerprint, same_rows, set_sums
from lettergraph.operators.notes import Notes
from lettergraph.operators.search_index import SearchIndex
from lettergraph.operators.state import open_actions
from lettergraph.operators.texts import by_text
from lettergraph.shared import shared_path
from lettergraph.sources import adapters, letters
from lettergraph.sources.adapters import DOCUMENT_SQL, EVENT_SQL
from lettergraph.streaming.chunks import Ingest
from lettergraph.versions import Versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ the search index


def document_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, SearchIndex]:
    """All documents as messages, and their index made of two segments."""
    m = adapters.document_messages(_table(spark, sf_dir, "documents"))
    index = SearchIndex(Versions(spark, shared_path(spark, "index")))
    index.add(m.where("id % 3 > 0"))
    index.add(m.where("id % 3 = 0"))
    return m, index


@query(f"""WITH {DOCUMENT_SQL}, c AS (SELECT id, string_split(lower(body), '') AS c FROM m), g AS (SELECT DISTINCT id, (unicode(c[i]) * 4398046511104 + unicode(c[i + 1]) * 2097152 + unicode(c[i + 2]))::BIGINT AS gram FROM (SELECT id, c, unnest(range(1, len(c) - 1)) AS i FROM c))
SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trigram with the number of documents that hold it, from the merged postings."""
    _, index = document_index(spark, sf_dir)
    return index.versions.read("postings", index.merge()).groupBy("gram").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ chunked ingest

_CUTS = ("2024-01-09", "2024-01-16", "2024-01-23")
N_CHUNKS = len(_CUTS) + 1
_KINDS = ("alpha", "bravo", "charlie", "delta", "echo"), ("north", "south", "east")


def arriving(m: DataFrame) -> DataFrame:
    """Messages with the chunk they arrive in: by time, every fortieth at the very end, every fiftieth a second time under its neighbour's message id."""
    chunk = F.lit(3)
    for i in reversed(range(len(_CUTS))):
        chunk = F.when(F.col("sent_ts") < F.lit(_CUTS[i]).cast("timestamp_ntz"), i).otherwise(chunk)
    return m.withColumns({
        "chunk": F.when(F.col("id") % 40 == 7, 3).otherwise(chunk),
        "message_id": F.concat(F.lit("<"), (F.col("id") - F.when(F.col("id") % 50 == 49, 1).otherwise(0)).cast("string"), F.lit(">")),
    })


_ARRIVING = f"""{EVENT_SQL}, a AS (SELECT *, CASE WHEN id % 40 = 7 THEN 3 WHEN sent_ts < TIMESTAMP '{_CUTS[0]}' THEN 0 WHEN sent_ts < TIMESTAMP '{_CUTS[1]}' THEN 1 WHEN sent_ts < TIMESTAMP '{_CUTS[2]}' THEN 2 ELSE 3 END AS chunk FROM m WHERE id % 50 <> 49)"""


def _taken(m: DataFrame, name: str, **options) -> Ingest:
    """All chunks of ``m`` taken in by a stream, one run each; a run that fails is started again."""
    spark = m.sparkSession
    inbox, checkpoint = shared_path(spark, f"{name}-inbox"), shared_path(spark, f"{name}-stream")
    ingest = Ingest(Versions(spark, shared_path(spark, name)), **options)
    rows = arriving(m)
    for chunk in range(N_CHUNKS):
        rows.where(F.col("chunk") == chunk).drop("chunk").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.drop("chunk").schema).parquet(inbox)
        try:
            ingest.run(stream, checkpoint)
        except StreamingQueryException:
            ingest.run(stream, checkpoint)
    return ingest


class _FailsOnce:
    """Dies the first time the third chunk has written its signals."""

    def __init__(self) -> None:
        self.seen = 0

    def __call__(self, table: str) -> None:
        self.seen += table == "signals"
        if table == "signals" and self.seen == 3:
            raise RuntimeError("lost between two writes")


@query(f"""WITH t AS ({letters.TRUTH_SQL}), {_ARRIVING} SELECT sender_addr, count(*) AS messages, count_if(t.has_deadline)::BIGINT AS deadlines, count_if(t.has_question)::BIGINT AS questions, 4 AS versions,
(SELECT strftime(max(sent_ts), '%Y-%m-%d %H:%M:%S') FROM a) AS last_sync FROM a JOIN t ON k = id % {letters.N_LETTERS} GROUP BY sender_addr""")
def ingest_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters taken in by four chunks, the third of which dies between two tables and is taken again."""
    m = letters.letter_messages(_table(spark, sf_dir, "events"))
    signals = lambda new: by_text(new.select("id", "body"), "body", "s", lambda body: text.signals(text.new_content(body), F.lit(""), [])).select("id", "s.*")
    ingest = _taken(m, "ingest", derived={"signals": signals}, written=_FailsOnce())
    now = ingest.versions.at()
    read = lambda table: ingest.versions.read(table, now)
    rows = read("messages").select("id", "sender_addr").join(read("signals"), "id", "left")
    return rows.groupBy("sender_addr").agg(
        F.count("*").alias("messages"), F.count_if("has_deadline").alias("deadlines"), F.count_if("has_question").alias("questions"),
        F.lit(now.number).alias("versions"), stamp(F.lit(now.facts["last_sync"]).cast("timestamp_ntz")).alias("last_sync"),
    )


def _lists(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""WITH {_ARRIVING}, w AS (SELECT *, date_trunc('week', sent_ts)::DATE AS week, event_word AS x, {_lists(_KINDS[0])}[thread_id % 5 + 1] AS y, {_lists(_KINDS[1])}[id % 3 + 1] AS z FROM (SELECT *, split_part(subject, ' ', 1) AS event_word FROM a)),
s AS (SELECT c AS chunk, max(week) - 7 AS since FROM w, range(4) AS r(c) WHERE chunk <= c GROUP BY c),
t AS (SELECT s.chunk, sender_addr AS who, unnest([struct_pack(kind := 'term', term := x), struct_pack(kind := 'term', term := y), struct_pack(kind := 'term', term := z), struct_pack(kind := 'phrase', term := x || ' ' || y), struct_pack(kind := 'phrase', term := y || ' ' || z)]) AS t
  FROM w JOIN s ON w.chunk <= s.chunk AND week >= since WHERE NOT is_sent)
SELECT chunk::INTEGER AS chunk, who, t.kind AS kind, t.term AS term, count(*) AS df FROM t GROUP BY ALL""")
def rolling_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the last two weeks after each chunk; what leaves the window was subtracted."""
    m = adapters.event_messages(_table(spark, sf_dir, "events"))
    word = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    body = F.concat_ws(" ", F.substring_index("subject", " ", 1), word(_KINDS[0], F.col("thread_id")), word(_KINDS[1], F.col("id")))
    ingest = _taken(m.withColumn("body", body), "terms", weeks=2)
    windows = [ingest.window(ingest.versions.at(n + 1)).withColumn("chunk", F.lit(n)) for n in range(N_CHUNKS)]
    out = windows[0]
    for w in windows[1:]:
        out = out.union(w)
    return out


# ------------------------------------------------------------------ version gates, cached profiles

_STAGES = (
    Stage("content", lambda t, s: by_text(t["source"], "body", "body", text.new_content)),
    Stage("signals", lambda t, s: by_text(t["content"], "body", "s", lambda body: text.signals(body, F.lit(""), s["names"])).select(
        "part", "id", "thread_id", "sent_ts", "is_sent", "sender_addr", *[F.col(f"s.{k}") for k in letters.FLAG_NAMES], F.col("s.mentions_me")), ("content",), ("names",)),
    Stage("fold", lambda t, s: open_actions(t["signals"], F.col("sender_addr").isin(s["ignored"])), ("signals",), ("ignored",), whole=True),
)
_CHANGES = ("first", "again", "ignored", "names", "one message", "tail below")
_IGNORED = [f"u{u}@d3.test" for u in range(3, 1500, 7)]


@query(f"""WITH t AS ({letters.TRUTH_SQL}), {EVENT_SQL}, w AS (SELECT count(DISTINCT date_trunc('week', sent_ts)) AS n FROM m), c(step, change, content, signals, fold) AS (VALUES
  (0, 'first', 9, 9, 1), (1, 'again', 0, 0, 0), (2, 'ignored', 0, 0, 1), (3, 'names', 0, 9, 0), (4, 'one message', 1, 1, 1), (5, 'tail below', 1, 0, 0))
SELECT change, (CASE content WHEN 9 THEN n ELSE content END)::INTEGER AS content, (CASE signals WHEN 9 THEN n ELSE signals END)::INTEGER AS signals, fold::INTEGER AS fold, true AS as_rebuilt FROM c, w""")
def version_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many weeks each stage computed after each change of settings or messages, and whether all tables are those of a rebuild."""
    m = letters.letter_messages(_table(spark, sf_dir, "events")).select(F.date_format(F.date_trunc("week", "sent_ts"), "yyyy-MM-dd").alias("part"), "id", "thread_id", "sent_ts", "is_sent", "sender_addr", "body")
    late = m.where("id = 0").withColumns({"id": F.lit(-1).cast("bigint"), "body": F.lit("Please send the list by Friday."), "is_sent": F.lit(False), "sender_addr": F.lit("new@x.test")})
    below = m.withColumn("body", F.when(F.col("id") == 0, F.concat("body", F.lit("\n\n-----Original Message-----\nold"))).otherwise(F.col("body")))
    plain, strict, named = ({"names": names, "ignored": ignored} for names, ignored in (([], []), ([], _IGNORED), (["Nobody Here"], _IGNORED)))
    steps = ((m, plain), (m, plain), (m, strict), (m, named), (m.unionByName(late), named), (below.unionByName(late), named))
    gates, rows = Gates(Versions(spark, shared_path(spark, "gates")), _STAGES), []
    for change, (source, settings) in zip(_CHANGES, steps, strict=True):
        ran = [stage for stage, _ in gates.refresh(source, settings)]
        rows.append((change, ran.count("content"), ran.count("signals"), ran.count("fold")))
    # After the last step: each table against one that was never kept.
    full = Gates(Versions(spark, shared_path(spark, "rebuilt")), _STAGES)
    full.refresh(*steps[-1])
    same = all(same_rows(gates.read(s.name), full.read(s.name)) for s in _STAGES)
    return spark.createDataFrame([(*r, same) for r in rows], "change string, content int, signals int, fold int, as_rebuilt boolean")


@query(f"""WITH {EVENT_SQL} SELECT sender_addr, bool_or(id % 10 IN (3, 4, 5)) AS stale, true AS as_recounted FROM m GROUP BY sender_addr HAVING count_if(id % 10 <> 3) > 0""")
def profile_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose cached profile is stale after some messages came, some left and some came twice over; kept sums against counting anew."""
    m = adapters.event_messages(_table(spark, sf_dir, "events")).select("sender_addr", "id", "sent_ts", "subject")
    r = F.col("id") % 10
    before, come, gone = m.where(r != 4), m.where(r == 4).union(m.where(r == 5)).union(m.where(r == 5)), m.where(r == 3)
    now = m.where(r != 3).union(m.where(r == 5)).union(m.where(r == 5))
    sums = lambda rows: rows.groupBy("sender_addr").agg(*set_sums("id", "sent_ts", "subject"))
    told = lambda df, name: df.select("sender_addr", fingerprint().alias(name))
    kept = told(changed_sums(sums(before), sums(come), sums(gone), ["sender_addr"]), "kept")
    rows = told(sums(now), "now").join(told(sums(before), "cached"), "sender_addr", "left").join(kept, "sender_addr", "left")
    return rows.select("sender_addr", (~F.col("now").eqNullSafe(F.col("cached"))).alias("stale"), F.col("now").eqNullSafe(F.col("kept")).alias("as_recounted"))


# ------------------------------------------------------------------ notes


@query("""WITH RECURSIVE e AS (SELECT user_id AS note_id, event_id AS nr, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN event_id % 3 ELSE event_id % 7 END AS seen,
  CASE event_type WHEN 'error' THEN '' ELSE event_type || ' text' END AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT note_id, 0::BIGINT AS k, NULL::BIGINT AS nr, '' AS outcome, 0::BIGINT AS version, 0::BIGINT AS last, '' AS body FROM (SELECT DISTINCT note_id FROM e)
  UNION ALL SELECT note_id, k, nr, o, CASE WHEN o IN ('conflict', 'noop') OR (o = 'saved' AND same) THEN version WHEN o = 'deleted' THEN 0 ELSE last + 1 END,
    CASE WHEN o = 'created' OR (o = 'saved' AND NOT same) THEN last + 1 ELSE last END, CASE o WHEN 'conflict' THEN was WHEN 'noop' THEN was ELSE body END
  FROM (SELECT e.note_id, e.k, e.nr, e.body, f.version, f.last, f.body AS was, e.body = f.body AS same,
    CASE WHEN e.seen <> f.version THEN 'conflict' WHEN e.body = '' AND f.version > 0 THEN 'deleted' WHEN e.body = '' THEN 'noop' WHEN f.version = 0 THEN 'created' ELSE 'saved' END AS o
    FROM f JOIN e ON e.note_id = f.note_id AND e.k = f.k + 1))
SELECT note_id, nr, outcome, version FROM f WHERE k > 0""")
def note_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of a note a user, some of which saw a version that is no longer there, applied in two goes."""
    e, n = _table(spark, sf_dir, "events"), F.col("event_id")
    edits = e.select(
        F.col("user_id").alias("note_id"), n.alias("nr"), F.when(n % 4 == 1, 0).when(n % 4 == 2, n % 3).when(n % 4 == 3, n % 7).cast("bigint").alias("seen"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat("event_type", F.lit(" text\r\n"))).alias("body"),
    )
    notes = Notes(Versions(spark, shared_path(spark, "notes")))
    half = F.lit("2024-01-15").cast("timestamp")
    first = notes.edit(edits.join(e.where(F.col("ts") < half).select(n.alias("nr")), "nr", "left_semi").select(edits.columns))
    return first.union(notes.edit(edits.join(e.where(F.col("ts") >= half).select(n.alias("nr")), "nr", "left_semi").select(edits.columns)))


# ------------------------------------------------------------------ a person's vocabulary in one call

_ALIASES = (("alpha", "u1@d1.test"), ("bravo", "u2@d2.test"), ("charlie", "u3@d3.test"), ("south", "u4@d4.test"))


@query(f"""WITH {EVENT_SQL}, f AS (SELECT sender_addr, thread_id, arg_min(id, (sent_ts, id)) AS first FROM m GROUP BY 1, 2),
w AS (SELECT sender_addr AS who, id, sent_ts, id = first AS opens, 'ledger' || split_part(subject, ' ', 1) AS x, {_lists(_KINDS[0])}[thread_id % 5 + 1] AS y, {_lists(_KINDS[1])}[id % 3 + 1] AS z, split_part(subject, ' ', 1) AS s FROM m JOIN f USING (sender_addr, thread_id)),
e AS (SELECT who, max(sent_ts) - INTERVAL 14 DAY AS since FROM w GROUP BY who),
b AS (SELECT who, id, sent_ts >= since AS new, list_distinct([x, y, z] || CASE WHEN opens THEN [s] ELSE [] END) AS terms, [x || ' ' || y, y || ' ' || z] AS phrases FROM w JOIN e USING (who)),
t AS (SELECT who, new, unnest(terms) AS term, 'terms' AS kind FROM b UNION ALL SELECT who, new, unnest(phrases), 'phrases' FROM b),
c AS (SELECT who, kind, term, count(*) AS df, count_if(new) AS dn, count_if(NOT new) AS dx FROM t GROUP BY ALL), a AS (SELECT kind, term, sum(df) AS adf FROM c GROUP BY ALL),
n AS (SELECT who, count(*) AS n, count_if(new) AS nn, count_if(NOT new) AS nx FROM b GROUP BY who), g AS (SELECT count(*) AS an FROM b),
l AS (SELECT *, ln(((df + 0.5) / (n + 1)) / ((adf - df + 0.5) / (an - n + 1))) AS lift FROM c JOIN a USING (kind, term) JOIN n USING (who), g WHERE df >= 2),
s AS (SELECT *, ln(1 + df) * sqrt(df / greatest(n, 1)) * (greatest(lift, 0.0) + 0.35) * CASE kind WHEN 'phrases' THEN 1.18 ELSE 1.0 END AS score FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY who, kind ORDER BY score DESC, df DESC, term) AS place FROM s QUALIFY place <= 25),
r AS (SELECT who, term, dn, ((dn + 0.5) / (nn + 1)) / ((dx + 0.5) / (nx + 1)) AS ratio FROM p WHERE kind = 'terms' AND nn >= 2 AND nx >= 3 AND dn >= 2),
h AS (SELECT who, addr, count(DISTINCT id) AS messages FROM (SELECT who, id, unnest(terms) AS term FROM b) JOIN (VALUES {", ".join(f"('{x}', '{y}')" for x, y in _ALIASES)}) AS v(term, addr) USING (term) WHERE addr <> who GROUP BY ALL HAVING count(DISTINCT id) >= 2),
o AS (SELECT who, kind AS section, place, term, df AS support, score FROM p WHERE place <= CASE kind WHEN 'terms' THEN 8 ELSE 5 END
  UNION ALL SELECT who, 'rising', row_number() OVER (PARTITION BY who ORDER BY ratio DESC, dn DESC, term) AS place, term, dn, ratio FROM r WHERE ratio >= 1.8 QUALIFY place <= 5
  UNION ALL SELECT who, 'mentions', row_number() OVER (PARTITION BY who ORDER BY messages DESC, addr) AS place, addr, messages, NULL FROM h QUALIFY place <= 5)
SELECT who, section, place::INTEGER AS place, term, support::BIGINT AS support, round(score, 6) AS score FROM o""")
def word_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, phrases, rising words and mentions of everyone, from one count; a thread's subject counts once a sender."""
    m = adapters.event_messages(_table(spark, sf_dir, "events"))
    word = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    body = F.concat_ws(" ", F.concat(F.lit("ledger"), F.substring_index("subject", " ", 1)), word(_KINDS[0], F.col("thread_id")), word(_KINDS[1], F.col("id")))
    aliases = spark.createDataFrame(_ALIASES, "alias string, addr string")
    return vocabulary.word_analysis(m.withColumn("body", body), aliases, weeks=2).withColumn("score", F.round("score", 6))
