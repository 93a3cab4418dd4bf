"""Steps whose cost once grew with groups, batches or Python calls."""
import datetime as dt
import random

import duckdb
import pytest

from pyspark.sql import functions as F
from test_operators import T0, direct_fold, messages, sequential_threads

from lettergraph.functions import rules, text
from lettergraph.operators import ingest, vocabulary
from lettergraph.operators.search_index import SearchIndex, trigrams_of
from lettergraph.operators.texts import by_text
from lettergraph.plans import catalog, upkeep
from lettergraph.sources import letters
from lettergraph.streaming import chunks, fold, ingest as streams
from lettergraph.versions import Versions


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_threads_call_python_by_batch_and_follow_names_over_subjects(spark):
    r = random.Random(5)
    rows = []
    for i in range(1, 401):
        refs = [f"m{r.randrange(1, i)}" for _ in range(r.choice([0, 0, 1, 2]))] if i > 1 else []
        rows.append((f"m{i}", [*refs, "missing"], r.choice(["", "", "", f"k{i % 9}"]), r.choice(["", *[f"s{k}" for k in range(60)]]), T0 + dt.timedelta(days=r.randrange(900), seconds=i), i))
    df = spark.createDataFrame(rows, "message_id string, refs array<string>, conversation_key string, subject string, sent_ts timestamp_ntz, arrival long")
    out = ingest.assign_threads(df.withColumn("refs", F.when(F.size("refs") > 0, F.col("refs"))))
    assert {x.message_id: x.thread_id for x in out.collect()} == sequential_threads(rows)
    assert "FlatMapGroups" not in planned(out) and "MapInArrow" in planned(out)


def test_ids_take_the_fewest_digits_that_hold_the_fullest_day(spark):
    full = spark.range(100_000).select(F.col("id").alias("arrival"), F.lit(T0).cast("timestamp_ntz").alias("sent_ts"))
    other = spark.createDataFrame([(-1, T0 + dt.timedelta(days=1))], "arrival long, sent_ts timestamp_ntz")
    ids = lambda df: {r.arrival: r.id for r in ingest.allocated_ids(df, digits=None).collect()}
    got = ids(full.union(other))
    # 60 quarter hours are left from nine o'clock on: 1,667 in each.
    assert len(set(got.values())) == 100_001 and got[-1] == 240102_36_0001 and got[0] == 240101_36_0001 and got[99_999] == 240101_46_0010
    # So many as three digits hold from there on, and one more.
    assert ids(full.where("arrival < 59940"))[59_939] == 240101_95_999 and ids(full.where("arrival <= 59940"))[59_940] == 240101_41_9946


@pytest.mark.parametrize("query", ["html_text", "html_safe", "html_safe_text", "html_markdown"])
def test_pages_reach_python_in_small_batches(spark, tmp_path, query):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.range(30).select(F.col("id").alias("page_id"), F.lit("<p>a &amp; b</p>").alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    spark.conf.unset(rows), spark.conf.unset(size)
    assert catalog.QUERIES[query](spark, str(tmp_path)).count() == 30
    assert int(spark.conf.get(rows)) <= 500 and int(spark.conf.get(size).lower().removesuffix("b")) <= 8 << 20


@pytest.mark.parametrize("name, different", [("id_allocation", 53_001), ("id_allocation_passed_on", 53_003)])
def test_ids_of_full_quarters_are_those_of_the_sql(spark, tmp_path, name, different):
    """Quarter hours of 3,000 and 50,000 and two records without a time: the one query's ids meet once there and are null twice, the other's never."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, CASE WHEN i < 3000 THEN TIMESTAMP '2024-01-01 09:00:00' + i % 900 * INTERVAL 1 SECOND WHEN i = 3000 THEN TIMESTAMP '2024-01-01 09:15:00'
WHEN i > 3002 THEN TIMESTAMP '2024-01-02 12:00:00' END AS ts, i % 7 AS user_id, 'click' AS event_type, 1.5 AS value, '{{}}' AS props FROM range(53003) AS r(i)) TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name]).fetchall()
    got = [(r.record, r.id) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0]) and len(got) == 53_003
    assert len({i for _, i in got}) == different


def test_the_index_reaches_python_in_small_batches(spark, tmp_path):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(rows), spark.conf.unset(size)
    index = SearchIndex(Versions(spark, str(tmp_path / "index")))
    assert int(spark.conf.get(rows)) <= 500 and int(spark.conf.get(size).lower().removesuffix("b")) <= 4 << 20
    # Two segments of blocks of 200 KB in all, merged by batches of less: none is lost between batches.
    spark.conf.set(size, str(64 << 10))
    m = spark.range(100_000).select("id", F.lit("").alias("subject"), F.lit("abcd").alias("body"))
    index.add(m.where("id % 2 = 0"))
    index.add(m.where("id % 2 = 1"))
    assert {r.gram: r.n for r in index.versions.read("postings", index.merge()).groupBy("gram").agg(F.sum("n").alias("n")).collect()} == dict.fromkeys(trigrams_of("abcd"), 100_000)
    assert index.candidates(["abcd"]).count() == 100_000
    spark.conf.unset(size)


def test_the_stream_folds_in_any_order_without_python(spark, tmp_path):
    rows, m = messages(spark, 31)
    for k in (3, 0, 2, 1):
        m.where(F.col("id") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    out = streams.run_to_table(fold.open_actions_stream(streams.file_stream(spark, str(tmp_path / "m"), files_per_batch=1)), "update", "t")
    got = streams.newest(out, ["thread_id"]).where("source_id IS NOT NULL").collect()
    assert out.select("batch").distinct().count() == 4
    assert {r.thread_id: (r.source_id, r.strength == "strong", r.kind == "decide", r.has_deadline, r.completion_after) for r in got} == direct_fold(rows)
    assert "InPandas" not in fold.open_actions_stream(spark.readStream.schema(m.schema).parquet(str(tmp_path)))._jdf.queryExecution().analyzed().toString()


def test_pairs_do_not_carry_their_messages_phrases(spark):
    m = spark.createDataFrame([(k, "a@x", "river bank\nriver stone bank") for k in range(3)], "id long, sender_addr string, body string").withColumn("thread_id", F.col("id"))
    b = vocabulary.bags(m)
    out = vocabulary.npmi(b, b.select("who", F.explode("terms").alias("term")).distinct())
    assert {(r.a, r.b): r.co for r in out.collect()} == {("bank", "river"): 3, ("bank", "stone"): 3, ("river", "stone"): 3} and all(r.weight == pytest.approx(0.35) for r in out.collect())
    assert "exists(phrases" not in planned(out)


def test_gates_judge_each_different_text_once(spark):
    schema = "part string, id long, thread_id long, sent_ts timestamp_ntz, is_sent boolean, sender_addr string, body string"
    bodies = [*[x[0] + tail for x in letters.LETTERS for tail in letters.TAILS], "", None]
    source = spark.createDataFrame([("w", i, i % 7, T0, False, "a@x", bodies[i % len(bodies)]) for i in range(3 * len(bodies))], schema)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(body):
        seen.add(1)
        return body

    rows = by_text(source, "body", "body", counted).collect()
    assert seen.value == len(set(bodies)) and sorted(map(str, rows)) == sorted(map(str, source.collect()))
    content, signals = (stage.compute for stage in upkeep._STAGES[:2])
    new = content({"source": source}, {})
    one_by_one = source.withColumn("body", text.new_content(F.col("body")))
    assert new.columns == source.columns and sorted(map(str, new.collect())) == sorted(map(str, one_by_one.collect()))
    got = signals({"content": new}, {"names": ["tea"]})
    want = one_by_one.select("*", text.signals(F.col("body"), F.lit(""), ["tea"]).alias("s")).select("*", "s.*").select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("mentions_me").count() > 0
    assert "BroadcastHashJoin" in planned(new) and "rlike" not in planned(new).lower() and "rlike" not in planned(got).lower()


def test_chunks_cut_each_different_text_once(spark):
    schema = "id long, thread_id long, sender_addr string, is_sent boolean, sent_ts timestamp_ntz, body string"
    bodies = ["river bank. stone", "stone bank river", "", None, f"kept {rules.PRESERVED} dropped", *[x[0] for x in letters.LETTERS]]
    m = spark.createDataFrame([(i, 1, f"{'ab'[i % 2]}@x", i % 11 == 0, T0 + dt.timedelta(days=i % 30), bodies[i % len(bodies)]) for i in range(4 * len(bodies))], schema)
    got = chunks.term_rows(m)
    b = vocabulary.bags(m.where("NOT is_sent")).select("who", chunks.week_of("sent_ts").alias("week"), "terms", "phrases")
    both = [b.select("who", F.lit(kind).alias("kind"), F.explode(f"{kind}s").alias("term"), "week") for kind in ("term", "phrase")]
    want = both[0].union(both[1]).groupBy("who", "kind", "term", "week").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("kind = 'phrase'").count() > 0
    assert "regexp" not in planned(got).lower() and "regexp" in planned(want).lower()
