"""Cards, diagnoses, values: small tables with what must come out."""
from pyspark.sql import functions as F

from lettergraph.operators import records


def test_values_and_cards(spark):
    have = spark.createDataFrame([("a", "1", 1), ("b", "x", 2)], "name string, value string, nr long")
    new = spark.createDataFrame([("a", "2", 5), ("c", None, 6)], "name string, value string, nr long")
    assert sorted((r.name, r.value) for r in records.values_set(have, new).collect()) == [("a", "2"), ("b", "x"), ("c", None)]
    cards = spark.createDataFrame([("a@x", "old", "1", 3, 1), ("b@x", "card", "1", 4, 2)], "addr string, card string, updated string, basis long, version int")
    checked = spark.createDataFrame([("A@x", 7), ("b@x", 9), ("c@x", 1)], "addr string, basis long")
    got = {r.addr: (r.card, r.basis, r.version) for r in records.cards_checked(cards, checked, 2).collect()}
    assert got == {"a@x": ("", 7, 2), "b@x": ("card", 9, 2), "c@x": ("", 1, 2)}
    counts = spark.createDataFrame([("a@x", 9), ("b@x", 4), ("z@x", 1)], "addr string, n long")
    assert sorted(r.addr for r in records.cards_due(counts, cards, 2).collect()) == ["a@x", "z@x"]


def test_checked_card(spark):
    text = '## Facts\n- leads the move (#3) "we move in May"\n- invented (#4) "never said"\n- no quote\n## Manner\n- brief "so"\n- kind\n- third\n## Other\n- x'
    row = spark.createDataFrame([(text, ["we move in May"])], "t string, v array<string>").select(records.checked_card(F.col("t"), F.col("v"), {"Facts": 3, "Manner": 2}, ("Facts",)).alias("c")).first()
    assert row.c == "## Facts\n- leads the move (#3)\n## Manner\n- brief\n- kind"


def test_diagnosis_reads_back_what_it_writes(spark):
    text = '원인: late parts | 근거: "parts come in June"\n- **정리**: all waits\n정리: a second one\n먼저 할일: call them\nnot a slot: x\n문제: '
    df = spark.createDataFrame([(text,), (None,)], "t string").select(records.diagnosis(F.col("t")).alias("d")).select("d", records.diagnosis_text(F.col("d")).alias("again"))
    first, none = df.select("d", "again", records.diagnosis(F.col("again")).alias("d2")).collect()
    assert [tuple(i) for i in first.d] == [("정리", "all waits", ""), ("원인", "late parts", "parts come in June"), ("먼저 할 일", "call them", "")]
    assert first.d2 == first.d and none.d == [] and none.again == ""


def test_bullets_references_and_sync(spark):
    got = spark.createDataFrame([("# T\n1. one\n• two\n\n- three  x\n* four\nfive\nsix",)], "t string").select(records.summary_bullets(F.col("t")).alias("b")).first().b
    assert got == "- one\n- two\n- three x\n- four\n- five"
    anchor = spark.sql("SELECT 7 AS thread_id, timestamp_ntz'2024-01-02 03:04:05' AS sent_ts, 'a@x' AS sender_addr")
    links = spark.createDataFrame([("http://b",), ("http://a",), ("http://a",)], "url string")
    assert [r.line for r in records.references(anchor, links, "said so").collect()] == ['- [#7] 2024-01-02 a@x — "said so"', "- http://a", "- http://b"]
    m = spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id AS int)) AS sent_ts FROM range(10)")
    held, fresh = spark.createDataFrame([(0,), (5,), (6,)], "id long"), spark.createDataFrame([(6,), (8,)], "id long")
    stay, todo = records.features_synced(held, m, fresh, "2024-01-05", True)
    assert sorted(r.id for r in stay.collect()) == [5, 6] and [r.id for r in todo.collect()] == [8]
    assert records.features_synced(held, m, fresh, "2024-01-05", False)[1].count() == 6
    parts = [("rules", spark.createDataFrame([("r",)], "text string")), ("notes", spark.createDataFrame([("n2",), ("n1",)], "text string"))]
    assert [(r.part, r.text) for r in records.context_block(parts).collect()] == [("rules", "r"), ("notes", "n1"), ("notes", "n2")]
