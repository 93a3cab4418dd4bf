"""Many searches in one scan against one search a line."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lettergraph.operators import questions, search

SCHEMA = "id long, thread_id long, sent_ts timestamp_ntz, subject string, body string, sender_addr string, sender_name string, read boolean"
LINES = {
    1: "model test", 2: '"model test"', 3: "Model", 4: "검토 요청", 5: "mo te", 6: "mod te", 7: "nothing-here", 8: '"test mod" x', 9: "from:u1 model", 10: "from:u1", 11: "", 12: "is:unread 🙂 pla", 13: "plan plan",
    14: "after:2024-01-05 before:2024-01-20", 15: "İst model", 16: "is:unread", 17: "model test",
}


@pytest.fixture(scope="module")
def m(spark):
    r = random.Random(2)
    words = ["model", "test", "te", "a", "b", "검토", "요청드립니다", "Plan", "🙂", "mo", "x", "İstanbul", "modtest"]
    text = lambda k: None if r.random() < 0.05 else " ".join(r.choice(words) for _ in range(r.randrange(k)))
    rows = [(i, i % 9, datetime(2024, 1, 1) + timedelta(hours=3 * (i % 200)), text(4), text(12), f"u{i % 3}@x", f"User {i % 3}", i % 2 == 0) for i in range(300)]
    return spark.createDataFrame(rows, SCHEMA)


def test_each_question_finds_what_its_search_finds(m):
    got, want = {}, {}
    for r in questions.gathered(m, LINES, limit=25).collect():
        got.setdefault(r.question, []).append((r.place, r.id, r.tier))
    for q, line in LINES.items():
        rows = [(k + 1, r.id, r.tier) for k, r in enumerate(search.search(m, line, 25).collect())]
        if rows:
            want[q] = rows
    assert {q: sorted(x) for q, x in got.items()} == want and len(want) > 11


def test_one_scan(m):
    plan = questions.gathered(m, LINES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("ArrowEvalPython") == 1 and "WindowGroupLimit" in plan


def test_denied_noise_and_far_off(spark, m):
    deny = spark.createDataFrame([(1, i) for i in range(0, 300, 2)] + [(None, i) for i in range(0, 300, 3)], "question int, id long")
    noise = spark.createDataFrame([(4,), (5,), (4,)], "thread_id long")
    got = questions.gathered(m, {1: "model test", 2: "model test"}, limit=1000, most_tier=2, deny=deny, noise=noise).collect()
    whole = search.matches(m, "model test").where("tier <= 2 AND thread_id NOT IN (4, 5)").select("id", "tier").collect()
    assert {(r.question, r.id, r.tier) for r in got} == {(q, r.id, r.tier) for q in (1, 2) for r in whole if r.id % 3 and (q == 2 or r.id % 2)}


def test_nothing_asked_and_too_much(m, monkeypatch):
    assert questions.gathered(m, {}).isEmpty() and questions.gathered(m, {1: ""}).isEmpty() and questions.gathered(m.limit(0), LINES).isEmpty()
    assert questions.matches_many(m.withColumn("body", F.lit(None).cast("string")), {1: "model"}).where("NOT contains(lower(subject), 'model')").isEmpty()
    monkeypatch.setattr(questions, "LETTERS", 5)
    with pytest.raises(ValueError, match="several goes"):
        questions.matches_many(m, {1: "a long question"})
