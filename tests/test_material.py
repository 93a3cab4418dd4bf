"""Names, periods, choices and states."""
import datetime as dt

from pyspark.sql import functions as F

from lettergraph.operators import daily, material

T0 = dt.datetime(2024, 1, 1, 9)


def mail(spark):
    rows = [(1, 1, 1, T0, False, "a@x", ["me@x"], "Plan", "The plan is at https://x.test/p. Read it."), (2, 1, 2, T0 + dt.timedelta(days=1), True, "me@x", ["a@x"], "Plan", "최종 plan agreed"), (3, 2, 3, T0 + dt.timedelta(days=2), False, "b@x", ["me@x"], "Other", "Other words")]
    return spark.createDataFrame(rows, "id long, thread_id long, seq long, sent_ts timestamp_ntz, is_sent boolean, sender_addr string, to_addrs array<string>, subject string, body string").withColumn("cc_addrs", F.array().cast("array<string>")).withColumn("sender_name", F.lit(""))


def test_people(spark):
    d = spark.createDataFrame([("a@x", "Kim Na", 5, 1), ("b@x", "Kim Nara Dr", 9, 9), ("c@x", "", 1, 0)], "addr string, name string, from_count long, to_count long")
    assert {r.name: r.addr for r in material.resolved_names(d, ["KimNa", "nobody", " "]).collect()} == {"KimNa": "b@x"}
    assert {(r.addr, r.alias) for r in material.aliases(d, ["dr"]).collect()} == {("a@x", "kim"), ("a@x", "na"), ("b@x", "kim"), ("b@x", "nara")}
    assert [r.addr for r in material.frequent_people(d, 2).collect()] == ["b@x", "a@x"]
    m = mail(spark)
    assert [r.thread_id for r in material.person_threads(m, "a@x").collect()] == [1] and material.person_count_since(m, "a@x", 1).first().n == 1
    s = spark.createDataFrame([(1, 1, "x", "s"), (2, 9, "Kim", "t"), (3, 9, "y", "u")], "id long, thread_id long, who string, signal string")
    assert [r.id for r in material.person_signals(s, m, "a@x", "Kim").collect()] == [2, 1]
    assert material.person_texts(m, "b@x").count() == 1


def test_periods():
    assert material.period(2, dt.date(2024, 1, 14)) == ("2024-01-01", "2024-01-14")
    assert material.last_round(["2024-01-07", "2024-01-14", "2024-01-21"], "2024-01-20") == ("2024-01-07", "2024-01-14") and material.last_round([], "2024-01-01") is None
    assert material.period_words("week", dt.date(2024, 1, 17)) == "after:2024-01-15" and material.period_words("all", dt.date(2024, 1, 1)) == ""
    assert material.config_version(a=1) != material.config_version(a=2) and material.highlight_terms('from:x "a b" c') == ["a b", "c"]


def test_choices(spark):
    m = mail(spark)
    kinds = spark.createDataFrame([(1, "work"), (2, "notice")], "thread_id long, kind string")
    assert [r.thread_id for r in material.diagnosis_pick(m, kinds).collect()] == [1]
    assert {r.id for r in material.counter_search(m, "plan", [2]).collect()} == {2, 3}
    assert [r.url for r in material.links_in(m).collect()] == ["https://x.test/p"]
    assert material.anchor_message(m, [1], "plan  agreed").first().id == 2 and material.anchor_message(m, [1], "none of it").first().id == 1
    assert {r.id for r in material.harvest_material(m, kinds, kinds).collect()} == {1, 2}
    counts = material.read_counts(m, spark.createDataFrame([(1,)], "id long")).first()
    assert (counts.read, counts.total, counts.partial) == (1, 2, True)
    notes = spark.createDataFrame([("a", "Plan", "budget plan", [1], 1), ("b", "x", "plan", [2], 2), ("c", "y", "z", [3], 3)], "path string, title string, body string, threads array<long>, mtime long")
    assert [r.path for r in material.relevant_notes(notes, "the budget plan?").collect()] == ["a", "b"]
    assert [r.path for r in material.relevant_notes(notes, "the budget plan?", spark.createDataFrame([(1,)], "thread_id long")).collect()] == ["b"]
    scored = spark.createDataFrame([(1, 5), (2, 50)], "thread_id long, score long")
    assert [r.thread_id for r in material.candidates(scored, kinds.where("thread_id = 1")).collect()] == [1, 2]
    assert material.state_before(m, "2024-01-02").first().id == 1


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(material.demoted(F.lit("answered"), F.lit(2), F.lit(1), F.lit(False))) == "partial" and one(material.demoted(F.lit("answered"), F.lit(0), F.lit(0), F.lit(False))) == "unknown"
    assert len(one(material.fitted(F.lit("x" * 5000), F.lit(2500)))) == 2000 and one(material.fitted(F.lit("short"), F.lit(300))) == "short"
    assert one(material.without_preamble(F.lit("Here is the summary:\n\nReal"))) == "Real" and one(material.without_preamble(F.lit("Sure, #12 moved.\n\nMore"))) == "Sure, #12 moved.\n\nMore"
    assert one(material.subject_noise(F.lit(False), F.lit(True), F.lit(False), F.lit(3))) is True
    history = "From: Ann\nSent: 2024-01-02\nTo: B\nSubject: s\nsecond\n\nFrom: Bob\nSent: 2024-01-01\nSubject: s\nfirst"
    turns = daily.preserved_turns(F.lit(history))
    assert [(t.who, t.date, t.body) for t in one(turns)] == [("Bob", "2024-01-01", "first"), ("Ann", "2024-01-02", "second")]
    assert one(material.preserved_label(turns)) == "2 turns · Bob, Ann · 2024-01-01 ~ 2024-01-02"
    assert one(daily.shown_attachments(F.array(F.lit("image001.png"), F.lit("plan.pdf")))) == ["plan.pdf"]
    issues = spark.createDataFrame([("a", " Open"), ("", "open"), ("b", "maybe")], "title string, status string")
    assert [tuple(r) for r in material.clean_issues(issues).collect()] == [("a", "open")]
    cards = spark.createDataFrame([("a@x", "# A\n- Leads the plan\n- x"), ("b@x", "none")], "addr string, card string")
    assert [(r.addr, r.role) for r in material.role_lines(cards).collect()] == [("a@x", "Leads the plan")]
    prompts = spark.createDataFrame([(1, "p")], "key long, prompt string")
    assert material.answered(prompts).first().answer is None and material.answered(prompts, lambda p: p.upper()).first().answer == "P"
