"""Operators whose results SQL does not check, and invariants between operators."""
import datetime as dt
import random
from collections import defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lettergraph.operators import evidence, ingest, links, people, promises, reports, search, state, threads, vocabulary
from lettergraph.sources import adapters, files
from lettergraph.streaming import fold, ingest as streams

T0 = dt.datetime(2024, 1, 1, 9)
FLAGS = ("is_trivial", "has_withdrawal", "has_completion", "has_strong_request", "has_weak_request", "has_decision", "has_question", "has_deadline", "mentions_me")


def messages(spark, seed, n=400):
    r = random.Random(seed)
    rows = [(i, r.randrange(40), T0 + dt.timedelta(minutes=7 * i), r.random() < 0.35, *[r.random() < 0.2 for _ in FLAGS]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, thread_id long, sent_ts timestamp_ntz, is_sent boolean, " + ", ".join(f"{f} boolean" for f in FLAGS))


def direct_fold(rows):
    per = defaultdict(list)
    for r in rows:
        per[r[1]].append(r)
    out = {}
    for t, ms in per.items():
        s = (0, False, False, False, False)
        for m in sorted(ms, key=lambda m: (m[2], m[0])):
            s = fold.step(s, type("M", (), dict(zip(("id", "thread_id", "sent_ts", "is_sent", *FLAGS), m, strict=True))))
        if s[0]:
            out[t] = s
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_window_fold_is_the_step_fold(spark, seed):
    rows, m = messages(spark, seed)
    got = {r.thread_id: (r.source_id, r.strength == "strong", r.kind == "decide", r.has_deadline, r.completion_after) for r in state.open_actions(m).collect()}
    assert got == direct_fold(rows)


def test_stream_fold_in_small_batches(spark, tmp_path):
    rows, m = messages(spark, 9)
    for k in range(4):  # four files in time order, one a micro-batch
        m.where((F.col("id") >= 100 * k) & (F.col("id") < 100 * k + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    stream = streams.file_stream(spark, str(tmp_path / "m"), files_per_batch=1)
    out = streams.newest(streams.run_to_table(fold.open_actions_stream(stream), "update", "t"), ["thread_id"]).collect()
    want = direct_fold(rows)
    assert {r.thread_id: r.source_id for r in out if r.source_id and not r.late} == {t: s[0] for t, s in want.items()}


def test_ids_survive_full_quarters(spark):
    rows = [(k, T0 + dt.timedelta(seconds=k % 900)) for k in range(2500)] + [(9000 + k, T0 + dt.timedelta(minutes=15)) for k in range(3)]
    got = {r.arrival: r.id for r in ingest.allocated_ids(spark.createDataFrame(rows, "arrival long, sent_ts timestamp_ntz")).collect()}
    assert len(set(got.values())) == len(rows) and all(240101 == i // 100_000 for i in got.values())
    assert got[0] == 240101 * 100_000 + 36 * 1000 + 1 and got[998] == got[0] + 998 and got[999] == 240101 * 100_000 + 37 * 1000 + 1
    numbers = ingest.arrival_numbers(spark.createDataFrame(rows, "arrival long, sent_ts timestamp_ntz"), offset=5)
    assert sorted(r.seq for r in numbers.collect()) == list(range(6, 6 + len(rows)))


def sequential_threads(rows):
    by_message, by_key, by_subject, last, out = {}, {}, defaultdict(list), {}, {}
    for mid, refs, key, norm, ts, arrival in sorted(rows, key=lambda r: r[5]):
        t = next((by_message[x] for x in refs if x in by_message), None) or by_key.get(key or None)
        if t is None and norm:
            t = max([x for x in by_subject[norm] if last[x] >= ts - dt.timedelta(days=30)], key=lambda x: last[x], default=None)
        if t is None:
            t = arrival
            by_subject[norm].append(t)
            if key:
                by_key[key] = t
        last[t] = max(last.get(t, ts), ts)
        by_message[mid] = out[mid] = t
    return out


def test_threading_is_sequential(spark):
    r = random.Random(11)
    rows = []
    for i in range(1, 161):
        refs = [f"m{r.randrange(1, i)}"] if i > 1 and r.random() < 0.3 else []
        rows.append((f"m{i}", refs, r.choice(["", "", "k1", "k2"]), r.choice(["", "plan", "report", "minutes", "x y"]), T0 + dt.timedelta(days=r.randrange(120), seconds=i), i))
    df = spark.createDataFrame([(a, b, c, "Re: " + d.upper() if d else "", e, f) for a, b, c, d, e, f in rows], "message_id string, refs array<string>, conversation_key string, subject string, sent_ts timestamp_ntz, arrival long")
    assert {x.message_id: x.thread_id for x in ingest.assign_threads(df).collect()} == sequential_threads(rows)


def test_linked_groups(spark):
    pairs = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "3"), ("e", "3"), ("f", "9")], "row string, key string")
    assert {r.row: r.component for r in links.linked(pairs, "row", "key").collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_first_arrival_and_folders(spark):
    df = spark.createDataFrame([("x", 3, "late"), ("x", 1, "first"), ("y", 2, "only")], "message_id string, arrival long, v string")
    assert {r.message_id: r.v for r in ingest.first_arrivals(df).collect()} == {"x": "first", "y": "only"}
    f = spark.createDataFrame([("Inbox", 0, True, False, True), ("A", 1, False, False, True), ("B", 1, False, False, True), ("Junk", 1, False, True, True), ("Cal", 1, False, False, False), ("Old", 1, False, False, True)], "label string, depth int, is_root boolean, is_special boolean, is_mail boolean")
    got = {r.label: r.reason for r in ingest.folder_plan(f, ["old"], most=2).collect()}
    assert got == {"Inbox": "", "A": "", "B": "over_cap", "Junk": "special", "Cal": "not_mail", "Old": "excluded"}
    merged = spark.range(1).select(ingest.merge_folder_state(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")), F.array(F.lit("b"))).alias("x")).first().x
    assert merged == ["b", "c"]


def test_promises(spark):
    rows = [(1, 1, T0, True, "s", "안녕하세요. 자료는 금요일까지 보내겠습니다."), (2, 1, T0 + dt.timedelta(days=1), False, "s", "고맙습니다"), (3, 2, T0, True, "s", "검토 부탁드립니다."), (4, 3, T0, True, "s", "내일 정리하겠습니다."), (5, 3, T0 + dt.timedelta(days=2), True, "s", "보냈습니다")]
    m = spark.createDataFrame(rows, "id long, thread_id long, sent_ts timestamp_ntz, is_sent boolean, subject string, body string")
    found = promises.promises(m)
    got = {r.id: r for r in found.collect()}
    assert set(got) == {1, 4} and got[1].replies_after == 1 and not got[1].followed_up and got[4].followed_up
    assert str(got[1].due) == "2024-01-05" and str(got[4].due) == "2024-01-02"
    assert [r.id for r in promises.open_promises(found, "2024-01-08").collect()] == [1]
    done = found.where("id = 1").select("key")
    assert promises.open_promises(promises.promises(m, done), "2024-01-08").count() == 0


def test_quotes(spark):
    m = spark.createDataFrame([(1, 1, "The budget was\napproved on Monday by all."), (2, 1, "Something else entirely."), (3, 2, "approved on Monday by all, he said")], "id long, thread_id long, body string")
    claims = spark.createDataFrame([(1, "budget was approved on Monday"), (2, "budget was approved on Monday"), (1, "short"), (9, "no such message here")], "mid long, quote string")
    assert [(r.mid, r.thread_id) for r in evidence.verified_quotes(claims, m).collect()] == [(1, 1)]
    q = spark.createDataFrame([(1, "was approved on Monday by"), (2, "pproved on Monday by al"), (3, "Something  else entirely"), (4, "nowhere to be found at all")], "quote_id long, quote string")
    found = evidence.located_quotes(q, m)
    assert sorted((r.quote_id, r.id) for r in found.collect()) == [(1, 1), (2, 1), (2, 3), (3, 2)]
    assert sorted((r.quote_id, r.id) for r in evidence.unique_source(found).collect()) == [(1, 1), (3, 2)]
    row = spark.createDataFrame([("First one. It was here. Last.",)], "b string").select(evidence.quote_context(F.col("b"), F.lit("was")).alias("c")).first().c
    assert (row.pre, row.quote, row.post) == ("It ", "was", " here.")


def test_quotes_spaced_differently(spark):
    m = spark.createDataFrame([(1, "He said it 's late , and the re-\nport is due."), (2, "예산 안을 월요일에 승인 했습니다 그렇게"), (3, "short one here")], "id long, body string")
    q = spark.createDataFrame([(1, "said it's late, and the re-port is due"), (2, "예산안을 월요일에 승인했습니다"), (3, "short one he"), (4, "it's late, and the report is due")], "quote_id long, quote string")
    assert sorted((r.quote_id, r.id) for r in evidence.located_quotes(q, m).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_mail_parts_are_joined(spark, tmp_path):
    from lettergraph.sources import files

    part = lambda kind, text: f"--b\nContent-Type: {kind}\n\n{text}\n"
    mail = "From a@x Mon\nMessage-ID: <1>\nFrom: a@x.test\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n"
    mail += part("text/plain", "The letter.") + part("text/html", "<p>one</p>") + part("text/plain", "List footer") + part("text/html", "<p>two</p>") + "--b--\n"
    (tmp_path / "in.mbox").write_text(mail)
    row = files.mail_folder(spark, str(tmp_path / "in.mbox")).first()
    assert row.body_text.split("\n") == ["The letter.", "List footer"] and row.body_html.split("\n") == ["<p>one</p>", "<p>two</p>"]


def test_top_terms_hold_no_list_of_all(spark):
    rows = [(w, f"t{i}", i, 0.0, float(i * 7919 % 501 // 2)) for w in ("p", "q") for i in range(500)]
    top = vocabulary.top_terms(spark.createDataFrame(rows, "who string, term string, df long, lift double, score double"), 12)
    assert sorted((r.who, -r.score, r.term) for r in top.collect()) == [x for w in "pq" for x in sorted((w, -r[4], r[1]) for r in rows if r[0] == w)[:12]]
    assert "collect_list" not in top._jdf.queryExecution().optimizedPlan().toString()


def test_roots_with_a_cycle(spark):
    asked = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 6)], "id long, parent_id long")
    got = {r.id: r.root for r in evidence.conversation_roots(asked).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5}


def test_search_tiers_and_names(spark):
    m = spark.createDataFrame([(1, "Model test", "x"), (2, "", "a model for every TEST"), (3, "", "mod el"), (4, "tests", ""), (5, "", "")], "id long, subject string, body string")
    assert {r.id: r.tier for r in search.search(m, "model test").collect()} == {1: 1, 2: 2, 4: 4}
    assert search.search(m, "").count() == 0 and search.search(m, '"model test"').collect()[0].id == 1
    rows = spark.createDataFrame([(1, "Kim Na", "kn@a.test", ["z@a.test"], ["plan.PDF"], False), (2, "Lee", "lee@a.test", [], [], True)], "id long, sender_name string, sender_addr string, to_addrs array<string>, attach_names array<string>, read boolean")
    ids = lambda line, **kw: [r.id for r in search.search(rows, line, **kw).collect()]
    assert ids("from:KimNa") == [1] and ids("from:@a.test") == [1, 2] and ids("file:pdf") == [1] and ids("is:read") == [2] and ids("has:attachment is:unread") == [1]
    assert ids("to:Zoe", addresses={"Zoe": "z@a.test"}) == [1] and ids("to:none") == []
    assert search.narrow_chips("검토합니다 a bb ccc") == ["ccc", "검토", "bb"]
    assert spark.range(1).select(search.snippet(F.lit("one two three"), "TWO").alias("s")).first().s == "one ⟪two⟫ three"


def test_overlays_and_lists(spark):
    a = spark.createDataFrame([(1, True, 1), (2, True, 1)], "thread_id long, hidden boolean, at int")
    b = spark.createDataFrame([(2, False, 5)], "thread_id long, hidden boolean, at int")
    assert {r.thread_id: r.hidden for r in threads.overlay(a, b, ["thread_id"], "at").collect()} == {1: True, 2: False}
    m = adapters.event_messages(spark.read.parquet(f"{DATA}/sf0.001/events.parquet"))
    assert people.thread_context(m, "u7@d0.test", adapters.ME).where("nr > 2").count() == 0
    assert threads.related_threads(m, 7, ["click 7"]).where("thread_id = 7").count() == 0
    label = lambda to: spark.range(1).select(threads.recipient_label(F.array(*map(F.lit, to)), F.create_map(F.lit("a@x"), F.lit("Ann")), "me@x").alias("l")).first().l
    assert label(["a@x"]) == "Ann" and label(["me@x", "a@x", "b@x"]) == "Ann +2" and label(["me@x"]) == "me"
    d = people.homonyms(spark.createDataFrame([("a@x", "Kim"), ("b@x", "Kim"), ("c@x", "Lee"), ("d@x", "")], "addr string, name string"))
    assert {r.addr: r.label for r in d.collect()} == {"a@x": "Kim (a)", "b@x": "Kim (b)", "c@x": "Lee", "d@x": "d@x"}


def test_vocabulary_pairs_and_clusters(spark):
    rows = [(i, 1, "p", "alpha beta gamma" if i % 2 else "delta epsilon") for i in range(12)] + [(50 + i, 2, "q", "zeta eta") for i in range(6)]
    m = spark.createDataFrame(rows, "id long, thread_id long, sender_addr string, body string")
    b = vocabulary.bags(m)
    top = vocabulary.top_terms(vocabulary.term_scores(b))
    pairs = {(r.who, r.a, r.b): r.weight for r in vocabulary.npmi(b, top).collect()}
    assert pairs[("p", "alpha", "beta")] == pytest.approx(1.0) and ("p", "alpha", "delta") not in pairs
    groups = defaultdict(set)
    for r in vocabulary.clusters(vocabulary.npmi(b, top)).collect():
        groups[r.who, r.cluster].add(r.term)
    assert {frozenset(v) for (w, _), v in groups.items() if w == "p"} == {frozenset({"alpha", "beta", "gamma"}), frozenset({"delta", "epsilon"})}
    shown = vocabulary.display_forms(spark.createDataFrame([("Soc SoC SoC",)], "body string")).first()
    assert (shown.term, shown.display) == ("soc", "SoC")


def test_reports_read_back(spark):
    states = spark.createDataFrame([(i, 100 - i, "mine" if i < 8 else "done") for i in range(10)], "thread_id long, score long, state string")
    page = reports.report_text(reports.board_lines(states), "Week 3")
    row = page.select("text", reports.sections(F.col("text")).alias("s")).first()
    assert row.text.startswith("# Week 3\n\n## mine (8)\n- #0 (100)") and set(row.s) == {"mine", "done"} and row.s["mine"].endswith("and 3 more")
    cut = page.select(reports.without_lines(F.col("text"), F.array(F.lit("#0 "))).alias("t")).first().t
    assert "#0 " not in cut and "#1 " in cut
    items = spark.createDataFrame([('x\n- [#7] Budget  agreed :: "was approved"\n- no',)], "t string").select(reports.harvest_items(F.col("t")).alias("i")).first().i
    assert [tuple(i) for i in items] == [(7, "Budget agreed", "was approved")]


def test_files(spark, tmp_path):
    (tmp_path / "a.mbox").write_text("From x Mon\nMessage-ID: <1@x>\nSubject: Hi\nFrom: Ann <Ann@X.test>\nTo: b@x.test, C <c@x.test>\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\nbody one\n\nFrom y Tue\nMessage-ID: <2@x>\nReferences: <1@x> <0@x>\n\nbody two\n")
    rows = {r.message_id: r for r in files.read(spark, "mbox", str(tmp_path / "a.mbox")).collect()}
    assert rows["<1@x>"].sender_addr == "ann@x.test" and rows["<1@x>"].to_addrs == ["b@x.test", "c@x.test"] and rows["<1@x>"].sent_ts == dt.datetime(2024, 1, 1, 10)
    assert rows["<2@x>"].refs == ["<1@x>", "<0@x>"] and rows["<2@x>"].sent_ts is None and "body two" in rows["<2@x>"].body_text
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "k.md").write_text("---\nthreads: [3, 4]\n---\n# Title\ntext\n")
    note = files.notes(spark, str(tmp_path / "n")).first()
    assert (note.title, note.threads) == ("Title", [3, 4]) and note.body == "# Title\ntext"
    known = spark.createDataFrame([("gone.md", note.mtime)], "path string, mtime timestamp")
    changed, lost = files.mirror(known, files.notes(spark, str(tmp_path / "n")))
    assert changed.count() == 1 and [r.path for r in lost.collect()] == ["gone.md"]
    m = adapters.event_messages(spark.read.parquet(f"{DATA}/sf0.001/events.parquet"))
    files.write_messages(m, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == m.count()
    with pytest.raises(ValueError, match="no source"):
        files.read(spark, "none", "x")


def test_medians_are_exact(spark):
    import statistics

    from lettergraph.operators import stats

    r = random.Random(3)
    rows = [(k, r.choice([0.0, 0.5, 0.50001, 3.25, r.uniform(0, 700), -r.random()])) for k in "abc" for _ in range(r.choice([1, 2, 301, 400]))]
    got = {x.k: (x.median, x.n) for x in stats.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    want = {k: (statistics.median([v for j, v in rows if j == k]), sum(j == k for j, _ in rows)) for k in {j for j, _ in rows}}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)


def test_late_threads_are_folded_again(spark, tmp_path):
    rows, m = messages(spark, 12)
    for k in (2, 0, 3, 1):  # files out of time order, one a micro-batch
        m.where((F.col("id") >= 100 * k) & (F.col("id") < 100 * k + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    newest = streams.newest(streams.run_to_table(fold.open_actions_stream(streams.file_stream(spark, str(tmp_path / "m"), files_per_batch=1)), "update", "t"), ["thread_id"])
    assert newest.where("late").count() > 20
    got = {r.thread_id: (r.source_id, r.strength == "strong", r.kind == "decide", r.has_deadline, r.completion_after) for r in fold.refolded(newest, m).collect()}
    assert got == direct_fold(rows)


def test_mail_without_an_id_stays_apart(spark, tmp_path):
    mail = lambda day, who: f"From x\nFrom: {who}\nDate: Mon, {day} Jan 2024 10:00:00 +0000\nSubject: s\n\nhello\n"
    (tmp_path / "a.mbox").write_text(mail(1, "a@x.test") + "\n" + mail(2, "a@x.test") + "\n" + mail(1, "a@x.test"))
    got = [r.message_id for r in files.read(spark, "mbox", str(tmp_path / "a.mbox")).collect()]
    assert len(got) == 3 and len(set(got)) == 2 and all(i.endswith("@no-id>") for i in got)


def test_subject_threads_rest_but_late_mail_still_joins(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    rows = [("a", 1, day(0)), ("b", 2, day(10)), ("c", 3, day(100)), ("d", 4, day(101)), ("e", 6, day(300)), ("f", 5, day(310)), ("g", 7, day(105)), ("n", 8, None)]
    df = spark.createDataFrame([(m, [], "", "plan", t, k) for m, k, t in rows], "message_id string, refs array<string>, conversation_key string, subject string, sent_ts timestamp_ntz, arrival long")
    assert {r.message_id: r.thread_id for r in ingest.assign_threads(df).collect()} == {"a": 1, "b": 1, "c": 3, "d": 3, "f": 5, "e": 5, "g": 5, "n": 8}


def test_page_tabs_and_thread_messages(spark):
    m = spark.createDataFrame([(1, 1, T0, False, False, "a@x", "s"), (2, 2, T0, False, True, "b@x", "s"), (3, 1, T0 + dt.timedelta(1), True, True, "me", "s")], "id long, thread_id long, sent_ts timestamp_ntz, is_sent boolean, read boolean, sender_addr string, subject string").withColumn("hidden", F.lit(False))
    assert [r.thread_id for r in threads.thread_page(m, 9, tab=F.col("unread_n") > 0).collect()] == [1]
    assert [r.id for r in threads.thread_messages(m, 1).collect()] == [1, 3] and [r.id for r in threads.thread_messages(m, 1, "A@x").collect()] == [1]
    wide = spark.createDataFrame([(k, T0) for k in range(100_000)], "arrival long, sent_ts timestamp_ntz")
    assert ingest.allocated_ids(wide, digits=5).select("id").distinct().count() == 100_000


@pytest.mark.parametrize("sent", [10**6, 0])
def test_quotes_are_found_wherever_they_stand(spark, sent):
    """All slices of 10 letters and more against plain search, with runs that come again and again."""
    r = random.Random(3)
    words = ["ab", "abab", "budget", "예산안을", "🙂", "x", "a"]
    bodies = [None, "", "short"] + [" ".join(r.choice(words) for _ in range(r.randrange(40))) for _ in range(40)]
    quotes = [(i, b[s : s + n]) for i, b in enumerate(bodies) if b for s, n in [(r.randrange(len(b)), r.randrange(8, 60)) for _ in range(4)]] + [(900, None), (901, "aaaaaaaaaa"), (902, "nowhere to be found")]
    quotes = [(k, q) for k, (_, q) in enumerate(quotes)]
    m = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id long, body string")
    got = {(x.quote_id, x.id) for x in evidence.located_quotes(spark.createDataFrame(quotes, "quote_id long, quote string"), m, sent=sent).collect()}
    plain = lambda t: "".join((t or "").split())
    assert got == {(k, i) for k, q in quotes for i, b in enumerate(bodies) if len(plain(q)) >= 10 and plain(q) in plain(b)}


def test_roots_beside_cycles(spark):
    """Paths end in their root and cycles at their least id, however many rounds the cycles move; a cycle that is too long raises."""
    pairs = [(i, i - 1 if i % 10 else None) for i in range(40)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(120, 103), (121, 120), (90, 121)]
    asked = spark.createDataFrame(pairs, "id long, parent_id long")
    got = {r.id: r.root for r in evidence.conversation_roots(asked).collect()}
    assert got == {**{i: i // 10 * 10 for i in range(40)}, **{i: 100 for i in (*range(100, 107), 120, 121, 90)}}
    with pytest.raises(RuntimeError, match="settle"):
        evidence.conversation_roots(asked, rounds=2)


def test_word_analysis_is_what_its_parts_say(spark):
    r = random.Random(6)
    words = [f"word{chr(97 + k)}" for k in range(12)]
    rows = [(i, i % 9, f"s{i % 3}@x", T0 + dt.timedelta(days=i), f"Re: subject{'abc'[i % 3]}", " ".join(r.choice(words[: 4 + i % 9]) for _ in range(8))) for i in range(90)]
    m = spark.createDataFrame(rows, "id long, thread_id long, sender_addr string, sent_ts timestamp_ntz, subject string, body string")
    aliases = spark.createDataFrame([("worda", "s0@x"), ("wordb", "s1@x")], "alias string, addr string")
    got = {}
    for x in vocabulary.word_analysis(m, aliases, caps=(1000, 1000, 1000, 1000), top=1000).collect():
        got.setdefault(x.section, {})[x.who, x.term] = (x.support, x.score)
    b = vocabulary.bags(vocabulary.with_first_subjects(m).withColumn("body", F.col("words")))
    for section in ("terms", "phrases"):
        assert got[section] == {(x.who, x.term): (x.df, pytest.approx(x.score)) for x in vocabulary.term_scores(b, section).collect()}
    assert got["mentions"] == {(x.who, x.addr): (x.messages, None) for x in vocabulary.mentions(b, aliases).where("messages >= 2").collect()}
    subjects = {(w, t): n for (w, t), (n, _) in got["terms"].items() if t.startswith("subject")}
    assert subjects == {(f"s{k}@x", f"subject{'abc'[k]}"): 3 for k in range(3)}  # three threads each, thirty messages
    assert set(got["rising"]) <= set(got["terms"]) and all(ratio >= 1.8 for _, ratio in got["rising"].values())
