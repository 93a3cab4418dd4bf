"""Sentence rules, cleaning, subjects, dates, HTML: own sentences for each rule."""
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from lettergraph.functions import html, rules, text
from lettergraph.functions.dates import date_group, resolve_when, workdays_since
from lettergraph.functions.query import day_range, parse


def flags(spark, body, subject="", names=()):
    row = spark.createDataFrame([(body, subject)], "b string, s string").select(text.signals(F.col("b"), F.col("s"), list(names)).alias("f")).first().f.asDict()
    return {k for k, v in row.items() if v}


@pytest.mark.parametrize(("body", "want"), [
    ("Please review the draft by Friday.", {"has_deadline", "has_strong_request", "has_request"}),
    ("If possible, could you send it?", {"has_weak_request", "has_request", "has_question"}),
    ("The ticket has been resolved.", {"has_completion"}),
    ("No action needed, please ignore it.", {"has_withdrawal"}),
    ("금요일까지 회신 부탁드립니다.", {"has_deadline", "has_strong_request", "has_request"}),
    ("검토 요청 건을 완료했습니다.", {"has_completion"}),
    ("요청하신 자료를 다시 검토 부탁드립니다.", {"has_decision", "has_strong_request", "has_request"}),
    ("참고 부탁드립니다.", {"is_trivial"}), ("회의록 참고 부탁드립니다.", set()),
    ("문제 없으면 승인 부탁드립니다.", {"has_decision", "has_strong_request", "has_request"}),
    ("현재까지 진행 중입니다.", set()),
    ("각 담당자는 확인 부탁드립니다.", {"mentions_group", "has_weak_request", "has_request"}),
    ("Is it so? Plain words.", {"has_question"}),
    ("요청은 취소합니다. 내일까지 제출 부탁드립니다.", {"has_withdrawal", "has_deadline", "has_strong_request", "has_request"}),
    ("", {"is_trivial"}), ("++ new reader", {"is_trivial"}), ("FYI.", {"is_trivial"}), ("All well.\n" + rules.PRESERVED + "\nPlease review?", set()),
])
def test_signals(spark, body, want):
    assert flags(spark, body) == want


def test_names_and_subject(spark):
    assert flags(spark, "Hello Kim Nara, see below.", "[검토 요청] plan", ["nara", "x"]) == {"mentions_me", "subject_has_request"}


def test_evidence_sentence(spark):
    rows = spark.createDataFrame([("Hi.\nWe finished; completed.\nWhat else? Please confirm 승인 부탁 soon.",), ("First\nsecond",), (None,)], "b string").select(text.evidence_sentence(F.col("b")).alias("e")).collect()
    assert [r.e for r in rows] == ["Please confirm 승인 부탁 soon.", "First", ""]


MAIL = "Sure, done.\n> old\nMore.\n--\nKim\n\nFrom: a@b.test\nSent: today\nTo: c\nSubject: x\nold text"


@pytest.mark.parametrize(("body", "want"), [
    (MAIL, "Sure, done.\nMore."), ("Yes\n\nOn Mon, 1 Jan 2024 at 10:00 Kim wrote:\n> q", "Yes"), ("Yes\n-----Original Message-----\nq", "Yes"), ("a\n\n\n\n\nb", "a\n\nb"),
    ("From: here the story starts\nnot a header", "From: here the story starts\nnot a header"), (None, ""), ("x\n__________\nFrom", "x"), ("only text", "only text"), ("Oui\nLe 3 mai 2024 à 10:00, a@b.fr a écrit :\nq", "Oui"),
])
def test_new_content_is_a_fixed_point(spark, body, want):
    once = spark.createDataFrame([(body,)], "b string").select(text.new_content(F.col("b")).alias("c"))
    assert once.first().c == want
    assert once.select(text.new_content(F.col("c")).alias("c")).first().c == want


def test_preserved_quotes(spark):
    row = spark.createDataFrame([(MAIL,)], "b string").select(text.new_content(F.col("b"), F.lit(True)).alias("c")).first().c
    assert row.startswith("Sure, done.\nMore.\n\n" + rules.PRESERVED + "\nFrom: a@b.test") and row.endswith("old text")
    again = spark.createDataFrame([(row,)], "b string").select(text.new_content(F.col("b")).alias("c"), text.own_text(F.col("b")).alias("o"), text.preserved_text(F.col("b")).alias("p")).first()
    assert again.c == row and again.o == "Sure, done.\nMore." and again.p.startswith("From: a@b.test")


def test_subjects_and_words(spark):
    rows = spark.createDataFrame([("RE: Fw:  [Re] 회신: The  Plan",), ("Report",), (None,)], "s string").select(text.normalised_subject(F.col("s")).alias("n")).collect()
    assert [r.n for r in rows] == ["the plan", "report", ""]
    w = spark.createDataFrame([("The server at https://x.test/a and 서버에서 첨부합니다 결과 a@b.test",)], "s string").select(text.words(F.col("s"), ("the", "and")).alias("w")).first().w
    assert w == ["server", "서버", "첨부", "결과"]
    cut = lambda t, n: spark.range(1).select(text.smart_truncated(F.lit(t), n).alias("t")).first().t
    long = cut("y" * 4000 + "x" * 50 + "END", 200)
    assert long.endswith("xEND") and "\n…(중략 — 3,877자)…\n" in long and long.startswith("y" * 105) and len(long) <= 200
    assert cut("x" * 50 + "END", 20) == "x" * 20 and cut("short", 20) == "short"
    table = "head\n" + "".join(f"| row {i} | {'v' * 20} |\n" for i in range(60)) + "the end"
    lines = cut(table, 300).split("\n")
    assert all(x.endswith("|") for x in lines if x.startswith("|")) and lines[0] == "head" and lines[-1] == "the end"
    assert spark.range(1).select(text.json_object(F.lit('say {"a": {"b": 1}} end')).alias("t")).first().t == '{"a": {"b": 1}}'


def test_dates(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(24)]
    pairs = [(a, b) for a in days[:9] for b in days]
    got = spark.createDataFrame(pairs, "a date, b date").select("a", "b", workdays_since(F.col("a"), F.col("b"), ["2024-01-10", "2024-01-13"]).alias("n")).collect()
    for r in got:
        want = sum(1 for d in days if r.a < d <= r.b and d.weekday() < 5 and d != dt.date(2024, 1, 10))
        assert r.n == want, r
    words = {"오늘": "2024-01-31", "내일": "2024-02-01", "모레": "2024-02-02", "2/30": None, "1/5": "2024-01-05", "수요일": "2024-02-07", "금요일": "2024-02-02", "다음 주 월요일": "2024-02-12", "조만간": None}
    base = F.lit("2024-01-31").cast("date")
    for w, d in words.items():
        got = spark.range(1).select(resolve_when(F.lit(w), base).cast("string").alias("d")).first().d
        assert got == d, (w, got)
    assert spark.range(1).select(resolve_when(F.lit("1/5"), F.lit("2024-12-20").cast("date")).cast("string").alias("d")).first().d == "2025-01-05"
    group = lambda d: spark.range(1).select(date_group(F.lit(d).cast("timestamp"), F.lit("2024-01-31").cast("date")).alias("g")).first().g
    assert [group(d) for d in ("2024-01-31", "2024-01-30", "2024-01-29", "2024-01-25", "2024-01-02", "2023-12-31")] == ["today", "yesterday", "this_week", "last_week", "this_month", "2023-12"]


def test_query_line():
    s = parse('from:"Kim Na" to:a@b.test after:2024 after:2024-03 before:2024-06-01 is:unread has:attachment file:x.pdf thread:7 "exact words" http://x.test plain on:2024-05')
    assert s.fields == {"from": ["Kim Na"], "to": ["a@b.test"], "file": ["x.pdf"]} and (s.after, s.before) == ("2024-05-01", "2024-06-01")
    assert s.flags == {"unread"} and s.has_attachment and s.thread == 7 and s.phrases == ["exact words"] and s.terms == ["http://x.test", "plain"]
    assert day_range("2024") == ("2024-01-01", "2025-01-01") and day_range("2024-12") == ("2024-12-01", "2025-01-01") and day_range("2024-02-29")[1] == "2024-03-01" and day_range("2024-13") == (None, None) and day_range("x") == (None, None)


HOSTILE = [
    "<img/onerror=alert(1)/src=x>", "<a/href=javascript:alert(1)>x</a>", '<a title="x"href="javascript:alert(1)">y</a>', '<img title="a"onerror="alert(1)">', "<a href=' java\nscript:alert(1)'>z</a>",
    "<scr<script>ipt>alert(1)</script>", "<svg><script>x</script></svg>", "<p title='<script>'>k</p>", "<iframe src=x></iframe><math><a href=x>", "<a href='&#106;avascript:alert(1)'>n</a>", "<img src='data:text/html,x'>",
    "<style>@import x</style><b style='x:expression(1)'>b", "<a href='//evil.test'>r</a><base href=x>", "<!--[if IE]><script>x</script><![endif]--><table background=x><td width='1;x'>", "<input autofocus onfocus=x><form action=javascript:x>", "<a href=\"x\" href=\"javascript:1\">",
]


def test_safe_html_keeps_nothing_hostile(spark):
    from html.parser import HTMLParser

    class Seen(HTMLParser):
        def handle_starttag(self, tag, attrs):
            assert tag in html.ALLOWED and {k for k, _ in attrs} <= {*html.ALLOWED[tag], *html.ANYWHERE, "data-blocked"}
            for k, v in attrs:
                assert k != "href" or (v.startswith(html._LINKS) and not v.startswith(("//", "/\\")))
                assert k != "src" or v.startswith(("cid:", "data:image/"))

    rows = spark.createDataFrame([(h,) for h in [*HOSTILE, "".join(HOSTILE), None, ""]], "h string").select(html.safe_html(F.col("h")).alias("s")).collect()
    for r in rows:
        Seen().feed(r.s)
        assert "alert" not in r.s.replace("ipt&gt;alert(1)", "")
    plain = spark.createDataFrame([("set style = \"bold\" here &amp; 1 &lt; 2",), ("<p>a <div class='gmail_quote'>old <b>x</b></div> tail</p>",)], "h string")
    got = plain.select(html.safe_html(F.col("h")).alias("keep"), html.safe_html(F.col("h"), "cut").alias("cut"), html.safe_html(F.col("h"), "fold").alias("fold")).collect()
    assert got[0].keep == "set style = \"bold\" here &amp; 1 &lt; 2" and got[1].cut == "<p>a  tail</p>" and "<details>" in got[1].fold and "old <b>x</b>" in got[1].fold


def test_references_and_markdown(spark):
    cases = [("&#8217; &eacute; &copy; &#x41; &amp;lt; &nosuch;", "\u2019 é © A &lt; &nosuch;")]
    assert [r.t for r in spark.createDataFrame([(a,) for a, _ in cases], "h string").select(html.html_text(F.col("h")).alias("t")).collect()] == [b for _, b in cases]
    marked = [
        ("<h2>T</h2><p>a <b>b</b> <em>c</em><br>d</p><ul><li>x<li>y<ol><li>1</ol></ul>", "## T\n\na **b** *c*\nd\n\n- x\n- y\n\n  1. 1"),
        ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "| A | B |\n| --- | --- |\n| 1 | 2 |"),
        ("<table cellpadding=0><tr><td>L</td><td>R</td></tr></table>", "L R"), ("<pre>a\n  b</pre>", "```\na\n  b\n```"), ("<blockquote>q</blockquote><span style='font-weight: bold'>s</span>", "> q\n\n**s**"), (None, ""),
    ]
    assert [r.m for r in spark.createDataFrame([(a,) for a, _ in marked], "h string").select(html.html_markdown(F.col("h")).alias("m")).collect()] == [b for _, b in marked]


def test_html(spark):
    page = "<!doctype html><head><title>t</title></head><body><script>x()</script><h2>Head</h2><p>One <b>bold</b> &amp; <a href='https://x.test'>link</a></p><ul><li>a<li>b</ul><img src='http://t.test/p.gif' onload='x()'><p style='a'>end&nbsp;</p></body>"
    row = spark.createDataFrame([(page,)], "h string").select(html.html_text(F.col("h")).alias("t"), html.html_markdown(F.col("h")).alias("m"), html.safe_html(F.col("h")).alias("s")).first()
    assert row.t == "Head\n\nOne bold & link\n\na\nb\n\nend"
    assert "## Head" in row.m and "**bold**" in row.m and "[link](https://x.test)" in row.m and "- a\n- b" in row.m
    assert "script" not in row.s and "onload" not in row.s and "t.test" not in row.s and 'href="https://x.test"' in row.s and "style" not in row.s
    img = spark.createDataFrame([("<img src='cid:A1'><img src='cid:zz'>", {"a1": ("image/png", bytearray(b"xy"))})], "h string, i map<string,struct<mime:string,data:binary>>")
    got = img.select(html.with_images(F.lower("h"), F.col("i")).alias("r")).first().r
    assert (got.n_ok, got.n_fail) == (1, 1) and "data:image/png;base64,eHk=" in got.html


QUOTED = [  # a body, what is left of its text when quotes are cut
    ("<p>own</p><div>-----Original Message-----</div><p>old</p>", "own"),
    ("<p>own</p><p><span>-----</span><b>Original</b> <i>Message</i><span>-----</span></p><p>old</p>", "own"),
    ("<div>own<div>-----</div><div><span>원본</span> <span>메시지</span></div>old</div>", "own"),
    ("own<hr><p><b>From:</b> a@b.test<br><b>Sent:</b> Monday<br><b>Subject:</b> x</p><p>old</p>", "own"),
    ("<div><p>own <img src='cid:a' alt='x'></p><div style='border-top: solid 1pt'><b>보낸 사람:</b> a<br>날짜: b<br>제목: c<br></div>old</div>", "own"),
    ("<p>own</p><p>On Mon, 8 Jan 2024 at 10:00, Kim &lt;kim@home.test&gt; wrote:</p><p>old</p>", "own"),
    ("<p>own</p><p>From: here to there</p><p>it is far</p>", "own\nFrom: here to there\nit is far"),
    ("<p>own</p><p>-----</p><p>Kim</p>", "own\n-----\nKim"),
    ("<p>own</p><hr><p>From: me</p><p>more</p>", "own\nFrom: me\nmore"),
    ("<p>the original message was lost</p><p>Original Message</p>", "the original message was lost\nOriginal Message"),
    ("<p>own</p><blockquote>old</blockquote><p>after</p>", "own\nafter"),
    ("-----Original Message-----<p>old</p>", ""),
    ("<table><tr><td>own</td></tr><tr><td>--- Forwarded message ---</td></tr><tr><td>old</td></tr></table>", "own"),
]


def test_quotes_are_cut_at_labels(spark):
    rows = spark.createDataFrame([(h,) for h, _ in QUOTED], "h string").select("h", *[html.safe_html(F.col("h"), q).alias(q) for q in ("keep", "cut", "fold")]).collect()
    strip = lambda h: "\n".join(x for x in (" ".join(t.split()) for t in re.sub(r"<(?:/?(?:p|div|td|tr|table|blockquote|hr|details|summary)\b[^>]*|br)>", "\n", h).split("\n")) if x)
    text = lambda h: strip(re.sub(r"<(?!/?(?:p|div|td|tr|table|blockquote|hr|br|details|summary)\b)[^>]*>", "", h))
    for r, (_, want) in zip(rows, QUOTED, strict=True):
        assert text(r.cut) == want, r.h
        folded = r.fold.replace("<details>", "").replace("</details>", "").replace("<summary>…</summary>", "")
        assert text(folded) == text(r.keep) and r.fold.count("<details>") == r.fold.count("</details>") == (text(r.keep) != want)
        for body in r[1:]:  # every element is closed in order
            stack = []
            for end, name in re.findall(r"<(/?)([a-z0-9]+)[^>]*>", body):
                if end:
                    assert stack.pop() == name, body
                elif name not in ("br", "hr", "img", "col"):
                    stack.append(name)
            assert not stack


def test_unclosed_elements_take_linear_time():
    import time

    for make in (lambda: html._Safe("keep"), html._Markdown):
        began = time.monotonic()
        walker = make()
        walker.feed("<p>x</i>" * 100_000)
        walker.close()
        assert walker.text().count("x") == 100_000 and time.monotonic() - began < 5
    began = time.monotonic()
    assert html._without_quotes("<p>x</i>" * 50_000 + "<b>---Original Message---</b>old", "cut").count("x") == 50_000 and time.monotonic() - began < 5


def test_hidden_elements_end_with_their_own_name(spark):
    cases = [
        ("<head><style>a{}</style><title>T1</title></head><body>x</body>", "x"), ("a<svg><title>t</title><text>l</text></svg>b<math><mi>x</mi></math>c", "a b c"), ("<title>t</title>x", "x"),
        ("a<svg viewBox='0'/>b", "a b"), ("x<script>var a = '</style>';", "x"), ("<head><meta charset=x><body>y", "y"), ("<header>h</header>x", "h\nx"), ("<script>" * 20_000, ""), ("x<!-- open", "x"),
    ]
    assert [r.t for r in spark.createDataFrame([(a,) for a, _ in cases], "h string").select(html.html_text(F.col("h")).alias("t")).collect()] == [b for _, b in cases]


def test_json_object_is_json_or_nothing(spark):
    cases = [('so: {"a": 1} ok', '{"a": 1}'), ('{"a": "}"} then {b}', None), ('{"a": 1}, {"b": 2}', None), ("none", None), (None, None), ("{}", "{}"), ('```json\n{"a": [1,\n2]}\n```', '{"a": [1,\n2]}'), ("{'a': 1}", None)]
    assert [r.j for r in spark.createDataFrame([(a,) for a, _ in cases], "t string").select(text.json_object(F.col("t")).alias("j")).collect()] == [b for _, b in cases]
