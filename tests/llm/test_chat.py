"""Chat: round trips, folded events, the loss mask."""
import hashlib

from pyspark.sql import functions as F

from lettergraph.llm import chat

NASTY = ["\\", "<|", "<\\|", "<|end|>\n", "a<", "|>", "\\\\<|turn|>x<|text|>", "", None, "\\### Assistant: </turn> ok", "é漢\n\n", "x" * 50_000]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_round_trip_of_control_strings(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(NASTY)] + [(2, k, r, "t") for k, r in enumerate(NASTY[:8])] + [(None, 0, None, "alone")]
    out = chat.format_conversations(turns(spark, rows).withColumn("branch", F.lit(1)))
    got = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("learnt"), "formatted", "loss_mask").collect()
    assert len(got) == 3
    for g in got:
        want = [(r or "", t or "") for c, _, r, t in rows if c == g.conv_id]
        assert [tuple(t) for t in g.back] == want
        assert g.learnt == "".join(t for r, t in want if r == "assistant")
        texts = [g.formatted[s.start : s.end] for s in g.loss_mask]
        assert [x.replace("<\\|", "<|").replace("\\\\", "\\") for x in texts] == [t for r, t in want if r == "assistant"]


def test_repeated_turns_are_kept(spark):
    got = chat.format_conversations(turns(spark, [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 0, "assistant", "b")])).select(chat.read_turns(F.col("formatted")).alias("b")).first().b
    assert [tuple(t) for t in got] == [("system", "s"), ("assistant", "b"), ("user", "a"), ("user", "a")]


def test_events_fold(spark):
    log = [
        (1, 1, 0, "message", "user", "Hi"), (1, 2, 1, "message", "assistant", ""), (1, 4, 1, "delta", None, "lo"), (1, 3, 1, "delta", None, "Hel"), (1, 5, 2, "message", "user", "bad"),
        (1, 6, 2, "edit", None, "good"), (1, 7, 3, "message", "assistant", "old"), (1, 8, 3, "regenerate", None, ""), (1, 9, 3, "delta", None, "new"),
        (1, 10, 4, "message", "user", "more"), (1, 11, 1, "regenerate", None, ""), (1, 12, 1, "delta", None, "Hello!"), (1, 13, 2, "delta", None, "gone with its message"),
        (2, 1, 0, "delta", None, "only a delta"),
    ]
    events = spark.createDataFrame([(c, s, m, 0, k, r, t) for c, s, m, k, r, t in log], "conv_id long, seq long, msg long, branch long, kind string, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.b] for r in chat.render(chat.fold_messages(events.orderBy(F.rand(1)))).select("conv_id", chat.read_turns(F.col("formatted")).alias("b")).collect()}
    assert got == {1: [("user", "Hi"), ("assistant", "Hello!")], 2: [("", "only a delta")]}


def test_log_of_turns_folds_back(spark):
    rows = [(c, k, "assistant" if k % 2 else "user", NASTY[(c + k) % len(NASTY)]) for c in range(12) for k in range(12)]
    rows += [(50, 0, "user", "same"), (50, 0, "user", "same"), (50, None, "user", "no number"), (50, -3, None, "before"), (None, 1, "user", "x")]
    table = turns(spark, rows)
    log = chat.turn_log(table).cache()
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == set(chat.KIND_ORDER) and kinds["edit"] > 20 and kinds["regenerate"] > 20 and kinds["delta"] > 200
    assert kinds["message"] == len(rows) + kinds["regenerate"] and log.count() > 4 * len(rows)
    final = chat.fold_messages(log.orderBy(F.rand(3)))
    assert final.where("text = 'gone with it'").isEmpty()
    sort = lambda df: sorted(map(str, df.select("conv_id", "msg", "role", "text").collect()))
    assert sort(final) == sort(chat.fold_messages(chat.turn_events(table)))
    assert sort(final) == sorted(str(r) for r in table.select("conv_id", F.col("turn").alias("msg"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).collect())


def test_query_digests(spark, tmp_path):
    from lettergraph.llm.queries import HARD_TEXT, op8_chat

    rows = [(3, 0, "system", "s"), (3, 1, "user", None), (3, 2, "assistant", "é<|x"), (4, 0, "user", "u")]
    turns(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    rows += [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)]
    for r in op8_chat(spark, str(tmp_path)).collect():
        own = [(x[2], x[3] or "") for x in sorted(rows, key=str) if x[0] == r.conv_id]
        learnt = "".join(t for role, t in own if role == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(learnt), sha(learnt))


def test_empty_table(spark):
    assert chat.format_conversations(turns(spark, [])).collect() == []


def test_turn_numbers_of_any_size_and_type(spark):
    """Numbers of int and bigint near their ends, beside a column that has a name of the log's."""
    for kind, numbers in (("int", [-(2**31), -1, 0, 2047, 2048, 3000, 2**31 - 1, None]), ("bigint", [-(2**63), 2**43, 2**60, 2**63 - 1, None]), ("smallint", [3000, -5])):
        rows = [(c, n, "assistant" if k % 2 else "user", f"text {c} {k} <|") for c in range(8) for k, n in enumerate(numbers)]
        table = spark.createDataFrame([(*r, "clash") for r in rows], f"conv_id long, turn {kind}, role string, text string, seq string")
        got = chat.fold_messages(chat.turn_log(table)).select("conv_id", "msg", "role", "text").collect()
        key = lambda r: (r[0], r[1] is not None, r[1] or 0)
        assert sorted(map(tuple, got), key=key) == sorted(rows, key=key)
        back = {r.conv_id: [t.text for t in r.b] for r in chat.render(chat.fold_messages(chat.turn_log(table))).select("conv_id", chat.read_turns(F.col("formatted")).alias("b")).collect()}
        assert back[3] == [r[3] for r in sorted(rows, key=key) if r[0] == 3]
