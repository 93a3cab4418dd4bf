"""Exact dedup against a dictionary, with colliding digests too."""
import re

import pytest
from pyspark.sql import functions as F

from lettergraph.llm.exact_dedup import digest_log, exact_duplicates, normalised, sha256

ROWS = [(1, "Same"), (5, "sAME"), (3, "same"), (2, None), (9, ""), (4, "É"), (6, "é"), (7, "abcd"), (8, "x" * 300_000), (None, "same"), (11, "X" * 300_000), (12, "efgh"), (13, "EFGH"), (20, "ſame"), (21, "Kelvin K")]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("digest", [sha256, lambda norm: F.length(norm).cast("string")])
@pytest.mark.parametrize("batches", [1, 3])
def test_groups(spark, tmp_path, digest, batches):
    spark.createDataFrame([(*r, 7) for r in ROWS], "doc_id long, text string, digest int").repartition(3).write.parquet(str(tmp_path / "d.parquet"))
    groups = {}
    for i, t in ROWS:
        groups.setdefault(low(t), []).append(-1 if i is None else i)
    want = sorted((i, max(groups[low(t)]), len(groups[low(t)]), (i or -1) == max(groups[low(t)])) for i, t in [(-1 if i is None else i, t) for i, t in ROWS])
    got = exact_duplicates(spark, str(tmp_path / "d.parquet"), digest=digest, batches=batches).collect()
    assert sorted((-1 if r.id is None else r.id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_repeated_rows_keep_one(spark, tmp_path):
    spark.createDataFrame([(1, "a")] * 3 + [(2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "d.parquet"))
    got = exact_duplicates(spark, str(tmp_path / "d.parquet")).collect()
    assert sorted((r.id, r.group_size, r.kept) for r in got) == [(1, 3, False), (1, 3, False), (1, 3, True), (2, 1, True)]


def test_batches_meet_the_state_of_those_before(spark, tmp_path):
    """A table of one file makes three micro-batches, and the state that one leaves is met by the next."""
    path = str(tmp_path / "d.parquet")
    rows = [(i, f"Text {i % 20}" if i < 100 else f"alone {i}") for i in range(140)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    log = digest_log(spark, path).collect()
    assert {r.batch for r in log} == {0, 1, 2}
    seen = {}
    for r in sorted(log, key=lambda r: r.batch):
        seen.setdefault(r.digest, []).append(r.n)
    hits = [n for n in seen.values() if len(n) > 1]
    assert len(seen) == 60 and len(hits) > 10  # digests that a later batch found in the state
    assert all(n == sorted(set(n)) for n in hits) and sorted(n[-1] for n in seen.values()) == [1] * 40 + [5] * 20
    got = sorted((r.id, r.keep_id, r.group_size) for r in exact_duplicates(spark, path).collect())
    assert got == [(i, 80 + i % 20 if i < 100 else i, 5 if i < 100 else 1) for i, _ in rows]


def test_clashing_columns(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, "a", 1, "x", 2), (2, "A", 1, "x", 2)], "doc_id long, text string, digest int, _metadata string, n int").write.parquet(path)
    assert sorted((r.id, r.keep_id) for r in exact_duplicates(spark, path).collect()) == [(1, 2), (2, 2)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "d.parquet"))
    assert exact_duplicates(spark, str(tmp_path / "d.parquet")).collect() == []


def test_only_ascii_letters_change(spark):
    got = spark.createDataFrame([("AZaz",), ("ÄİſK",), (None,)], "t string").select(normalised(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == ["azaz", "Äİſk", ""]
