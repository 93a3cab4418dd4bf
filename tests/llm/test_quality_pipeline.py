"""Held-out accuracy of the classifier; the pipeline against its stages done by hand."""
import math
import zlib

import numpy as np
import pyarrow as pa
from conftest import DATA

import corpus_pipeline
from lettergraph.llm import quality
from lettergraph.llm.queries import op9_quality
from test_decontaminate import brute as brute_hits
from test_mixing_sharding import targets
from test_near_dedup import shingles, union


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in op9_quality(spark, f"{DATA}/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    held = [i for i in labels if rows[i].held_out]
    right = np.mean([rows[i].predicted == labels[i] for i in held])
    good, bad = ([rows[i].score for i in held if labels[i] == k] for k in (1, 0))
    assert right >= 0.95 and np.mean([g > b for g in good for b in bad]) >= 0.98


def test_labels_of_held_out_rows_and_negatives_change_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    other = labels.where(~quality.held_out() & (labels.quality == 1))
    a, b = quality.learn(docs, labels), quality.learn(docs.withColumn("source", docs.lang), other)
    assert a.prior == b.prior and all(np.array_equal(x, y) for x, y in zip(a.weights, b.weights, strict=True))


def test_odd_texts_and_no_positives(spark):
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "x" * 2_000_000, 1), (None, "plain", 1), (1, None, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    out = quality.score(odd, quality.learn(odd, labels))
    assert out.columns == odd.columns and [r.score for r in out.collect()] == [0.5] * 6
    model = quality.fit(quality.features(pa.array(["good text here. And more of it."] * 30)), quality.features(pa.array(["BAD!! TEXT!!", "good words."] * 30)))
    scores = [r.score for r in quality.score(odd, model).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] == scores[5]
    assert quality.score(odd.limit(0), model).collect() == []


def test_scores_do_not_depend_on_the_batch(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    model = quality.learn(docs, spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"))
    text = docs.toPandas().sort_values("doc_id").text.tolist()
    whole = model.score(quality.features(pa.array(text)))
    for size in (1, 7, 500):
        assert np.array_equal(whole, np.concatenate([model.score(quality.features(pa.array(text[i : i + size]))) for i in range(0, len(text), size)]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            assert [r.score for r in quality.score(docs.repartition(size + 2), model).orderBy("doc_id").collect()] == whole.tolist()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def plain_risk(z, n_p, prior):
    """The non-negative risk row by row, as it is written down."""
    as_one = sum(math.log(1 + math.exp(-x)) for x in z[:n_p]) / n_p
    as_none = sum(math.log(1 + math.exp(x)) for x in z[:n_p]) / n_p
    unlabelled = sum(math.log(1 + math.exp(x)) for x in z[n_p:]) / (len(z) - n_p)
    return prior * as_one, unlabelled - prior * as_none


def test_risk_and_slope_against_a_plain_loop():
    r = np.random.default_rng(8)
    for prior, shift in ((0.3, 0.0), (0.9, 3.0), (0.6, -1.0)):
        z = np.concatenate([r.normal(shift, 1, 17), r.normal(-shift, 1, 29)])
        positive, negative = plain_risk(z, 17, prior)
        value, slope = quality.risk(z, 17, prior)
        assert abs(value - (positive + max(0.0, negative))) < 1e-12
        step = 1e-6
        # Below 0 the slope climbs on the estimate alone, else it is that of the whole risk.
        part = (lambda p, n: -n) if negative < 0 else (lambda p, n: p + n)
        for k in range(len(z)):
            up, down = z.copy(), z.copy()
            up[k] += step
            down[k] -= step
            assert abs((part(*plain_risk(up, 17, prior)) - part(*plain_risk(down, 17, prior))) / (2 * step) - slope[k]) < 1e-7
    assert plain_risk(np.concatenate([r.normal(3, 1, 17), r.normal(-3, 1, 29)]), 17, 0.9)[1] < 0


def test_stages(spark):
    sf, docs = f"{DATA}/sf0.001", spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mixing", "sharding"]
    good = corpus_pipeline.quality_stage(spark, docs, sf).cache()
    scores = {r.doc_id: r.predicted for r in op9_quality(spark, sf).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, p in scores.items() if p)
    one = corpus_pipeline.near_dedup_stage(spark, good, sf).cache()
    texts = {r.doc_id: r.text for r in good.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    close = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(union(close, list(sets)).values()))
    clean = corpus_pipeline.decontaminate_stage(spark, one, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in one.collect()], items)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(h[0] for h in hits if not h[4])
    mixed = corpus_pipeline.mixing_stage(spark, clean, sf).cache()
    sizes: dict = {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    want, taken, times = targets(sizes), dict.fromkeys(sizes, 0), {}
    for r in mixed.collect():
        taken[r.source] += len(r.text.encode().split())
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    longest = max(len(r.text.encode().split()) for r in clean.collect())
    assert max(times.values()) <= 3 and all(abs(taken[s] - want[s]) <= longest + 1 for s in sizes)
    last = corpus_pipeline.sharding_stage(spark, mixed, sf)
    assert good.columns == one.columns == clean.columns == mixed.columns == docs.columns and last.columns == [*docs.columns, "shard", "slot"]
    rows = sorted((r.doc_id, r.shard, r.slot) for r in last.collect())
    assert [r[0] for r in rows] == sorted(r.doc_id for r in mixed.collect())
    assert sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, sf).collect()) == rows


def test_stages_take_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_hit int, rep string, copies int"
    rows = [(None, None, None, None, None, None, None, None), (1, "", "en", "a", 0, 1, "x", 2), (1, "", "en", "a", 0, 1, "x", 2), (2, "w " * 70_000, "en", "b", 1, 1, "x", 2), (3, "some words in a row here", "en", None, 1, 1, "x", 2)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "never said before")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert set(docs.columns) <= set(out.columns)
            n = out.count()
            assert n <= 3 * table.count()
            if name in ("near_dedup", "decontaminate"):
                assert n == table.count()
