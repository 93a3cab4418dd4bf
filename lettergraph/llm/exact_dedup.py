"""Exact dedup as a stateful stream: keyed state on disk, without expiry.

Documents stream in as narrow rows, digest and place, dealt by a hash of their place
over parts that make several micro-batches, however many files the table has.  The state, kept by RocksDB under the stream's
checkpoint and never expired, has one entry a digest of the normalised text
(A-Z lower-cased, nothing else): how many rows had it, and of the row that stays
the stable identifier (largest id) and the content locator (file and row in it).
Each micro-batch meets the digests that those before it left in the state, and writes the entries it
changed to the shared folder; after the last one every row is looked up by its digest.  On a hit,
a digest seen more than once in any batches, the full text is compared with that
of the located row; rows that share a digest but not the bytes are grouped by
their text instead.  The comparison reads the documents again, as a locator
stands in the state and not the text.

Only DataFrame functions touch the rows.  Partial counts and maxima are built
before each shuffle, so a hot text costs one state entry and no large group.

Defined cases: null text counts as empty; texts of any length are compared whole;
null ids are smaller than all others; of rows that repeat id and text, the one
located last stays; an empty table has no rows; columns other than the two named
are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettergraph.shared import discard, shared_path, written

BATCHES = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(source: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    norm = normalised(F.col(text_col))
    return source.select(
        digest(norm).alias("digest"),
        F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"),
        norm.alias("norm"),
    )


def _schema(spark: SparkSession, path: str, id_col: str, text_col: str) -> T.StructType:
    """The two columns that are read; of a table that has a column ``_metadata``, the files' own is then not hidden."""
    return T.StructType([f for f in spark.read.parquet(path).schema if f.name in (id_col, text_col)])


def digest_log(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, batches: int = BATCHES) -> DataFrame:
    """Run the stream over all rows there are, in ``batches`` micro-batches; every change of the state as (digest, n, keep, batch)."""
    work = shared_path(spark, "exact")
    rows = _rows(spark.read.schema(_schema(spark, path, id_col, text_col)).parquet(path), id_col, text_col, digest).select("digest", "place")
    parts = batches * -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    rows.repartition(parts, "place.file", "place.row").write.parquet(f"{work}/rows")
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts // batches)
    seen = reader.parquet(f"{work}/rows").groupBy("digest").agg(F.count("*").alias("n"), F.max("place").alias("keep"))
    done = []

    def log(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{work}/log/batch={batch}")
        done.append(batch)

    # A store closed at its commit leaves no local files beside the shared ones; the next batch opens it from these.
    settings = _STATE | {"spark.sql.streaming.stateStore.unloadOnCommit": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = seen.writeStream.outputMode("update").foreachBatch(log).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    logged = T.StructType([*seen.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(logged).parquet(f"{work}/log") if done else spark.createDataFrame([], logged)


def digest_state(spark: SparkSession, path: str, *args, **options) -> DataFrame:
    """The state after the last micro-batch: (digest, n, keep)."""
    last = digest_log(spark, path, *args, **options).groupBy("digest").agg(F.max(F.struct("batch", "n", "keep")).alias("s"))
    return last.select("digest", "s.n", "s.keep")


def exact_duplicates(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, batches: int = BATCHES) -> DataFrame:
    """One row an input row: id, keep_id, group_size, kept, digest, and its place (file, row)."""
    state = written(digest_state(spark, path, id_col, text_col, digest, batches), "state")
    rows = _rows(spark.read.schema(_schema(spark, path, id_col, text_col)).parquet(path), id_col, text_col, digest)
    # Texts travel once; those that share a digest are written, to be compared.
    hits = written(rows.join(state.where("n > 1"), "digest"), "hits")
    located = hits.where(F.col("place").eqNullSafe(F.col("keep"))).select("digest", F.col("norm").alias("kept_norm"))
    other = written(hits.join(located, "digest").where("norm <> kept_norm").select("digest", "norm", "place"), "clashes")
    # Digests that more than one text has: the texts decide.
    by_text = other.groupBy("digest", "norm").agg(F.count("*").alias("own_n"), F.max("place").alias("own_keep"))
    apart = written(other.join(by_text, ["digest", "norm"]).select("place", "own_n", "own_keep"), "apart")
    lost = written(other.groupBy("digest").agg(F.count("*").alias("lost")), "lost")
    discard(hits)
    found = rows.drop("norm").join(state, "digest").join(lost, "digest", "left").join(apart, "place", "left")
    keep = F.coalesce("own_keep", "keep")
    return found.select(
        F.col("place.id").alias("id"), keep["id"].alias("keep_id"), F.coalesce(F.col("own_n"), F.col("n") - F.coalesce("lost", F.lit(0))).alias("group_size"),
        F.col("place").eqNullSafe(keep).alias("kept"), "digest", "place",
    )
