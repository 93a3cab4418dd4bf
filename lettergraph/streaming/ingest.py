"""Streams of messages: ingest once, counts by week with a watermark, results in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettergraph.shared import shared_path


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern: a stream takes a single file only so


def run_to_table(stream: DataFrame, mode: str, name: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Run a stream over all there is; its rows with the micro-batch they came in.  A batch done twice replaces itself."""
    spark = stream.sparkSession
    work = shared_path(spark, name)

    def write(rows: DataFrame, batch: int) -> None:
        prepare(rows).write.mode("overwrite").parquet(f"{work}/rows/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not any(p.numInputRows for p in query.recentProgress):
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{work}/rows")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key of an updating stream."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")


def deduplicated(records: DataFrame, key: str = "message_id", lateness: str | None = None) -> DataFrame:
    """The first arrival of each message id; with ``lateness`` the state forgets ids older than that."""
    if lateness is None:
        return records.dropDuplicates([key])
    return records.withWatermark("sent_ts", lateness).dropDuplicatesWithinWatermark([key])


def weekly_counts(m: DataFrame, lateness: str = "26 weeks") -> DataFrame:
    """Messages by sender and week, the week's state dropped once the watermark has passed it."""
    stamped = m.withColumn("at", F.col("sent_ts").cast("timestamp")).withWatermark("at", lateness)
    return stamped.groupBy("sender_addr", F.window("at", "7 days", "7 days", "4 days").alias("w")).agg(F.count("*").alias("n")).select("sender_addr", F.date_format("w.start", "yyyy-MM-dd").alias("week"), "n")


def rolling_frequency(weekly: DataFrame, weeks: int = 26) -> DataFrame:
    """Counts over the last ``weeks`` weeks from weekly counts: nothing is subtracted, the frame moves."""
    day = F.datediff(F.col("week").cast("date"), F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy("sender_addr").orderBy(day).rangeBetween(-7 * (weeks - 1), 0)
    return weekly.withColumn("rolling", F.sum("n").over(frame))


def high_water(rows: DataFrame, column: str = "sent_ts") -> DataFrame:
    """The newest time taken in: the next read begins there."""
    return rows.agg(F.max(column).alias("last_sync"), F.count("*").alias("n"))
