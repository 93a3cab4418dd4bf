"""Tables in the folder that driver and executors share: written, read back, removed. Bounds of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, the session's ``spark.checkpoint.dir``.

    Only a session on one machine may go without that setting, as tests do: it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lettergraph-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs no earlier step."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def small_batches(spark: SparkSession, rows: int = 500, megabytes: int | None = None) -> None:
    """Bound an Arrow batch to ``rows`` rows, as documents can be long, and to so many ``megabytes``; a session that has it smaller keeps that.

    Plans run later than they are made, so the settings stay with the session.
    """
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, **({"spark.sql.execution.arrow.maxBytesPerBatch": megabytes << 20} if megabytes else {})}
    for name, most in bounds.items():
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _PATHS:
        _PATHS.remove(path)


def discard(*tables: DataFrame) -> None:
    """Remove written tables that no later step reads."""
    for table in tables:
        _remove(table.sparkSession, table._shared_path)


def release(spark: SparkSession) -> None:
    """Remove all that this process wrote to the shared folder; call it once the results are saved elsewhere."""
    for path in list(_PATHS):
        _remove(spark, path)
