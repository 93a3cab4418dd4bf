"""Values of texts: copies of a text are judged once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettergraph.shared import written


def by_text(rows: DataFrame, column: str, name: str, value: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``name``, the value of the text in ``column`` (which it may replace); null is a text of its own.

    The different texts are found by partial aggregation, judged and written, so few of them are broadcast and rows
    meet many in a join with one row a text.
    """
    texts = rows.select(F.col(column).alias("_text")).distinct()
    judged = written(texts.select("_text", value(F.col("_text")).alias("_value")), "texts")
    return rows.join(judged, F.col(column).eqNullSafe(F.col("_text")), "left").withColumn(name, F.col("_value")).drop("_text", "_value")
