"""Column names, session settings and draws used by several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettergraph.shared import small_batches  # noqa: F401


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def md5_int(*cols, digits: int = 13):
    """An integer below 16**digits drawn from the md5 of the joined columns.

    Thirteen hex digits fill 52 bits, so the value is exact as a double and
    SQL engines agree on it.
    """
    joined = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, digits), 16, 10).cast("bigint")
