"""How much of a source a run touches: from a high-water mark on, or a bounded sample."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def high_water_mark(df: DataFrame, column: str = "updated_at") -> DataFrame:
    """One row, ``wm``: the greatest value of ``column``, NULL when there is none."""
    return df.agg(F.max(column).alias("wm"))


def latest_watermark(spark: SparkSession, table: str, column: str = "updated_at") -> Any | None:
    """The high-water mark of a table, or None on the first run; one value reaches the driver."""
    if not spark.catalog.tableExists(table):
        return None
    return high_water_mark(spark.table(table), column).first()["wm"]


def newer_than(df: DataFrame, column: str, watermark: Any | None) -> DataFrame:
    """Rows past the mark. It is compared as a literal of the column's own type, so that the filter reaches the
    scan and prunes files."""
    if watermark is None:
        return df
    dtype = df.schema[column].dataType
    if isinstance(dtype, TimestampNTZType):  # as text: a datetime literal would shift by the driver's zone
        watermark = str(watermark)
    return df.filter(F.col(column) > F.lit(watermark).cast(dtype))


def sample_scope(df: DataFrame, *, where: Column | str | None = None, limit: int | None = None) -> DataFrame:
    """Bounds a trial run by a predicate, a row limit or both; refuses to run unbounded."""
    if where is None and limit is None:
        raise ValueError("a sample needs a predicate or a limit")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    scoped = df if where is None else df.filter(where)
    return scoped if limit is None else scoped.limit(limit)
