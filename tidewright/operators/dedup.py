"""One row per key, the newest one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.fixed import HASH_COLUMN, INGESTED_AT_COLUMN, SOURCE_FILE_COLUMN
from tidewright.functions.hashing import cheap_row_hash


def latest_wins(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """Keeps, per key, the row that is greatest in ``order_by`` (NULLs lose).

    Ties go on to ingest time, source file and content hash where the frame has them, and else to a hash of
    the row, so a rerun keeps the same row. ``row_number() = 1`` lets Spark keep one row per key in every map
    task before the shuffle: a key that holds a third of the rows sends one row per task, not all of them.
    """
    if not keys:
        raise ValueError("at least one key is required")
    named = [c for c in order_by if isinstance(c, str)]
    order: list[Column] = [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order_by]
    for name in (INGESTED_AT_COLUMN, SOURCE_FILE_COLUMN):
        if name in df.columns and name not in named:
            order.append(F.col(name).desc_nulls_last())
    if HASH_COLUMN not in named:
        order.append((F.col(HASH_COLUMN) if HASH_COLUMN in df.columns else cheap_row_hash(df)).desc_nulls_last())
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")
