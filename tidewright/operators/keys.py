"""Key handling shared by the joins: which keys occur on both sides, and whether a key is unique."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPREAD = "_spread"


def check_keys(columns: Sequence[str], keys: Sequence[str]) -> None:
    if not keys:
        raise ValueError("at least one key is required")
    missing = [k for k in keys if k not in columns]
    if missing:
        raise ValueError(f"keys not in columns: {missing}")


def any_null(keys: Sequence[str]) -> Column:
    """True where a key column is NULL; such a row equals no other row's key."""
    result = F.lit(False)
    for k in keys:
        result = result | F.col(f"`{k}`").isNull()
    return result


def likely_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer's own estimate of ``df`` is under ``spark.sql.autoBroadcastJoinThreshold``.

    Only used to choose between two equally exact plans; no hint is given, so Spark still decides on the
    join, at run time, from real sizes.
    """
    if not hasattr(df, "_jdf"):  # a Connect client has no estimate to offer; take the plan that suits any size
        return False
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= int(limit)


def lookup_join(left: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``left`` joined with a frame that holds each key once; ``how`` is left, inner, left_semi or left_anti.

    The join also compares a hash of the keys. That changes no result, but it keeps Spark from reusing the
    partitioning which the lookup's own deduplication left behind: both inputs then are plain shuffles, the
    shape in which adaptive execution can split a partition of ``left`` that a hot (or NULL) key has made too
    large. The price is one more shuffle of the lookup, unless it is small enough to be broadcast.
    """
    spread = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    joined = left.withColumn(_SPREAD, spread).join(lookup.withColumn(_SPREAD, spread), [*keys, _SPREAD], how)
    return joined.drop(_SPREAD)


def keys_of_interest(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``table``, cut to those in ``batch`` when the batch is small enough to send around.

    Always holds every key the two share, so it can stand for the table in a semi or anti join with the
    batch. A small batch filters the table inside the scan stage and next to nothing is shuffled; a large one
    would shuffle the table anyway, so it is reduced to one row per key in the map tasks instead.
    """
    wanted = batch.select(*keys)
    found = table.select(*keys)
    if likely_broadcast(wanted):
        found = found.join(wanted, list(keys), "left_semi")
    return found.distinct()


def key_profile(df: DataFrame, keys: Sequence[str], *, nulls_group: bool = True) -> DataFrame:
    """One row: ``total`` rows and ``duplicates``, the rows beyond the first of each key.

    NULL keys count as one group, or not as duplicates at all with ``nulls_group=False`` (where NULL equals
    nothing). Counts are combined in the map tasks, so a hot key costs one row per task.
    """
    check_keys(df.columns, keys)
    counts = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    excess = F.col("_n") - 1
    if not nulls_group:
        excess = F.when(any_null(keys), F.lit(0)).otherwise(excess)
    return counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.sum(excess), F.lit(0)).cast("bigint").alias("duplicates"),
    )


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> int:
    """Raises when a (non-NULL) key occurs twice; returns the row count the check has seen anyway."""
    profile = key_profile(df, keys, nulls_group=False).first()
    if profile["duplicates"]:
        raise ValueError(
            f"{what} has {profile['duplicates']} row(s) beyond the first of their key ({', '.join(keys)}); "
            "reduce it with latest_wins first"
        )
    return profile["total"]
