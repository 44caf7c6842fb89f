"""Keyed upsert as a plan: the table's next content, with what happened to each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.widening import require_fit
from tidewright.operators.keys import any_null, check_keys, keys_of_interest, lookup_join

_HIT = "_hit"


def merged_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` after upserting ``source`` on ``keys``, plus ``_action``: update, insert or keep.

    Keys match with ``=``: a NULL key never matches, so such source rows are always inserted. Matched rows
    take the source's non-key columns; columns only the target has keep their value, and are NULL on insert.
    Each source key is expected once (``require_unique``). A source type that would lose values in the target's raises.

    Two joins instead of one full outer join, which Spark can neither broadcast nor split: with a small
    source the target passes through a broadcast join unshuffled, and with a large one adaptive execution can
    split whatever partition a hot target key makes too large.
    """
    check_keys(target.columns, keys)
    check_keys(source.columns, keys)
    extra = [c for c in source.columns if c not in target.columns]
    if extra:
        raise ValueError(f"source columns not in target: {extra}")
    require_fit(source.schema, target.schema, "the target")
    values = [c for c in source.columns if c not in keys]
    names = {c: f"_s{i}" for i, c in enumerate(values)}

    incoming = source.filter(~any_null(keys)).select(
        *[F.col(f"`{k}`") for k in keys],
        *[F.col(f"`{c}`").alias(names[c]) for c in values],
        F.lit(True).alias(_HIT),
    )
    joined = lookup_join(target, incoming, keys, "left")
    hit = F.col(_HIT).isNotNull()
    existing = joined.select(
        *[
            F.when(hit, F.col(names[c]).cast(target.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c)
            if c in names
            else F.col(f"`{c}`")
            for c in target.columns
        ],
        F.when(hit, "update").otherwise("keep").alias("_action"),
    )

    fresh = lookup_join(source, keys_of_interest(target, source, keys), keys, "left_anti")
    inserted = fresh.select(
        *[
            (F.col(f"`{f.name}`") if f.name in source.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ],
        F.lit("insert").alias("_action"),
    )
    return existing.unionByName(inserted)


def upsert_counts(merged: DataFrame, source_rows: int) -> DataFrame:
    """One row: ``inserted``, ``updated`` (every other source row) and ``total_processed``."""
    return merged.agg(F.count_if(F.col("_action") == "insert").alias("inserted")).select(
        "inserted",
        F.greatest(F.lit(source_rows) - F.col("inserted"), F.lit(0)).cast("bigint").alias("updated"),
        F.lit(source_rows).cast("bigint").alias("total_processed"),
    )


def row_counts(before: DataFrame, source: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, in the source and after, in one row."""
    tagged = [
        df.select(F.lit(i).alias("_t")) for i, df in enumerate((before, source, after))
    ]
    return tagged[0].unionAll(tagged[1]).unionAll(tagged[2]).agg(
        F.count_if(F.col("_t") == 0).alias("rows_before"),
        F.count_if(F.col("_t") == 1).alias("rows_source"),
        F.count_if(F.col("_t") == 2).alias("rows_after"),
    )
