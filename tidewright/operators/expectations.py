"""Expectations on rows: count violations, drop bad rows, or set them aside with their reasons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewright.functions.fixed import REASONS_COLUMN


def holds(condition: Column | str) -> Column:
    """The condition with NULL read as a violation."""
    col = F.expr(condition) if isinstance(condition, str) else condition
    return F.coalesce(col.cast("boolean"), F.lit(False))


def expectation_counts(df: DataFrame, expectations: Mapping[str, Column | str]) -> DataFrame:
    """One row per expectation: ``expectation``, ``n_rows`` seen, ``violations``; one pass for all."""
    if not expectations:
        raise ValueError("no expectations given")
    names = list(expectations)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(~holds(expectations[n])).alias(f"_v{i}") for i, n in enumerate(names)],
    )
    entries = [F.struct(F.lit(n).alias("expectation"), F.col(f"_v{i}").alias("violations")) for i, n in enumerate(names)]
    return counts.select("_rows", F.explode(F.array(*entries)).alias("e")).select(
        F.col("e.expectation"), F.col("_rows").alias("n_rows"), F.col("e.violations")
    )


def observe_expectations(
    df: DataFrame, expectations: Mapping[str, Column | str], observation: Observation
) -> DataFrame:
    """Keeps every row and counts violations on the side, during whatever action the frame feeds.

    ``observation.get`` then holds ``n_rows`` and one count per expectation name.
    """
    return df.observe(
        observation,
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~holds(c)).alias(n) for n, c in expectations.items()],
    )


def add_counts(counts: dict[str, int], more: Mapping[str, int]) -> None:
    """Adds what one action observed to counts that several actions share."""
    for name, n in more.items():
        counts[name] = counts.get(name, 0) + int(n)


def expect_or_drop(
    df: DataFrame, expectations: Mapping[str, Column | str], observation: Observation | None = None
) -> DataFrame:
    """Only the rows that meet every expectation.

    With an observation, what is dropped is counted during whatever action the frame feeds: ``n_rows`` that came,
    ``n_dropped``, and the violations of each expectation, where a row may fail several.
    """
    if observation is not None:
        failed = F.lit(False)
        for condition in expectations.values():
            failed = failed | ~holds(condition)
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(failed).alias("n_dropped"),
            *[F.count_if(~holds(c)).alias(n) for n, c in expectations.items()],
        )
    for condition in expectations.values():
        df = df.filter(holds(condition))
    return df


def tag_reasons(
    df: DataFrame, expectations: Mapping[str, Column | str], *, reasons: str = REASONS_COLUMN
) -> DataFrame:
    """Adds the names of the expectations a row fails, after any reasons it already carries."""
    failed = F.array_compact(F.array(*[F.when(~holds(c), F.lit(n)) for n, c in expectations.items()]))
    if reasons in df.columns:
        failed = F.concat(F.coalesce(F.col(reasons), F.array().cast("array<string>")), failed)
    return df.withColumn(reasons, failed)


def split_quarantine(
    df: DataFrame, expectations: Mapping[str, Column | str], *, reasons: str = REASONS_COLUMN
) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: good rows without the reasons column, bad rows with it."""
    tagged = tag_reasons(df, expectations, reasons=reasons)
    return tagged.filter(F.size(reasons) == 0).drop(reasons), tagged.filter(F.size(reasons) > 0)
