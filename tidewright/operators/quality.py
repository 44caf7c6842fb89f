"""Threshold checks that yield finding rows, and the gate that fails on any error."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import fixed
from tidewright.operators.keys import check_keys, key_profile

FINDING_COLUMNS = ("table", "severity", "code", "message", "details")
FINDING_SCHEMA = "table string, severity string, code string, message string, details map<string,string>"


class GateFailed(RuntimeError):
    """A report holds at least one error; ``findings`` is the frame of all of them."""

    def __init__(self, text: str, findings: DataFrame | None = None) -> None:
        super().__init__(text)
        self.findings = findings


def _finding(table: Column, severity: str, code: str, message: Column, details: Mapping[str, Column]) -> list[Column]:
    pairs = [part for k, v in details.items() for part in (F.lit(k), v.cast("string"))]
    return [
        table.cast("string").alias("table"),
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        message.alias("message"),
        F.create_map(*pairs).alias("details"),
    ]


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING_SCHEMA)


def check_row_counts(counts: DataFrame, tolerance: Column | float = fixed.DEFAULT_ROW_COUNT_TOLERANCE) -> DataFrame:
    """Findings for tables that shrank beyond the tolerance; ``counts`` has ``table, previous, current``.

    Growth, a first run (``previous`` 0 or NULL) and a drop of exactly the tolerance all pass.
    """
    tol = F.lit(float(tolerance)) if isinstance(tolerance, (int, float)) else tolerance
    prev, cur = F.col("previous"), F.col("current")
    drop = (prev - cur).cast("double") / prev.cast("double")
    flagged = counts.filter(F.when(prev > 0, drop > tol).otherwise(F.lit(False)))
    message = F.format_string(fixed.ROW_COUNT_DROP_FORMAT, F.bround(drop * 100.0, 1), prev, cur, F.bround(tol.cast("double") * 100.0, 1))
    return flagged.select(
        *_finding(
            F.col("table"),
            "ERROR",
            fixed.ROW_COUNT_DROP,
            message,
            {"previous": prev, "current": cur, "tolerance": tol},
        )
    )


def counts_per(df: DataFrame, group: Column, label: Column) -> DataFrame:
    """``(table, n)``: rows per group, e.g. per partition, ready to meet the last run's counts."""
    return df.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("n")).select(label.alias("table"), "n")


def against_last_run(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``(table, previous, current)`` from two ``(table, n)`` frames; a table that vanished counts 0."""
    return (
        current.withColumnRenamed("n", "current")
        .join(previous.withColumnRenamed("n", "previous"), "table", "full_outer")
        .select(
            "table",
            F.coalesce("previous", F.lit(0)).cast("bigint").alias("previous"),
            F.coalesce("current", F.lit(0)).cast("bigint").alias("current"),
        )
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str], *, by_hash: bool = False) -> DataFrame:
    """One row: ``total`` and ``duplicates`` for the key.

    ``by_hash`` groups wide text keys by their SHA-256, so 32 bytes are shuffled per key instead of whole
    texts.
    """
    if by_hash:
        check_keys(df.columns, keys)
        digests = [F.unhex(F.sha2(F.col(f"`{k}`").cast("string"), 256)).alias(k) for k in keys]
        df = df.select(*digests)
    return key_profile(df, keys)


def check_duplicates(profile: DataFrame, table: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """A finding when ``duplicates`` is above zero."""
    n = F.col("duplicates")
    names = ", ".join(keys) or "unspecified"
    return profile.filter(n > 0).select(
        *_finding(
            F.lit(table),
            "ERROR",
            fixed.DUPLICATE_KEYS,
            F.format_string(fixed.DUPLICATE_KEYS_FORMAT, n, F.lit(names)),
            {"duplicates": n, "keys": F.lit(",".join(keys))},
        )
    )


def null_counts(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``(column, nulls)`` for each required column, all counted in one pass."""
    check_keys(df.columns, required)
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(required)])
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("nulls")) for i, c in enumerate(required)]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.column", "e.nulls")


def check_nulls(counts: DataFrame, table: str) -> DataFrame:
    """One finding per required column that holds a NULL."""
    return counts.filter(F.col("nulls") > 0).select(
        *_finding(
            F.lit(table),
            "ERROR",
            fixed.NULLS_IN_REQUIRED,
            F.format_string(fixed.NULLS_IN_REQUIRED_FORMAT, F.col("column"), F.col("nulls")),
            {"column": F.col("column"), "nulls": F.col("nulls")},
        )
    )


def check_columns(df: DataFrame, expected: Sequence[str], table: str, *, allow_extra: bool = True) -> DataFrame:
    """Findings for columns missing and, with ``allow_extra=False``, for columns nobody expected.

    Reads the schema only. Names are compared case-sensitively.
    """
    sides = [(c, True, False) for c in df.columns] + [(c, False, True) for c in expected]
    names = df.sparkSession.createDataFrame(sides, "name string, there boolean, wanted boolean").coalesce(1)
    seen = names.groupBy("name").agg(F.max("there").alias("there"), F.max("wanted").alias("wanted"))
    fate = F.when(~F.col("there"), "missing").when(F.lit(not allow_extra) & ~F.col("wanted"), "unexpected").alias("fate")
    lists = seen.select(fate, "name").filter("fate IS NOT NULL").groupBy("fate")
    lists = lists.agg(F.array_sort(F.collect_list("name")).alias("names"))

    def of(which: str, severity: str, code: str, text: str) -> DataFrame:
        message = F.format_string(text, F.array_join("names", ", "))
        details = {which: F.array_join("names", ",")}
        return lists.filter(F.col("fate") == which).select(*_finding(F.lit(table), severity, code, message, details))

    missing = of("missing", "ERROR", fixed.MISSING_COLUMNS, fixed.MISSING_COLUMNS_FORMAT)
    return missing.unionByName(of("unexpected", "WARN", fixed.UNEXPECTED_COLUMNS, fixed.UNEXPECTED_COLUMNS_FORMAT))


def check_written(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """Findings for tables a run should have written that are missing or empty; reads at most one row of each."""
    rows = []
    for name in tables:
        if not spark.catalog.tableExists(name):
            rows.append((name, "ERROR", fixed.TABLE_MISSING, "table does not exist after the run", {}))
        elif spark.table(name).isEmpty():
            rows.append((name, "ERROR", fixed.TABLE_EMPTY, "table has no rows after the run", {}))
    return spark.createDataFrame(rows, FINDING_SCHEMA)


def run_checks(spark: SparkSession, *findings: DataFrame | None | Iterable[DataFrame]) -> DataFrame:
    """All findings as one frame, with an empty one beneath; a check that found nothing to check may be None."""

    def frames(given: DataFrame | None | Iterable[DataFrame]) -> list[DataFrame]:
        return [given] if isinstance(given, DataFrame) else list(given or ())

    together = (f.select(*FINDING_COLUMNS) for given in findings for f in frames(given))
    return functools.reduce(DataFrame.unionByName, together, no_findings(spark))


def summarize(report: DataFrame) -> DataFrame:
    """One row: ``errors``, ``warnings``, ``infos``, ``ok`` and the summary line."""
    counts = report.agg(
        *[
            F.count_if(F.col("severity") == s).alias(n)
            for s, n in zip(fixed.QA_SEVERITIES, ("errors", "warnings", "infos"))
        ]
    )
    ok = F.col("errors") == 0
    return counts.select(
        "errors",
        "warnings",
        "infos",
        ok.alias("ok"),
        F.format_string(
            fixed.SUMMARY_FORMAT, F.when(ok, "PASS").otherwise("FAIL"), F.col("errors"), F.col("warnings"), F.col("infos")
        ).alias("summary"),
    )


def raise_if_failed(report: DataFrame) -> str:
    """Raises ``GateFailed``, or returns the summary line.

    The error's text has the summary and the number of errors per code, of which there are few; its ``findings``, a
    frame, has every error with its table and message.
    """
    result = summarize(report).first()
    if result["ok"]:
        return result["summary"]
    errors = report.filter(F.col("severity") == "ERROR")
    kinds = errors.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("table").alias("first")).orderBy("code")
    text = "; ".join(f"{k['code']} {k['n']}, first in {k['first']}" for k in kinds.collect())
    raise GateFailed(f"{result['summary']} — {text}", errors)
