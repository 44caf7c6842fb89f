"""Fresh targets and promotion: write a run's output beside the live one, switch over when it passes."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.quality import raise_if_failed

VERSION_PROPERTY = "tidewright.version"


def quoted(name: str) -> str:
    """A table name with each part in backticks."""
    parts = name.split(".")
    if any(not p or "`" in p for p in parts):
        raise ValueError(f"invalid table name: {name!r}")
    return ".".join(f"`{p}`" for p in parts)


def version_name(name: str, run_id: str) -> str:
    return f"{name}_attempt_{run_id}"


def is_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.getTable(name).tableType in ("VIEW", "TEMPORARY")


def write_version(
    df: DataFrame,
    name: str,
    *,
    run_id: str | None = None,
    location: str | None = None,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> str:
    """Writes a run's output to a table of its own, ``<name>_attempt_<run_id>``, and returns that name.

    With ``location`` its files go to a directory below it. A target left over from a failed run with the
    same id is refused, not overwritten.
    """
    run_id = run_id or uuid.uuid4().hex[:12]
    version = version_name(name, run_id)
    writer = df.write.format(fmt).mode("errorifexists")
    if partition_by:
        writer = df.hint("rebalance", *partition_by).write.format(fmt).mode("errorifexists").partitionBy(*partition_by)
    if location:
        writer = writer.option("path", f"{location.rstrip('/')}/{version}")
    writer.saveAsTable(version)
    return version


def publish(spark: SparkSession, name: str, version: str) -> None:
    """Points ``name``, a view, at a version table. One catalog change: readers see the old or the new."""
    if spark.catalog.tableExists(name) and not is_view(spark, name):
        raise ValueError(f"{name} is a table of its own, not a published view")
    spark.sql(
        f"CREATE OR REPLACE VIEW {quoted(name)} TBLPROPERTIES ('{VERSION_PROPERTY}' = '{version}') "
        f"AS SELECT * FROM {quoted(version)}"
    )


def current_version(spark: SparkSession, name: str) -> str | None:
    """The version table a published name points at."""
    rows = (
        spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").filter(F.col("key") == VERSION_PROPERTY).select("value").collect()
    )
    return rows[0]["value"] if rows else None


def table_format(spark: SparkSession, name: str) -> str:
    return _described(spark, name, "Provider").lower()


def table_location(spark: SparkSession, name: str) -> str:
    return _described(spark, name, "Location").rstrip("/")


def _described(spark: SparkSession, name: str, what: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)}").filter(F.col("col_name") == what).collect()
    return rows[0]["data_type"] if rows else ""


def fresh_location(location: str, run_id: str | None = None) -> str:
    """A folder beside a table's present one, for its next content."""
    stem = re.sub(r"_attempt_[0-9A-Za-z-]+$", "", location.rstrip("/"))
    return f"{stem}_attempt_{run_id or uuid.uuid4().hex[:12]}"


def drop_old_versions(spark: SparkSession, name: str, *, keep: int = 0, min_age_seconds: float = 86_400) -> list[str]:
    """Deletes what earlier writes of a table have left: replaced versions and abandoned attempts; returns them.

    The live version always stays, and so do the ``keep`` newest others and all changed within ``min_age_seconds``,
    which a running write or a reader may still be on. For a published name they are its version tables, for a plain
    table the folders beside its present location.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(where: str):  # noqa: ANN202  (a JVM object)
        return jvm.org.apache.hadoop.fs.Path(where)

    found: list[tuple[float, str, str | None]] = []  # (changed at, folder, version table)
    if is_view(spark, name):
        live = current_version(spark, name)
        if live is None:
            raise ValueError(f"{name} is a view that was not published here")
        head, _, last = name.rpartition(".")
        mine = re.compile(re.escape(last) + r"_attempt_[0-9A-Za-z-]+$")
        for t in spark.catalog.listTables(head or None):
            version = f"{head}.{t.name}" if head else t.name
            if mine.match(t.name) and not t.isTemporary and version != live:
                found.append((0.0, table_location(spark, version), version))
    else:
        base = table_location(spark, name)
        stem = fresh_location(base, "x").removesuffix("_attempt_x")
        mine = re.compile(re.escape(stem.rsplit("/", 1)[1]) + r"(_attempt_[0-9A-Za-z-]+)?$")
        parent = path(stem).getParent()
        for status in parent.getFileSystem(conf).listStatus(parent):
            folder = status.getPath()
            if status.isDirectory() and mine.match(folder.getName()) and folder.getName() != base.rsplit("/", 1)[1]:
                found.append((0.0, folder.toString(), None))
    aged = []
    for _, folder, version in found:
        fs = path(folder).getFileSystem(conf)
        changed = fs.getFileStatus(path(folder)).getModificationTime() / 1000 if fs.exists(path(folder)) else 0.0
        aged.append((changed, folder, version))
    aged.sort(reverse=True)
    gone = [entry for entry in aged[keep:] if entry[0] <= time.time() - min_age_seconds]
    for _, folder, version in gone:
        if version is not None:
            spark.sql(f"DROP TABLE {quoted(version)}")
        path(folder).getFileSystem(conf).delete(path(folder), True)
    return [version or folder for _, folder, version in gone]


def promote_on_gate(spark: SparkSession, name: str, version: str, report: DataFrame) -> str:
    """Publishes a version if its quality report has no error, and returns the summary line.

    Otherwise raises; the live name keeps its content and the attempt stays for inspection.
    """
    summary = raise_if_failed(report)
    publish(spark, name, version)
    return summary
