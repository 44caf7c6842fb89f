"""The source-to-silver flow put together from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType

from tidewright.folders import ensure_checkpoint_dir
from tidewright.functions.fixed import BATCH_COLUMN, REASONS_COLUMN, RESCUED_COLUMN
from tidewright.operators.changes import needing_update
from tidewright.operators.dedup import latest_wins
from tidewright.operators.expectations import add_counts, expect_or_drop, tag_reasons
from tidewright.operators.keys import lookup_join
from tidewright.operators.scope import high_water_mark, newer_than
from tidewright.operators.typing import drop_helpers, type_columns
from tidewright.sources.landing import write_landing
from tidewright.sources.publish import drop_old_versions
from tidewright.sources.tables import MERGE_FORMATS, read_or_none, upsert
from tidewright.streaming.bronze import bronze_stream, refresh_table, refresh_with, skip_or_run


def land_changes(
    spark: SparkSession,
    batch: DataFrame,
    bronze_table: str,
    key: str,
    *,
    root: str,
    entity: str,
    dt: str,
    run_id: str,
) -> str | None:
    """Lands the rows of a batch that bronze does not hold in this form; the skip reason if there are none.

    Bronze is the memory: a wiped bronze table makes everything new again.
    """
    changed = needing_update(batch, read_or_none(spark, bronze_table), key)
    return skip_or_run(
        changed,
        lambda rows: write_landing(rows, root, entity, dt=dt, run_id=run_id),
        reason=f"no new {entity} records",
    )


def refresh_bronze(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    bronze_table: str,
    checkpoint: str,
    *,
    path: str | None = None,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
    expectations: Mapping[str, Column | str] | None = None,
    counts: dict[str, int] | None = None,
) -> bool:
    """Takes the landing files that bronze has not seen; returns whether there were any.

    ``options`` go to the file source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``: the size of a micro-batch).
    ``expectations`` warn: rows that fail them are kept, and counted in ``counts`` while they are written.
    """
    return refresh_table(
        bronze_stream(spark, landing, schema, options=options),
        bronze_table,
        checkpoint,
        path=path,
        fmt=fmt,
        partition_by=partition_by,
        expectations=expectations,
        counts=counts,
    )


def silver(
    bronze: DataFrame,
    keys: Sequence[str],
    *,
    updated_at: str = "updated_at",
    types: Mapping[str, str] | None = None,
    expectations: Mapping[str, Column | str] | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Typed, guarded, one row per key: the newest by ``updated_at``, then by ingest time.

    Rows are tested before the deduplication, so that every unusable row is seen and not only the one that
    would have survived it. ``observation`` counts what is dropped, as in ``expect_or_drop``.
    """
    guards = expectations or {f"valid_{k}": f"`{k}` IS NOT NULL" for k in keys}
    typed = type_columns(bronze, {updated_at: "timestamp", **(types or {})})
    usable = expect_or_drop(typed, guards, observation)
    return drop_helpers(latest_wins(usable, keys, [updated_at]), ("_rn", RESCUED_COLUMN, BATCH_COLUMN))


def silver_with_reasons(
    bronze: DataFrame,
    keys: Sequence[str],
    *,
    updated_at: str = "updated_at",
    types: Mapping[str, str] | None = None,
    expectations: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Every bronze row, typed, with the reasons it cannot go to silver (none: it can)."""
    guards = expectations or {f"valid_{k}": f"`{k}` IS NOT NULL" for k in keys}
    typed = type_columns(bronze, {updated_at: "timestamp", **(types or {})}, reasons=REASONS_COLUMN)
    return tag_reasons(typed, guards)


def refresh_silver(
    spark: SparkSession,
    bronze_table: str,
    silver_table: str,
    keys: Sequence[str],
    checkpoint: str,
    *,
    updated_at: str = "updated_at",
    types: Mapping[str, str] | None = None,
    expectations: Mapping[str, Column | str] | None = None,
    location: str | None = None,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    counts: dict[str, int] | None = None,
    keep_versions: int | None = None,
) -> bool:
    """Brings the silver table up to date from the bronze rows that are new, and returns whether there were any.

    What the expectations drop is counted during the fold's own pass over the new rows and added to ``counts``
    (``n_rows``, ``n_dropped``, one per expectation). ``fmt`` and ``partition_by`` (key columns, so that a fold rewrites
    only the partitions it touches) say how a missing table is created. Each fold of an unpartitioned table writes a
    version; ``keep_versions`` drops all but that many of the replaced ones, which readers must be done with.

    The newest of the stored and the arriving versions of a key is the newest of all its versions, so this
    gives what ``silver`` gives over the whole of bronze, while reading of bronze only what came since. Stored
    rows are looked up for the arriving keys alone.
    """

    def fold(batch: DataFrame, _batch_id: int) -> None:
        seen = Observation() if counts is not None else None
        arriving = silver(
            batch, keys, updated_at=updated_at, types=types, expectations=expectations, observation=seen
        )
        # several steps read what arrives; written once, it is also counted once
        ensure_checkpoint_dir(spark)
        arriving = arriving.checkpoint()
        if counts is not None:
            add_counts(counts, seen.get)
        stored = read_or_none(spark, silver_table)
        if stored is not None:
            met = lookup_join(stored, arriving.select(*keys), keys, "left_semi")
            arriving = latest_wins(met.unionByName(arriving), keys, [updated_at])
        upsert(arriving, silver_table, keys, location=location, fmt=fmt, partition_by=partition_by, keep_batch=False)
        if keep_versions is not None and not partition_by and fmt not in MERGE_FORMATS:
            drop_old_versions(spark, silver_table, keep=keep_versions, min_age_seconds=0)

    any_new = refresh_with(spark.readStream.table(bronze_table), fold, checkpoint)
    if spark.catalog.tableExists(silver_table):
        spark.catalog.refreshTable(silver_table)
    return any_new


def incremental(df: DataFrame, column: str, bronze: DataFrame | None) -> DataFrame:
    """Rows past bronze's high-water mark; all of them on a first run."""
    if bronze is None:
        return df
    return newer_than(df, column, high_water_mark(bronze, column).first()["wm"])
