"""Auxiliary tables written beside a primary one: quarantine and metrics."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.fixed import REASONS_COLUMN
from tidewright.operators.expectations import tag_reasons
from tidewright.sources.publish import quoted, table_location
from tidewright.sources.tables import create_table, overwrite_partitions, write_with_strategy

LANE_COLUMN = "_lane"
RUN_COLUMN = "_run"
METRICS_SCHEMA = "metric string, value bigint, run_id string, table string"


def quarantine_name(name: str) -> str:
    """``db.meters`` → ``db._quarantine_meters``."""
    head, _, last = name.rpartition(".")
    return f"{head}.{'_quarantine_' + last}" if head else f"_quarantine_{last}"


def _observed(tagged: DataFrame, metrics: Observation, expectations: Mapping[str, Column | str]) -> DataFrame:
    return tagged.observe(
        metrics,
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(F.size(REASONS_COLUMN) > 0).alias("rows_quarantined"),
        *[F.count_if(F.array_contains(REASONS_COLUMN, e)).alias(e) for e in expectations],
    )


def _lane() -> Column:
    return F.when(F.size(REASONS_COLUMN) > 0, "quarantine").otherwise("primary")


def write_with_quarantine(
    df: DataFrame,
    name: str,
    expectations: Mapping[str, Column | str],
    *,
    path: str | None = None,
    fmt: str = "parquet",
    metrics: Observation | None = None,
) -> None:
    """Appends good rows under ``name`` and rejected rows, with their reasons, under ``_quarantine_<name>``.

    Both come from one pass over ``df`` and one commit: the rows go to one table partitioned by lane, and the
    two names are views on a partition each, so reading one never touches the other's files. A plain append, which a
    rerun repeats; ``write_guarded`` goes with any strategy and can be run again.
    """
    spark = df.sparkSession
    store = f"{name}_lanes"
    tagged = tag_reasons(df, expectations)
    if metrics is not None:
        tagged = _observed(tagged, metrics, expectations)
    rows = tagged.withColumn(LANE_COLUMN, _lane())
    first = not spark.catalog.tableExists(store)
    writer = rows.write.format(fmt).mode("append").partitionBy(LANE_COLUMN)
    if path and first:
        writer = writer.option("path", path)
    writer.saveAsTable(store)
    spark.sql(
        f"CREATE OR REPLACE VIEW {quoted(name)} AS SELECT * EXCEPT (`{LANE_COLUMN}`, `{REASONS_COLUMN}`) "
        f"FROM {quoted(store)} WHERE `{LANE_COLUMN}` = 'primary'"
    )
    spark.sql(
        f"CREATE OR REPLACE VIEW {quoted(quarantine_name(name))} AS SELECT * EXCEPT (`{LANE_COLUMN}`) "
        f"FROM {quoted(store)} WHERE `{LANE_COLUMN}` = 'quarantine'"
    )


def write_guarded(
    df: DataFrame,
    name: str,
    expectations: Mapping[str, Column | str],
    strategy: str,
    *,
    run_id: str,
    metrics_table: str | None = None,
    quarantine_path: str | None = None,
    metrics_path: str | None = None,
    **strategy_options: Any,
) -> dict[str, int]:
    """Writes the good rows of a run by a write strategy, and its rejected rows to ``_quarantine_<name>``.

    One pass over ``df`` tags every row and writes it to its lane of the run's partition of the quarantine table. The
    good lane is then written on by the strategy and emptied; the bad lane, with ``_reasons`` and ``_run``, stays.
    Returns ``rows_in``, ``rows_quarantined`` and a count per expectation, and keeps them in ``metrics_table``.

    A rerun under the same ``run_id`` replaces the run's rejected rows and metrics, whatever it rejects this time, and
    repeats the strategy, which is safe to repeat but for ``none``. If the strategy's write fails, the good rows stay
    in their lane until the rerun. ``strategy_options`` go to ``write_with_strategy``.
    """
    if not run_id or "/" in run_id:
        raise ValueError(f"invalid run id: {run_id!r}")
    spark, store, seen = df.sparkSession, quarantine_name(name), Observation()
    tagged = _observed(tag_reasons(df, expectations), seen, expectations)
    rows = tagged.withColumn(RUN_COLUMN, F.lit(run_id)).withColumn(LANE_COLUMN, _lane())
    lanes = f"{store}_lanes"
    if not spark.catalog.tableExists(lanes):
        create_table(spark, lanes, rows.schema, partition_by=[RUN_COLUMN, LANE_COLUMN], path=quarantine_path)
        spark.sql(
            f"CREATE OR REPLACE VIEW {quoted(store)} AS SELECT * EXCEPT (`{LANE_COLUMN}`) "
            f"FROM {quoted(lanes)} WHERE `{LANE_COLUMN}` = 'quarantine'"
        )
    _drop_lanes(spark, lanes, run_id)
    mine = [{RUN_COLUMN: run_id, LANE_COLUMN: lane} for lane in ("primary", "quarantine")]
    overwrite_partitions(rows, lanes, [RUN_COLUMN, LANE_COLUMN], touched=mine)
    good = spark.table(lanes).filter((F.col(RUN_COLUMN) == run_id) & (F.col(LANE_COLUMN) == "primary"))
    write_with_strategy(good.select(*df.columns), name, strategy, **strategy_options)
    _drop_lanes(spark, lanes, run_id, "primary")
    counts = {k: int(v) for k, v in seen.get.items()}
    if metrics_table:
        write_metrics(spark, counts, run_id=run_id, table=name, metrics_table=metrics_table, path=metrics_path)
    return counts


def _drop_lanes(spark: SparkSession, lanes: str, run_id: str, lane: str | None = None) -> None:
    """Removes one run's lanes, or one of them, files included."""
    shown = spark.sql(f"SHOW PARTITIONS {quoted(lanes)} PARTITION (`{RUN_COLUMN}` = '{run_id}')")
    known = {r[0] for r in shown.collect()}  # two at most
    for which in ("primary", "quarantine") if lane is None else (lane,):
        spec = f"{RUN_COLUMN}={run_id}/{LANE_COLUMN}={which}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table_location(spark, lanes)}/{spec}")
        if spec in known:
            drop = f"DROP IF EXISTS PARTITION (`{RUN_COLUMN}` = '{run_id}', `{LANE_COLUMN}` = '{which}')"
            spark.sql(f"ALTER TABLE {quoted(lanes)} {drop}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshTable(lanes)


def write_metrics(
    spark: SparkSession,
    counts: Mapping[str, int],
    *,
    run_id: str,
    table: str,
    metrics_table: str,
    path: str | None = None,
) -> None:
    """Keeps a run's counts, one row per metric, in a partition per run and table, which a rerun replaces."""
    rows = [(metric, int(value), run_id, table) for metric, value in sorted(counts.items())]
    frame = spark.createDataFrame(rows, METRICS_SCHEMA).coalesce(1)
    keys = ["run_id", "table"]
    if not spark.catalog.tableExists(metrics_table):
        create_table(spark, metrics_table, frame.schema, path=path, partition_by=keys)
    touched = [{"run_id": run_id, "table": table}]
    overwrite_partitions(frame, metrics_table, keys, rebalance=False, touched=touched)


def append_metrics(
    observation: Observation, df: DataFrame, *, run_id: str, table: str, metrics_table: str, path: str | None = None
) -> None:
    """``write_metrics`` of what an action observed; ``df`` only lends its session.

    Call it after the action that the observed frame fed.
    """
    write_metrics(
        df.sparkSession, observation.get, run_id=run_id, table=table, metrics_table=metrics_table, path=path
    )


