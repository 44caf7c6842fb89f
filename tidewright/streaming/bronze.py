"""Bronze: new landing files picked up once each, raw rows kept, nothing dropped."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.functions.fixed import BATCH_COLUMN
from tidewright.operators.expectations import add_counts, observe_expectations
from tidewright.sources.landing import with_provenance
from tidewright.sources.rescue import parse_with_rescue
from tidewright.sources.tables import create_table, overwrite_partitions


def bronze_stream(
    spark: SparkSession, landing: str, schema: StructType, *, options: Mapping[str, str] | None = None
) -> DataFrame:
    """A stream of the files under ``landing``: typed columns, ``_rescued``, ``_ingested_at``, ``_source_file``.

    ``options`` go to the file source, e.g. ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` to bound a
    micro-batch.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true").options(**dict(options or {}))
    return parse_with_rescue(with_provenance(reader.text(landing)), schema)


def refresh_table(
    stream: DataFrame,
    name: str,
    checkpoint: str,
    *,
    path: str | None = None,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    expectations: Mapping[str, Column | str] | None = None,
    counts: dict[str, int] | None = None,
) -> bool:
    """Adds everything that is new to a table, then stops; returns whether there was anything.

    Every micro-batch becomes a partition of its own, ``_batch``, named after the stream and the batch's number. A batch
    that runs again after a failure overwrites its own partition, so each file's rows are in the table exactly once.
    The table is a plain one: later batch writes to it are seen, and their rows have no ``_batch``. Further columns to
    partition by lie below it.

    ``expectations`` warn: no row is dropped, the violations are counted during the write, and the counts, with
    ``n_rows``, are added to ``counts``.
    """
    spark, layout = stream.sparkSession, [BATCH_COLUMN, *partition_by]

    def add(batch: DataFrame, batch_id: int) -> None:
        source = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = batch
        if expectations:
            seen = Observation()
            rows = observe_expectations(rows, expectations, seen)
        if fmt == "delta":  # its log knows which batches it holds
            once = rows.write.format(fmt).option("txnAppId", source).option("txnVersion", batch_id).mode("append")
            (once.option("path", path) if path else once).saveAsTable(name)
        else:
            mine = f"{source}-{batch_id:09d}"
            rows = rows.withColumn(BATCH_COLUMN, F.lit(mine))
            if not spark.catalog.tableExists(name):
                create_table(spark, name, rows.schema, path=path, fmt=fmt, partition_by=layout)
            touched = None if partition_by else [{BATCH_COLUMN: mine}]
            overwrite_partitions(rows, name, layout, rebalance=bool(partition_by), touched=touched)
        if expectations and counts is not None:
            add_counts(counts, seen.get)

    any_new = refresh_with(stream, add, checkpoint)
    if spark.catalog.tableExists(name):
        spark.catalog.refreshTable(name)  # batches are written in the stream's session, which knows its files alone
    return any_new


def refresh_with(stream: DataFrame, handler: Callable[[DataFrame, int], Any], checkpoint: str) -> bool:
    """Hands every non-empty micro-batch of what is new to ``handler``, then stops; returns whether there was any.

    A batch may be handed over again after a failure, so the handler's write should be one of the retry-safe
    strategies.
    """

    handled: list[int] = []

    def skip_empty(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            handler(batch, batch_id)
            handled.append(batch_id)

    writer = stream.writeStream.foreachBatch(skip_empty).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return bool(handled)


def skip_or_run(changed: DataFrame, write: Callable[[DataFrame], Any], *, reason: str = "nothing new") -> str | None:
    """Runs ``write(changed)`` and returns None, or returns the reason for skipping when there is no row.

    The frame is kept while both look at it, so the joins behind it run once; the emptiness test stops at the
    first row found.
    """
    kept = changed.persist()
    try:
        if kept.isEmpty():
            return reason
        write(kept)
        return None
    finally:
        kept.unpersist()
