"""Tables: reading, writing and the retry-safe write strategies."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.folders import ensure_checkpoint_dir
from tidewright.functions.fixed import STRATEGIES
from tidewright.functions.widening import require_fit
from tidewright.operators.dedup import latest_wins
from tidewright.operators.keys import any_null, check_keys, keys_of_interest, lookup_join, require_unique
from tidewright.operators.merge import merged_rows
from tidewright.sources.publish import (
    current_version,
    fresh_location,
    is_view,
    publish,
    quoted,
    table_format,
    table_location,
    write_version,
)

#: formats whose tables run MERGE themselves
MERGE_FORMATS = ("delta", "iceberg")
CHANGE_FEED_PROPERTY = "delta.enableChangeDataFeed"
#: partitions that a scan's filter names one by one; of more, it has the range
PARTITION_LITERALS = 200


def read_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    """The table, or None when it does not exist yet: a first run."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def _aligned(df: DataFrame, target: DataFrame) -> DataFrame:
    """``df`` in the target's column order and types, absent columns NULL; raises where a type would lose values."""
    require_fit(df.schema, target.schema, "the table")
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )


def create_table(
    spark: SparkSession,
    name: str,
    schema: StructType,
    *,
    path: str | None = None,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> None:
    """An empty table, made without running a job; partition columns come last."""
    fields = [f for f in schema if f.name not in partition_by] + [schema[p] for p in partition_by]
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    layout = f" PARTITIONED BY ({', '.join(f'`{p}`' for p in partition_by)})" if partition_by else ""
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE {quoted(name)} ({columns}) USING {fmt}{layout}{where}")


def write_table(
    df: DataFrame,
    name: str,
    *,
    mode: str,
    merge_schema: bool = False,
    overwrite_schema: bool = False,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    path: str | None = None,
    rebalance: bool = True,
) -> None:
    """Saves a frame as a table. An existing table's schema stays as it is unless a change is asked for.

    An overwrite writes its rows beside the old ones first: if that fails, the table is as it was. A plain table's
    location is then moved to them, and the old files stay until ``drop_old_versions``; a partitioned table, or one
    that gets another schema, is filled from them.

    ``merge_schema`` adds the frame's new columns; ``overwrite_schema`` lets an overwrite replace the schema.
    Columns the frame lacks are written as NULL; a column whose type would lose values in the table's raises. Delta
    tables are created with row-change capture on.
    Rows bound for a partitioned table are rebalanced by partition first: one file set per partition instead
    of one per task, while adaptive execution splits a partition that is too large for one task. Turn
    ``rebalance`` off for rows that already lie together by partition.
    A published name (see ``publish``) is appended to in its current version and overwritten by a new one.
    """
    spark = df.sparkSession
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    exists = spark.catalog.tableExists(name)
    if exists and mode == "overwrite" and overwrite_schema and is_view(spark, name):
        publish(spark, name, write_version(df, name, location=path, fmt=fmt, partition_by=partition_by))
        return
    if fmt == "delta" or not exists or (mode == "overwrite" and overwrite_schema):
        writer = df.write.format(fmt).mode(mode)
        if fmt == "delta":
            writer = writer.option(CHANGE_FEED_PROPERTY, "true")
            if merge_schema:
                writer = writer.option("mergeSchema", "true")
            if overwrite_schema:
                writer = writer.option("overwriteSchema", "true")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if exists and fmt not in MERGE_FORMATS:
            here = table_location(spark, name)
            if spark.catalog.getTable(name).tableType == "EXTERNAL" or "_attempt_" in here:
                path = here  # a replaced table stays where it was put, or moved to
        if path and (not exists or fmt not in MERGE_FORMATS):
            writer = writer.option("path", path)
        if not exists or fmt in MERGE_FORMATS:
            writer.saveAsTable(name)
            return
        staged = write_version(df, name, fmt=fmt, location=fresh_location(table_location(spark, name)))
        again = spark.table(staged).write.format(fmt).mode(mode)
        if partition_by:
            again = again.partitionBy(*partition_by)
        if path:
            again = again.option("path", path)
        again.saveAsTable(name)
        _drop_staged(spark, staged)
        return
    if mode in ("error", "errorifexists"):
        raise ValueError(f"table exists: {name}")
    if mode == "ignore":
        return
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode: {mode!r}")
    published, store = is_view(spark, name), name
    if published:
        store = current_version(spark, name)
        if store is None:
            raise ValueError(f"{name} is a view that was not published here")
    target = spark.table(store)
    added = [f for f in df.schema.fields if f.name not in target.columns]
    if added and not merge_schema:
        raise ValueError(f"columns not in {name}: {[f.name for f in added]}; pass merge_schema to add them")
    if published and mode == "overwrite":
        wide = target.limit(0).unionByName(df.limit(0), allowMissingColumns=True)
        parts = partition_columns(spark, store)
        version = write_version(_aligned(df, wide), name, location=path, fmt=fmt, partition_by=parts)
        publish(spark, name, version)
        return
    if added:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
        spark.sql(f"ALTER TABLE {quoted(store)} ADD COLUMNS ({ddl})")
        target = spark.table(store)
    rows = _aligned(df, target)
    if mode == "append":
        rows.write.insertInto(store)
    elif partition_columns(spark, store):
        _refill(rows, store)
    else:
        _move_to_fresh_files(rows, store)
    if published and added:
        publish(spark, name, store)


def _drop_staged(spark: SparkSession, staged: str) -> None:
    """Drops a table that only passed rows on, with the folder made for it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(table_location(spark, staged)).getParent()
    spark.sql(f"DROP TABLE {quoted(staged)}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _refill(rows: DataFrame, name: str, run_id: str | None = None) -> None:
    """Overwrites a partitioned plain table from a written copy of its next content, which stays if that fails."""
    spark = rows.sparkSession
    where = fresh_location(table_location(spark, name))
    staged = write_version(rows, name, run_id=run_id, location=where, fmt=table_format(spark, name))
    spark.table(staged).write.insertInto(name, overwrite=True)
    _drop_staged(spark, staged)


def _move_to_fresh_files(rows: DataFrame, name: str, run_id: str | None = None) -> None:
    """Writes a plain table's next content beside the present one and moves the table's location to it."""
    spark = rows.sparkSession
    base = table_location(spark, name)
    fresh = fresh_location(base, run_id)
    rows.write.format(table_format(spark, name)).mode("errorifexists").save(fresh)
    if table_location(spark, name) != base:
        raise RuntimeError(f"{name} was replaced during this write; its own output is in {fresh}")
    spark.sql(f"ALTER TABLE {quoted(name)} SET LOCATION '{fresh}'")
    spark.catalog.refreshTable(name)


@contextlib.contextmanager
def _kept(df: DataFrame, keep: bool | str) -> Iterator[DataFrame]:
    """A batch that several steps read: as it is, kept on the executors, or written to the checkpoint folder.

    On the executors (in memory, else on disk) it is computed once and its true size is known to the planner from the
    second step on, but a lost executor's part is computed again, from whatever the source holds by then. A source that
    moves on under a running write needs ``"checkpoint"``: then every step sees the same rows, come what may.
    """
    if keep == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        yield df.checkpoint()
        return
    if not keep:
        yield df
        return
    batch = df.persist()
    try:
        yield batch
    finally:
        batch.unpersist()


def overwrite_table(df: DataFrame, name: str, *, path: str | None = None, fmt: str = "parquet") -> None:
    """Retry-safe full replace."""
    write_table(df, name, mode="overwrite", fmt=fmt, path=path)


def overwrite_partitions(
    df: DataFrame,
    name: str,
    partition_key: str | Sequence[str],
    *,
    path: str | None = None,
    fmt: str = "parquet",
    rebalance: bool = True,
    touched: Sequence[Mapping[str, str]] | None = None,
) -> None:
    """Replaces only the partitions that ``df`` has rows for; ``rebalance`` as in ``write_table``.

    The mode is an option of this one write, at the table's location, so writes that run at the same time in one
    session do not meet; partitions that are new are registered after it: those in ``touched`` where the caller knows
    them all, else whatever lies below the table's location.
    """
    keys = [partition_key] if isinstance(partition_key, str) else list(partition_key)
    if not keys:
        raise ValueError("overwrite_partition requires a partition key")
    check_keys(df.columns, keys)
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        write_table(df, name, mode="overwrite", partition_by=keys, path=path, fmt=fmt, rebalance=rebalance)
        return
    have = partition_columns(spark, name)
    if have != keys:
        raise ValueError(f"{name} is partitioned by {have}, not by {keys}")
    target = spark.table(name)
    extra = [c for c in df.columns if c not in target.columns]
    if extra:
        raise ValueError(f"columns not in {name}: {extra}")
    rows = _aligned(df, target)
    if rebalance:
        rows = rows.hint("rebalance", *keys)
    writer = rows.write.format(table_format(spark, name)).mode("overwrite").partitionBy(*keys)
    writer.option("partitionOverwriteMode", "dynamic").save(table_location(spark, name))
    if touched is None:
        _register_partitions(spark, name)
    elif touched:
        specs = [", ".join(f"`{k}` = '{spec[k]}'" for k in keys) for spec in touched]
        spark.sql(f"ALTER TABLE {quoted(name)} ADD IF NOT EXISTS {' '.join(f'PARTITION ({s})' for s in specs)}")
    spark.catalog.refreshTable(name)


def _register_partitions(spark: SparkSession, name: str, tries: int = 5) -> None:
    """Registers what lies below the table's location; a folder that another write replaces during the listing may be
    gone for a moment, and then it is listed again."""
    for left in reversed(range(tries)):
        try:
            spark.catalog.recoverPartitions(name)
            return
        except Exception as e:  # noqa: BLE001  the classic and the Connect client raise different classes
            if not left or "FileNotFoundException" not in str(e):
                raise
            time.sleep(0.2)


def touched_partitions(target: DataFrame, batch: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The rows of ``target`` in partitions that ``batch`` has rows for, NULL partitions like any other.

    The partitions are named in a filter of literals, so the scan lists and reads no others, whatever join comes after
    it. Of more than ``PARTITION_LITERALS`` the filter has the range of each column, and a semi join the rest.
    """
    wanted = batch.select(*[F.col(f"`{p}`").cast(target.schema[p].dataType).alias(p) for p in parts]).distinct()
    found = wanted.limit(PARTITION_LITERALS + 1).collect()
    if len(found) <= PARTITION_LITERALS:
        named = F.lit(False)
        for row in found:
            one = F.lit(True)
            for p in parts:
                one = one & (F.col(f"`{p}`").isNull() if row[p] is None else F.col(f"`{p}`") == F.lit(row[p]))
            named = named | one
        return target.filter(named)
    facts = wanted.agg(
        *[F.min(F.col(f"`{p}`")).alias(f"low_{i}") for i, p in enumerate(parts)],
        *[F.max(F.col(f"`{p}`")).alias(f"high_{i}") for i, p in enumerate(parts)],
        *[F.count_if(F.col(f"`{p}`").isNull()).alias(f"nulls_{i}") for i, p in enumerate(parts)],
    ).first()
    same = F.lit(True)
    for i, p in enumerate(parts):
        col, within = F.col(f"`{p}`"), F.lit(False)
        if facts[f"low_{i}"] is not None:
            within = col.between(F.lit(facts[f"low_{i}"]), F.lit(facts[f"high_{i}"]))
        if facts[f"nulls_{i}"]:
            within = within | col.isNull()
        target = target.filter(within)
        same = same & col.eqNullSafe(F.col(f"_t_{p}"))
    return target.join(wanted.select(*[F.col(f"`{p}`").alias(f"_t_{p}") for p in parts]), same, "left_semi")


def append_dedup(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    *,
    order_by: Sequence[str] = (),
    path: str | None = None,
    fmt: str = "parquet",
    keep_batch: bool | str = True,
) -> int:
    """Appends the rows whose key the table does not hold yet, one per key, and returns how many.

    ``order_by`` says which of several batch rows with one key to keep (the greatest). Rows with a NULL key
    cannot be told apart from earlier ones, so they are refused. ``keep_batch`` as in ``upsert``.
    """
    check_keys(df.columns, keys)
    spark = df.sparkSession
    existing = read_or_none(spark, name)
    with _kept(df, keep_batch and existing is not None) as batch:
        if not batch.filter(any_null(keys)).isEmpty():
            raise ValueError(f"append_dedup needs non-NULL keys ({', '.join(keys)})")
        fresh = latest_wins(batch, keys, order_by)
        if existing is not None:
            known = keys_of_interest(existing, batch, keys)
            fresh = lookup_join(fresh, known, keys, "left_anti").select(*batch.columns)
        seen = Observation()
        counted = fresh.observe(seen, F.count(F.lit(1)).alias("n"))
        write_table(counted, name, mode="append", path=path, fmt=fmt)
        return seen.get["n"]


def upsert(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    *,
    location: str | None = None,
    fmt: str = "parquet",
    run_id: str | None = None,
    keep_batch: bool | str = True,
    partition_by: Sequence[str] = (),
) -> dict[str, int]:
    """Upserts ``df`` into a table on ``keys``, creating it if missing: with ``partition_by``, as a partitioned table.

    Returns ``inserted``, ``updated`` and ``total_processed``; a matched row counts as updated even if
    nothing in it differs. Two batch rows with one key raise before anything is written.

    How it is written depends on the table. Formats with MERGE run it. A table partitioned by key columns has
    only the touched partitions rewritten. Any other published name gets a new version and is switched over to
    it, and a plain table gets new files beside the old and its location moved: readers see the old content or
    the new, never a mix, and what is replaced stays until its owner drops it. The one exception is a plain
    table partitioned by other columns: it is overwritten from a version, which is kept if that fails.

    The steps of an upsert each read the batch. It is kept on the executors for them; turn ``keep_batch`` off
    for a batch that is itself a stored table, and cheaper to read again than to hold.
    """
    check_keys(df.columns, keys)
    with _kept(df, keep_batch and df.sparkSession.catalog.tableExists(name)) as batch:
        return _upsert(batch, name, keys, location, fmt, run_id, partition_by)


def _upsert(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    location: str | None,
    fmt: str,
    run_id: str | None,
    partition_by: Sequence[str],
) -> dict[str, int]:
    spark = df.sparkSession
    total = require_unique(df, keys, "batch")
    if not spark.catalog.tableExists(name):
        if fmt in MERGE_FORMATS or partition_by:
            write_table(df, name, mode="overwrite", fmt=fmt, path=location, partition_by=partition_by)
        else:
            publish(spark, name, write_version(df, name, run_id=run_id, location=location, fmt=fmt))
        return {"inserted": total, "updated": 0, "total_processed": total}

    view = is_view(spark, name)
    if not view and table_format(spark, name) in MERGE_FORMATS:
        return _native_merge(df, name, keys, total)

    base = current_version(spark, name) if view else None
    if view and base is None:
        raise ValueError(f"{name} is a view that was not published here")
    target = spark.table(name)
    parts = partition_columns(spark, base if view else name)
    scoped = not view and bool(parts) and set(parts) <= set(keys)
    if scoped:
        target = touched_partitions(target, df, parts)
    merged = merged_rows(target, df, keys)
    if scoped:
        merged = merged.hint("rebalance", *parts)
    # observed above every shuffle, in the tasks that write: a part that a lost executor makes Spark compute
    # again is not counted twice there
    seen = Observation()
    counted = merged.observe(seen, F.count_if(F.col("_action") == "insert").alias("inserted")).drop("_action")
    if scoped:
        overwrite_partitions(counted, name, parts, rebalance=False)
    elif view:
        fresh = write_version(counted, name, run_id=run_id, location=location, fmt=fmt, partition_by=parts)
        if current_version(spark, name) != base:
            raise RuntimeError(f"{name} was replaced during this upsert; its own output is in {fresh}")
        publish(spark, name, fresh)
    elif parts:
        _refill(counted, name, run_id)
    else:
        _move_to_fresh_files(counted, name, run_id)
    inserted = seen.get["inserted"]
    return {"inserted": inserted, "updated": max(total - inserted, 0), "total_processed": total}


def _native_merge(df: DataFrame, name: str, keys: Sequence[str], total: int) -> dict[str, int]:
    spark = df.sparkSession
    target = spark.table(name)
    inserted = lookup_join(df, keys_of_interest(target, df, keys), keys, "left_anti").count()
    on = " AND ".join(f"{quoted(name)}.`{k}` = source.`{k}`" for k in keys)
    merge = df.alias("source").mergeInto(name, F.expr(on))
    values = {c: F.col(f"source.`{c}`") for c in df.columns}
    updates = {c: v for c, v in values.items() if c not in keys}
    if updates:
        merge = merge.whenMatched().update(updates)
    merge.whenNotMatched().insert(values).merge()
    return {"inserted": inserted, "updated": max(total - inserted, 0), "total_processed": total}


def write_with_strategy(
    df: DataFrame,
    name: str,
    strategy: str,
    *,
    partition_key: str | Sequence[str] | None = None,
    merge_key: Sequence[str] | None = None,
    path: str | None = None,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> dict[str, int] | int | None:
    """Writes by a declared strategy, refusing one that lacks the key it needs.

    ``none`` is a plain append: nothing makes it safe to retry. ``fmt`` and ``partition_by`` say how a table that is
    missing is created; ``overwrite_partition`` creates it by its key.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    if strategy == "overwrite_partition":
        if not partition_key:
            raise ValueError("overwrite_partition requires a partition key")
        return overwrite_partitions(df, name, partition_key, path=path, fmt=fmt)
    if partition_by and not df.sparkSession.catalog.tableExists(name):
        create_table(df.sparkSession, name, df.schema, path=path, fmt=fmt, partition_by=partition_by)
    if strategy in ("merge_on_key", "append_dedup"):
        if not merge_key:
            raise ValueError(f"{strategy} requires a merge key")
        if strategy == "merge_on_key":
            return upsert(df, name, merge_key, location=path, fmt=fmt)
        return append_dedup(df, name, merge_key, path=path, fmt=fmt)
    if strategy == "overwrite_table":
        return overwrite_table(df, name, path=path, fmt=fmt)
    return write_table(df, name, mode="append", path=path, fmt=fmt)

