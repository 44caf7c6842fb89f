"""The row changes between two snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tidewright.folders import ensure_checkpoint_dir
from tidewright.functions.hashing import JSON_OPTIONS, _holds_map, canonical
from tidewright.operators.keys import any_null, check_keys, lookup_join


def _same(schema: StructType, name: str) -> Column:
    old, new = F.col(f"_old.`{name}`"), F.col(f"_new.`{name}`")
    dtype = schema[name].dataType
    if _holds_map(dtype):  # maps and variants have no equality of their own
        text = lambda c: F.to_json(F.struct(canonical(c, dtype).alias("v")), JSON_OPTIONS)
        return text(old).eqNullSafe(text(new))
    return old.eqNullSafe(new)


def _digest(df: DataFrame, keys: Sequence[str]) -> Column:
    """128 bits of a row's other columns; NULLs count, and maps and variants by their entries, not their order."""
    parts: list[Column] = []
    for f in df.schema.fields:
        if f.name not in keys:
            col = F.col(f"`{f.name}`")
            nested = isinstance(f.dataType, (ArrayType, StructType)) or _holds_map(f.dataType)
            parts.append(F.to_json(F.struct(canonical(col, f.dataType).alias("v")), JSON_OPTIONS) if nested else col)
            parts.append(col.isNull())  # a hash passes NULLs over
    return F.struct(F.xxhash64(F.lit(0), *parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str], *, check_unique: bool = True) -> DataFrame:
    """The keys whose rows differ between two snapshots, or that only one has, written to the checkpoint folder.

    One shuffle of keys and digests, combined in the map tasks, finds them; it also finds keys that a snapshot holds
    twice, which raise. NULL keys are left out.
    """
    ensure_checkpoint_dir(old.sparkSession)

    def side(df: DataFrame, name: str) -> DataFrame:
        kept = df.filter(~any_null(keys))
        return kept.select(*[F.col(f"`{k}`") for k in keys], F.lit(name).alias("_side"), _digest(df, keys).alias("_d"))

    both = side(old, "old").unionAll(side(new, "new"))
    of = lambda name, value: F.when(F.col("_side") == name, value)
    grouped = both.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.count(of("old", 1)).alias("_old_n"),
        F.count(of("new", 1)).alias("_new_n"),
        F.max(of("old", F.col("_d"))).alias("_old_d"),
        F.max(of("new", F.col("_d"))).alias("_new_d"),
    )
    differs = ~F.col("_old_d").eqNullSafe(F.col("_new_d")) | (F.col("_old_n") > 1) | (F.col("_new_n") > 1)
    found = grouped.filter(differs).select(*[F.col(f"`{k}`") for k in keys], "_old_n", "_new_n").checkpoint()
    if check_unique:
        for what in ("old", "new"):
            repeated = found.filter(F.col(f"_{what}_n") > 1).agg(F.sum(F.col(f"_{what}_n") - 1)).first()[0]
            if repeated:
                raise ValueError(
                    f"{what} snapshot has {repeated} row(s) beyond the first of their key ({', '.join(keys)}); "
                    "reduce it with latest_wins first"
                )
    return found.select(*[F.col(f"`{k}`") for k in keys])


def _small(keys_frame: DataFrame) -> bool:
    """Whether the keys, counted, are few enough to be sent to every task."""
    limit = keys_frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = keys_frame.agg(F.sum(F.length(F.to_json(F.struct("*"))) + 16)).first()[0] or 0
    return size <= int(limit)


def change_feed(old: DataFrame, new: DataFrame, keys: Sequence[str], *, check_unique: bool = True) -> DataFrame:
    """Turns ``old`` into ``new``: the rows with ``_change_type`` insert, update_preimage, update_postimage or
    delete.

    Each snapshot holds a key at most once; pass ``check_unique=False`` where that is known. Which keys differ is found
    from digests, so the rows themselves are looked at only for those: where they are few, by their counted size, the
    snapshots are filtered in the scan and no unchanged row is shuffled at all. Rows whose digests differ are compared
    once more value by value. A row with a NULL key equals no other, so it is a delete on the old side, an insert on
    the new side, and stays out of the join, where all such rows would meet in one task.
    """
    check_keys(old.columns, keys)
    check_keys(new.columns, keys)
    if set(old.columns) != set(new.columns):
        raise ValueError(f"snapshots differ in columns: {sorted(set(old.columns) ^ set(new.columns))}")
    new = new.select(*[F.col(f"`{c}`") for c in old.columns])
    wanted = changed_keys(old, new, keys, check_unique=check_unique)
    if _small(wanted):
        wanted = F.broadcast(wanted)

    def side(df: DataFrame, name: str) -> DataFrame:
        kept = lookup_join(df.filter(~any_null(keys)), wanted, keys, "left_semi")
        packed = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)
        return kept.select(*[F.col(f"`{k}`") for k in keys], packed)

    joined = side(old, "_old").join(side(new, "_new"), list(keys), "full_outer")
    unchanged = F.lit(True)
    for name in old.columns:
        if name not in keys:
            unchanged = unchanged & _same(old.schema, name)
    entry = lambda kind, row: F.struct(F.lit(kind).alias("_change_type"), F.col(row).alias("_row"))
    changes = (
        F.when(F.col("_old").isNull(), F.array(entry("insert", "_new")))
        .when(F.col("_new").isNull(), F.array(entry("delete", "_old")))
        .when(~unchanged, F.array(entry("update_preimage", "_old"), entry("update_postimage", "_new")))
    )
    feed = joined.select(F.explode(changes).alias("_c")).select("_c._row.*", "_c._change_type")
    for df, kind in ((old, "delete"), (new, "insert")):
        if any(df.schema[k].nullable for k in keys):
            feed = feed.unionByName(df.filter(any_null(keys)).withColumn("_change_type", F.lit(kind)))
    return feed


def apply_feed(old: DataFrame, feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The snapshot after ``feed``: for replaying a feed, and for checking one.

    Rows with a NULL key can only be inserted or, all of them, deleted.
    """
    gone = feed.filter(F.col("_change_type").isin("update_preimage", "delete")).select(*keys)
    came = feed.filter(F.col("_change_type").isin("insert", "update_postimage")).drop("_change_type")
    keyed = old.filter(~any_null(keys)).join(gone, list(keys), "left_anti")
    return keyed.select(*old.columns).unionByName(came)
