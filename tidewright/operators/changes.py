"""Hash change detection: what in a batch is new, changed or already stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.fixed import HASH_COLUMN, INGESTED_AT_COLUMN
from tidewright.functions.hashing import stamp_hash
from tidewright.functions.scalars import key_text
from tidewright.operators.dedup import latest_wins
from tidewright.operators.keys import check_keys, likely_broadcast, lookup_join

_KEY, _STORED, _FOUND = "_key", "_stored_hash", "_found"


def latest_stored_hashes(
    stored: DataFrame,
    key: str,
    *,
    order_by: Sequence[str | Column] | None = None,
    hash_column: str = HASH_COLUMN,
) -> DataFrame:
    """``(key, content_hash)`` with one row per key: the hash of the newest stored version."""
    check_keys(stored.columns, [key, hash_column])
    if order_by is None:
        order_by = [INGESTED_AT_COLUMN] if INGESTED_AT_COLUMN in stored.columns else []
    needed = [key, hash_column, *[c for c in order_by if isinstance(c, str)]]
    if all(isinstance(c, str) for c in order_by):  # read the few columns the lookup needs, not the whole table
        stored = stored.select(*dict.fromkeys(needed))
    return latest_wins(stored, [key], [*order_by, hash_column]).select(key, hash_column)


def existing_hashes(
    stored: DataFrame | None,
    batch: DataFrame,
    key: str,
    *,
    order_by: Sequence[str | Column] | None = None,
    hash_column: str = HASH_COLUMN,
) -> DataFrame:
    """Stored hashes ``(key as text, content_hash)`` of the batch's keys only; empty without a stored table.

    The semi join runs before the newest-version step when the batch is small (it then happens inside the
    scan stage), and after it otherwise: by then each key is down to one row, so a key with a long history
    cannot load one task.
    """
    check_keys(batch.columns, [key])
    wanted = batch.select(key_text(batch[f"`{key}`"]).alias(key))
    if stored is None:
        return wanted.filter(F.lit(False)).withColumn(hash_column, F.lit(None).cast("string"))
    texted = stored.withColumn(key, key_text(stored[f"`{key}`"])).filter(F.col(f"`{key}`").isNotNull())
    if likely_broadcast(wanted):
        return latest_stored_hashes(
            texted.join(wanted, key, "left_semi"), key, order_by=order_by, hash_column=hash_column
        )
    latest = latest_stored_hashes(texted, key, order_by=order_by, hash_column=hash_column)
    return latest.join(wanted.distinct(), key, "left_semi")  # one row per key on either side


def classify_changes(
    batch: DataFrame,
    stored: DataFrame | None,
    key: str,
    *,
    order_by: Sequence[str | Column] | None = None,
    hash_column: str = HASH_COLUMN,
    class_column: str = "change_class",
) -> DataFrame:
    """The batch, stamped with its content hash and classed ``new``, ``changed`` or ``unchanged``.

    Keys compare as text. A NULL key is always new, a NULL stored hash always changed, and rows that share a
    key are each classed on their own.
    """
    check_keys(batch.columns, [key])
    stamped = stamp_hash(batch, hash_column)
    if stored is None:
        return stamped.withColumn(class_column, F.lit("new"))
    wanted = batch.select(key_text(batch[f"`{key}`"]).alias(key))
    if likely_broadcast(wanted):
        latest = existing_hashes(stored, batch, key, order_by=order_by, hash_column=hash_column)
    else:  # the left join below drops the other keys as well; a semi join first would only add a shuffle
        texted = stored.withColumn(key, key_text(stored[f"`{key}`"])).filter(F.col(f"`{key}`").isNotNull())
        latest = latest_stored_hashes(texted, key, order_by=order_by, hash_column=hash_column)
    lookup = latest.select(
        F.col(f"`{key}`").alias(_KEY), F.col(hash_column).alias(_STORED), F.lit(True).alias(_FOUND)
    )
    joined = lookup_join(stamped.withColumn(_KEY, key_text(F.col(f"`{key}`"))), lookup, [_KEY], "left")
    change_class = (
        F.when(F.col(_FOUND).isNull(), "new")
        .when(~F.col(_STORED).eqNullSafe(F.col(hash_column)), "changed")
        .otherwise("unchanged")
    )
    return joined.select(*[F.col(f"`{c}`") for c in stamped.columns], change_class.alias(class_column))


def needing_update(
    batch: DataFrame,
    stored: DataFrame | None,
    key: str,
    *,
    order_by: Sequence[str | Column] | None = None,
    hash_column: str = HASH_COLUMN,
) -> DataFrame:
    """The new and the changed rows of the batch, stamped with their hash."""
    classed = classify_changes(batch, stored, key, order_by=order_by, hash_column=hash_column)
    return classed.filter(F.col("change_class") != "unchanged").drop("change_class")


def change_class_counts(classified: DataFrame, class_column: str = "change_class") -> DataFrame:
    """Rows per change class."""
    return classified.groupBy(class_column).agg(F.count(F.lit(1)).alias("n_rows"))
