"""Content hashes as native expressions: one SHA-256 per row, no Python in the tasks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tidewright.functions.fixed import HASH_COLUMN

# Without these, to_json drops NULL fields and cuts timestamps to milliseconds, so two rows that differ only
# there would share a hash; the fixed zone keeps the hash independent of the session's.
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _holds_map(dtype: DataType) -> bool:
    if isinstance(dtype, MapType):
        return True
    if isinstance(dtype, ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, VariantType)


def _needs_order(dtype: DataType) -> bool:
    if isinstance(dtype, ArrayType):
        return _needs_order(dtype.elementType)
    return isinstance(dtype, (MapType, StructType))


def canonical(col: Column, dtype: DataType) -> Column:
    """``col`` with struct fields and map entries in name order, all the way down."""
    if isinstance(dtype, StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        ordered = F.struct(*[canonical(col.getField(f.name), f.dataType).alias(f.name) for f in fields])
        return F.when(col.isNotNull(), ordered)
    if isinstance(dtype, ArrayType) and _needs_order(dtype):
        return F.transform(col, lambda item: canonical(item, dtype.elementType))
    if isinstance(dtype, MapType):
        if _holds_map(dtype.valueType):  # such values have no order of their own; sort the keys alone
            return F.transform(
                F.array_sort(F.map_keys(col)),
                lambda key: F.struct(
                    key.alias("key"), canonical(F.element_at(col, key), dtype.valueType).alias("value")
                ),
            )
        return F.transform(
            F.array_sort(F.map_entries(col)),
            lambda entry: F.struct(
                entry.getField("key").alias("key"),
                canonical(entry.getField("value"), dtype.valueType).alias("value"),
            ),
        )
    return col


def canonical_json(df: DataFrame, columns: Iterable[str] | None = None, exclude: Iterable[str] = ()) -> Column:
    """One JSON text per row: fields by name, NULLs written out, ``exclude`` left out."""
    skipped = set(exclude)
    names = sorted(c for c in (df.columns if columns is None else columns) if c not in skipped)
    if not names:
        raise ValueError("no columns to hash")
    fields = [canonical(df[f"`{n}`"], df.schema[n].dataType).alias(n) for n in names]
    return F.to_json(F.struct(*fields), JSON_OPTIONS)


def row_hash(df: DataFrame, columns: Iterable[str] | None = None, exclude: Iterable[str] = (HASH_COLUMN,)) -> Column:
    """SHA-256 hex of the row's canonical JSON; the same whatever the column order."""
    return F.sha2(canonical_json(df, columns, exclude), 256)


def value_hash(df: DataFrame, column: str) -> Column:
    """SHA-256 hex of one column: of its text when scalar (NULL reads ``None``), of its JSON when nested."""
    dtype = df.schema[column].dataType
    col = df[f"`{column}`"]
    if isinstance(dtype, (StructType, ArrayType, MapType)):
        return F.sha2(F.to_json(canonical(col, dtype), JSON_OPTIONS), 256)
    return F.sha2(F.coalesce(col.cast("string"), F.lit("None")), 256)


def cheap_row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of the row, for breaking ties; columns that hold maps or variants go in as JSON."""
    parts = [
        F.to_json(F.struct(canonical(df[f"`{f.name}`"], f.dataType).alias("v")), JSON_OPTIONS)
        if _holds_map(f.dataType)
        else df[f"`{f.name}`"]
        for f in df.schema.fields
    ]
    return F.xxhash64(*parts)


def stamp_hash(df: DataFrame, hash_column: str = HASH_COLUMN) -> DataFrame:
    """Adds (or refreshes) the content hash, computed over every other column."""
    return df.withColumn(hash_column, row_hash(df, exclude=(hash_column,)))
