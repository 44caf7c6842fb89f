"""Void (all-NULL, untyped) columns: find them, give them a type, or drop them before a write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NullType, StructField, StructType


def void_columns(schema: StructType) -> list[str]:
    """Names of the top-level columns whose type is void."""
    return [f.name for f in schema.fields if isinstance(f.dataType, NullType)]


def _replace_void(dtype: DataType, typed: DataType) -> DataType:
    if isinstance(dtype, NullType):
        return typed
    if isinstance(dtype, ArrayType):
        return ArrayType(_replace_void(dtype.elementType, typed), dtype.containsNull)
    if isinstance(dtype, MapType):
        return MapType(
            _replace_void(dtype.keyType, typed), _replace_void(dtype.valueType, typed), dtype.valueContainsNull
        )
    if isinstance(dtype, StructType):
        return StructType(
            [StructField(f.name, _replace_void(f.dataType, typed), f.nullable) for f in dtype.fields]
        )
    return dtype


def defend_voids(df: DataFrame, cast_to: str | None = "string") -> DataFrame:
    """Casts void columns to ``cast_to``, or drops the top-level ones when it is None.

    A void column written once can never hold a value later. With a cast, voids inside structs, arrays and
    maps are typed too. A frame without any comes back as it is.
    """
    if cast_to is None:
        names = void_columns(df.schema)
        return df.drop(*names) if names else df
    typed = df.sparkSession.range(0).select(F.lit(None).cast(cast_to)).schema[0].dataType
    wanted = {f.name: _replace_void(f.dataType, typed) for f in df.schema.fields}
    if all(wanted[f.name] == f.dataType for f in df.schema.fields):
        return df
    return df.select(
        *[
            df[f"`{f.name}`"] if wanted[f.name] == f.dataType else df[f"`{f.name}`"].cast(wanted[f.name]).alias(f.name)
            for f in df.schema.fields
        ]
    )
