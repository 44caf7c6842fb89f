"""Raw text to typed columns, with the misfits named instead of lost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.fixed import REASONS_COLUMN
from tidewright.functions.scalars import parse_timestamp


def _typed(col: Column, dtype: str) -> Column:
    return parse_timestamp(col) if dtype == "timestamp" else col.try_cast(dtype)


def type_columns(df: DataFrame, types: Mapping[str, str], *, reasons: str | None = None) -> DataFrame:
    """Casts each column in ``types`` (name → SQL type); a value that does not fit becomes NULL.

    With ``reasons``, that column lists ``<column>: not a <type>`` for every value lost to the cast, added to
    whatever it listed before.
    """
    unknown = [c for c in types if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    out = []
    for name in df.columns:
        if name == reasons:
            continue
        col = df[f"`{name}`"]
        out.append(_typed(col, types[name]).alias(name) if name in types else col)
    if reasons:
        misfits = F.array_compact(
            F.array(
                *[
                    F.when(
                        df[f"`{n}`"].isNotNull() & _typed(df[f"`{n}`"], t).isNull(), F.lit(f"{n}: not a {t}")
                    )
                    for n, t in types.items()
                ]
            )
        )
        if reasons in df.columns:
            misfits = F.concat(F.coalesce(df[f"`{reasons}`"], F.array().cast("array<string>")), misfits)
        out.append(misfits.alias(reasons))
    return df.select(*out)


def drop_helpers(df: DataFrame, names: Sequence[str] = ("_rn", "_rescued", REASONS_COLUMN)) -> DataFrame:
    """Drops helper columns that have no place in a silver table; absent ones are ignored."""
    return df.drop(*names)
