"""Embeddings as whole numbers: rows of an array column turned into ``floor(scale * x)``, packed as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: first byte of a packed vector: the numbers that follow are of this type, the narrowest that holds them
CODES = {1: np.dtype("<i2"), 2: np.dtype("<i4"), 3: np.dtype("<f8")}


def pack(vector: np.ndarray) -> bytes:
    """Whole numbers, given as doubles, as bytes; equal vectors give equal bytes."""
    most = np.abs(vector).max(initial=0)
    code = 1 if most < 2**15 else 2 if most < 2**31 else 3
    return bytes([code]) + vector.astype(CODES[code]).tobytes()


def unpack(packed: list[bytes], dims: int) -> np.ndarray:
    """Rows of doubles; vectors shorter than ``dims`` go on with zeros."""
    out = np.zeros((len(packed), dims))
    for i, p in enumerate(packed):
        row = np.frombuffer(p, CODES[p[0]], offset=1)
        out[i, : len(row)] = row
    return out


def usable(column: pa.Array, below: float) -> Iterator[tuple[int, np.ndarray]]:
    """(place, vector as doubles) of rows that are not NULL and hold no NULL, NaN or number of ``below`` or more."""
    column = column.cast(pa.list_(pa.float64()))
    values, offsets = column.values, column.offsets.to_numpy()
    numbers = values.to_numpy(zero_copy_only=False)  # NULL entries become NaN
    bad = np.concatenate([[0], np.cumsum(~(np.abs(numbers) < below))])
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(there & (bad[offsets[1:]] == bad[offsets[:-1]])):
        yield int(i), numbers[offsets[i] : offsets[i + 1]]


def map_rows(df: DataFrame, schema: str, each: Callable[[pa.RecordBatch], Iterator[tuple]]) -> DataFrame:
    """``each`` batch's tuples as rows of ``schema``."""
    fields = StructType.fromDDL(schema)
    kinds = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*each(batch))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return df.mapInArrow(run, fields)
