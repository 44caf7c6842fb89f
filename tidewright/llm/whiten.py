"""Whitening of embeddings from exact statistics, by bit-sliced scatter.

Entries become whole numbers ``floor(scale * c)``; adding one constant to all of them would leave every deviation,
covariance and distinct vector as it is, so none is added. The cross-products of all dimensions over the distinct
vectors are counted from bits: in a block of rows each dimension is shifted by its least value, and each bit of what is
left, over all rows, is packed into 64-bit words. The product sum of two dimensions is the sum, over pairs of bit
planes, of the set bits they share, weighted by the planes' powers of two; the shifts are put back afterwards.
Everything is a whole number until the covariance, n times the products less the products of the sums, is divided by n
squared. Its eigenvectors are found on the driver, from dims squared numbers.

Rows whose vector is NULL or holds a NULL, NaN, infinity or number of 2**56 and more take no part. Shorter vectors go on
with zeros. Repeated rows are each returned, but count once in the statistics. Components without variance (e is 0, as
when n is 1) have ``whitened`` 0 and ``explained`` 0 and are left out of ``identity_error``. A ``deviation`` beyond the
range of long is NULL; ``deviation_exact`` has it as text. An empty table gives no rows. Columns but the two named are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import keep
from tidewright.llm.vectors import map_rows, pack, unpack, usable

#: rows whose bit planes are packed together
BLOCK = 1 << 13
#: numbers of this size and more are not fitted
MOST = 2.0**56


@dataclass
class Whitening:
    """A fitted transform: ``n`` distinct vectors, their exact ``sums``, variances (falling) and component rows."""

    n: int
    sums: list[int]
    variances: np.ndarray
    trace: float
    components: np.ndarray
    identity_error: float | None = None

    def project(self, whole: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened rows and exact sums of squared deviations, from rows of whole numbers."""
        sums = np.array(self.sums, object)
        # within a long as long as rows times range are; else Python's whole numbers
        reach = int(np.abs(whole).max(initial=0)) + max((abs(s) // self.n for s in self.sums), default=0) + 1
        small = self.n * reach < 2**62
        kind = np.int64 if small else object
        deviations = self.n * whole.astype(np.int64).astype(kind) - sums.astype(kind)
        most = int(np.abs(deviations).max(initial=0))
        squares = deviations if small and most**2 * max(len(sums), 1) < 2**63 else deviations.astype(object)
        scales = np.array([1 / np.sqrt(v) if v > 0 else 0.0 for v in self.variances])
        whitened = (deviations.astype(np.float64) / self.n) @ (self.components * scales[:, None]).T
        return whitened, [int(s) for s in (squares * squares).sum(axis=1)]


def whole_vectors(df: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """``vec_id`` and the packed vector of whole numbers."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids = batch.column(0).to_pylist()
        for i, c in usable(batch.column(1), MOST):
            yield ids[i], pack(np.floor(scale * c)), len(c)

    entries = F.col(f"`{vector}`").cast("array<double>")
    named = df.select(F.col(f"`{id}`").cast("bigint").alias("vec_id"), entries.alias("e"))
    return map_rows(named, "vec_id bigint, v binary, dims int", rows)


def shared_bits(whole: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums, and sums of products, of the columns of a block of whole numbers, from shared bits of their planes."""
    shifts = whole.min(axis=0)
    left = (whole - shifts).astype(np.uint64)
    rows, dims = left.shape
    bits = [int(m).bit_length() for m in left.max(axis=0)]
    planes, owner, power = [], [], []
    for d in range(dims):
        for b in range(bits[d]):
            packed = np.packbits(((left[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8))
            planes.append(np.pad(packed, (0, -len(packed) % 8)).view(np.uint64))
            owner.append(d)
            power.append(b)
    sums, products = [0] * dims, [[0] * dims for _ in range(dims)]
    planes = np.array(planes, np.uint64).reshape(len(owner), -(-rows // 64))
    for p, plane in enumerate(planes):
        shared = np.bitwise_count(plane & planes[p:]).sum(axis=1, dtype=np.int64).tolist()
        sums[owner[p]] += shared[0] << power[p]
        row = products[owner[p]]
        for q, count in enumerate(shared, p):
            # planes of one dimension meet once here and count for both orders
            twice = owner[p] == owner[q] and q > p
            row[owner[q]] += count << (power[p] + power[q] + twice)
    shifts = [int(s) for s in shifts]
    for i in range(dims):
        for j in range(i, dims):
            products[i][j] += shifts[i] * sums[j] + shifts[j] * sums[i] + rows * shifts[i] * shifts[j]
    return [s + rows * shift for s, shift in zip(sums, shifts)], products


def scatter(distinct: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and sums of products of all packed vectors; each task adds up its own, Spark the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products, waiting = 0, [0] * dims, [[0] * dims for _ in range(dims)], []

        def add(packed: list[bytes]) -> None:
            nonlocal n
            n += len(packed)
            whole = unpack(packed, dims).astype(np.int64)
            block_sums, block_products = shared_bits(whole)
            for i in range(dims):
                sums[i] += block_sums[i]
                for j in range(i, dims):
                    products[i][j] += block_products[i][j]

        for batch in batches:
            waiting += batch.column(0).to_pylist()
            while len(waiting) >= BLOCK:
                add(waiting[:BLOCK])
                del waiting[:BLOCK]
        if waiting:
            add(waiting)
        if n:
            # in two parts of 2**60, since a sum of products can pass the range of long
            out = [(-1, -1, n, 0)] + [(i, -1, *_parts(sums[i])) for i in range(dims)]
            out += [(i, j, *_parts(products[i][j])) for i in range(dims) for j in range(i, dims)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "low", "high"])

    parts = distinct.select("v").mapInArrow(run, "i int, j int, low bigint, high bigint")
    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")]
    n, sums, products = 0, [0] * dims, [[0] * dims for _ in range(dims)]
    for i, j, low, high in parts.groupBy("i", "j").agg(*total).collect():  # dims squared rows at most
        value = int(low) + (int(high) << 60)
        if i < 0:
            n = value
        elif j < 0:
            sums[i] = value
        else:
            products[i][j] = products[j][i] = value
    return n, sums, products


def _parts(value: int) -> tuple[int, int]:
    return value & ((1 << 60) - 1), value >> 60


def fit(distinct: DataFrame, dims: int, components: int) -> Whitening | None:
    """Fits the transform to distinct packed vectors; measures how far their whitened covariance is from identity."""
    n, sums, products = scatter(distinct, dims)
    if not n:
        return None
    # exact until the one division
    exact = [[n * products[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    covariance = np.array([[float(Fraction(c, n * n)) for c in row] for row in exact]).reshape(dims, dims)
    values, vectors = np.linalg.eigh(covariance) if dims else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(Fraction(sum(exact[i][i] for i in range(dims)), n * n))
    # what rounding leaves of a variance of zero
    nothing = dims * np.finfo(np.float64).eps * max(values.max(initial=0), 0)
    variances = np.where(values[order] > nothing, values[order], 0.0)
    model = Whitening(n, sums, variances, trace, vectors[:, order].T)
    model.identity_error = _identity_error(distinct, model, dims)
    return model


def _identity_error(distinct: DataFrame, model: Whitening, dims: int) -> float:
    """The largest entry of the whitened vectors' covariance, less the identity, over the distinct vectors."""
    live = np.flatnonzero(model.variances > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(len(live)), np.zeros((len(live), len(live)))
        for batch in batches:
            whitened = model.project(unpack(batch.column(0).to_pylist(), dims))[0][:, live]
            total += whitened.sum(axis=0)
            square += whitened.T @ whitened
        keys = [(-1, j) for j in range(len(live))] + [(i, j) for i in range(len(live)) for j in range(len(live))]
        columns = [pa.array(c, pa.int32()) for c in zip(*keys)] or [pa.array([], pa.int32())] * 2
        values = pa.array(np.concatenate([total, square.ravel()]), pa.float64())
        yield pa.RecordBatch.from_arrays([*columns, values], ["i", "j", "value"])

    sums = distinct.select("v").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value"))
    mean, square = np.zeros(len(live)), np.zeros((len(live), len(live)))
    for i, j, value in sums.collect():  # components squared rows at most
        if i < 0:
            mean[j] = value / model.n
        else:
            square[i, j] = value / model.n
    # projected rows are centred already; the means are what rounding left
    return float(np.abs(square - np.outer(mean, mean) - np.eye(len(live))).max(initial=0))


def whiten(
    df: DataFrame, components: int = 16, scale: int = 64, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Per row and component ``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact``.

    Components are numbered from 1 by falling variance.
    """
    spark = df.sparkSession
    schema = (
        "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
        "identity_error double, deviation_exact string"
    )
    whole = keep(whole_vectors(df, id, vector, scale), "whole-vectors")
    dims = whole.agg(F.max("dims")).first()[0]
    if dims is None:
        return spark.createDataFrame([], schema)
    # equal vectors meet as bytes; those that end in zeros as if they were longer
    padded = whole.select("v") if whole.filter(F.col("dims") < dims).isEmpty() else _padded(whole, dims)
    distinct = keep(padded.distinct(), "distinct-vectors")
    model = fit(distinct, dims, components)
    explained = [v / model.trace if model.trace > 0 else 0.0 for v in model.variances.tolist()]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids = batch.column("vec_id").to_pylist()
        whitened, deviations = model.project(unpack(batch.column("v").to_pylist(), dims))
        for name, row, deviation in zip(ids, whitened.tolist(), deviations):
            fits = deviation if deviation < 2**63 else None
            for c, value in enumerate(row):
                yield name, c + 1, model.n, fits, value, explained[c], model.identity_error, str(deviation)

    return map_rows(whole.select("vec_id", "v"), schema, rows)


def _padded(whole: DataFrame, dims: int) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        yield from ((pack(v),) for v in unpack(batch.column(0).to_pylist(), dims))

    return map_rows(whole.select("v"), "v binary", rows)
