"""Exact search and whitening of vectors against plain versions, with awkward rows and hot groups."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows as rows_of
from tidewright.llm import topk, whiten
from tidewright.llm.vectors import pack, unpack

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, row string, cell string, n int"


def sample(n=300, dims=12, seed=5):
    """Clustered vectors, a third of them one vector; repeated rows, NULLs, NaN, infinity and a NULL id."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    vectors = centres[rng.integers(0, 6, n)] * rng.uniform(0.2, 2, (n, 1)) + 0.1 * rng.normal(size=(n, dims))
    vectors[: n // 3] = vectors[0]
    table = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    bad = [None, [None] * dims, [float("nan")] + [0.0] * (dims - 1), [float("inf")] * dims]
    table += [(1000 + 10 * i, v) for i, v in enumerate(bad)] + [(None, table[5][1]), table[20], table[7], (2000, [1.0, 2.0])]
    return table


def frame(spark, table):
    return spark.createDataFrame([(*row, 1, "a", "b", "c", 2) for row in table], SCHEMA).repartition(7)


def good(table):
    return [(i, v) for i, v in table if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def expected_topk(table, k, scale=1024):
    rows = [(i, [int(np.floor(x * scale)) for x in np.float64(v)]) for i, v in good(table)]
    out = []
    for place, (name, q) in enumerate(rows):
        if name is not None and name % 10 == 0:
            found = [
                (-sum(a * b for a, b in zip(q, v)), other is None, other or 0, other)
                for at, (other, v) in enumerate(rows)
                if at != place
            ]
            found.sort(key=lambda t: t[:3])
            out += [(name, rank, other, -score) for rank, (score, _, _, other) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, cut, pivots", [(1 << 14, 1 << 12, 32), (40, 9, 5)])
def test_topk_is_exact(spark, monkeypatch, block, cut, pivots):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SLICE", cut)
    monkeypatch.setattr(topk, "PIVOTS", pivots)
    table = sample()
    got = topk.search(frame(spark, table), F.col("vec_id") % 10 == 0, k=7)
    assert rows_of(got) == expected_topk(table, 7)


def test_topk_leaves_far_blocks_out():
    """In well-separated clusters the bound stops the search early, and loses nothing."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    vectors = np.floor(1024 * (centres[np.arange(2000) % 8] + 0.01 * rng.normal(size=(2000, 16))))
    longest = float((vectors**2).sum(axis=1).max())
    pivots = topk.choose_pivots(vectors, 16)
    far, near = (topk.distances(vectors, pivots, longest, lift) for lift in (True, False))
    query = vectors[3]
    bound = (query @ query + longest - longest * np.abs(near[3] - far).max(axis=1) ** 2) / 2
    scores = vectors @ query
    assert (bound * (1 + 1e-9) + 1 >= scores).all()
    tenth = np.sort(scores)[-11]
    assert (bound >= tenth).sum() < len(vectors) / 2


def test_topk_few_wide_and_empty(spark):
    table = [(0, [3e30, 1.0]), (1, [-2e30, 5.0]), (10, [1.0, 1.0])]
    got = rows_of(topk.search(frame(spark, table), F.col("vec_id") % 10 == 0))
    whole = [(i, [int(np.floor(1024 * x)) for x in np.float64(np.float32(v))]) for i, v in table]
    dot = {(i, j): max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(u, v)))) for i, u in whole for j, v in whole}
    assert got == [(0, 1, 10, dot[0, 10]), (0, 2, 1, dot[0, 1]), (10, 1, 0, dot[10, 0]), (10, 2, 1, dot[10, 1])]
    assert rows_of(topk.search(frame(spark, []), F.col("vec_id") % 10 == 0)) == []
    assert rows_of(topk.search(frame(spark, [(0, [1.0])]), F.col("vec_id") % 10 == 0)) == []


def test_packed_vectors_come_back():
    for row in ([1.0, -3.0], [40000.0, -1.0], [2.0**40, 3.0], []):
        assert unpack([pack(np.array(row))], 3).tolist() == [row + [0.0] * (3 - len(row))]


def test_shared_bits_are_products():
    rng = np.random.default_rng(2)
    for high in (2, 300, 2**40):
        whole = rng.integers(-high, high, (131, 5))
        sums, products = whiten.shared_bits(whole)
        exact = whole.astype(object)
        assert sums == list(exact.sum(axis=0))
        assert all(products[i][j] == (exact[:, i] * exact[:, j]).sum() for i in range(5) for j in range(i, 5))


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whiten, "BLOCK", 50)
    table = sample()
    got = whiten.whiten(frame(spark, table), components=5).collect()
    rows = [(i, np.floor(64 * np.float64(v + [0.0] * (12 - len(v)))).astype(int) + 1_000_000) for i, v in good(table)]
    fitted = np.unique([x for _, x in rows], axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    covariance = np.array(
        [[float(Fraction(int(n * (a * b).sum() - a.sum() * b.sum()), n * n)) for b in fitted.T] for a in fitted.T]
    )
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:5]
    want = sorted(((i, int(((n * x - sums) ** 2).sum())) for i, x in rows), key=repr)
    assert sorted(((r.vec_id, r.deviation) for r in got if r.component == 1), key=repr) == want
    assert {r.n for r in got} == {n} and len(got) == 5 * len(rows)
    assert {r.identity_error for r in got}.pop() < 1e-9
    for c in range(5):
        mine = {r.vec_id: r.whitened for r in got if r.component == c + 1}
        theirs = {i: (x - sums / n) @ vectors[:, order[c]] / np.sqrt(values[order[c]]) for i, x in rows}
        sign = np.sign(sum(mine[i] * theirs[i] for i in mine))
        assert max(abs(mine[i] - sign * theirs[i]) for i in mine) < 1e-6
        shares = {r.explained for r in got if r.component == c + 1}
        assert abs(shares.pop() - values[order[c]] / np.trace(covariance)) < 1e-12 and not shares


def test_whitening_without_variance(spark):
    assert rows_of(whiten.whiten(frame(spark, []))) == []
    assert rows_of(whiten.whiten(frame(spark, [(1, None), (2, [None])]))) == []
    same = whiten.whiten(frame(spark, [(1, [0.5, 2.0]), (1, [0.5, 2.0])])).collect()
    assert [tuple(r)[1:] for r in sorted(same)] == [(c, 1, 0, 0.0, 0.0, 0.0, "0") for c in (1, 1, 2, 2)]
    wide = whiten.whiten(frame(spark, [(1, [1e15, 0.0]), (2, [0.0, 0.0])])).collect()
    assert {r.deviation for r in wide} == {None} and len({r.deviation_exact for r in wide}) == 1
