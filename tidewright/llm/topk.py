"""Exact search for the rows with the highest integer inner products, by pivot-table elimination.

Vectors become ``floor(scale * x)``. One more coordinate lifts every candidate to the length of the longest, so that a
high inner product is a short distance between a query and a lifted candidate. Every row's distances to the pivots are
computed once. By the triangle inequality their differences bound a pair's distance from below, the greatest over all
pivots counts, and so its score from above. Candidates are evaluated in the order of that bound until it falls below
the score of the k-th best found.

Candidates lie in cells, one per nearest pivot, and a cell in blocks of at most about ``BLOCK`` rows, however many
rows are alike. A query first visits a block of its own cell, then the blocks of all cells whose bound reaches the k-th
best score known by then. Queries visit in slices of about ``SLICE``, so a task holds one block and one slice.
The pivots come from a sample of at most ``SAMPLE`` rows; they decide how much is left out, never the result.

Rows whose vector is NULL or holds a NULL, NaN, infinity or number beyond 1e100 take no part. Shorter vectors go on
with zeros. Repeated rows are rows of their own: each is a query and a candidate, and a query leaves out only itself. A
NULL id is no query and comes last among ties (it stands as ``LAST_ID`` until the end). A score beyond the range of long
is the nearest long. Columns but the two named are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import LAST_ID, keep
from tidewright.llm.vectors import map_rows, pack, unpack, usable

#: pivots, rows of the sample they are chosen from, candidates in a block and queries in a slice
PIVOTS, SAMPLE, BLOCK, SLICE = 32, 2048, 1 << 14, 1 << 12
#: queries that are compared with a block at a time, and candidates of the first round
BATCH, ROUND = 128, 64
#: added to bounds, in parts of the squared lengths, for rounding in the distances
SLACK = 1e-5
LONGS = np.iinfo(np.int64)
FOUND = "q_row bigint, query_id bigint, vec_id bigint, score bigint, c_row bigint"


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each is the one farthest from those before."""
    if not len(vectors):
        return vectors
    chosen, far = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(n, len(vectors)):
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() == 0:
            break
        chosen.append(int(far.argmax()))
    return vectors[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray, longest: float, lift: bool) -> np.ndarray:
    """Distances to lifted pivots of candidates, lifted too, or of queries, whose last coordinate is 0.

    They are given in lengths of the longest vector.
    """
    own, theirs = (vectors**2).sum(axis=1), (pivots**2).sum(axis=1)
    squared = own[:, None] + longest - 2 * vectors @ pivots.T
    if lift:
        up, pivots_up = np.sqrt(np.maximum(longest - own, 0)), np.sqrt(np.maximum(longest - theirs, 0))
        squared = 2 * (longest - vectors @ pivots.T - up[:, None] * pivots_up)
    return np.sqrt(np.maximum(squared, 0) / (longest or 1.0))


def scores_of(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, pair by pair of the rows of two equal stacks or all by all."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(queries.shape[1], 1)
    if most < 2**53:  # every partial sum is a whole number that a double holds
        return (queries @ vectors.T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    product = exact(queries).dot(exact(vectors).T)
    return np.clip(product, LONGS.min, LONGS.max).astype(np.int64)


def _search(queries: pd.DataFrame, block: pd.DataFrame, dims: int, k: int, longest: float) -> Iterator[tuple]:
    """The k best candidates of one block for each query of one slice that can be among its k best of all."""
    vectors = unpack(list(block["v"]), dims)
    ids, rows = block["vec_id"].to_numpy(), block["row"].to_numpy()
    table = np.array([np.frombuffer(t, "<f4") for t in block["far"]], np.float32).reshape(len(block), -1)
    for at in range(0, len(queries), BATCH):
        batch = queries.iloc[at : at + BATCH]
        wanted, own = unpack(list(batch["v"]), dims), batch["row"].to_numpy()
        limits = batch["least"].to_numpy().copy()
        near = np.array([np.frombuffer(t, "<f4") for t in batch["far"]], np.float32).reshape(len(batch), -1)
        bound = np.zeros((len(batch), len(block)), np.float32)
        for p in range(table.shape[1]):
            np.maximum(bound, np.abs(near[:, p, None] - table[:, p]), out=bound)
        size = (wanted**2).sum(axis=1)[:, None] + longest
        bound = np.maximum((size - longest * bound.astype(np.float64) ** 2) / 2 + SLACK * size + 1, LONGS.min)
        bound[own[:, None] == rows] = -np.inf  # a query's own row
        order = np.argsort(-bound, axis=1)
        kept: list[list[tuple]] = [[] for _ in own]
        alive, start, width = np.arange(len(own)), 0, ROUND
        while start < len(block) and len(alive):
            some = order[alive, start : start + width]
            reach = np.take_along_axis(bound[alive], some, axis=1)
            alive, some, reach = _still(alive, some, reach, limits)
            if not len(alive):
                break
            if some.shape[1] * 8 > len(block):  # most of the block: all scores at once are cheaper than picking rows
                scores = np.take_along_axis(scores_of(wanted[alive], vectors), some, axis=1)
            else:
                scores = np.stack([scores_of(wanted[[a]], vectors[s])[0] for a, s in zip(alive, some)])
            good = np.isfinite(reach) & (scores >= limits[alive, None])
            for i, a in enumerate(alive):
                new = np.flatnonzero(good[i])
                if len(new):
                    best = new[np.lexsort((ids[some[i][new]], -scores[i][new]))[:k]]
                    more = [(-int(scores[i][j]), int(ids[some[i][j]]), int(some[i][j])) for j in best]
                    kept[a] = sorted(kept[a] + more)[:k]
                    if len(kept[a]) == k:
                        limits[a] = max(limits[a], -kept[a][-1][0])
            start, width = start + width, width * 4
        for row, name, best in zip(own, batch["vec_id"], kept):
            yield from ((row, name, ids[j], -s, rows[j]) for s, _, j in best)


def _still(alive: np.ndarray, some: np.ndarray, reach: np.ndarray, limits: np.ndarray) -> tuple:
    """Queries whose best bound among the next candidates still reaches their k-th best score."""
    on = reach[:, 0] >= limits[alive]
    return alive[on], some[on], reach[on]


def _visit(visits: DataFrame, blocks: DataFrame, dims: int, k: int, longest: float) -> DataFrame:
    """``visits`` (cell, block, slice and a query's columns) against candidates (cell, block, slice), both grouped."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(_search(left, right, dims, k, longest)) if len(left) and len(right) else []
        columns = list(zip(*found)) or [[]] * 5
        names = ("q_row", "query_id", "vec_id", "score", "c_row")
        return pd.DataFrame({n: np.array(c, np.int64) for n, c in zip(names, columns)})

    keys = ("cell", "block", "slice")
    return visits.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "c_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``df`` with ``is_query`` its k best other rows, exactly.

    ``is_query`` is a condition on the id column, named ``vec_id``. Scores are integer inner products; of equal ones the
    smaller id comes first. Fewer than k rows are returned only if there are fewer.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, x in usable(batch.column(2), 1e100):
            whole = np.floor(x * scale)
            name = LAST_ID if ids[i] is None else ids[i]
            yield name, bool(wanted[i]), pack(whole), float((whole**2).sum()), len(whole)

    named = df.select(F.col(f"`{id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("e"))
    named = named.select("vec_id", is_query.alias("wanted"), F.col("e").cast("array<double>"))
    whole = map_rows(named, "vec_id bigint, wanted boolean, v binary, size double, dims int", rows)
    whole = keep(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")
    spark = df.sparkSession
    longest, dims, queries_n = whole.agg(F.max("size"), F.max("dims"), F.count_if("wanted")).first()
    if not queries_n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sample = whole.orderBy(F.xxhash64("v", "row")).limit(SAMPLE).select("v").toArrow()
    pivots = choose_pivots(unpack(sample.column("v").to_pylist(), dims), PIVOTS)
    slices = -(-queries_n // SLICE)

    def measure(batch: pa.RecordBatch) -> Iterator[tuple]:
        v = batch.column("v").to_pylist()
        vectors = unpack(v, dims)
        far, near = distances(vectors, pivots, longest, True), distances(vectors, pivots, longest, False)
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "wanted")), v)):
            to_query = near[i].astype("<f4").tobytes() if row[2] else None
            yield *row, far[i].astype("<f4").tobytes(), to_query, int(far[i].argmin())

    schema = "row bigint, vec_id bigint, wanted boolean, v binary, far binary, near binary, cell int"
    table = keep(map_rows(whole.select("row", "vec_id", "wanted", "v"), schema, measure), "pivot-table")

    # what a cell's rows have in common: how many there are, and between which distances of each pivot they lie
    def spans(batch: pa.RecordBatch) -> Iterator[tuple]:
        cells = np.array(batch.column("cell").to_pylist(), int)
        far = np.array([np.frombuffer(t, "<f4") for t in batch.column("far").to_pylist()]).reshape(len(cells), -1)
        for c in np.unique(cells):
            mine = far[cells == c]
            for p, (a, b) in enumerate(zip(mine.min(axis=0), mine.max(axis=0))):
                yield int(c), p, float(a), float(b), len(mine) if p == 0 else 0

    facts = map_rows(table.select("cell", "far"), "cell int, p int, low float, high float, n bigint", spans)
    facts = facts.groupBy("cell", "p").agg(F.min("low"), F.max("high"), F.sum("n"))
    low, high, n = np.full((len(pivots),) * 2, np.inf), np.full((len(pivots),) * 2, -np.inf), np.zeros(len(pivots), int)
    for cell, p, a, b, count in facts.collect():  # PIVOTS squared rows at most
        low[cell, p], high[cell, p] = a, b
        n[cell] += count
    blocks_n = -(-n // BLOCK)

    per_cell = F.array(*[F.lit(int(b)) for b in blocks_n])
    block = F.pmod(F.xxhash64("row"), F.greatest(F.get(per_cell, F.col("cell")), F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(int(slices) - 1)))
    placed = table.select("cell", block.alias("block"), every.alias("slice"), "row", "vec_id", "v", "far")
    piece = F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(int(slices))).cast("int").alias("slice")
    to_query, home = F.col("near").alias("far"), block.alias("block")
    queries = table.filter("wanted").select("row", "vec_id", "v", to_query, "cell", home, piece)

    unlimited = queries.withColumn("least", F.lit(int(LONGS.min)))
    first = keep(_best(_visit(unlimited, placed, dims, k, longest), k), "first-found")
    known = first.groupBy(F.col("q_row").alias("_q")).agg(F.min("score").alias("_least"), F.count("*").alias("_n"))
    least = F.when(F.col("_n") == k, F.col("_least")).otherwise(LONGS.min).alias("least")
    ready = queries.join(known, F.col("row") == F.col("_q"), "left").select(*queries.columns, least)

    def route(batch: pa.RecordBatch) -> Iterator[tuple]:
        names = ("row", "vec_id", "v", "far", "cell", "block", "slice", "least")
        got = [batch.column(c).to_pylist() for c in names]
        if not got[0]:
            return
        vectors = unpack(got[2], dims)
        near = np.array([np.frombuffer(t, "<f4") for t in got[3]], np.float64)
        size = (vectors**2).sum(axis=1) + longest
        for i, (row, name, v, far, cell, home, part, limit) in enumerate(zip(*got)):
            gap = np.maximum(0, np.maximum(near[i] - high, low - near[i])).max(axis=1)
            reach = np.maximum((size[i] - longest * gap**2) / 2 + SLACK * size[i] + 1, LONGS.min)
            for c in np.flatnonzero((n > 0) & (reach >= limit)):
                for b in range(blocks_n[c]):
                    if (c, b) != (cell, home):
                        yield row, name, v, far, limit, int(c), b, part

    schema = "row bigint, vec_id bigint, v binary, far binary, least bigint, cell int, block int, slice int"
    more = _visit(map_rows(ready, schema, route), placed, dims, k, longest)
    best = _best(first.drop("rank").unionByName(more), k)
    unnamed = lambda c: F.when(F.col(c) != LAST_ID, F.col(c)).alias(c)
    return best.select(unnamed("query_id"), "rank", unnamed("vec_id"), "score")
