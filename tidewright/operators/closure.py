"""Transitive questions over edges ``src → dst``: what reaches what, and who sits on or behind a cycle.

Every round is written to the checkpoint folder, so plans stay short and a lost executor costs one round. Edges with a
NULL end lead nowhere and are left out.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.folders import ensure_checkpoint_dir
from tidewright.operators.keys import lookup_join
from tidewright.operators.lineage import dependencies
from tidewright.operators.pairs import PairTable

#: frames of earlier rounds that are read side by side before they are written together
PIECES = 8
#: edges for which pairs get one bucket more; what a bucket holds is grouped and sorted by one task
EDGES_A_BUCKET = 250_000


def _ends_known(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())


def _edges(edges: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(edges.sparkSession)
    return _ends_known(edges).distinct().checkpoint()


def reachability(edges: DataFrame, seeds: DataFrame | None = None, *, max_rounds: int | None = None) -> DataFrame:
    """Pairs ``(src, dst)`` with a path of one or more edges from src to dst; cycles are fine.

    With ``seeds`` (a frame with ``src``) only paths from those: each round takes one more edge from the pairs the last
    one found, so the work grows with what the seeds reach. Without, all pairs: each round takes the pairs that are as
    far apart as the rounds so far could see, and joins to them all that is known of where they end, which doubles the
    length of the paths covered; a path of 1,000 edges takes 10 rounds. Known pairs lie in a ``PairTable`` and are
    neither shuffled nor written again. The answer itself can be as large as the square of the nodes.

    Raises if ``max_rounds`` is not enough, rather than return part of it.
    """
    spark = edges.sparkSession
    step = PairTable(spark, "src")
    tables = [step]
    try:
        step.add(_ends_known(edges).withColumn("found", F.lit(0)))
        buckets = math.ceil(step.rows().count() / EDGES_A_BUCKET)
        if seeds is not None:
            start = seeds.select("src").filter(F.col("src").isNotNull()).distinct()
            tables.append(found := PairTable(spark, "src", "dst", buckets=buckets))
            return _walk(found, step.rows().join(start, "src", "left_semi"), step.rows(), max_rounds)
        # all pairs of one start share a bucket; where one node starts more edges than any ends, go by their ends
        turned = step.most("src") > step.most("dst")
        tables.append(pairs := PairTable(spark, "src", buckets=buckets))
        pairs.add(step.turned() if turned else step.rows())
        found = _doubled(pairs, max_rounds)
        return found.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if turned else found
    finally:
        for table in tables:
            table.release()


def _within(rounds: int, max_rounds: int | None, left: DataFrame) -> None:
    if max_rounds is not None and rounds >= max_rounds and not left.isEmpty():
        raise RuntimeError(f"closure not complete after {max_rounds} rounds")


def _chain(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs that lead from the start of one pair to the end of another that begins where the first ends."""
    onward = second.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
    return first.join(onward, "dst").select("src", F.col("_next").alias("dst"))


def _walk(found: PairTable, pairs: DataFrame, step: DataFrame, max_rounds: int | None) -> DataFrame:
    """What ``pairs`` lead to, edge by edge; ``found`` takes them under the number of their round."""
    found.add(pairs)
    rounds = 0
    while found.has(rounds):
        frontier = found.first().filter(F.col("found") == rounds)
        _within(rounds, max_rounds, frontier)
        found.add(_chain(frontier, step).withColumn("found", F.lit(rounds + 1)))
        rounds += 1
    return found.first().select("src", "dst")


def _doubled(pairs: PairTable, max_rounds: int | None) -> DataFrame:
    """All that the edges in ``pairs`` lead to.

    After ``r`` rounds every pair with a path of at most 2^r edges is known. Those first found at the end of exactly
    2^r edges have the number 2r, others that the round has found 2r + 1. A shortest path of more than 2^r and at most
    2^(r+1) edges begins with one of the former, and what is left of it is known.
    """
    rounds = 0
    while pairs.has(2 * rounds):
        known = pairs.first()
        far = F.col("found") == 2 * rounds
        ends = known.filter(far).select("src", "dst")
        _within(rounds, max_rounds, ends)
        onward = known.select(
            F.col("src").alias("dst"),
            F.col("dst").alias("_next"),
            F.when(far, 2 * rounds + 2).otherwise(2 * rounds + 3).alias("found"),
        )
        pairs.add(ends.join(onward, "dst").select("src", F.col("_next").alias("dst"), "found"))
        rounds += 1
    return pairs.first().select("src", "dst")


def _ends(edges: DataFrame, end: str, name: str) -> DataFrame:
    return edges.select(F.col(end).alias(name)).distinct()


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges on a cycle or on a way from one cycle to another.

    Rounds take away the nodes that nothing leads to and those that lead nowhere, from both ends at once, until none is
    left to take. A round costs no more than the edges that are left, and keeps no pairs.
    """
    left = _edges(edges)
    n = left.count()
    while n:
        for _ in range(2):  # two layers from each end; more would make the plan grow faster than it saves
            reached = lookup_join(left, _ends(left, "dst", "src"), ["src"], "left_semi")
            left = lookup_join(reached, _ends(left, "src", "dst"), ["dst"], "left_semi").select("src", "dst")
        left = left.checkpoint()
        before, n = n, left.count()
        if n == before:
            break
    return left


def on_cycle(edges: DataFrame) -> DataFrame:
    """``node``: the nodes that reach themselves.

    They are those of the strongly connected components of more than one node, and those with an edge to themselves. In
    the core, every node takes the greatest name that reaches it; the nodes from which the owner of that name can be
    reached within its colour are its component. What remains goes through the same again.
    """
    core = cyclic_core(edges)
    found = [core.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))]
    left = core.filter(F.col("src") != F.col("dst"))
    while not (left := cyclic_core(left)).isEmpty():
        colours = _colours(left)
        of_src = colours.select(F.col("node").alias("src"), F.col("colour").alias("_a"))
        of_dst = colours.select(F.col("node").alias("dst"), F.col("colour").alias("_b"))
        both = lookup_join(lookup_join(left, of_src, ["src"], "inner"), of_dst, ["dst"], "inner")
        inside = both.filter(F.col("_a") == F.col("_b")).select("src", "dst").checkpoint()
        owners = colours.filter(F.col("node") == F.col("colour")).select("node")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        members = _reached(owners, back)
        # a component is more than its owner where an edge of its colour joins two members
        joined = lookup_join(inside, members.withColumnRenamed("node", "src"), ["src"], "left_semi")
        joined = lookup_join(joined, members.withColumnRenamed("node", "dst"), ["dst"], "left_semi")
        found.append(joined.select(F.col("src").alias("node")).unionAll(joined.select(F.col("dst").alias("node"))))
        left = lookup_join(left, members.withColumnRenamed("node", "src"), ["src"], "left_anti")
        left = lookup_join(left, members.withColumnRenamed("node", "dst"), ["dst"], "left_anti").select("src", "dst")
    return functools.reduce(DataFrame.unionAll, found).distinct()


def _colours(edges: DataFrame) -> DataFrame:
    """``node, colour``: the greatest node that reaches a node or is it."""
    nodes = _ends(edges, "src", "node").unionAll(_ends(edges, "dst", "node")).distinct()
    colours = nodes.withColumn("colour", F.col("node")).checkpoint()
    while True:
        passed = lookup_join(edges, colours.withColumnRenamed("node", "src"), ["src"], "inner")
        offered = passed.groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_offered"))
        better = F.col("_offered") > F.col("colour")
        new = lookup_join(colours, offered, ["node"], "left").select(
            "node", F.when(better, F.col("_offered")).otherwise(F.col("colour")).alias("colour"), better.alias("_moved")
        )
        new = new.checkpoint()
        still = new.filter("_moved").isEmpty()
        colours = new.select("node", "colour")
        if still:
            return colours


def _reached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``: the given nodes and all that edges lead to from them."""
    found = [nodes.select("node").distinct().checkpoint()]
    frontier = found[0]
    while not frontier.isEmpty():
        known = functools.reduce(DataFrame.unionAll, found)
        onward = lookup_join(edges, frontier.withColumnRenamed("node", "src"), ["src"], "left_semi")
        frontier = lookup_join(_ends(onward, "dst", "node"), known, ["node"], "left_anti").select("node").checkpoint()
        found = [*found, frontier] if len(found) < PIECES else [known.unionAll(frontier).checkpoint()]
    return functools.reduce(DataFrame.unionAll, found)


def unplaceable(edges: DataFrame) -> DataFrame:
    """``node``: nodes on a cycle or behind one, which no order of execution can place.

    ``src → dst`` reads "dst comes after src", so everything that the cyclic core leads to waits for it. Every node of
    the core is on a cycle or behind one already.
    """
    core = cyclic_core(edges)
    return _reached(_ends(core, "src", "node").unionAll(_ends(core, "dst", "node")), _edges(edges))


def stuck_steps(edges: DataFrame) -> DataFrame:
    """Steps of a lineage graph that wait, directly or through others, on a cycle of dependencies."""
    waits = dependencies(edges).select(F.col("depends_on").alias("src"), F.col("step").alias("dst"))
    return unplaceable(waits).withColumnRenamed("node", "step")
