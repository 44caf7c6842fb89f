"""Findings on the declared graph of steps, before anything is observed."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import fixed
from tidewright.operators.closure import stuck_steps
from tidewright.operators.keys import lookup_join
from tidewright.operators.lineage import as_findings, external_reads, primary_writes, producers


def graph_findings(edges: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Findings ``severity, step, message`` on the declared graph itself.

    Errors: a primary write without a ref, a ref with another producer before this one (by ``position`` if the edges
    carry one, else by name), and, one row each under the step ``<flow>``, the steps that wait on a cycle. Warnings: a
    read of what a step produces that ``steps`` marks with a true ``violates_single_primary``. Information: a read of a
    ref that nobody produces.
    """
    nameless = primary_writes(edges).filter(F.col("ref").isNull()).select("step")
    found = [as_findings(nameless, F.lit("error"), F.lit(fixed.NAMELESS_WRITE_MESSAGE))]

    order = ["position", "step"] if "position" in edges.columns else ["step"]
    writers = primary_writes(edges).filter(F.col("ref").isNotNull()).select("ref", *order).distinct()
    earlier = F.lag("step").over(Window.partitionBy("ref").orderBy(*order))
    again = writers.withColumn("_earlier", earlier).filter(F.col("_earlier").isNotNull())
    twice = F.format_string(fixed.DUPLICATE_PRODUCER_FORMAT, "ref", "_earlier")
    found.append(as_findings(again, F.lit("error"), twice))

    stuck = stuck_steps(edges).select(F.lit(fixed.FLOW_STEP).alias("step"), F.col("step").alias("_member"))
    found.append(as_findings(stuck, F.lit("error"), F.concat(F.lit(fixed.CYCLE_MESSAGE), F.col("_member"))))

    if steps is not None and "violates_single_primary" in steps.columns:
        violators = steps.filter(F.col("violates_single_primary")).select(F.col("step").alias("producer")).distinct()
        owned = lookup_join(producers(edges), violators, ["producer"], "left_semi")
        reads = edges.filter(F.col("direction") == "read").select("step", "ref").distinct()
        unsure = lookup_join(reads, owned, ["ref"], "inner").filter(F.col("step") != F.col("producer"))
        text = F.format_string(fixed.VIOLATING_PRODUCER_FORMAT, "ref", "producer")
        found.append(as_findings(unsure, F.lit("warn"), text))

    outside = external_reads(edges)
    found.append(as_findings(outside, F.lit("info"), F.format_string(fixed.EXTERNAL_READ_FORMAT, "ref")))
    return functools.reduce(DataFrame.unionByName, found)
