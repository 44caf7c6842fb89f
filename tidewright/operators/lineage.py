"""Lineage as tables: what steps declare against what was observed.

Edges are rows ``step, direction ('read' | 'write'), ref`` with optional ``kind``, ``via`` and ``status``.
Observed edges come from an access log that may be very large and very skewed, so every operator first
reduces it to distinct edges, which Spark combines in the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import fixed
from tidewright.functions.scalars import qualify_ref
from tidewright.operators.keys import lookup_join

EDGE = ("step", "direction", "ref")


def qualified(edges: DataFrame, catalog: str | None) -> DataFrame:
    """Edges with the default catalog put before refs that lack one."""
    return edges.withColumn("ref", qualify_ref(F.col("ref"), catalog))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*EDGE).distinct()


def primary_writes(edges: DataFrame) -> DataFrame:
    """Write edges of kind primary (the default kind)."""
    kind = F.coalesce("kind", F.lit("primary")) if "kind" in edges.columns else F.lit("primary")
    return edges.filter((F.col("direction") == "write") & (kind == "primary"))


def as_findings(df: DataFrame, severity: Column, message: Column) -> DataFrame:
    return df.select(severity.alias("severity"), "step", message.alias("message"))


def edge_diff(declared: DataFrame, observed: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges on one side only: ``step, direction, ref, side`` with side ``undeclared`` or ``unseen``.

    Compared are the steps of the graph, ``steps`` with a column ``step``, that were observed: one that declares
    nothing has every access undeclared. A step nobody observed is ``unverified_steps``; one outside the graph is
    nobody's to declare.
    """
    sides = distinct_edges(declared).select(*EDGE, F.lit(1).alias("_d"), F.lit(0).alias("_o")).unionByName(
        distinct_edges(observed).select(*EDGE, F.lit(0).alias("_d"), F.lit(1).alias("_o"))
    )
    # one aggregation over the union does the work of a full outer join; each side is already distinct, so no
    # group holds more than two rows, and the observed steps come out of the same shuffle
    edges = sides.groupBy(*EDGE).agg(F.max("_d").alias("_d"), F.max("_o").alias("_o"))
    known = steps.select("step", F.lit(1).alias("_g"), F.lit(0).alias("_o")).unionByName(
        edges.select("step", F.lit(0).alias("_g"), "_o")
    )
    known = known.groupBy("step").agg(F.max("_g").alias("_g"), F.max("_o").alias("_o"))
    compared = known.filter((F.col("_g") == 1) & (F.col("_o") == 1)).select("step")
    one_sided = lookup_join(edges.filter(F.col("_d") != F.col("_o")), compared, ["step"], "left_semi")
    return one_sided.select(*EDGE, F.when(F.col("_o") == 1, "undeclared").otherwise("unseen").alias("side"))


def reconcile(declared: DataFrame, observed: DataFrame, steps: DataFrame, *, source: str = "lineage") -> DataFrame:
    """Findings ``severity, step, message`` for every edge of the graph's ``steps`` that only one side has.

    An undeclared write is an error, an undeclared read an error too when lineage saw it and else a warning;
    a declared write nobody saw is a warning, such a read is information.
    """
    read = F.col("direction") == "read"
    undeclared = F.col("side") == "undeclared"
    src = F.lit(source)
    severity = (
        F.when(undeclared & ~read, "error")
        .when(undeclared, "error" if source == "lineage" else "warn")
        .when(~read, "warn")
        .otherwise("info")
    )
    message = (
        F.when(undeclared & ~read, F.format_string(fixed.UNDECLARED_WRITE_FORMAT, "ref", src))
        .when(undeclared, F.format_string(fixed.UNDECLARED_READ_FORMAT, "ref", src))
        .when(~read, F.format_string(fixed.UNSEEN_WRITE_FORMAT, "ref", src))
        .otherwise(F.format_string(fixed.UNSEEN_READ_FORMAT, "ref", src))
    )
    return as_findings(edge_diff(declared, observed, steps), severity, message)


def producers(edges: DataFrame) -> DataFrame:
    """``ref, producer``: the step that owns a ref, one per ref.

    Where several steps primarily write a ref (``duplicate_producers`` reports those), the last one owns it:
    last by ``position`` if the edges carry one, else by name.
    """
    writers = primary_writes(edges).filter(F.col("ref").isNotNull())
    last = F.max_by("step", F.struct("position", "step")) if "position" in edges.columns else F.max("step")
    return writers.groupBy("ref").agg(last.alias("producer"))


def dependencies(edges: DataFrame) -> DataFrame:
    """``step, depends_on``: the step reads what the other produces; never itself.

    With one producer per ref the join returns at most one row per read edge, however many steps share a ref.
    """
    reads = edges.filter(F.col("direction") == "read").select("step", "ref").distinct()
    pairs = lookup_join(reads, producers(edges), ["ref"], "inner").filter(F.col("step") != F.col("producer"))
    return pairs.select("step", F.col("producer").alias("depends_on")).distinct()


def external_reads(edges: DataFrame) -> DataFrame:
    """Reads of refs that no step primarily writes."""
    produced = primary_writes(edges).select("ref").distinct()
    reads = edges.filter(F.col("direction") == "read").select("step", "ref").distinct()
    return lookup_join(reads, produced, ["ref"], "left_anti").select("step", "ref")


def unused_assets(edges: DataFrame) -> DataFrame:
    """Refs that are written but never read."""
    read = edges.filter(F.col("direction") == "read").select("ref").distinct()
    written = edges.filter(F.col("direction") == "write").select("ref").distinct()
    return written.join(read, "ref", "left_anti")


def duplicate_producers(edges: DataFrame) -> DataFrame:
    """``ref, producers``: refs with more than one primary writer."""
    writers = primary_writes(edges).select("ref", "step").distinct()
    return writers.groupBy("ref").agg(F.count(F.lit(1)).alias("producers")).filter(F.col("producers") > 1)


def access_inventory(log: DataFrame) -> DataFrame:
    """``step, direction, ref, accesses``: what each step touches, one row per ref.

    Rows rather than one list per step: a step that touches millions of refs stays spread over tasks.
    """
    return log.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("accesses"))


def inventory_totals(log: DataFrame) -> DataFrame:
    """One row: distinct steps, distinct refs read and distinct refs written."""
    touched = F.array(
        F.struct(F.lit("step").alias("what"), F.col("step").alias("name")),
        F.struct(F.col("direction").alias("what"), F.col("ref").alias("name")),
    )
    names = log.select(F.inline(touched)).distinct().filter(F.col("name").isNotNull())
    return names.agg(
        F.count_if(F.col("what") == "step").alias("steps"),
        F.count_if(F.col("what") == "read").alias("distinct_reads"),
        F.count_if(F.col("what") == "write").alias("distinct_writes"),
    )


def status_counts(steps: DataFrame) -> DataFrame:
    """Steps per status, with a row for each known status even when no step has it."""
    known = steps.sparkSession.createDataFrame([(s, 0) for s in fixed.STATUSES], "status string, n int")
    ones = steps.select("status", F.lit(1).alias("n"))
    return ones.unionByName(known).groupBy("status").agg(F.sum("n").cast("bigint").alias("steps"))


def mode_drift(strategies: DataFrame, modes: DataFrame) -> DataFrame:
    """Findings for confirmed steps none of whose observed write modes agrees with their strategy.

    ``strategies``: ``step, strategy, confirmed_at``; ``modes``: ``step, mode``, one row per access. A log may spell
    anything as a mode; what no strategy expects is told apart only as ``other``, so a step's set is a few words.
    """
    seen = step_modes(modes)
    checked = strategies.filter(F.col("confirmed_at").isNotNull()).withColumn("_expected", _expected_modes())
    drifted = checked.filter(F.col("_expected").isNotNull()).join(seen, "step")
    drifted = drifted.filter(~F.arrays_overlap("modes", "_expected"))
    quoted = F.concat_ws(", ", F.transform("modes", lambda m: F.concat(F.lit("'"), m, F.lit("'"))))
    return as_findings(
        drifted,
        F.lit("error"),
        F.format_string(fixed.MODE_DRIFT_FORMAT, quoted, F.col("strategy"), F.col("confirmed_at").cast("string")),
    )


def step_modes(modes: DataFrame) -> DataFrame:
    """``step, modes``: the write modes seen of each step, sorted; all but the known ones as ``other``."""
    known = sorted({m for allowed in fixed.STRATEGY_MODES.values() for m in allowed} | set(fixed.OTHER_WRITE_MODES))
    mode = F.when(F.col("mode").isin(*known), F.col("mode")).otherwise("other")
    seen = modes.filter(F.col("mode").isNotNull()).groupBy("step")
    return seen.agg(F.array_sort(F.collect_set(mode)).alias("modes"))


def modes_agree(strategies: DataFrame, modes: DataFrame) -> DataFrame:
    """``step, agrees``: whether any observed mode is one that the step's strategy expects; steps with both only."""
    expected = _expected_modes()
    checked = strategies.withColumn("_expected", expected).filter(F.col("_expected").isNotNull())
    agrees = F.arrays_overlap("modes", "_expected").alias("agrees")
    return checked.join(step_modes(modes), "step").select("step", agrees)


def _expected_modes() -> Column:
    expected = F.lit(None).cast("array<string>")
    for strategy, allowed in fixed.STRATEGY_MODES.items():
        expected = F.when(F.col("strategy") == strategy, F.array(*[F.lit(m) for m in allowed])).otherwise(expected)
    return expected


def unverified_steps(steps: DataFrame, observed: DataFrame) -> DataFrame:
    """Warnings for shipped steps that lineage has never seen; ``steps`` has ``step, status``."""
    shipped = steps.filter(F.col("status") == "shipped")
    missing = shipped.join(observed.select("step").distinct(), "step", "left_anti")
    return as_findings(missing, F.lit("warn"), F.lit(fixed.UNVERIFIED_MESSAGE))


def promote_provenance(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Declared edges with ``via`` turned to ``observed`` where lineage has the edge; nothing else turns it."""
    seen = distinct_edges(observed).withColumn("_seen", F.lit(True))
    joined = lookup_join(declared, seen, list(EDGE), "left")
    via = F.when(F.col("_seen"), "observed").otherwise(F.col("via"))
    return joined.select(*[via.alias("via") if c == "via" else F.col(c) for c in declared.columns])


def inferred_reads(edges: DataFrame) -> DataFrame:
    """Warnings for reads that were only inferred."""
    weak = edges.filter((F.col("direction") == "read") & (F.col("via") == "inferred"))
    return as_findings(weak, F.lit("warn"), F.format_string(fixed.INFERRED_READ_FORMAT, "ref"))


def in_severity_order(findings: DataFrame) -> DataFrame:
    """Errors first, then warnings, then information; by step and message within each."""
    rank = F.lit(len(fixed.LINEAGE_SEVERITIES))
    for i, severity in enumerate(fixed.LINEAGE_SEVERITIES):
        rank = F.when(F.col("severity") == severity, i).otherwise(rank)
    return findings.orderBy(rank, "step", "message")
