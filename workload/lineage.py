"""Queries on lineage: declared against observed edges, and the graph they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import lineage
from tidewright.operators.closure import on_cycle, reachability, unplaceable
from tidewright.operators.graph import graph_findings
from workload.inputs import (
    LINEAGE_CTE,
    ROLES_CTE,
    TRAIL_CTE,
    WHOLE_LINEAGE_CTE,
    access_log,
    declared_edges,
    job_steps,
    order_trail,
    role_edges,
)
from workload.registry import Tables, case

DIFF_CTE = f"""{LINEAGE_CTE},
d AS (SELECT DISTINCT step, direction, ref FROM declared),
o AS (SELECT DISTINCT step, direction, ref FROM log),
diff AS (
  SELECT *, 'undeclared' AS side FROM (SELECT * FROM o EXCEPT SELECT * FROM d)
  WHERE step IN (SELECT step FROM steps)
  UNION ALL
  SELECT *, 'unseen' FROM (SELECT * FROM d EXCEPT SELECT * FROM o)
  WHERE step IN (SELECT step FROM steps) AND step IN (SELECT step FROM o))"""

FINDINGS_CTE = f"""{DIFF_CTE},
findings AS (
  SELECT CASE WHEN side = 'undeclared' THEN 'error' WHEN direction = 'write' THEN 'warn' ELSE 'info' END AS severity,
         step,
         CASE WHEN side = 'undeclared' AND direction = 'write'
                THEN 'undeclared write to ' || ref || ' (per lineage) — an undeclared write is what breaks a retry'
              WHEN side = 'undeclared' THEN 'undeclared read of ' || ref || ' (per lineage) — wave order may be wrong'
              WHEN direction = 'write' THEN 'declares write to ' || ref || ' but lineage shows none'
              ELSE 'declares read of ' || ref || ' but lineage shows none' END AS message
  FROM diff)"""


@case("jn5_edge_diff", f"WITH {DIFF_CTE} SELECT step, direction, ref, side FROM diff")
def _(t: Tables) -> DataFrame:
    return lineage.edge_diff(declared_edges(t, some_silent=True), access_log(t), job_steps(t))


@case(
    "st2_edges_on_one_side",
    f"WITH {DIFF_CTE} SELECT side, direction, count(*) AS edges FROM diff GROUP BY 1, 2",
)
def _(t: Tables) -> DataFrame:
    diff = lineage.edge_diff(declared_edges(t, some_silent=True), access_log(t), job_steps(t))
    return diff.groupBy("side", "direction").agg(F.count(F.lit(1)).alias("edges"))


@case("ln1_reconcile", f"WITH {FINDINGS_CTE} SELECT * FROM findings")
def reconcile(t: Tables) -> DataFrame:
    return lineage.reconcile(declared_edges(t, some_silent=True), access_log(t), job_steps(t))


@case("sr1_findings_in_severity_order", f"WITH {FINDINGS_CTE} SELECT * FROM findings")
def _(t: Tables) -> DataFrame:
    return lineage.in_severity_order(lineage.reconcile(declared_edges(t, some_silent=True), access_log(t), job_steps(t)))


@case(
    "ln1_reconcile_qualified",
    f"""WITH {FINDINGS_CTE}
    SELECT severity, step, replace(replace(message, ' app.', ' prod.app.'), ' crm.', ' prod.crm.') AS message FROM findings""",
)
def _(t: Tables) -> DataFrame:
    """The log spells the catalog out, the declarations leave it to the default."""
    observed = access_log(t).withColumn("ref", F.concat(F.lit("prod."), F.col("ref")))
    declared = lineage.qualified(declared_edges(t, some_silent=True), "prod")
    return lineage.reconcile(declared, lineage.qualified(observed, "prod"), job_steps(t))


@case(
    "ln2_mode_drift",
    f"""WITH {LINEAGE_CTE},
    seen AS (SELECT step, bool_or(mode = 'append') AS app, bool_or(mode = 'overwrite') AS ovw FROM log
             WHERE mode IS NOT NULL GROUP BY 1)
    SELECT 'error' AS severity, step,
           'write mode [' || concat_ws(', ', CASE WHEN app THEN '''append''' END, CASE WHEN ovw THEN '''overwrite''' END)
           || '] does not match strategy ''' || strategy || ''' confirmed on ' || confirmed_at
           || ' — idempotency confirmation is stale, re-confirm before the loop may retry this step' AS message
    FROM steps JOIN seen USING (step)
    WHERE confirmed_at IS NOT NULL
      AND ((strategy IN ('overwrite_table', 'overwrite_partition') AND NOT ovw) OR (strategy = 'append_dedup' AND NOT app))""",
)
def _(t: Tables) -> DataFrame:
    return lineage.mode_drift(job_steps(t).select("step", "strategy", "confirmed_at"), access_log(t).select("step", "mode"))


@case(
    "st3_modes_agree",
    f"""WITH {LINEAGE_CTE},
    seen AS (SELECT step, bool_or(mode = 'append') AS app, bool_or(mode = 'overwrite') AS ovw FROM log
             WHERE mode IS NOT NULL GROUP BY 1)
    SELECT step, CASE WHEN strategy IN ('overwrite_table', 'overwrite_partition') THEN ovw
                      WHEN strategy = 'append_dedup' THEN app ELSE app OR ovw END AS agrees
    FROM steps JOIN seen USING (step) WHERE strategy <> 'none'""",
)
def _(t: Tables) -> DataFrame:
    return lineage.modes_agree(job_steps(t), access_log(t).select("step", "mode"))


@case(
    "ln3_unverified_steps",
    f"""WITH {LINEAGE_CTE} SELECT 'warn' AS severity, step, 'shipped but no UC lineage supplied; drift unverified' AS message
        FROM steps WHERE status = 'shipped' AND step NOT IN (SELECT step FROM log)""",
)
def _(t: Tables) -> DataFrame:
    return lineage.unverified_steps(job_steps(t), access_log(t))


@case(
    "ln4_promoted_provenance",
    f"""WITH {WHOLE_LINEAGE_CTE}, o AS (SELECT DISTINCT step, direction, ref FROM log)
    SELECT d.step, d.direction, d.ref, d.kind, CASE WHEN o.ref IS NOT NULL THEN 'observed' ELSE d.via END AS via
    FROM declared d LEFT JOIN o USING (step, direction, ref)""",
)
def _(t: Tables) -> DataFrame:
    return lineage.promote_provenance(declared_edges(t), access_log(t))


@case(
    "ln5_inferred_reads",
    f"""WITH {WHOLE_LINEAGE_CTE} SELECT 'warn' AS severity, step,
        'read ' || ref || ' is inferred from code — wave order may be wrong' AS message
        FROM declared WHERE direction = 'read' AND via = 'inferred'""",
)
def _(t: Tables) -> DataFrame:
    return lineage.inferred_reads(declared_edges(t))


PRIMARY_CTE = f"""{WHOLE_LINEAGE_CTE},
writers AS (SELECT DISTINCT step, ref FROM declared WHERE direction = 'write' AND coalesce(kind, 'primary') = 'primary'),
readers AS (SELECT DISTINCT step, ref FROM declared WHERE direction = 'read')"""


@case(
    "jn6_dependencies",
    f"""WITH {PRIMARY_CTE}, owner AS (SELECT ref, max(step) AS producer FROM writers GROUP BY 1)
    SELECT DISTINCT r.step, o.producer AS depends_on FROM readers r JOIN owner o USING (ref) WHERE r.step <> o.producer""",
)
def _(t: Tables) -> DataFrame:
    return lineage.dependencies(declared_edges(t))


@case("jn7_external_reads", f"WITH {PRIMARY_CTE} SELECT step, ref FROM readers WHERE ref NOT IN (SELECT ref FROM writers)")
def _(t: Tables) -> DataFrame:
    return lineage.external_reads(declared_edges(t))


@case(
    "jn8_unused_assets",
    f"""WITH {WHOLE_LINEAGE_CTE} SELECT DISTINCT ref FROM declared
        WHERE direction = 'write' AND ref NOT IN (SELECT ref FROM declared WHERE direction = 'read')""",
)
def _(t: Tables) -> DataFrame:
    return lineage.unused_assets(declared_edges(t))


@case("ag7_duplicate_producers", f"WITH {PRIMARY_CTE} SELECT ref, count(*) AS producers FROM writers GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return lineage.duplicate_producers(declared_edges(t))


@case("ag8_access_inventory", f"WITH {LINEAGE_CTE} SELECT step, direction, ref, count(*) AS accesses FROM log GROUP BY 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return lineage.access_inventory(access_log(t))


@case(
    "ag8_inventory_totals",
    f"""WITH {LINEAGE_CTE} SELECT count(DISTINCT step) AS steps,
        count(DISTINCT CASE WHEN direction = 'read' THEN ref END) AS distinct_reads,
        count(DISTINCT CASE WHEN direction = 'write' THEN ref END) AS distinct_writes FROM log""",
)
def _(t: Tables) -> DataFrame:
    return lineage.inventory_totals(access_log(t))


@case("ag10_status_counts", f"WITH {LINEAGE_CTE} SELECT status, count(*) AS steps FROM steps GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return lineage.status_counts(job_steps(t))


@case("ln6_reachability", f"WITH RECURSIVE {ROLES_CTE} SELECT src, dst FROM reach")
def role_reachability(t: Tables) -> DataFrame:
    return reachability(role_edges(t))


@case(
    "ln6_reachability_from_seeds",
    f"WITH RECURSIVE {ROLES_CTE} SELECT src, dst FROM reach WHERE src IN (SELECT conv_id || ':' || role FROM conversations WHERE turn = 1)",
)
def _(t: Tables) -> DataFrame:
    """What follows whoever speaks second."""
    node = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("role")).alias("src")
    return reachability(role_edges(t), t.conversations.filter("turn = 1").select(node))


@case("ln6_deep_trail_from_seeds", f"WITH {TRAIL_CTE} SELECT * FROM trail WHERE src IN (SELECT 'order ' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t: Tables) -> DataFrame:
    seeds = t.orders.filter("o_orderpriority = '1-URGENT'")
    return reachability(order_trail(t), seeds.select(F.concat(F.lit("order "), "o_orderkey").alias("src")))


@case("ln6_deep_trail", f"WITH {TRAIL_CTE} SELECT * FROM trail")
def _(t: Tables) -> DataFrame:
    """All pairs of a deep graph whose hubs every trail ends in."""
    return reachability(order_trail(t))


@case(
    "jn7_graph_findings",
    f"""WITH RECURSIVE {ROLES_CTE.strip()}, {LINEAGE_CTE.strip()},
    writers AS (SELECT DISTINCT step, ref FROM declared WHERE direction = 'write' AND coalesce(kind, 'primary') = 'primary'),
    readers AS (SELECT DISTINCT step, ref FROM declared WHERE direction = 'read'),
    owner AS (SELECT ref, max(step) AS producer FROM writers GROUP BY 1),
    waits AS (SELECT DISTINCT o.producer AS src, r.step AS dst FROM readers r JOIN owner o USING (ref) WHERE r.step <> o.producer),
    behind AS (SELECT src, dst FROM waits UNION SELECT b.src, w.dst FROM behind b JOIN waits w ON b.dst = w.src),
    stuck AS (SELECT src AS step FROM behind WHERE src = dst
              UNION SELECT dst FROM behind WHERE src IN (SELECT src FROM behind WHERE src = dst)),
    again AS (SELECT ref, step, lag(step) OVER (PARTITION BY ref ORDER BY step) AS earlier FROM writers)
    SELECT 'error' AS severity, step, ref || ' already produced by ' || earlier AS message FROM again WHERE earlier IS NOT NULL
    UNION ALL SELECT 'error', '<flow>', 'cycle among: ' || step FROM stuck
    UNION ALL SELECT 'warn', r.step, 'depends on ' || ref || ' produced by ' || producer
                     || ', which violates single-primary — this step''s wave position is unreliable'
              FROM readers r JOIN owner USING (ref) JOIN steps s ON s.step = producer
              WHERE s.violates_single_primary AND r.step <> producer
    UNION ALL SELECT 'info', step, 'reads external asset ' || ref || ' (not in flow)' FROM readers
              WHERE ref NOT IN (SELECT ref FROM writers)""",
)
def _(t: Tables) -> DataFrame:
    return graph_findings(declared_edges(t, some_silent=True), job_steps(t))


@case("ln7_on_cycle", f"WITH RECURSIVE {ROLES_CTE} SELECT DISTINCT src AS node FROM reach WHERE src = dst")
def _(t: Tables) -> DataFrame:
    return on_cycle(role_edges(t))


@case(
    "ln7_unplaceable",
    f"""WITH RECURSIVE {ROLES_CTE} SELECT src AS node FROM reach WHERE src = dst
        UNION SELECT dst FROM reach WHERE src IN (SELECT src FROM reach WHERE src = dst)""",
)
def _(t: Tables) -> DataFrame:
    return unplaceable(role_edges(t))
