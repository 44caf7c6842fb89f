import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewright.folders import ensure_checkpoint_dir
from tidewright.operators import closure, graph, lineage, quality
from tests.conftest import rows


# --- quality -----------------------------------------------------------------------------------------------
def test_row_count_drop(spark):
    counts = spark.createDataFrame(
        [("ok", 1000, 960), ("edge", 1000, 950), ("drop", 1000, 900), ("grown", 1000, 2000), ("first", 0, 500), ("none", None, 5)],
        "table string, previous bigint, current bigint",
    )
    out = quality.check_row_counts(counts)
    got = out.collect()
    assert [(r["table"], r["severity"], r["code"]) for r in got] == [("drop", "ERROR", "ROW_COUNT_DROP")]
    assert got[0]["message"] == "row count dropped 10.0% (1000 → 900), tolerance 5.0%"
    assert got[0]["details"] == {"previous": "1000", "current": "900", "tolerance": "0.05"}
    assert quality.check_row_counts(counts, 0.2).isEmpty()


def test_against_last_run(spark):
    cur = spark.createDataFrame([("a", 5), ("b", 1)], "table string, n bigint")
    prev = spark.createDataFrame([("a", 6), ("c", 9)], "table string, n bigint")
    assert rows(quality.against_last_run(cur, prev)) == [("a", 6, 5), ("b", 0, 1), ("c", 9, 0)]


def test_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "id int, name string")
    assert quality.check_duplicates(quality.duplicate_rows(df, ["name", "id"]), "t", keys=["id"]).count() == 1
    assert tuple(quality.duplicate_rows(df, ["name"], by_hash=True).first()) == (3, 1)
    assert quality.check_duplicates(quality.duplicate_rows(spark.range(3), ["id"]), "t").isEmpty()
    got = quality.check_nulls(quality.null_counts(df, ["id", "name"]), "t").collect()
    assert [(r["code"], r["message"], r["details"]["column"]) for r in got] == [
        ("NULLS_IN_REQUIRED", "column 'name' has 1 null(s)", "name")
    ]


def test_columns(spark):
    df = spark.sql("select 1 a, 2 x")
    assert quality.check_columns(df, ["a", "x"], "t").isEmpty()
    assert quality.check_columns(df, ["a"], "t").isEmpty()
    assert [(r.severity, r.code, r.message) for r in quality.check_columns(df, ["a", "z", "A"], "t", allow_extra=False).collect()] == [
        ("ERROR", "MISSING_COLUMNS", "missing columns: A, z"),
        ("WARN", "UNEXPECTED_COLUMNS", "unexpected columns: x"),
    ]


def test_gate(spark, name):
    assert quality.raise_if_failed(quality.run_checks(spark, None, [])).startswith("QA PASS: 0 error(s)")
    counts = spark.createDataFrame([("t", 1000, 500)], "table string, previous bigint, current bigint")
    nulls = spark.createDataFrame([("id", 1)], "column string, nulls bigint")
    report = quality.run_checks(spark, quality.check_row_counts(counts), None, [quality.check_nulls(nulls, "t")])
    assert tuple(quality.summarize(report).first())[:4] == (2, 0, 0, False)
    with pytest.raises(quality.GateFailed, match=r"QA FAIL: 2 error.*NULLS_IN_REQUIRED 1, first in t.*ROW_COUNT_DROP 1"):
        quality.raise_if_failed(report)
    many = spark.range(150).select(
        F.lit("t").alias("table"), F.lit("ERROR").alias("severity"), F.lit("C").alias("code"),
        F.format_string("%03d", "id").alias("message"), F.create_map().cast("map<string,string>").alias("details"),
    )
    with pytest.raises(quality.GateFailed, match="150 error.*C 150, first in t") as failed:
        quality.raise_if_failed(many)
    assert failed.value.findings.count() == 150
    spark.range(0).write.saveAsTable(name)
    assert rows(quality.check_written(spark, [name, name + "_no"]).select("table", "code")) == [
        (name, "TABLE_EMPTY"), (name + "_no", "TABLE_MISSING"),
    ]


# --- lineage -----------------------------------------------------------------------------------------------
SCHEMA = "step string, direction string, ref string, kind string, via string, status string"


def _declared(spark):
    return spark.createDataFrame(
        [
            ("ingest", "write", "bronze.events", "primary", "observed", "shipped"),
            ("ingest", "write", "bronze._log", "metrics", "declared", "shipped"),
            ("conform", "read", "bronze.events", None, "inferred", "tested"),
            ("conform", "read", "shared.ref", None, "declared", "tested"),
            ("conform", "write", "silver.players", None, "declared", "tested"),
            ("legacy", "read", "bronze.events", None, "declared", "shipped"),
            ("legacy", "write", "silver.players", "primary", "declared", "shipped"),
        ],
        SCHEMA,
    )


def _observed(spark):
    return spark.createDataFrame(
        [
            ("ingest", "write", "bronze.events"),
            ("ingest", "write", "bronze.events"),
            ("ingest", "write", "bronze.secret"),
            ("conform", "read", "bronze.events"),
            ("conform", "read", "bronze.other"),
            ("conform", "write", "silver.players"),
            ("stranger", "write", "x.y"),
            ("silent", "write", "x.z"),
        ],
        "step string, direction string, ref string",
    )


def _steps(spark):
    """The graph's steps: one that declares nothing, and one that nobody saw; a stranger is none of them."""
    return spark.createDataFrame([("ingest",), ("conform",), ("legacy",), ("silent",), ("silent",)], "step string")


def test_reconcile_severities(spark):
    out = lineage.reconcile(_declared(spark), _observed(spark), _steps(spark))
    got = [(r.severity, r.step, r.message.split(" — ")[0]) for r in lineage.in_severity_order(out).collect()]
    assert got == [
        ("error", "conform", "undeclared read of bronze.other (per lineage)"),
        ("error", "ingest", "undeclared write to bronze.secret (per lineage)"),
        ("error", "silent", "undeclared write to x.z (per lineage)"),
        ("warn", "ingest", "declares write to bronze._log but lineage shows none"),
        ("info", "conform", "declares read of shared.ref but lineage shows none"),
    ]
    code = lineage.reconcile(_declared(spark), _observed(spark), _steps(spark), source="code")
    assert code.filter("severity = 'warn' and message like 'undeclared read%'").count() == 1


def test_reconcile_qualified(spark):
    full = _observed(spark).withColumn("ref", F.concat(F.lit("cat."), "ref"))
    declared = lineage.qualified(_declared(spark), "cat")
    out = lineage.reconcile(declared, lineage.qualified(full, "cat"), _steps(spark))
    assert out.count() == 5


def test_graph_questions(spark):
    edges = _declared(spark)
    assert rows(lineage.dependencies(edges)) == [("conform", "ingest"), ("legacy", "ingest")]
    two = spark.createDataFrame(
        [("b", "write", "r", 1), ("a", "write", "r", 2), ("c", "read", "r", 3)],
        "step string, direction string, ref string, position int",
    )
    assert rows(lineage.dependencies(two)) == [("c", "a")]
    assert rows(lineage.dependencies(two.drop("position"))) == [("c", "b")]
    assert rows(lineage.external_reads(edges)) == [("conform", "shared.ref")]
    assert rows(lineage.unused_assets(edges)) == [("bronze._log",), ("silver.players",)]
    assert rows(lineage.duplicate_producers(edges)) == [("silver.players", 2)]
    steps = edges.select("step", "status").distinct()
    assert rows(lineage.status_counts(steps)) == [
        ("implemented", 0), ("planned", 0), ("shipped", 2), ("tested", 1),
    ]
    assert rows(lineage.unverified_steps(steps, _observed(spark)).select("severity", "step")) == [("warn", "legacy")]
    assert lineage.inferred_reads(edges).first()["step"] == "conform"
    via = {(r.step, r.ref): r.via for r in lineage.promote_provenance(edges, _observed(spark)).collect()}
    assert via[("conform", "bronze.events")] == "observed" and via[("conform", "shared.ref")] == "declared"
    assert rows(lineage.access_inventory(_observed(spark)))[1] == ("conform", "read", "bronze.other", 1)
    assert tuple(lineage.inventory_totals(_observed(spark)).first()) == (4, 2, 5)


def test_mode_drift(spark):
    strategies = spark.createDataFrame(
        [
            ("a", "overwrite_table", "2026-01-01"), ("b", "append_dedup", "2026-01-01"), ("c", "merge_on_key", "2026-01-01"),
            ("d", "overwrite_table", None), ("e", "none", "2026-01-01"), ("f", "overwrite_partition", "2026-01-01"),
        ],
        "step string, strategy string, confirmed_at string",
    )
    modes = spark.createDataFrame(
        [("a", "append"), ("a", "ignore"), ("b", "append"), ("b", "overwrite"), ("c", "ignore"), ("d", "append"), ("e", "append"),
         ("a", "typo 1"), ("a", "typo 2")],
        "step string, mode string",
    )
    got = lineage.in_severity_order(lineage.mode_drift(strategies, modes)).collect()
    assert [r.step for r in got] == ["a", "c"]
    assert got[0].message.startswith("write mode ['append', 'ignore', 'other'] does not match strategy 'overwrite_table' confirmed on 2026-01-01")


def _closure(edges):
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            return reach
        reach |= more


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_reachability_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(16)]
    expected = _closure(edges)
    frame = spark.createDataFrame(edges + [(None, 1)], "src int, dst int")
    assert rows(closure.reachability(frame)) == sorted(expected, key=repr)
    seeds = spark.createDataFrame([(3,), (9,), (9,), (None,), (99,)], "src int")
    assert rows(closure.reachability(frame, seeds)) == sorted(((a, b) for a, b in expected if a in (3, 9)), key=repr)
    members = {a for a, b in expected if a == b}
    assert {r.node for r in closure.on_cycle(frame).collect()} == members
    assert {r.node for r in closure.unplaceable(frame).collect()} == members | {b for a, b in expected if a in members}


def test_cycles_joined_by_a_path(spark):
    """Nodes between two cycles are in the core, but on no cycle; two cycles that share a colour are told apart."""
    edges = [(1, 2), (2, 1), (2, 5), (5, 6), (6, 9), (9, 8), (8, 9), (9, 20), (20, 21), (0, 1), (30, 30), (30, 1), (4, 3), (3, 4), (4, 1)]
    frame = spark.createDataFrame(edges, "src int, dst int")
    assert rows(closure.on_cycle(frame)) == sorted([(n,) for n in (1, 2, 3, 4, 8, 9, 30)], key=repr)
    behind = (5, 6, 20, 21)
    assert rows(closure.unplaceable(frame)) == sorted([(n,) for n in (1, 2, 3, 4, 8, 9, 30, *behind)], key=repr)


def test_long_chain_has_no_cycle_and_takes_few_rounds(spark):
    chain = spark.range(40).selectExpr("id as src", "id + 1 as dst").coalesce(1)
    closure.on_cycle(chain.limit(2)).collect()  # compiled once
    started = time.time()
    assert closure.unplaceable(chain).count() == 0
    assert time.time() - started < 10
    assert closure.reachability(chain, max_rounds=7).count() == 41 * 40 / 2


def test_reachability_limit_raises(spark):
    chain = spark.range(6).selectExpr("id as src", "id + 1 as dst")
    assert closure.reachability(chain).count() == 21
    with pytest.raises(RuntimeError, match="not complete"):
        closure.reachability(chain, max_rounds=2)
    with pytest.raises(RuntimeError, match="not complete"):
        closure.reachability(chain, chain.select("src").limit(1), max_rounds=2)


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


@pytest.mark.parametrize("seeded", [False, True])
def test_reachability_writes_a_pair_once(spark, seeded):
    """Chains that end in one hub: what is on disk after all rounds is the edges and each pair, not a copy per round."""
    n, chains = 12, 2000
    edges = spark.range(n * chains).selectExpr("id as src", f"if(id % {n} = {n - 1}, -1, id + 1) as dst")
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = _bytes(folder)
    reached = closure.reachability(edges, edges.select("src") if seeded else None)
    assert _bytes(folder) - before < 16 * n * (n + 1) / 2 * chains
    assert "Exchange" not in reached._jdf.queryExecution().executedPlan().toString()
    assert reached.count() == reached.distinct().count() == n * (n + 1) / 2 * chains
    assert reached.filter("dst = -1").count() == n * chains
    assert spark.sql("show tables like 'pairs_*'").isEmpty()


def test_reachability_of_a_root_hub(spark, monkeypatch):
    """One node that starts most edges, and more buckets than the session has partitions."""
    monkeypatch.setattr(closure, "EDGES_A_BUCKET", 4)
    edges = [(0, i) for i in range(1, 41)] + [(i, i + 100) for i in range(1, 41)] + [(101, 200), (200, 0), (0, 101)]
    frame = spark.createDataFrame(edges, "src int, dst int")
    expected = sorted(_closure(edges), key=repr)
    assert rows(closure.reachability(frame)) == expected
    assert rows(closure.reachability(frame, frame.select("src"))) == expected


def test_graph_findings(spark):
    edges = spark.createDataFrame(
        [
            ("a", "write", "t.a", 1), ("a", "read", "t.b", 1), ("b", "write", "t.b", 2), ("b", "read", "t.a", 2),
            ("c", "read", "t.b", 3), ("c", "write", "t.c", 3), ("d", "read", "x.ext", 4), ("d", "write", "t.c", 4),
            ("e", "write", "t.c", 5), ("e", "write", None, 5), ("b", "read", "t.b", 2),
        ],
        "step string, direction string, ref string, position int",
    )
    steps = spark.createDataFrame([("b", True), ("a", False), ("d", None)], "step string, violates_single_primary boolean")
    unsure = "depends on t.b produced by b, which violates single-primary — this step's wave position is unreliable"
    found = graph.graph_findings(edges, steps)
    assert found.columns == ["severity", "step", "message"]
    assert rows(found) == sorted(
        [
            ("error", "e", "primary write with no ref"),
            ("error", "d", "t.c already produced by c"),
            ("error", "e", "t.c already produced by d"),
            ("error", "<flow>", "cycle among: a"),
            ("error", "<flow>", "cycle among: b"),
            ("error", "<flow>", "cycle among: c"),
            ("warn", "a", unsure),
            ("warn", "c", unsure),
            ("info", "d", "reads external asset x.ext (not in flow)"),
        ],
        key=repr,
    )
    assert graph.graph_findings(edges).filter("severity = 'warn'").isEmpty()


def test_stuck_steps(spark):
    edges = spark.createDataFrame(
        [
            ("a", "write", "t.a"), ("a", "read", "t.b"), ("b", "write", "t.b"), ("b", "read", "t.a"),
            ("c", "read", "t.b"), ("c", "write", "t.c"), ("d", "read", "x.ext"), ("d", "write", "t.d"),
        ],
        "step string, direction string, ref string",
    )
    assert rows(closure.stuck_steps(edges)) == [("a",), ("b",), ("c",)]
    assert closure.stuck_steps(edges.filter("step <> 'b'")).isEmpty()


def test_counts_per(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, v int")
    out = quality.counts_per(df, F.col("g"), F.concat(F.lit("t/"), F.col("_g")))
    assert rows(out) == [("t/a", 2), ("t/b", 1)]
