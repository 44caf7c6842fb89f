"""Queries over landed files: bronze streams, rescue, schema inference, the flow to silver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.plans import ingest
from tidewright.sources.landing import infer_landing_schema, read_landing
from tidewright.streaming.bronze import bronze_stream, refresh_with, skip_or_run
from workload.inputs import LANDED_DDL, LANDED_SELECT, event_lines, incoming_orders, land_lines, stored_orders
from workload.registry import ORACLES, Tables, case



def _schema() -> StructType:
    return StructType.fromDDL(LANDED_DDL)


def _shown(bronze: DataFrame) -> DataFrame:
    """The bronze columns but for the ingest time; the keys, NULL in broken lines, as text."""
    keys = [F.col(c).cast("string").alias(c) for c in ("event_id", "user_id")]
    return bronze.select(*keys, "updated_at", "event_type", "value", "_rescued")


@case("io1_bronze_stream_events", LANDED_SELECT)
def bronze_stream_events(t: Tables) -> DataFrame:
    root, name = t.scratch("landing"), t.fresh_name("bronze")
    land_lines(t, root)
    ingest.refresh_bronze(t.spark, root, _schema(), name, t.scratch("check"), path=t.scratch("bronze"))
    return _shown(t.spark.table(name))


@case(
    "io2_inferred_schema_events",
    """SELECT c.column_name, c.data_type, count(*) AS lines FROM events, (VALUES
         ('event_id', 'bigint'), ('event_type', 'string'), ('fee', 'double'), ('plan', 'string'),
         ('scale', 'double'), ('serial', 'double'), ('updated_at', 'string'),
         ('user_id', 'bigint'), ('value', 'string')) c(column_name, data_type)
       GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    """``value`` holds numbers and the odd text, so the type that fits all of it is string."""
    root, kept = t.scratch("landing"), t.scratch("schema")
    land_lines(t, root)
    infer_landing_schema(t.spark, root, kept)
    again = infer_landing_schema(t.spark, root, kept)
    found = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type")) for f in again]
    lines = read_landing(t.spark, root, again).agg(F.count(F.lit(1)).alias("lines"))
    return lines.select("lines", F.inline(F.array(*found)))


@case("io3_rescued_events", LANDED_SELECT)
def rescued_events(t: Tables) -> DataFrame:
    root = t.scratch("landing")
    land_lines(t, root)
    return _shown(read_landing(t.spark, root, _schema()))


@case(
    "io4_provenance_events",
    "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n_rows, true AS all_stamped FROM events GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    root = t.scratch("landing")
    land_lines(t, root)
    rows = read_landing(t.spark, root, _schema())
    dt = F.regexp_extract("_source_file", r"/dt=([0-9-]+)/", 1)
    stamped = F.every(F.col("_ingested_at").isNotNull() & F.col("_source_file").isNotNull())
    return rows.groupBy(dt.alias("dt")).agg(F.count(F.lit(1)).alias("n_rows"), stamped.alias("all_stamped"))


@case(
    "ss1_rerun_adds_only_new_files",
    """SELECT 'first' AS run, count(*) AS n_rows FROM events WHERE ts < TIMESTAMP '2024-01-16'
       UNION ALL SELECT 'rerun', count(*) FROM events WHERE ts < TIMESTAMP '2024-01-16'
       UNION ALL SELECT 'more', count(*) FROM events""",
)
def _(t: Tables) -> DataFrame:
    root, name = t.scratch("landing"), t.fresh_name("bronze")
    check, path = t.scratch("check"), t.scratch("bronze")
    lines = event_lines(t)
    outcome = []
    for run, part in (("first", "dt < '2024-01-16'"), ("rerun", None), ("more", "dt >= '2024-01-16'")):
        if part:
            lines.filter(part).hint("rebalance", "dt").write.mode("append").partitionBy("dt").text(root)
        ingest.refresh_bronze(t.spark, root, _schema(), name, check, path=path)
        outcome.append((run, t.spark.table(name).count()))
    return t.spark.createDataFrame(outcome, "run string, n_rows bigint")


@case(
    "ss2_triggered_refresh_by_batch",
    "SELECT event_type, count(*) AS n_rows FROM events WHERE NOT (event_type = 'click' AND value > 200) GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    """A triggered run in bounded micro-batches, each appended by a handler."""
    root, path = t.scratch("landing"), t.scratch("typed")
    land_lines(t, root)
    stream = bronze_stream(t.spark, root, _schema(), options={"maxFilesPerTrigger": "10"})
    refresh_with(
        stream.filter("event_id IS NOT NULL"),
        # a batch handed over again replaces its own directory
        lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}"),
        t.scratch("check"),
    )
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))


@case(
    "ss3_skip_when_nothing_new",
    """SELECT 'all' AS batch, NULL AS reason, count(*) AS landed FROM orders
       UNION ALL SELECT 'none', 'no new orders', count(*) FROM orders WHERE o_totalprice < 0""",
)
def _(t: Tables) -> DataFrame:
    outcome = []
    for label, batch in (("all", t.orders), ("none", t.orders.filter("o_totalprice < 0"))):
        path = t.scratch("landed")
        reason = skip_or_run(batch, lambda rows: rows.write.parquet(path), reason="no new orders")
        outcome.append((label, reason, t.spark.read.parquet(path).count() if reason is None else 0))
    return t.spark.createDataFrame(outcome, "batch string, reason string, landed bigint")


@case(
    "flow_landing_to_silver_events",
    """WITH ok AS (SELECT * FROM events WHERE NOT (event_type = 'click' AND value > 200)),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM ok)
       SELECT event_id, user_id, event_type, ts AS updated_at,
              CASE WHEN event_type = 'error' AND value > 100 THEN NULL ELSE value END AS value
       FROM ranked WHERE rn = 1""",
)
def landing_to_silver(t: Tables) -> DataFrame:
    root, name = t.scratch("landing"), t.fresh_name("bronze")
    land_lines(t, root)
    ingest.refresh_bronze(t.spark, root, _schema(), name, t.scratch("check"), path=t.scratch("bronze"))
    bronze = t.spark.table(name).withColumn("_ingested_at", F.col("event_id"))  # a fixed order among ties
    out = ingest.silver(bronze, ["user_id"])
    return out.select(
        "event_id", "user_id", "event_type", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "value"
    )


@case("flow_silver_in_steps_events", ORACLES["flow_landing_to_silver_events"])
def silver_in_steps(t: Tables) -> DataFrame:
    """Files land in two lots, the later days first; silver is folded forward after each."""
    root, bronze, silver_table = t.scratch("landing"), t.fresh_name("bronze"), t.fresh_name("silver")
    check, path, folded, location = (t.scratch(x) for x in ("check", "bronze", "folded", "silver"))
    lines = event_lines(t)
    for part in ("dt >= '2024-01-16'", "dt < '2024-01-16'"):
        lines.filter(part).hint("rebalance", "dt").write.mode("append").partitionBy("dt").text(root)
        ingest.refresh_bronze(t.spark, root, _schema(), bronze, check, path=path)
        ingest.refresh_silver(t.spark, bronze, silver_table, ["user_id"], folded, location=location)
    return t.spark.table(silver_table).select(
        "event_id", "user_id", "event_type", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "value"
    )


@case(
    "flow_incremental_landing_orders",
    """SELECT o_orderstatus, count(*) AS n_rows, count(*) FILTER (WHERE o_orderstatus = 'P') AS priced_again FROM (
         SELECT o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'
         UNION ALL
         SELECT o_orderstatus FROM orders
         WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01')
           AND (o_orderdate >= TIMESTAMP '2000-01-01' OR o_orderstatus = 'P'))
       GROUP BY 1""",
)
def incremental_landing(t: Tables) -> DataFrame:
    """Two fetches land only what bronze does not hold yet in that form; a third finds nothing and skips."""
    root, name = t.scratch("landing"), t.fresh_name("bronze")
    check, path = t.scratch("check"), t.scratch("bronze")
    schema = StructType.fromDDL(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string, content_hash string"
    )
    skipped = []
    for run, batch in enumerate((stored_orders(t), incoming_orders(t), incoming_orders(t))):
        reason = ingest.land_changes(
            t.spark, batch, name, "o_orderkey", root=root, entity="orders", dt="2024-01-01", run_id=str(run)
        )
        skipped.append(reason)
        if reason is None:
            ingest.refresh_bronze(t.spark, f"{root}/orders", schema, name, check, path=path)
    if skipped != [None, None, "no new orders records"]:
        raise RuntimeError(f"unexpected runs: {skipped}")
    return t.spark.table(name).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("o_orderstatus") == "P").alias("priced_again")
    )
