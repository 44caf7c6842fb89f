"""Queries that write: each writes tables of its own to the shared scratch folder and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.functions.hashing import stamp_hash
from tidewright.operators import quality
from tidewright.operators.changes import change_class_counts, classify_changes
from tidewright.sources import publish, side_tables, tables
from tidewright.sources.landing import read_landing, write_landing
from workload.changes import CLASSED_CTE, UPSERT_CTE
from workload.inputs import GAPS_CTE, events_with_gaps, incoming_orders, stored_orders
from workload.registry import Tables, case
from workload.rows import EXPECTATIONS


@case(
    "io5_landing_roundtrip_orders",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders",
)
def _(t: Tables) -> DataFrame:
    root = t.scratch("landing")
    batch = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    path = write_landing(batch, root, "orders", dt="2024-01-01", run_id="1")
    schema = StructType.fromDDL(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"
    )
    return read_landing(t.spark, path, schema).filter("_rescued IS NULL").select(*schema.names)


@case(
    "io6_writer_merge_schema_customer",
    """SELECT c_custkey, c_name, NULL AS c_mktsegment FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal >= 0""",
)
def _(t: Tables) -> DataFrame:
    name = t.fresh_name("customers")
    first = t.customer.filter("c_acctbal < 0").select("c_custkey", "c_name")
    more = t.customer.filter("c_acctbal >= 0").select("c_mktsegment", "c_custkey", "c_name")
    tables.write_table(first, name, mode="append", path=t.scratch("customers"))
    tables.write_table(more, name, mode="append", merge_schema=True)
    return t.spark.table(name)


@case(
    "io6_writer_overwrite_schema_customer",
    "SELECT c_custkey, c_mktsegment FROM customer",
)
def _(t: Tables) -> DataFrame:
    name = t.fresh_name("customers")
    tables.write_table(t.customer.select("c_custkey", "c_name"), name, mode="overwrite", path=t.scratch("customers"))
    tables.write_table(t.customer.select("c_custkey", "c_mktsegment"), name, mode="overwrite", overwrite_schema=True)
    return t.spark.table(name)


@case(
    "io8_first_run_then_second",
    f"""WITH {CLASSED_CTE} SELECT 'first' AS run, 'new' AS change_class, count(*) AS n_rows FROM stored
        UNION ALL SELECT 'second', change_class, count(*) FROM classed GROUP BY 2""",
)
def _(t: Tables) -> DataFrame:
    name = t.fresh_name("orders")
    first = classify_changes(stored_orders(t), tables.read_or_none(t.spark, name), "o_orderkey")
    tables.write_table(first.drop("change_class"), name, mode="append", path=t.scratch("orders"))
    second = classify_changes(incoming_orders(t), tables.read_or_none(t.spark, name), "o_orderkey")
    runs = [change_class_counts(df).withColumn("run", F.lit(run)) for df, run in ((first, "first"), (second, "second"))]
    return runs[0].unionByName(runs[1])


@case(
    "io9_quarantine_events",
    f"""WITH {GAPS_CTE} SELECT event_id, concat_ws(',',
          CASE WHEN user_id IS NULL THEN 'valid_user' END, CASE WHEN value IS NULL THEN 'has_value' END,
          CASE WHEN value IS NULL OR value >= 300 THEN 'sane_value' END) AS reasons
        FROM gaps""",
)
def _(t: Tables) -> DataFrame:
    name = t.fresh_name("events")
    side_tables.write_with_quarantine(events_with_gaps(t), name, EXPECTATIONS, path=t.scratch("events"))
    good = t.spark.table(name).select("event_id", F.lit("").alias("reasons"))
    bad = t.spark.table(side_tables.quarantine_name(name))
    return good.unionAll(bad.select("event_id", F.concat_ws(",", "_reasons").alias("reasons")))


@case(
    "io9_quarantine_beside_merge_events",
    f"""WITH {GAPS_CTE}, checked AS (
          SELECT *, user_id IS NULL OR value IS NULL OR value >= 300 AS bad, event_id % 3 = 0 AS late FROM gaps)
        SELECT 'kept' AS lane, event_id, CASE WHEN late THEN value + 1 ELSE value END AS value, 0 AS reasons
        FROM checked WHERE NOT bad
        UNION ALL SELECT 'rejected', event_id, value,
          (user_id IS NULL)::INT + (value IS NULL)::INT + (value IS NULL OR value >= 300)::INT FROM checked WHERE bad
        UNION ALL SELECT 'metrics', NULL, count(*)::DOUBLE, count(*) FILTER (WHERE bad) FROM checked WHERE late""",
)
def _(t: Tables) -> DataFrame:
    """Rejected rows beside a merge on key: all events in one run; a third of them, changed, in another, run twice."""
    name, path = t.fresh_name("events"), t.scratch("events")
    rejected, metrics = t.scratch("rejected"), t.scratch("metrics")
    events = events_with_gaps(t)
    late = events.filter("event_id % 3 = 0")
    changed = late.withColumn("value", F.when(F.col("value") < 300, F.col("value") + 1).otherwise(F.col("value")))
    sane = EXPECTATIONS | {"sane_value": "value < 301"}
    runs = (("1", events, EXPECTATIONS), ("2", changed, sane), ("2", changed, sane))
    for run_id, batch, expect in runs:
        side_tables.write_guarded(
            batch,
            name,
            expect,
            "merge_on_key",
            run_id=run_id,
            merge_key=["event_id"],
            path=path,
            quarantine_path=rejected,
            metrics_table=f"{name}_metrics",
            metrics_path=metrics,
        )
    bad = t.spark.table(side_tables.quarantine_name(name)).filter("_run = '1'")
    shown = t.spark.table(name).select(F.lit("kept").alias("lane"), "event_id", "value", F.lit(0).alias("reasons"))
    shown = shown.unionAll(bad.select(F.lit("rejected"), "event_id", "value", F.size("_reasons")))
    kept = t.spark.table(f"{name}_metrics").filter("run_id = '2'")
    n = lambda metric: F.max(F.when(F.col("metric") == metric, F.col("value")))
    total = kept.agg(n("rows_in").cast("double").alias("n"), n("rows_quarantined").cast("int").alias("bad"))
    return shown.unionAll(total.select(F.lit("metrics"), F.lit(None).cast("bigint"), "n", "bad"))


@case(
    "io10_metrics_events",
    f"""WITH {GAPS_CTE}, flags AS (
          SELECT user_id IS NULL AS u, value IS NULL AS v, (value IS NULL OR value >= 300) AS s FROM gaps)
        SELECT metric, CASE metric WHEN 'rows_in' THEN count(*) WHEN 'rows_quarantined' THEN count(*) FILTER (WHERE u OR v OR s)
               WHEN 'valid_user' THEN count(*) FILTER (WHERE u) WHEN 'has_value' THEN count(*) FILTER (WHERE v)
               ELSE count(*) FILTER (WHERE s) END AS value
        FROM flags, (VALUES ('rows_in'), ('rows_quarantined'), ('valid_user'), ('has_value'), ('sane_value')) m(metric)
        GROUP BY metric""",
)
def _(t: Tables) -> DataFrame:
    name, seen = t.fresh_name("events"), Observation()
    source = events_with_gaps(t)
    side_tables.write_with_quarantine(source, name, EXPECTATIONS, path=t.scratch("events"), metrics=seen)
    side_tables.append_metrics(
        seen, source, run_id="1", table=name, metrics_table=f"{name}_metrics", path=t.scratch("metrics")
    )
    return t.spark.table(f"{name}_metrics").select("metric", "value")


@case("io11_overwrite_table_orders", f"WITH {UPSERT_CTE} SELECT * FROM incoming")
def _(t: Tables) -> DataFrame:
    name, path = t.fresh_name("orders"), t.scratch("orders")
    for batch in (stored_orders(t), incoming_orders(t), incoming_orders(t)):  # the last one is a retry
        tables.write_with_strategy(batch, name, "overwrite_table", path=path)
    return t.spark.table(name)


@case(
    "io12_overwrite_partition_events",
    """SELECT event_id, user_id, CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-20' THEN value * 2 ELSE value END AS value,
              strftime(ts, '%Y-%m-%d') AS dt FROM events""",
)
def _(t: Tables) -> DataFrame:
    name = t.fresh_name("events")
    base = t.events.select("event_id", "user_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("dt"))
    tables.write_with_strategy(base, name, "overwrite_partition", partition_key="dt", path=t.scratch("events"))
    corrected = base.filter("dt >= '2024-01-20'").withColumn("value", F.col("value") * 2)
    for _run in range(2):
        tables.write_with_strategy(corrected, name, "overwrite_partition", partition_key="dt")
    return t.spark.table(name)


@case("io13_merge_on_key_orders", f"WITH {UPSERT_CTE} SELECT * FROM after")
def _(t: Tables) -> DataFrame:
    name, path = t.fresh_name("orders"), t.scratch("orders")
    for batch in (stored_orders(t), incoming_orders(t), incoming_orders(t)):
        tables.write_with_strategy(batch, name, "merge_on_key", merge_key=["o_orderkey"], path=path)
    return t.spark.table(name)


@case(
    "jn2_upsert_partitioned_orders",
    f"WITH {UPSERT_CTE} SELECT * FROM after",
)
def _(t: Tables) -> DataFrame:
    """Only the partitions the batch touches are rewritten; the key includes the partition column."""
    name = t.fresh_name("orders")
    tables.write_table(
        stored_orders(t), name, mode="append", partition_by=["o_orderpriority"], path=t.scratch("orders")
    )
    tables.upsert(incoming_orders(t), name, ["o_orderkey", "o_orderpriority"])
    return t.spark.table(name)


@case(
    "io14_append_dedup_documents",
    """SELECT sha256(text) AS text_hash, coalesce(min(doc_id) FILTER (WHERE lang = 'en'), min(doc_id)) AS doc_id
       FROM documents GROUP BY text""",
)
def _(t: Tables) -> DataFrame:
    """English documents first, then all of them twice: each text is kept once, the first copy of its batch."""
    name, path = t.fresh_name("documents"), t.scratch("documents")
    docs = t.documents.select(
        F.sha2("text", 256).alias("text_hash"), "doc_id", (-F.col("doc_id")).alias("_first"), "lang"
    )
    for batch in (docs.filter("lang = 'en'"), docs, docs):
        tables.append_dedup(batch, name, ["text_hash"], order_by=["_first"], path=path)
    return t.spark.table(name).select("text_hash", "doc_id")


@case("io15_promote_on_gate_orders", f"WITH {UPSERT_CTE} SELECT * FROM stored")
def _(t: Tables) -> DataFrame:
    """A good attempt is published; a later one with NULL keys fails its gate and is not."""
    name, path = t.fresh_name("orders"), t.scratch("orders")

    def attempt(df: DataFrame) -> None:
        version = publish.write_version(df, name, location=path)
        written = t.spark.table(version)
        report = quality.run_checks(
            t.spark,
            quality.check_nulls(quality.null_counts(written, ["o_orderkey"]), name),
            quality.check_duplicates(quality.duplicate_rows(written, ["o_orderkey"]), name, keys=["o_orderkey"]),
        )
        publish.promote_on_gate(t.spark, name, version, report)

    attempt(stored_orders(t))
    broken = incoming_orders(t).withColumn("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")))
    try:
        attempt(broken)
    except quality.GateFailed:
        pass
    return t.spark.table(name)


@case(
    "jn4_needing_update_from_table",
    f"WITH {CLASSED_CTE} SELECT o_orderkey, change_class FROM classed",
)
def _(t: Tables) -> DataFrame:
    """Stored hashes are read from a table whose rows arrived in two runs."""
    name = t.fresh_name("orders")
    stored = stamp_hash(stored_orders(t))
    older = stored.withColumns({"content_hash": F.lit("older"), "_ingested_at": F.lit(1)})
    tables.write_table(older, name, mode="append", path=t.scratch("orders"))
    tables.write_table(stored.withColumn("_ingested_at", F.lit(2)), name, mode="append")
    classed = classify_changes(incoming_orders(t), t.spark.table(name), "o_orderkey")
    return classed.select("o_orderkey", "change_class")
