"""Inputs the given tables lack, derived by the same rule in Spark and in the oracle's SQL.

Every rule is over whole tables and says something a business would: orders as they were booked at an earlier
date, closed orders retired since, a reading that failed, a batch with drift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workload.registry import Tables

# --- two versions of orders -----------------------------------------------------------------------------------
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

ORDERS_CTE = """
stored AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00'),
incoming AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'))
"""


def stored_orders(t: Tables) -> DataFrame:
    """Orders booked before 2000; the pending ones were priced one higher then."""
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return (
        t.orders.filter(F.col("o_orderdate") < F.expr("timestamp_ntz'2000-01-01 00:00:00'"))
        .withColumn("o_totalprice", price)
        .select(*ORDER_COLUMNS)
    )


def incoming_orders(t: Tables) -> DataFrame:
    """Orders as the source has them now: finished ones from before 1996 are retired."""
    retired = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.expr("timestamp_ntz'1996-01-01 00:00:00'"))
    return t.orders.filter(~retired).select(*ORDER_COLUMNS)


# --- events with gaps and bad text ----------------------------------------------------------------------------
GAPS_CTE = """
gaps AS (
  SELECT event_id, ts, event_type,
         CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS user_id,
         CASE WHEN value < 5 THEN NULL ELSE value END AS value
  FROM events)
"""


def events_with_gaps(t: Tables) -> DataFrame:
    """Error events have lost their user, small readings their value."""
    return t.events.select(
        "event_id",
        "ts",
        "event_type",
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
        F.when(F.col("value") >= 5, F.col("value")).alias("value"),
    )


RAW_CTE = """
raw AS (
  SELECT event_id, user_id, event_type,
         CASE WHEN event_type = 'error' THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS updated_at,
         CASE WHEN event_type = 'signup' AND value < 20 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value
  FROM events)
"""


def raw_events(t: Tables) -> DataFrame:
    """Events as untyped text: error events carry a broken time, small signups no number."""
    return t.events.select(
        "event_id",
        "user_id",
        "event_type",
        F.when(F.col("event_type") == "error", "bad")
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .alias("updated_at"),
        F.when((F.col("event_type") == "signup") & (F.col("value") < 20), "n/a")
        .otherwise(F.col("value").cast("string"))
        .alias("value"),
    )


# --- lineage: what steps declare, what was observed -----------------------------------------------------------
def _lineage_cte(app: str, crm: str) -> str:
    return f"""
log AS (
  SELECT 'job_' || user_id AS step,
         CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'write' END AS direction,
         'app.h' || strftime(ts, '%d%H') AS ref,
         CASE WHEN value > 150 THEN 'overwrite' WHEN value > 60 THEN 'append' END AS mode
  FROM events),
declared AS (
  SELECT DISTINCT 'job_' || user_id AS step,
         CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'write' END AS direction,
         'app.h' || strftime(ts, '%d%H') AS ref,
         CASE WHEN event_type = 'signup' THEN 'metrics' WHEN event_type = 'error' THEN 'quarantine'
              WHEN event_type = 'purchase' THEN 'primary' END AS kind,
         CASE WHEN event_type = 'click' THEN 'inferred' ELSE 'declared' END AS via
  FROM events WHERE {app}
  UNION ALL
  SELECT DISTINCT 'job_' || o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'read' ELSE 'write' END,
         'crm.d' || strftime(o_orderdate, '%Y%m%d'),
         CASE WHEN o_orderstatus = 'P' THEN 'quarantine' WHEN o_orderstatus = 'F' THEN 'primary' END,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'inferred' ELSE 'declared' END
  FROM orders{crm}),
steps AS (
  SELECT 'job_' || c_custkey AS step,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'planned' WHEN c_mktsegment = 'BUILDING' THEN 'implemented'
              WHEN c_mktsegment = 'FURNITURE' THEN 'tested' ELSE 'shipped' END AS status,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'overwrite_table'
              WHEN c_mktsegment = 'BUILDING' THEN 'overwrite_partition'
              WHEN c_mktsegment = 'FURNITURE' THEN 'merge_on_key'
              WHEN c_mktsegment = 'HOUSEHOLD' THEN 'append_dedup' ELSE 'none' END AS strategy,
         CASE WHEN c_acctbal >= 0 THEN '2026-01-01' END AS confirmed_at,
         c_acctbal > 9000 AS violates_single_primary
  FROM customer)
"""


#: every job declares what it does
WHOLE_LINEAGE_CTE = _lineage_cte("value > 5", "")
#: for comparisons with the log: jobs whose number ends in 7 declare nothing
LINEAGE_CTE = _lineage_cte("value > 5 AND user_id % 10 <> 7", " WHERE o_custkey % 10 <> 7")


def _job(key: str) -> Column:
    return F.concat(F.lit("job_"), F.col(key).cast("string")).alias("step")


def _event_direction() -> Column:
    return F.when(F.col("event_type").isin("view", "click"), "read").otherwise("write").alias("direction")


def _event_ref() -> Column:
    return F.concat(F.lit("app.h"), F.date_format("ts", "ddHH")).alias("ref")


def access_log(t: Tables) -> DataFrame:
    """Every event as one access of a job to an hourly table."""
    mode = F.when(F.col("value") > 150, "overwrite").when(F.col("value") > 60, "append")
    return t.events.select(_job("user_id"), _event_direction(), _event_ref(), mode.alias("mode"))


def declared_edges(t: Tables, *, some_silent: bool = False) -> DataFrame:
    """What jobs declare: their larger event accesses, and daily tables they touch through orders.

    With ``some_silent``, for comparisons with the log, jobs whose number ends in 7 declare nothing.
    """
    app, crm = t.events.filter(F.col("value") > 5), t.orders
    if some_silent:
        app, crm = app.filter(F.col("user_id") % 10 != 7), crm.filter(F.col("o_custkey") % 10 != 7)
    event_kind = (
        F.when(F.col("event_type") == "signup", "metrics")
        .when(F.col("event_type") == "error", "quarantine")
        .when(F.col("event_type") == "purchase", "primary")
    )
    event_via = F.when(F.col("event_type") == "click", "inferred").otherwise("declared")
    app = app.select(
        _job("user_id"), _event_direction(), _event_ref(), event_kind.alias("kind"), event_via.alias("via")
    )
    status = F.col("o_orderstatus")
    crm = crm.select(
        _job("o_custkey"),
        F.when(status == "O", "read").otherwise("write").alias("direction"),
        F.concat(F.lit("crm.d"), F.date_format("o_orderdate", "yyyyMMdd")).alias("ref"),
        F.when(status == "P", "quarantine").when(status == "F", "primary").alias("kind"),
        F.when(F.col("o_orderpriority") == "5-LOW", "inferred").otherwise("declared").alias("via"),
    )
    return app.distinct().unionAll(crm.distinct())


def job_steps(t: Tables) -> DataFrame:
    """Every customer as a job with a status and a signed (or unsigned) write strategy."""
    segment = F.col("c_mktsegment")
    status = (
        F.when(segment == "AUTOMOBILE", "planned")
        .when(segment == "BUILDING", "implemented")
        .when(segment == "FURNITURE", "tested")
        .otherwise("shipped")
    )
    strategy = (
        F.when(segment == "AUTOMOBILE", "overwrite_table")
        .when(segment == "BUILDING", "overwrite_partition")
        .when(segment == "FURNITURE", "merge_on_key")
        .when(segment == "HOUSEHOLD", "append_dedup")
        .otherwise("none")
    )
    return t.customer.select(
        _job("c_custkey"),
        status.alias("status"),
        strategy.alias("strategy"),
        F.when(F.col("c_acctbal") >= 0, "2026-01-01").alias("confirmed_at"),
        (F.col("c_acctbal") > 9000).alias("violates_single_primary"),
    )


# --- a graph with cycles --------------------------------------------------------------------------------------
ROLES_CTE = """
edges AS (
  SELECT DISTINCT a.conv_id || ':' || a.role AS src, b.conv_id || ':' || b.role AS dst
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
reach AS (
  SELECT src, dst FROM edges
  UNION
  SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)
"""


def role_edges(t: Tables) -> DataFrame:
    """Who answers whom: an edge from each speaker of a conversation to the speaker of the next turn.

    The join is on conversation and turn together, so a very long conversation spreads like any other rows.
    """
    node = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("role"))
    turns = t.conversations
    now = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), node.alias("src"))
    then = turns.select("conv_id", "turn", node.alias("dst"))
    return now.join(then, ["conv_id", "turn"]).select("src", "dst").distinct()


def order_trail(t: Tables) -> DataFrame:
    """A deep graph with hubs: each order leads to its customer's next one, the last to the nation, that to the region."""
    mine = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    nation = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("nation "), "c_nationkey").alias("_n"))
    orders = t.orders.select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(mine).alias("_next"))
    order = lambda c: F.concat(F.lit("order "), F.col(c).cast("string"))
    trail = orders.join(nation, "o_custkey").select(
        order("o_orderkey").alias("src"), F.coalesce(order("_next"), F.col("_n")).alias("dst")
    )
    up = t.nation.select(
        F.concat(F.lit("nation "), "n_nationkey").alias("src"), F.concat(F.lit("region "), "n_regionkey").alias("dst")
    )
    return trail.unionAll(up)


TRAIL_CTE = """
placed AS (SELECT o_orderkey AS k, o_custkey AS c, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey),
trail AS (
  SELECT 'order ' || a.k AS src, 'order ' || b.k AS dst FROM placed a JOIN placed b ON a.c = b.c AND a.k < b.k
  UNION ALL SELECT 'order ' || k, 'nation ' || n FROM placed
  UNION ALL SELECT 'order ' || k, 'region ' || n_regionkey FROM placed JOIN nation ON n = n_nationkey
  UNION ALL SELECT 'nation ' || n_nationkey, 'region ' || n_regionkey FROM nation)
"""


# --- landed lines with drift ----------------------------------------------------------------------------------
LANDED_DDL = "event_id bigint, updated_at string, user_id bigint, event_type string, value double"

LANDED_SELECT = """
SELECT CASE WHEN broken THEN NULL ELSE CAST(event_id AS VARCHAR) END AS event_id,
       CASE WHEN broken THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS updated_at,
       CASE WHEN broken THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id,
       CASE WHEN broken THEN NULL ELSE event_type END AS event_type,
       CASE WHEN broken OR misfit THEN NULL ELSE value END AS value,
       CASE WHEN broken THEN '{"_corrupt_record":"{\\"event_id\\": ' || event_id || '"}'
            WHEN misfit THEN '{"value":"n/a"}'
            WHEN event_type = 'signup' THEN '{"plan":"pro"}'
            WHEN event_type = 'view' AND value < 20 THEN '{"fee":1.10}'
            WHEN event_type = 'purchase' AND value < 20 THEN '{"scale":1e3}'
            WHEN event_type = 'purchase' AND value > 100 THEN '{"serial":123456789012345678901234567890' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '}'
       END AS _rescued
FROM (SELECT *, event_type = 'click' AND value > 200 AS broken, event_type = 'error' AND value > 100 AS misfit
      FROM events)
"""


def event_lines(t: Tables) -> DataFrame:
    """``value, dt``: events as JSON lines. Signups carry a field the schema lacks, large error readings are
    no number, and large clicks were cut off while writing. Some views and purchases carry numbers whose text matters."""
    broken = (F.col("event_type") == "click") & (F.col("value") > 200)
    misfit = (F.col("event_type") == "error") & (F.col("value") > 100)
    record = F.to_json(
        F.struct(
            "event_id",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"),
            "user_id",
            "event_type",
            F.when(~misfit, F.col("value")).alias("value"),
            F.when(F.col("event_type") == "signup", "pro").alias("plan"),
        )
    )
    record = F.when(misfit, F.regexp_replace(record, r"\}$", ',"value":"n/a"}')).otherwise(record)
    event, value = F.col("event_type"), F.col("value")
    digits = F.lpad(F.col("event_id").cast("string"), 12, "0")
    serial = F.concat(F.lit(',"serial":123456789012345678901234567890'), digits, F.lit("}"))
    extra = (
        F.when((event == "view") & (value < 20), ',"fee":1.10}')
        .when((event == "purchase") & (value < 20), ',"scale":1e3}')
        .when((event == "purchase") & (value > 100), serial)
        .otherwise("}")
    )
    record = F.concat(F.regexp_replace(record, r"\}$", ""), extra)
    line = F.when(broken, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))).otherwise(record)
    return t.events.select(line.alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("dt"))


def land_lines(t: Tables, root: str) -> None:
    event_lines(t).hint("rebalance", "dt").write.partitionBy("dt").text(root)
