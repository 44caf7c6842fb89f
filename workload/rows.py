"""Queries on rows: projections, filters, deduplication, scalar functions, record contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewright.functions.fixed import REASONS_COLUMN
from tidewright.functions.hashing import row_hash, value_hash
from tidewright.functions.scalars import (
    is_table_ref,
    json_field,
    key_text,
    landing_path,
    parse_timestamp,
    percent,
    qualify_ref,
)
from tidewright.operators.contract import check_contract, contract_errors
from tidewright.operators.dedup import latest_wins
from tidewright.operators.expectations import expect_or_drop, expectation_counts
from tidewright.operators.lineage import step_modes
from tidewright.operators.scope import high_water_mark, newer_than, sample_scope
from tidewright.operators.typing import type_columns
from tidewright.operators.voids import defend_voids, void_columns
from tidewright.plans.ingest import silver
from workload.inputs import GAPS_CTE, LINEAGE_CTE, RAW_CTE, access_log, events_with_gaps, raw_events
from workload.registry import Tables, case


# --- void columns ---------------------------------------------------------------------------------------------
def _customers_with_voids(t: Tables) -> DataFrame:
    return t.customer.withColumns({"fax": F.lit(None), "fax_area": F.lit(None)})


@case(
    "pr1_void_columns_customer",
    "SELECT v.column_name, count(*) AS n_rows FROM customer, (VALUES ('fax'), ('fax_area')) v(column_name) GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    df = _customers_with_voids(t)
    names = F.explode(F.array(*[F.lit(n) for n in void_columns(df.schema)])).alias("column_name")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(names, "n_rows")


@case(
    "pr2_void_cast_customer",
    "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS fax, CAST(NULL AS VARCHAR) AS fax_area FROM customer",
)
def _(t: Tables) -> DataFrame:
    return defend_voids(_customers_with_voids(t).select("c_custkey", "c_name", "fax", "fax_area"))


@case("pr3_void_drop_customer", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t: Tables) -> DataFrame:
    return defend_voids(_customers_with_voids(t).select("c_custkey", "c_name", "c_acctbal", "fax", "fax_area"), None)


# --- typing and expectations ----------------------------------------------------------------------------------
@case(
    "pr4_typed_events",
    f"""WITH {RAW_CTE}
    SELECT event_id, TRY_CAST(updated_at AS TIMESTAMP) AS updated_at, TRY_CAST(value AS DOUBLE) AS value,
           concat_ws('; ', CASE WHEN updated_at = 'bad' THEN 'updated_at: not a timestamp' END,
                     CASE WHEN value = 'n/a' THEN 'value: not a double' END) AS reasons
    FROM raw""",
)
def _(t: Tables) -> DataFrame:
    typed = type_columns(raw_events(t), {"updated_at": "timestamp", "value": "double"}, reasons=REASONS_COLUMN)
    return typed.select(
        "event_id",
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        "value",
        F.concat_ws("; ", REASONS_COLUMN).alias("reasons"),
    )


EXPECTATIONS = {"valid_user": "user_id IS NOT NULL", "has_value": "value IS NOT NULL", "sane_value": "value < 300"}


@case(
    "pr5_expect_warn_events",
    f"""WITH {GAPS_CTE}
    SELECT e.expectation, count(*) AS n_rows,
           sum(CASE e.expectation WHEN 'valid_user' THEN (user_id IS NULL)::INT
               WHEN 'has_value' THEN (value IS NULL)::INT
               ELSE (value IS NULL OR value >= 300)::INT END)::BIGINT AS violations
    FROM gaps, (VALUES ('valid_user'), ('has_value'), ('sane_value')) e(expectation) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return expectation_counts(events_with_gaps(t), EXPECTATIONS)


@case(
    "pr6_expect_drop_events",
    f"WITH {GAPS_CTE} SELECT * FROM gaps WHERE user_id IS NOT NULL AND value IS NOT NULL AND value < 300",
)
def _(t: Tables) -> DataFrame:
    return expect_or_drop(events_with_gaps(t), EXPECTATIONS)


@case(
    "pr6_dropped_counts_events",
    f"""WITH {GAPS_CTE}, flags AS (
          SELECT user_id IS NULL AS u, value IS NULL AS v, (value IS NULL OR value >= 300) AS s FROM gaps)
        SELECT metric, CASE metric WHEN 'n_rows' THEN count(*) WHEN 'n_dropped' THEN count(*) FILTER (WHERE u OR v OR s)
               WHEN 'n_kept' THEN count(*) FILTER (WHERE NOT (u OR v OR s))
               WHEN 'valid_user' THEN count(*) FILTER (WHERE u) WHEN 'has_value' THEN count(*) FILTER (WHERE v)
               ELSE count(*) FILTER (WHERE s) END AS n
        FROM flags, (VALUES ('n_rows'), ('n_dropped'), ('n_kept'), ('valid_user'), ('has_value'), ('sane_value')) m(metric)
        GROUP BY metric""",
)
def _(t: Tables) -> DataFrame:
    """The drops are counted by the write of what is kept."""
    seen, path = Observation(), t.scratch("kept")
    expect_or_drop(events_with_gaps(t), EXPECTATIONS, seen).write.parquet(path)
    counts = [(metric, int(n)) for metric, n in seen.get.items()]
    kept = t.spark.read.parquet(path).agg(F.lit("n_kept").alias("metric"), F.count("*").alias("n"))
    return t.spark.createDataFrame(counts, "metric string, n bigint").unionAll(kept)


@case(
    "pr7_silver_events",
    f"""WITH {RAW_CTE},
    ranked AS (
      SELECT *, row_number() OVER (
               PARTITION BY user_id
               ORDER BY TRY_CAST(updated_at AS TIMESTAMP) DESC NULLS LAST, event_id DESC) AS _rn
      FROM raw WHERE user_id IS NOT NULL)
    SELECT event_id, user_id, event_type, TRY_CAST(updated_at AS TIMESTAMP) AS updated_at,
           TRY_CAST(value AS DOUBLE) AS value
    FROM ranked WHERE _rn = 1""",
)
def _(t: Tables) -> DataFrame:
    bronze = raw_events(t).withColumns({"_rescued": F.lit(None).cast("string"), "_ingested_at": F.col("event_id")})
    out = silver(bronze, ["user_id"], types={"value": "double"})
    return out.select(
        "event_id", "user_id", "event_type", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "value"
    )


# --- scope ----------------------------------------------------------------------------------------------------
@case(
    "pr8_incremental_events",
    """SELECT event_id, ts, user_id, event_type, value FROM events
       WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup')""",
)
def _(t: Tables) -> DataFrame:
    stored = t.events.filter(F.col("event_type") == "signup")
    mark = high_water_mark(stored, "ts").first()["wm"]
    return newer_than(t.events, "ts", mark).select("event_id", "ts", "user_id", "event_type", "value")


@case(
    "pr9_sample_scope_day",
    "SELECT event_id, ts, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'",
)
def _(t: Tables) -> DataFrame:
    day = "ts >= timestamp_ntz'2024-01-10 00:00:00' AND ts < timestamp_ntz'2024-01-11 00:00:00'"
    return sample_scope(t.events, where=day).select("event_id", "ts", "user_id", "value")


@case("ag1_watermark_events", "SELECT max(ts) AS wm FROM events")
def _(t: Tables) -> DataFrame:
    return high_water_mark(t.events, "ts")


@case("sr3_sample_limit_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(t: Tables) -> DataFrame:
    ordered = t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "o_totalprice")
    return sample_scope(ordered, limit=100)


# --- one row per key ------------------------------------------------------------------------------------------
@case(
    "wn1_latest_event_per_user",
    """SELECT event_id, ts, user_id, event_type, value, props FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       WHERE rn = 1""",
)
def latest_event_per_user(t: Tables) -> DataFrame:
    return latest_wins(t.events, ["user_id"], ["ts", "event_id"])


@case(
    "wn1_latest_tied_days",
    """SELECT event_id, user_id, event_type, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type
                                      ORDER BY date_trunc('day', ts) DESC, event_id DESC) AS rn FROM events)
       WHERE rn = 1""",
)
def _(t: Tables) -> DataFrame:
    days = t.events.select("event_id", "user_id", "event_type", "value", F.date_trunc("day", "ts").alias("updated_at"))
    # event_id plays the part of the ingest time that breaks the tie
    tied = days.withColumn("_ingested_at", F.col("event_id"))
    return latest_wins(tied, ["user_id", "event_type"], ["updated_at"]).drop("_ingested_at", "updated_at")


# --- scalar functions -----------------------------------------------------------------------------------------
@case("sc1_hash_documents", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(t: Tables) -> DataFrame:
    docs = t.documents
    return docs.select("doc_id", value_hash(docs, "text").alias("content_hash"))


@case(
    "sc2_hash_stamp_orders",
    """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderdate":"'
         || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '","o_orderkey":' || o_orderkey
         || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS content_hash
       FROM orders""",
)
def _(t: Tables) -> DataFrame:
    orders = t.orders.drop("o_totalprice").withColumn("content_hash", F.lit("stale"))
    return orders.select("o_orderkey", row_hash(orders).alias("content_hash"))


@case(
    "sc3_key_text_join",
    """SELECT c_custkey, count(*) AS orders FROM orders JOIN customer
       ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    # counting first leaves one row per key for the join, however many orders one customer has
    orders = t.orders.groupBy(key_text("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("orders"))
    customers = t.customer.select("c_custkey", key_text("c_custkey").alias("key"))
    return customers.join(orders, "key").select("c_custkey", "orders")


@case(
    "sc4_parse_timestamps_events",
    f"WITH {RAW_CTE} SELECT event_id, TRY_CAST(updated_at AS TIMESTAMP) AS parsed FROM raw",
)
def _(t: Tables) -> DataFrame:
    return raw_events(t).select("event_id", parse_timestamp("updated_at").cast("timestamp_ntz").alias("parsed"))


@case(
    "sc6_landing_paths_events",
    """SELECT '/landing/events/dt=' || strftime(ts, '%Y-%m-%d') || '/run=' || event_type AS path, count(*) AS n_rows
       FROM events GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    path = landing_path("/landing", "events", F.col("ts"), F.col("event_type"))
    return t.events.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))


_REFS_SQL = """
refs AS (
  SELECT event_id, CASE event_type WHEN 'view' THEN 'app.users' WHEN 'click' THEN 'prod.app.clicks'
           WHEN 'error' THEN 'models:/m' || user_id WHEN 'signup' THEN '/Volumes/a.b/' || user_id
           ELSE 'plain' END AS ref FROM events)"""


def _refs(t: Tables) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    ref = (
        F.when(kind == "view", "app.users")
        .when(kind == "click", "prod.app.clicks")
        .when(kind == "error", F.concat(F.lit("models:/m"), user))
        .when(kind == "signup", F.concat(F.lit("/Volumes/a.b/"), user))
        .otherwise("plain")
    )
    return t.events.select("event_id", ref.alias("ref"))


@case(
    "sc7_qualify_refs",
    f"""WITH {_REFS_SQL} SELECT event_id, CASE WHEN contains(ref, ':') OR contains(ref, '/') THEN ref
          WHEN length(ref) - length(replace(ref, '.', '')) = 2 THEN ref ELSE 'dev.' || ref END AS ref FROM refs""",
)
def _(t: Tables) -> DataFrame:
    return _refs(t).select("event_id", qualify_ref(F.col("ref"), "dev").alias("ref"))


@case(
    "sc8_table_refs",
    f"WITH {_REFS_SQL} SELECT event_id, ref IN ('app.users', 'prod.app.clicks') AS is_table FROM refs",
)
def _(t: Tables) -> DataFrame:
    return _refs(t).select("event_id", is_table_ref(F.col("ref")).alias("is_table"))


@case(
    "sc9_percent_of_orders",
    """SELECT o_orderpriority, printf('%.1f%%', 100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)) AS finished
       FROM orders GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))
    return t.orders.groupBy("o_orderpriority").agg(percent(done).alias("finished"))


@case(
    "sc10_json_field_events",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(NULL AS VARCHAR) AS absent FROM events",
)
def _(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", json_field("props", "$.k", "int").alias("k"), json_field("props", "$.none").alias("absent")
    )


# --- record contracts -----------------------------------------------------------------------------------------
PROPS_CONTRACT = {
    "type": "object",
    "required": ["k", "version"],
    "properties": {"k": {"type": "integer", "enum": [1, 2, 3]}, "version": {"const": 1}},
}


@case(
    "pr10_contract_props_events",
    """SELECT event_id, concat_ws('; ',
           CASE WHEN event_id % 3 = 0 THEN '$: missing required key ''version''' END,
           CASE WHEN (props->>'$.k')::INT NOT IN (1, 2, 3) THEN '$.k: ' || (props->>'$.k') || ' not one of [1, 2, 3]' END,
           CASE WHEN event_id % 3 = 2 THEN '$.version: expected 1, got ''2''' END) AS errors
       FROM events""",
)
def _(t: Tables) -> DataFrame:
    version = F.when(F.col("event_id") % 3 == 1, ',"version":1}').when(F.col("event_id") % 3 == 2, ',"version":"2"}')
    doc = F.concat(F.regexp_replace("props", r"\}$", ""), F.coalesce(version, F.lit("}")))
    return t.events.select("event_id", F.concat_ws("; ", contract_errors(doc, PROPS_CONTRACT)).alias("errors"))


EVENT_CONTRACT = {
    "type": "object",
    "required": ["id", "at"],
    "properties": {
        "id": {"type": "integer"},
        "kind": {"enum": ["view", "click", "purchase", "signup"]},
        "at": {"type": "string"},
        "readings": {"type": "array", "items": {"$ref": "#/$defs/reading"}},
    },
    "$defs": {"reading": {"type": "number"}},
}


@case(
    "pr10_contract_nested_events",
    """SELECT event_id, concat_ws('; ',
           CASE WHEN event_type = 'error' THEN '$.kind: ''error'' not one of [''view'', ''click'', ''purchase'', ''signup'']' END,
           CASE WHEN event_type = 'signup' THEN '$: missing required key ''at''' END,
           CASE WHEN value > 100 THEN '$.readings[1]: expected number, got bool' END) AS errors
       FROM events""",
)
def _(t: Tables) -> DataFrame:
    doc = F.to_json(
        F.struct(
            F.col("event_id").alias("id"),
            F.col("event_type").alias("kind"),
            F.when(F.col("event_type") != "signup", F.date_format("ts", "yyyy-MM-dd")).alias("at"),
            F.col("value"),
        )
    )
    readings = F.when(F.col("value") > 100, ',"readings":[1.5,true]}').otherwise(',"readings":[1.5,2]}')
    full = F.concat(F.regexp_replace(doc, r"\}$", ""), readings)
    checked = check_contract(t.events.select("event_id", full.alias("doc")), "doc", EVENT_CONTRACT)
    # in the order the oracle lists them: by kind, by missing key, by reading
    rank = lambda e: F.when(e.startswith("$.kind"), 0).when(e.startswith("$:"), 1).otherwise(2)
    ranked = F.array_sort(F.transform("errors", lambda e: F.struct(rank(e).alias("rank"), e.alias("error"))))
    return checked.select("event_id", F.array_join(ranked["error"], "; ").alias("errors"))


# --- lists in order -------------------------------------------------------------------------------------------
@case(
    "sr2_sorted_modes_per_step",
    f"WITH {LINEAGE_CTE} SELECT step, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes FROM log WHERE mode IS NOT NULL GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    return step_modes(access_log(t).select("step", "mode")).select("step", F.array_join("modes", ",").alias("modes"))
