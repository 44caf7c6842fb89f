"""Queries on changes: classification by hash, upsert, change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.hashing import row_hash, stamp_hash
from tidewright.operators.changes import (
    change_class_counts,
    classify_changes,
    existing_hashes,
    latest_stored_hashes,
    needing_update,
)
from tidewright.operators.feed import change_feed
from tidewright.operators.keys import require_unique
from tidewright.operators.merge import merged_rows, row_counts, upsert_counts
from workload.inputs import ORDERS_CTE, incoming_orders, stored_orders
from workload.registry import Tables, case

_KEY = ["o_orderkey"]

CLASSED_CTE = f"""{ORDERS_CTE},
classed AS (
  SELECT i.*, CASE WHEN s.o_orderkey IS NULL THEN 'new'
         WHEN s.o_custkey IS DISTINCT FROM i.o_custkey OR s.o_orderstatus IS DISTINCT FROM i.o_orderstatus
           OR s.o_totalprice IS DISTINCT FROM i.o_totalprice OR s.o_orderdate IS DISTINCT FROM i.o_orderdate
           OR s.o_orderpriority IS DISTINCT FROM i.o_orderpriority THEN 'changed'
         ELSE 'unchanged' END AS change_class
  FROM incoming i LEFT JOIN stored s USING (o_orderkey))"""


@case("jn1_classify_orders", f"WITH {CLASSED_CTE} SELECT o_orderkey, o_totalprice, change_class FROM classed")
def classify_orders(t: Tables) -> DataFrame:
    classed = classify_changes(incoming_orders(t), stamp_hash(stored_orders(t)), "o_orderkey")
    return classed.select("o_orderkey", "o_totalprice", "change_class")


@case(
    "jn3_stored_hashes_of_batch",
    f"""WITH {ORDERS_CTE} SELECT CAST(s.o_orderkey AS VARCHAR) AS o_orderkey, sha256(s.o_orderstatus) AS content_hash
        FROM stored s SEMI JOIN incoming i ON s.o_orderkey = i.o_orderkey""",
)
def _(t: Tables) -> DataFrame:
    stored = stored_orders(t).select("o_orderkey", F.sha2("o_orderstatus", 256).alias("content_hash"))
    return existing_hashes(stored, incoming_orders(t), "o_orderkey")


@case(
    "jn4_orders_needing_update",
    f"""WITH {CLASSED_CTE} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        FROM classed WHERE change_class <> 'unchanged'""",
)
def _(t: Tables) -> DataFrame:
    return needing_update(incoming_orders(t), stamp_hash(stored_orders(t)), "o_orderkey").drop("content_hash")


@case("ag4_change_class_counts", f"WITH {CLASSED_CTE} SELECT change_class, count(*) AS n_rows FROM classed GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return change_class_counts(classify_changes(incoming_orders(t), stamp_hash(stored_orders(t)), "o_orderkey"))


@case(
    "st1_new_and_changed_by_status",
    f"""WITH {CLASSED_CTE} SELECT o_orderstatus, count(*) AS n_rows FROM (
          SELECT * FROM classed WHERE change_class = 'new' UNION ALL
          SELECT * FROM classed WHERE change_class = 'changed') GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    changed = needing_update(incoming_orders(t), stamp_hash(stored_orders(t)), "o_orderkey")
    return changed.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))


@case(
    "wn2_latest_stored_hash_per_user",
    """SELECT user_id, sha256(event_type) AS content_hash FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       WHERE rn = 1""",
)
def _(t: Tables) -> DataFrame:
    history = t.events.select("user_id", F.sha2("event_type", 256).alias("content_hash"), "ts", "event_id")
    return latest_stored_hashes(history, "user_id", order_by=["ts", "event_id"])


@case(
    "jn1_classify_users_with_history",
    """WITH latest AS (
         SELECT user_id, event_type FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
           WHERE value < 100) WHERE rn = 1),
       batch AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS user_id, event_type FROM events)
       SELECT CAST(b.user_id AS VARCHAR) AS user_id, b.event_type, count(*) AS n_rows,
              CASE WHEN l.user_id IS NULL THEN 'new' WHEN l.event_type <> b.event_type THEN 'changed'
                   ELSE 'unchanged' END AS change_class
       FROM batch b LEFT JOIN latest l ON b.user_id = l.user_id GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    """Many rows per key on both sides, and NULL keys in the batch."""
    small = t.events.filter(F.col("value") < 100).select("user_id", "event_type", "ts", "event_id")
    history = small.withColumn("content_hash", row_hash(small, ["user_id", "event_type"]))
    batch = t.events.select(F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"), "event_type")
    classed = classify_changes(batch, history, "user_id", order_by=["ts", "event_id"])
    user = F.col("user_id").cast("string").alias("user_id")
    return classed.groupBy(user, "event_type", "change_class").agg(F.count(F.lit(1)).alias("n_rows"))


# --- upsert ---------------------------------------------------------------------------------------------------
UPSERT_CTE = f"""{ORDERS_CTE},
after AS (
  SELECT * FROM incoming UNION ALL
  SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.o_orderkey = s.o_orderkey))"""


@case("jn2_upsert_orders", f"WITH {UPSERT_CTE} SELECT * FROM after")
def upsert_orders(t: Tables) -> DataFrame:
    return merged_rows(stored_orders(t), incoming_orders(t), _KEY).drop("_action")


@case(
    "ag2_row_counts_orders",
    f"""WITH {UPSERT_CTE} SELECT (SELECT count(*) FROM stored) AS rows_before,
        (SELECT count(*) FROM incoming) AS rows_source, (SELECT count(*) FROM after) AS rows_after""",
)
def _(t: Tables) -> DataFrame:
    stored, incoming = stored_orders(t), incoming_orders(t)
    return row_counts(stored, incoming, merged_rows(stored, incoming, _KEY))


@case(
    "ag3_upsert_metrics_orders",
    f"""WITH {ORDERS_CTE} SELECT
        (SELECT count(*) FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.o_orderkey = i.o_orderkey)) AS inserted,
        (SELECT count(*) FROM incoming i WHERE EXISTS (SELECT 1 FROM stored s WHERE s.o_orderkey = i.o_orderkey)) AS updated,
        (SELECT count(*) FROM incoming) AS total_processed""",
)
def _(t: Tables) -> DataFrame:
    incoming = incoming_orders(t)
    total = require_unique(incoming, _KEY, "batch")
    return upsert_counts(merged_rows(stored_orders(t), incoming, _KEY), total)


@case(
    "io7_change_feed_orders",
    f"""WITH {ORDERS_CTE}
    SELECT s.*, 'delete' AS _change_type FROM stored s ANTI JOIN incoming i ON s.o_orderkey = i.o_orderkey
    UNION ALL SELECT i.*, 'insert' FROM incoming i ANTI JOIN stored s ON s.o_orderkey = i.o_orderkey
    UNION ALL SELECT s.*, 'update_preimage' FROM stored s JOIN incoming i ON s.o_orderkey = i.o_orderkey
              WHERE s.o_totalprice <> i.o_totalprice
    UNION ALL SELECT i.*, 'update_postimage' FROM stored s JOIN incoming i ON s.o_orderkey = i.o_orderkey
              WHERE s.o_totalprice <> i.o_totalprice""",
)
def change_feed_orders(t: Tables) -> DataFrame:
    return change_feed(stored_orders(t), incoming_orders(t), _KEY)
