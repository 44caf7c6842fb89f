"""Queries on quality: counts, findings, the report and its gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import quality
from workload.inputs import GAPS_CTE, ORDERS_CTE, events_with_gaps, incoming_orders, stored_orders
from workload.registry import Tables, case

_FINDING = ["table", "severity", "code", "message"]
#: the synthetic days differ by a few percent only, so the drop is judged against a tighter tolerance
TOLERANCE = 0.02


def _daily_drops(t: Tables) -> DataFrame:
    """Findings for days of events that fall behind the day before."""
    days = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    now = days.select("d", F.col("n").alias("current"))
    before = days.select(F.date_add("d", 1).alias("d"), F.col("n").alias("previous"))
    pairs = now.join(before, "d").select(
        F.concat(F.lit("events/"), F.date_format("d", "yyyy-MM-dd")).alias("table"), "previous", "current"
    )
    return quality.check_row_counts(pairs, TOLERANCE)


DROPS_CTE = f"""
days AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1),
drops AS (
  SELECT 'events/' || strftime(c.d, '%Y-%m-%d') AS "table", 'ERROR' AS severity, 'ROW_COUNT_DROP' AS code,
         printf('row count dropped %.1f%% (%d → %d), tolerance 2.0%%', 100.0 * (p.n - c.n) / p.n, p.n, c.n) AS message
  FROM days c JOIN days p ON c.d = p.d + 1 WHERE (p.n - c.n)::DOUBLE / p.n > {TOLERANCE})"""

NULLS_CTE = f"""{GAPS_CTE},
nulls AS (
  SELECT 'user_id' AS "column", count(*) FILTER (WHERE user_id IS NULL) AS nulls FROM gaps UNION ALL
  SELECT 'value', count(*) FILTER (WHERE value IS NULL) FROM gaps UNION ALL
  SELECT 'event_id', count(*) FILTER (WHERE event_id IS NULL) FROM gaps),
null_findings AS (
  SELECT 'events' AS "table", 'ERROR' AS severity, 'NULLS_IN_REQUIRED' AS code,
         printf('column ''%s'' has %d null(s)', "column", nulls) AS message FROM nulls WHERE nulls > 0)"""

DUPS_CTE = """
dups AS (SELECT sum(n)::BIGINT AS total, sum(n - 1)::BIGINT AS duplicates
         FROM (SELECT count(*) AS n FROM documents GROUP BY text)),
dup_findings AS (
  SELECT 'documents' AS "table", 'ERROR' AS severity, 'DUPLICATE_KEYS' AS code,
         printf('%d duplicate row(s) for key (text)', duplicates) AS message FROM dups WHERE duplicates > 0)"""

#: what a table of events per kind should have a column for, and has one for
COLUMNS_CTE = """
kinds AS (SELECT DISTINCT event_type AS name FROM events
          UNION SELECT DISTINCT 'user ' || user_id % 7 FROM events WHERE value > 100),
column_sides AS (
  SELECT name, name IN ('view', 'click', 'refund', 'user 3', 'user 9') AS wanted FROM kinds),
column_findings AS (
  SELECT 'events' AS "table", 'ERROR' AS severity, 'MISSING_COLUMNS' AS code,
         'missing columns: ' || string_agg(name, ', ' ORDER BY name) AS message
  FROM (VALUES ('view'), ('click'), ('refund'), ('user 3'), ('user 9')) e(name)
  WHERE name NOT IN (SELECT name FROM kinds) HAVING count(*) > 0
  UNION ALL
  SELECT 'events', 'WARN', 'UNEXPECTED_COLUMNS', 'unexpected columns: ' || string_agg(name, ', ' ORDER BY name)
  FROM column_sides WHERE NOT wanted HAVING count(*) > 0)"""

EXPECTED_KINDS = ["view", "click", "refund", "user 3", "user 9"]
REQUIRED = ["event_id", "user_id", "value"]


def _columns(t: Tables) -> DataFrame:
    """Columns come from the events: one per kind of event, and one per group of users with large ones."""
    large = F.when(F.col("value") > 100, F.concat(F.lit("user "), (F.col("user_id") % 7).cast("string")))
    names = t.events.select(F.explode(F.array("event_type", large)).alias("kind")).filter("kind IS NOT NULL")
    return quality.check_columns(names.groupBy().pivot("kind").count(), EXPECTED_KINDS, "events", allow_extra=False)


def _nulls(t: Tables) -> DataFrame:
    return quality.check_nulls(quality.null_counts(events_with_gaps(t), REQUIRED), "events")


def _duplicates(t: Tables) -> DataFrame:
    return quality.check_duplicates(quality.duplicate_rows(t.documents, ["text"], by_hash=True), "documents", keys=["text"])


def _report(t: Tables) -> DataFrame:
    return quality.run_checks(t.spark, _daily_drops(t), [_nulls(t), _columns(t)], None, _duplicates(t))


REPORT_CTE = f"""{DROPS_CTE}, {NULLS_CTE}, {DUPS_CTE}, {COLUMNS_CTE},
report AS (SELECT * FROM drops UNION ALL SELECT * FROM null_findings UNION ALL SELECT * FROM dup_findings
           UNION ALL SELECT * FROM column_findings)"""


@case("ag5_duplicate_texts_documents", f"WITH {DUPS_CTE} SELECT * FROM dups")
def _(t: Tables) -> DataFrame:
    return quality.duplicate_rows(t.documents, ["text"], by_hash=True)


@case(
    "ag5_duplicate_lines_lineitem",
    """SELECT sum(n)::BIGINT AS total, sum(n - 1)::BIGINT AS duplicates
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def _(t: Tables) -> DataFrame:
    return quality.duplicate_rows(t.lineitem, ["l_orderkey", "l_linenumber"])


@case("ag6_null_counts_events", f'WITH {NULLS_CTE} SELECT "column", nulls FROM nulls')
def _(t: Tables) -> DataFrame:
    return quality.null_counts(events_with_gaps(t), REQUIRED)


@case("qa1_row_count_drop_by_day", f"WITH {DROPS_CTE} SELECT * FROM drops")
def _(t: Tables) -> DataFrame:
    return _daily_drops(t).select(*_FINDING)


@case(
    "qa1_row_count_drop_since_last_run",
    f"""WITH {ORDERS_CTE},
    runs AS (SELECT coalesce(c.y, p.y) AS s, coalesce(p.n, 0) AS prev, coalesce(c.n, 0) AS cur
             FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM incoming GROUP BY 1) c FULL JOIN
                  (SELECT year(o_orderdate) AS y, count(*) AS n FROM stored GROUP BY 1) p ON c.y = p.y)
    SELECT 'orders/' || s AS "table", 'ERROR' AS severity, 'ROW_COUNT_DROP' AS code,
           printf('row count dropped %.1f%% (%d → %d), tolerance 5.0%%', 100.0 * (prev - cur) / prev, prev, cur) AS message
    FROM runs WHERE prev > 0 AND (prev - cur)::DOUBLE / prev > 0.05""",
)
def _(t: Tables) -> DataFrame:
    """Orders per year: what the source has now against what was stored before."""
    label = F.concat(F.lit("orders/"), F.col("_g").cast("string"))
    per_year = [quality.counts_per(df, F.year("o_orderdate"), label) for df in (incoming_orders(t), stored_orders(t))]
    return quality.check_row_counts(quality.against_last_run(*per_year)).select(*_FINDING)


@case("qa2_duplicate_documents", f"WITH {DUPS_CTE} SELECT * FROM dup_findings")
def _(t: Tables) -> DataFrame:
    return _duplicates(t).select(*_FINDING)


@case("qa3_nulls_in_required_events", f"WITH {NULLS_CTE} SELECT * FROM null_findings")
def _(t: Tables) -> DataFrame:
    return _nulls(t).select(*_FINDING)


@case("qa4_columns_events", f"WITH {COLUMNS_CTE} SELECT * FROM column_findings")
def _(t: Tables) -> DataFrame:
    return _columns(t).select(*_FINDING)


@case(
    "qa5_written_tables",
    """SELECT CASE n WHEN 0 THEN 'TABLE_EMPTY' END AS code, 'orders_none' AS which
       FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice < 0) WHERE n = 0
       UNION ALL SELECT 'TABLE_MISSING', 'orders_missing'""",
)
def _(t: Tables) -> DataFrame:
    names = {label: t.fresh_name(label) for label in ("orders_all", "orders_none", "orders_missing")}
    t.orders.write.option("path", t.scratch("orders_all")).saveAsTable(names["orders_all"])
    t.orders.filter(F.col("o_totalprice") < 0).write.option("path", t.scratch("orders_none")).saveAsTable(names["orders_none"])
    found = quality.check_written(t.spark, list(names.values()))
    return found.select("code", F.regexp_replace("table", "_[0-9a-f]{12}$", "").alias("which"))


@case("st4_combined_findings", f"WITH {REPORT_CTE} SELECT * FROM report")
def _(t: Tables) -> DataFrame:
    return _report(t).select(*_FINDING)


@case(
    "ag9_severity_summary",
    f"""WITH {REPORT_CTE} SELECT count(*) FILTER (WHERE severity = 'ERROR') AS errors,
        count(*) FILTER (WHERE severity = 'WARN') AS warnings, count(*) FILTER (WHERE severity = 'INFO') AS infos,
        count(*) FILTER (WHERE severity = 'ERROR') = 0 AS ok,
        printf('QA %s: %d error(s), %d warning(s), %d info',
               CASE WHEN count(*) FILTER (WHERE severity = 'ERROR') = 0 THEN 'PASS' ELSE 'FAIL' END,
               count(*) FILTER (WHERE severity = 'ERROR'), count(*) FILTER (WHERE severity = 'WARN'),
               count(*) FILTER (WHERE severity = 'INFO')) AS summary
        FROM report""",
)
def _(t: Tables) -> DataFrame:
    return quality.summarize(_report(t))


@case(
    "qa6_report_gate",
    f"""WITH {REPORT_CTE} SELECT 'report' AS gate, count(*) FILTER (WHERE severity = 'ERROR') > 0 AS failed FROM report
        UNION ALL SELECT 'columns only', false""",
)
def _(t: Tables) -> DataFrame:
    def failed(report: DataFrame) -> bool:
        try:
            quality.raise_if_failed(report)
        except quality.GateFailed:
            return True
        return False

    known = quality.check_columns(t.events, ["event_id"], "events")
    outcome = [("report", failed(_report(t))), ("columns only", failed(quality.run_checks(t.spark, known)))]
    return t.spark.createDataFrame(outcome, "gate string, failed boolean")
