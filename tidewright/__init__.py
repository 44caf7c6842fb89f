"""Lakehouse table operators on Spark: DataFrame in, DataFrame out."""

from tidewright.functions.fixed import HASH_COLUMN
from tidewright.functions.hashing import row_hash, stamp_hash, value_hash
from tidewright.operators.changes import (
    change_class_counts,
    classify_changes,
    existing_hashes,
    latest_stored_hashes,
    needing_update,
)
from tidewright.operators.closure import on_cycle, reachability, unplaceable
from tidewright.operators.contract import check_contract, contract_errors
from tidewright.operators.dedup import latest_wins
from tidewright.operators.expectations import (
    expect_or_drop,
    expectation_counts,
    observe_expectations,
    split_quarantine,
)
from tidewright.operators.feed import apply_feed, change_feed, changed_keys
from tidewright.operators.graph import graph_findings
from tidewright.operators.lineage import edge_diff, mode_drift, reconcile
from tidewright.operators.merge import merged_rows, upsert_counts
from tidewright.operators.quality import (
    GateFailed,
    check_columns,
    check_duplicates,
    check_nulls,
    check_row_counts,
    check_written,
    raise_if_failed,
    run_checks,
    summarize,
)
from tidewright.operators.scope import high_water_mark, latest_watermark, newer_than, sample_scope
from tidewright.operators.typing import drop_helpers, type_columns
from tidewright.operators.voids import defend_voids, void_columns
from tidewright.plans.ingest import land_changes, refresh_bronze, refresh_silver, silver
from tidewright.sources.landing import infer_landing_schema, read_landing, write_landing
from tidewright.sources.publish import drop_old_versions, promote_on_gate, publish, write_version
from tidewright.sources.rescue import parse_with_rescue
from tidewright.sources.side_tables import append_metrics, write_guarded, write_metrics, write_with_quarantine
from tidewright.sources.tables import (
    append_dedup,
    create_table,
    overwrite_partitions,
    overwrite_table,
    read_or_none,
    upsert,
    write_table,
    write_with_strategy,
)
from tidewright.streaming.bronze import bronze_stream, refresh_table, refresh_with, skip_or_run

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("functions", "operators", "plans", "sources", "streaming")]
