"""Names, codes, severities, strategies and message formats that callers match on.

They are kept together because a finding's code or wording is part of its meaning to whoever reads it.
"""

# column and table conventions
HASH_COLUMN = "content_hash"
RESCUED_COLUMN = "_rescued"
INGESTED_AT_COLUMN = "_ingested_at"
SOURCE_FILE_COLUMN = "_source_file"
REASONS_COLUMN = "_reasons"
BATCH_COLUMN = "_batch"
CORRUPT_FIELD = "_corrupt_record"

# quality findings
DEFAULT_ROW_COUNT_TOLERANCE = 0.05
QA_SEVERITIES = ("ERROR", "WARN", "INFO")
ROW_COUNT_DROP = "ROW_COUNT_DROP"
DUPLICATE_KEYS = "DUPLICATE_KEYS"
NULLS_IN_REQUIRED = "NULLS_IN_REQUIRED"
MISSING_COLUMNS = "MISSING_COLUMNS"
UNEXPECTED_COLUMNS = "UNEXPECTED_COLUMNS"
TABLE_MISSING = "TABLE_MISSING"
TABLE_EMPTY = "TABLE_EMPTY"
ROW_COUNT_DROP_FORMAT = "row count dropped %.1f%% (%d → %d), tolerance %.1f%%"
DUPLICATE_KEYS_FORMAT = "%d duplicate row(s) for key (%s)"
NULLS_IN_REQUIRED_FORMAT = "column '%s' has %d null(s)"
MISSING_COLUMNS_FORMAT = "missing columns: %s"
UNEXPECTED_COLUMNS_FORMAT = "unexpected columns: %s"
SUMMARY_FORMAT = "QA %s: %d error(s), %d warning(s), %d info"

# lineage findings
LINEAGE_SEVERITIES = ("error", "warn", "info")
STATUSES = ("planned", "implemented", "tested", "shipped")
UNDECLARED_WRITE_FORMAT = "undeclared write to %s (per %s) — an undeclared write is what breaks a retry"
UNSEEN_WRITE_FORMAT = "declares write to %s but %s shows none"
UNDECLARED_READ_FORMAT = "undeclared read of %s (per %s) — wave order may be wrong"
UNSEEN_READ_FORMAT = "declares read of %s but %s shows none"
MODE_DRIFT_FORMAT = (
    "write mode [%s] does not match strategy '%s' confirmed on %s — idempotency confirmation is stale, "
    "re-confirm before the loop may retry this step"
)
UNVERIFIED_MESSAGE = "shipped but no UC lineage supplied; drift unverified"
INFERRED_READ_FORMAT = "read %s is inferred from code — wave order may be wrong"
EXTERNAL_READ_FORMAT = "reads external asset %s (not in flow)"
DUPLICATE_PRODUCER_FORMAT = "%s already produced by %s"
CYCLE_MESSAGE = "cycle among: "
NAMELESS_WRITE_MESSAGE = "primary write with no ref"
VIOLATING_PRODUCER_FORMAT = (
    "depends on %s produced by %s, which violates single-primary — this step's wave position is unreliable"
)
#: the step that findings on the graph as a whole are filed under
FLOW_STEP = "<flow>"

# write strategies and the write modes that agree with each
STRATEGIES = ("overwrite_table", "overwrite_partition", "merge_on_key", "append_dedup", "none")
STRATEGY_MODES = {
    "overwrite_table": ("overwrite",),
    "overwrite_partition": ("overwrite",),
    "merge_on_key": ("overwrite", "append", "update", "complete"),
    "append_dedup": ("append",),
}

# write modes a log may hold besides those a strategy expects
OTHER_WRITE_MODES = ("ignore", "error", "errorifexists")

# a 2- or 3-part table name
TABLE_REF_PATTERN = r"^[A-Za-z_][\w]*\.[A-Za-z_][\w]*(\.[A-Za-z_][\w]*)?$"

# what a contract calls the JSON types, and the name an error gives the value found
VALUE_TYPE_NAMES = {
    "object": "dict",
    "array": "list",
    "string": "str",
    "integer": "int",
    "fraction": "float",
    "boolean": "bool",
    "null": "NoneType",
}
