"""The landing zone: JSON lines under ``<root>/<entity>/dt=YYYY-MM-DD/run=<id>/``."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.functions.fixed import INGESTED_AT_COLUMN, SOURCE_FILE_COLUMN
from tidewright.functions.hashing import JSON_OPTIONS
from tidewright.sources.rescue import parse_with_rescue


def write_landing(df: DataFrame, root: str, entity: str, *, dt: str, run_id: str, compression: str | None = None) -> str:
    """Lands one run's rows as JSON lines, from the executors, and returns the directory.

    Each run has a directory of its own and an existing one is never written to, so a rerun under the same
    id fails instead of landing its rows twice.
    """
    if not run_id or "/" in run_id:
        raise ValueError(f"invalid run id: {run_id!r}")
    path = f"{root.rstrip('/')}/{entity}/dt={dt}/run={run_id}"
    writer = df.write.mode("errorifexists").options(**JSON_OPTIONS)
    if compression:
        writer = writer.option("compression", compression)
    writer.json(path)
    return path


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Landed lines as text with their source file and ingest time."""
    return with_provenance(spark.read.option("recursiveFileLookup", "true").text(path))


def with_provenance(df: DataFrame) -> DataFrame:
    """Adds ``_ingested_at`` and ``_source_file`` to a frame read from files."""
    return df.withColumn(INGESTED_AT_COLUMN, F.current_timestamp()).withColumn(
        SOURCE_FILE_COLUMN, F.col("_metadata.file_path")
    )


def read_landing(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A batch read of landed files: typed columns, rescue column, provenance."""
    return parse_with_rescue(read_lines(spark, path), schema)


def infer_landing_schema(
    spark: SparkSession, path: str, schema_path: str, *, sampling_ratio: float = 1.0
) -> StructType:
    """The landing schema: inferred once by Spark over the files, then kept at ``schema_path`` and reused.

    Later drift does not change it; fields it does not know are rescued.
    """
    try:
        kept = spark.read.option("wholetext", "true").text(schema_path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = []
    if kept:
        return StructType.fromJson(json.loads(kept[0]["value"]))
    inferred = (
        spark.read.option("recursiveFileLookup", "true")
        .option("mode", "DROPMALFORMED")
        .option("samplingRatio", str(sampling_ratio))
        .json(path)
        .schema
    )
    if not inferred.fields:
        raise ValueError(f"no JSON object under {path} to infer a schema from")
    spark.createDataFrame([(inferred.json(),)], "value string").coalesce(1).write.mode("errorifexists").text(schema_path)
    return inferred
