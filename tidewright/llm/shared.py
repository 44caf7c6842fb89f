"""What the text operators share: the folder all executors reach, kept tables, document ids and row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: the white space that separates words, as characters
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: stands for a NULL id: such rows together are one document that comes after all others
LAST_ID = 2**63 - 1


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it, else a folder below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return folder.rstrip("/")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame that several steps read to the shared folder and reads it back.

    What a lost executor held is then read again and not computed again, and every reader sees the same rows. The
    table stays until the folder's owner clears it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("bigint"), F.lit(LAST_ID))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def with_columns(row: str, frame: DataFrame, **new: Column) -> DataFrame:
    """The fields of the struct column ``row`` with ``new`` columns added or put in place of fields of that name."""
    fields = [f.name for f in frame.schema[row].dataType.fields]
    old = [new.get(f, F.col(f"`{row}`").getField(f)).alias(f) for f in fields]
    return frame.select(*old, *[c.alias(n) for n, c in new.items() if n not in fields])
