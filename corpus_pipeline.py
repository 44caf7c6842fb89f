"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``. A stage judges all its predecessor kept
and decides on that alone. NULL and empty texts pass every filter: they are no toxic text, no copy and no passage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, lines, neardup, packing, toxicity
from tidewright.llm.queries import not_held_out, table
from tidewright.llm.shared import keep
from tidewright.operators.keys import lookup_join


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents the toxicity model, fitted to ``labels`` without its held-out rows, scores 0.5 or more."""
    model = toxicity.fit(docs, not_held_out(table(spark, sf_dir, "labels")))
    return docs.filter(toxicity.scorer(spark, model)(F.col("text")) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines found in several documents out of all but the first; ``n_chars`` follows the text.

    A document of which nothing but white space stays, an exact copy for one, goes; one that lost no line stays as it is.
    """
    out = lines.dedup_lines(docs).filter((F.col("n_dropped") == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates, alike by 80 % or more.

    A document without an id, or without words, is nobody's copy and stays.
    """
    judged = neardup.near_duplicates(docs, percent=80, least_equal=38)
    gone = judged.filter(~F.col("kept")).select("doc_id").distinct()
    return lookup_join(docs, gone, ["doc_id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that quote an item of ``benchmark``; one without an id cannot be named and stays."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return lookup_join(docs, found.select("doc_id").distinct(), ["doc_id"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: no SQL scores texts or compares signatures; tests hold the pipeline against its stages done by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
