"""Line deduplication across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import SPACE, ascii_lower, doc_key, with_columns
from tidewright.operators.keys import lookup_join


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """Drops lines that occur in ``min_docs`` documents or more, except in the document with the smallest id.

    A line's key is the line without white space at its ends, A-Z in lower case; keys of fewer than ``min_chars``
    code points are never dropped. Returns every row of ``docs`` with all its columns, its text made of the lines
    that stay, and ``n_lines`` (before dropping), ``n_dropped``, ``kept_sha256`` (columns of these names are
    replaced).

    Lines travel as 128 bits of hash and a position. Documents per key are counted with map-side combine, so a
    line found everywhere costs a row per task; the lookup of dropped keys is a join that adaptive execution can
    split. Texts are shuffled once, to meet the positions they lose.

    A NULL or empty text is one empty line and its text comes back empty. Rows with one id are one document: a
    line repeated among them only is no repeat. Rows with a NULL id are together one document after all others.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        doc_key(id_col).alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ).withColumn("version", F.xxhash64("text"))
    lines = rows.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = (
        lines.withColumn("key", ascii_lower(F.trim("line", F.lit(SPACE))))
        .filter(F.length("key") >= min_chars)
        .select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    if min_docs == 2:  # two documents at least: the smallest id differs from the largest
        holders = keyed.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        repeated = holders.filter(F.col("first") < F.col("last"))
    else:
        once = keyed.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        holders = once.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("one").alias("n_docs"))
        repeated = holders.filter(F.col("n_docs") >= min_docs)
    dropped = (
        lookup_join(keyed, repeated.select("h1", "h2", "first"), ["h1", "h2"], "inner")
        .filter(F.col("id") > F.col("first"))
        .groupBy("id", "version")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    split = (
        lookup_join(rows, dropped, ["id", "version"], "left")
        .withColumn("lines", F.split("text", "\n", -1))
        .withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
        .withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped"))
        .withColumn("kept", F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
    )
    return with_columns(
        "row",
        split,
        **{
            text_col: F.col("kept"),
            "n_lines": F.size("lines").cast("bigint"),
            "n_dropped": F.size("dropped").cast("bigint"),
            "kept_sha256": F.sha2(F.col("kept"), 256),
        },
    )
