"""Pairs ``src, dst`` kept on disk between rounds, so that a round moves what is new and not what is known."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.folders import ensure_checkpoint_dir


class PairTable:
    """Rows ``src, dst, found`` in the checkpoint folder, dealt over buckets by ``keys``, which are ends of the pairs.

    Grouping by the pair, and joins on just the keys, read the buckets as they are: what was written once is not
    shuffled again. There are as many buckets as the session has shuffle partitions, or more if the caller says so.
    ``found`` is a number that the caller gives to a round; a pair may be added again later, and ``first`` has it with
    its smallest number.

    The table's name is gone after ``release``; its files stay with the other checkpoints, and frames made before can
    still be read.
    """

    def __init__(self, spark: SparkSession, *keys: str, buckets: int = 1) -> None:
        self.spark = spark
        self._keys = keys
        self._name = f"pairs_{uuid.uuid4().hex}"
        self._buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self._made = False

    def add(self, pairs: DataFrame) -> None:
        """Writes each pair of ``src, dst, found`` once."""
        dealt = pairs.select("src", "dst", "found").repartition(self._buckets, *self._keys)
        rows = dealt.groupBy("src", "dst").agg(F.min("found").alias("found"))
        if self._made:
            rows.write.insertInto(self._name)
            return
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/tidewright/{self._name}"
        writer = rows.write.format("parquet").option("path", path)
        writer.bucketBy(self._buckets, *self._keys).sortBy("src", "dst").saveAsTable(self._name)
        self._made = True

    def rows(self) -> DataFrame:
        return self.spark.table(self._name)

    def first(self) -> DataFrame:
        return self.rows().groupBy("src", "dst").agg(F.min("found").alias("found"))

    def has(self, found: int) -> bool:
        """Whether pairs were added under this number, be it again."""
        return not self.rows().filter(F.col("found") == found).isEmpty()

    def most(self, end: str) -> int:
        """The most pairs that one node is this end of."""
        return self.rows().groupBy(end).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    def turned(self) -> DataFrame:
        return self.rows().select(F.col("dst").alias("src"), F.col("src").alias("dst"), "found")

    def release(self) -> None:
        if self._made:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name}")
