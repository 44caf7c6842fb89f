"""How a query is registered, and what it is given: the tables of one directory and a place to write."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.folders import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``tables.orders`` reads ``<dir>/orders.parquet``; scratch paths lie in the session's checkpoint folder,
    which every executor can reach."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self._directory = directory.rstrip("/")

    def __getattr__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._directory}/{table}.parquet")

    def scratch(self, label: str) -> str:
        base = ensure_checkpoint_dir(self.spark).rstrip("/")
        return f"{base}/tidewright/{label}-{uuid.uuid4().hex[:12]}"

    @staticmethod
    def fresh_name(label: str) -> str:
        return f"{label}_{uuid.uuid4().hex[:12]}"


def case(name: str, sql: str | None = None) -> Callable:
    """Registers ``fn(tables) -> DataFrame`` as a query, with its oracle when there is one."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, directory: fn(Tables(spark, directory))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
