"""Documents in blocks, and questions about fingerprints that all blocks share.

Repeats are found by asking, for very many fingerprints, whether they occur elsewhere. A row for each would cost
more than the work itself, so rows here are arrays: a block of documents sends each bucket of the hash space one
sorted array of the distinct fingerprints it has there, and gets one array of answers in the same order. A fingerprint found
everywhere is one entry per block. Spark partitions, shuffles and, after a loss, computes again; numpy works in the
tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import doc_key

ASKED = "bucket int, block int, keys binary, values binary"
ANSWERS = "block int, bucket int, answers binary"


def sizes(docs: DataFrame, text_col: str, block_bytes: int) -> tuple[int, int]:
    """The number of blocks and the bytes of all texts, for blocks of about ``block_bytes``."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))).alias("n")).first()["n"] or 0
    return max(1, -(-total // block_bytes)), total


def into_blocks(docs: DataFrame, n_blocks: int, *, id_col: str, text_col: str) -> DataFrame:
    """``block``, ``id``, ``missing`` (the id is NULL), ``text`` in bytes, dealt by a hash of id, text and partition.

    The partition a row comes from is a salt: equal rows, however many, go to as many blocks as partitions hold them,
    and a partition that is computed again holds the same rows. Every use of the frame in one plan reads the same
    shuffle.
    """
    rows = docs.select(
        doc_key(id_col).alias("id"),
        F.col(f"`{id_col}`").isNull().alias("missing"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
    )
    dealt = F.xxhash64("id", "text", F.spark_partition_id())
    rows = rows.select(F.pmod(dealt, F.lit(n_blocks)).cast("int").alias("block"), *rows.columns)
    return rows.repartition(n_blocks, "block")


def documents_of(table: pa.Table) -> Iterator[tuple[int, bool, bytes]]:
    """The documents of a block, ordered so that each run over it sees them alike."""
    rows = list(zip(table["id"].to_pylist(), table["missing"].to_pylist(), table["text"].to_pylist()))
    rows.sort(key=lambda r: (r[0], r[2]))
    yield from rows


def ask(block: int, keys: np.ndarray, values: np.ndarray, n_buckets: int) -> pa.Table:
    """Rows for ``ASKED``: the sorted, distinct 64-bit ``keys`` of one block, cut at equal parts of the hash space."""
    edges = np.arange(1, n_buckets, dtype=np.uint64) * np.uint64((2**64 - 1) // n_buckets)
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    rows = [b for b in range(n_buckets) if cuts[b + 1] > cuts[b]]
    return pa.table(
        {
            "bucket": pa.array(rows, pa.int32()),
            "block": pa.array([block] * len(rows), pa.int32()),
            "keys": pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in rows], pa.binary()),
            "values": pa.array([values[cuts[b] : cuts[b + 1]].tobytes() for b in rows], pa.binary()),
        }
    )


def answered(asked: DataFrame, n_buckets: int, value_type: str, answer: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Answers each block's keys, given all blocks' keys and values of the bucket.

    ``answer(keys, values)`` gets them in no particular order, a key once per block that has it, and returns one
    answer for each, as an array of one dtype.
    """

    def reply(table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
        values = np.concatenate([np.frombuffer(v, value_type) for v in table["values"].to_pylist()])
        replies = answer(np.concatenate(raw), values)
        cuts = np.cumsum([0, *map(len, raw)])
        return pa.table(
            {
                "block": table["block"],
                "bucket": table["bucket"],
                "answers": pa.array([replies[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            }
        )

    return asked.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(reply, ANSWERS)


def replies_of(table: pa.Table, dtype: str) -> np.ndarray:
    """A block's answers in the order of the keys it asked."""
    order = np.argsort(table["bucket"].to_numpy(), kind="stable")
    replies = table["answers"].to_pylist()
    return np.frombuffer(b"".join(replies[i] for i in order), dtype)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, starts)``: the stable order that sorts ``keys`` and where each distinct key begins in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, int)
    return order, starts


def in_two_or_more(keys: np.ndarray, several: np.ndarray) -> np.ndarray:
    """For each key, whether two blocks have it or one says that ``several`` of its own places do."""
    order, starts = groups(keys)
    lengths = np.diff(np.append(starts, len(keys)))
    repeated = (lengths > 1) | (np.maximum.reduceat(several[order], starts) > 0) if len(keys) else np.empty(0, bool)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(repeated, lengths)
    return out
