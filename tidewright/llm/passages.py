"""Removal of word passages that an earlier document has."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidewright.llm import blocks

#: A perfect difference cover: of any two positions, some shift of both by less than PERIOD brings both to a cover
#: position modulo PERIOD.
PERIOD, COVER = 7, (0, 1, 3)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PAIR = np.dtype([("low", "<u8"), ("id", "<i8")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _window_hashes(words: np.ndarray, starts: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """A 64-bit hash of the ``width`` words from each start."""
    out = np.full(len(starts), np.uint64(width))
    for j in range(width):
        out = (out ^ words[starts + j]) * factor
        out ^= out >> np.uint64(32)
    return _mix(out)


class _Block:
    """The words of a block's documents, one after another, and what each position belongs to."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.rows = list(blocks.documents_of(table))
        hashes = [_word_hashes(text) for _, _, text in self.rows]
        self.sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        self.words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        doc_of = np.repeat(np.arange(len(hashes)), self.sizes)
        self.ids = np.array([r[0] for r in self.rows], np.int64)[doc_of]
        self.place = np.arange(len(self.words)) - self.starts[doc_of]
        self.left = self.sizes[doc_of] - self.place  # words from here to the document's end
        self.anchor_width = window - PERIOD + 1
        on_cover = np.isin(self.place % PERIOD, COVER)
        self.anchors = np.flatnonzero(on_cover & (self.left >= self.anchor_width))

    def anchor_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes, whether documents of several ids have each, and each anchor's place among them."""
        hashes = _window_hashes(self.words, self.anchors, self.anchor_width, _A)
        keys, inverse = np.unique(hashes, return_inverse=True)
        ids = self.ids[self.anchors]
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, ids)
        np.maximum.at(high, inverse, ids)
        return keys, (low != high).astype(np.uint8), inverse

    def candidates(self, repeated: np.ndarray, inverse: np.ndarray, window: int) -> np.ndarray:
        """Starts of the windows that have an anchor which other documents have as well."""
        hit = self.anchors[repeated[inverse] > 0]
        marks = np.zeros(len(self.words) + 1, np.int64)
        # a window from s to s + PERIOD - 1 positions further on takes in the anchor at hit
        np.add.at(marks, np.maximum(hit - PERIOD + 1, 0), 1)
        np.add.at(marks, hit + 1, -1)
        return np.flatnonzero((np.cumsum(marks[:-1]) > 0) & (self.left >= window))


def dedup_passages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 13,
    block_bytes: int = 6_000_000,
    bucket_bytes: int = 24_000_000,
) -> DataFrame:
    """Removes each word in a ``window``-word sequence that a document with a smaller id has as well.

    Words are runs without ``[\\x20\\x09-\\x0D]``, compared unchanged. Returns per row of ``docs``: ``id_col``,
    ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by a space), ``kept_sha256`` and ``spans``
    (array of first and past-the-last word of each removed run).

    Only positions in a difference cover modulo 7 are hashed, over ``window`` - 6 words: two equal windows share at
    least one such anchor at the same place in both. Documents are dealt into blocks; each block asks once which of its distinct
    anchors occur in documents of different ids, and once, for the full windows around those, which smallest id has the
    window (compared by 128 bits). ``block_bytes`` and ``bucket_bytes`` are the text behind one task of documents and of
    hashes. Both questions send one entry per block however often a passage occurs. Windows
    are judged on the input, so the result does not depend on any order of removal.

    A NULL or empty text has no words; a text shorter than the window is kept whole. Rows with one id are one
    document and remove nothing from each other; rows with a NULL id are together one document after all others.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must have more than {PERIOD} words")
    n_blocks, total = blocks.sizes(docs, text_col, block_bytes)
    n_buckets = max(1, -(-total // bucket_bytes))
    dealt = blocks.into_blocks(docs, n_blocks, id_col=id_col, text_col=text_col)

    def anchors(table: pa.Table) -> pa.Table:
        keys, several, _ = _Block(table, window).anchor_keys()
        return blocks.ask(table["block"][0].as_py(), keys, several, n_buckets)

    asked = dealt.groupBy("block").applyInArrow(anchors, blocks.ASKED)
    repeated = blocks.answered(asked, n_buckets, "u1", blocks.in_two_or_more)

    def found(table: pa.Table, replies: pa.Table) -> tuple[_Block, np.ndarray, np.ndarray]:
        block = _Block(table, window)
        _, _, inverse = block.anchor_keys()
        starts = block.candidates(blocks.replies_of(replies, "u1"), inverse, window)
        pairs = np.empty(len(starts), np.dtype([("high", "<u8"), ("low", "<u8")]))
        pairs["high"] = _window_hashes(block.words, starts, window, _A)
        pairs["low"] = _window_hashes(block.words, starts, window, _B)
        return block, starts, pairs

    def windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return blocks.ask(0, np.empty(0, np.uint64), np.empty(0, _PAIR), n_buckets)
        block, starts, pairs = found(table, replies)
        order = np.lexsort((block.ids[starts], pairs["low"], pairs["high"]))
        pairs, ids = pairs[order], block.ids[starts][order]
        first = np.concatenate([[True], pairs[1:] != pairs[:-1]]) if len(pairs) else np.empty(0, bool)
        values = np.empty(int(first.sum()), _PAIR)
        values["low"], values["id"] = pairs["low"][first], ids[first]
        return blocks.ask(table["block"][0].as_py(), pairs["high"][first], values, n_buckets)

    def smallest(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values["id"], values["low"], keys))
        k, low = keys[order], values["low"][order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (low[1:] != low[:-1])])
        out = np.empty(len(keys), np.int64)
        out[order] = values["id"][order][np.flatnonzero(new)][np.cumsum(new) - 1]
        return out

    asked_windows = dealt.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(windows, blocks.ASKED)
    holders = blocks.answered(asked_windows, n_buckets, _PAIR, smallest)
    replies = repeated.withColumn("question", F.lit(0)).unionByName(holders.withColumn("question", F.lit(1)))

    def removed(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _result([])
        question = replies["question"].to_numpy()
        block, starts, pairs = found(table, replies.filter(pa.array(question == 0)))
        owners = blocks.replies_of(replies.filter(pa.array(question == 1)), "<i8")
        _, inverse = np.unique(pairs, return_inverse=True)
        gone = starts[owners[inverse] < block.ids[starts]] if len(starts) else starts
        marks = np.zeros(len(block.words) + 1, np.int64)
        np.add.at(marks, gone, 1)
        np.add.at(marks, gone + window, -1)
        covered = np.cumsum(marks[:-1]) > 0
        return _result(_kept(block, covered))

    def _kept(block: _Block, covered: np.ndarray) -> Iterator[tuple]:
        for (id_, missing, text), start, n in zip(block.rows, block.starts, block.sizes):
            words, cut = text.split(), covered[start : start + n]
            kept = b" ".join([w for w, c in zip(words, cut.tolist()) if not c] if cut.any() else words)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
            yield None if missing else id_, n, cut.sum(), kept, hashlib.sha256(kept).hexdigest(), edges

    def _result(rows) -> pa.Table:  # noqa: ANN001
        columns = list(zip(*rows)) or [()] * 6
        spans = [[{"first": int(a), "beyond": int(b)} for a, b in e.reshape(-1, 2)] for e in columns[5]]
        return pa.table(
            {
                "id": pa.array(columns[0], pa.int64()),
                "n_words": pa.array(columns[1], pa.int64()),
                "n_removed": pa.array(columns[2], pa.int64()),
                "kept": pa.array(columns[3], pa.binary()).cast(pa.string()),
                "kept_sha256": pa.array(columns[4], pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("beyond", pa.int64())]))),
            }
        )

    out = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        removed,
        "id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string, "
        "spans array<struct<first: bigint, beyond: bigint>>",
    )
    return out.withColumnRenamed("id", id_col)
