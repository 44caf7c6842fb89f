"""Removal of byte strings that occur twice, by column-wise sorting of aligned segments."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tidewright.llm import blocks

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: windows of a block that are hashed at a time, so that a block of any size needs memory for one piece; with a window
#: more, their places fit into the low bits of a hash
PIECE, _PLACE = 1 << 21, np.uint64(2**24 - 1)
SEGMENTS = "bucket int, block int, segments binary, shapes binary"
#: of a segment: bytes before its anchor, all bytes, whether its block has it more than once
_SHAPE = np.dtype([("before", "<u2"), ("length", "<u2"), ("several", "u1")])
#: of a window under a crowded anchor: the second half of its digest, whether its block has it more than once
_WINDOW = np.dtype([("rest", ">u8"), ("several", "u1")])
#: what is known of an anchor
ALONE, SHARED, CROWDED = range(3)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _runs(data: np.ndarray, lo: int, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the windows that start in one piece and lie in one document: runs with one anchor, each run's anchor, first
    window, number of windows, and the anchor's hash."""
    n = min(PIECE, len(data) - window + 1 - lo)
    piece = data[lo : lo + n + window - 1]
    sums = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(piece)), out=sums[1:])
    grams = len(piece) - gram + 1
    hashes = _mix((sums[gram:] - sums[: len(sums) - gram]) * _powers(_UNBASE, grams))
    del sums
    smallest = (hashes & ~_PLACE) | np.arange(grams, dtype=np.uint64)  # of equal ones the first
    width, reach = 1, window - gram + 1
    while width < reach:
        step = min(width, reach - width)
        smallest = np.minimum(smallest[:-step], smallest[step:])
        width += step
    inside = np.ones(n, bool)
    for end in ends[(ends > lo) & (ends < lo + n + window - 1)]:
        inside[max(0, end - lo - window + 1) : max(0, end - lo)] = False
    at = np.flatnonzero(inside)
    anchors = (smallest[at] & _PLACE).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else at
    counts = np.diff(np.append(starts, len(at)))
    return anchors[starts] + lo, at[starts] + lo, counts, hashes[anchors[starts]]


class _Block:
    """The bytes of a block's documents, and the anchor of every window of ``window`` bytes.

    The anchor of a window is its ``gram``-byte string with the smallest hash, the first if there are several: equal
    windows have equal anchors at the same place. The windows of one anchor start one after another, so an anchor
    stands for a segment: from the first such window's first byte to the last one's last.
    """

    def __init__(self, table: pa.Table, window: int, gram: int) -> None:
        self.rows = list(blocks.documents_of(table))
        self.sizes = np.array([len(r[2]) for r in self.rows], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = b"".join(r[2] for r in self.rows)
        data, ends = np.frombuffer(self.joined, np.uint8), self.starts + self.sizes
        found = [_runs(data, lo, ends, window, gram) for lo in range(0, max(0, len(data) - window + 1), PIECE)]
        anchors, first, n_windows, hashes = (np.concatenate(c) for c in zip(*found)) if found else [np.empty(0, int)] * 4
        # a run that goes on in the next piece is one run
        whole = np.ones(len(anchors), bool)
        whole[1:] = (anchors[1:] != anchors[:-1]) | (first[1:] != first[:-1] + n_windows[:-1])
        runs = np.flatnonzero(whole)
        self.anchors, self.first = anchors[runs], first[runs]
        self.n_windows = np.add.reduceat(n_windows, runs) if len(runs) else n_windows
        keys = _mix(hashes[runs].astype(np.uint64))  # anchors have small hashes: mixed again, they spread over all buckets
        self.keys, self.key_of, counts = np.unique(keys, return_inverse=True, return_counts=True)
        self.window = window
        #: per anchor, the number of its different segments, doubled, plus 1 if it occurs more than once
        self.held = np.full(len(counts), 2, np.uint32)
        again = np.flatnonzero(counts[self.key_of] > 1)
        if len(again):
            prints = np.empty((len(again), 2), np.uint64)
            prints[:, 0] = self.key_of[again]
            for k, (i, a, b) in enumerate(zip(again.tolist(), self.first[again].tolist(), self.beyond(again).tolist())):
                prints[k, 1] = xxh3_64_intdigest(self.joined[a:b], seed=int(self.anchors[i]) - a)
            of_key = np.unique(prints, axis=0)[:, 0].astype(np.int64)
            keys, different = np.unique(of_key, return_counts=True)
            self.held[keys] = different * 2 + 1

    def beyond(self, runs: np.ndarray) -> np.ndarray:
        return (self.first + self.n_windows - 1 + self.window)[runs]

    def crowded(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows under crowded anchors: where each starts, its number, and by number the digests' first
        halves, ascending, and the rest as ``_WINDOW``."""
        runs = np.flatnonzero(known[self.key_of] == CROWDED)
        n = self.n_windows[runs]
        starts = np.repeat(self.first[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        digests = b"".join(xxh3_128_digest(self.joined[a : a + self.window]) for a in starts.tolist())
        halves = np.frombuffer(digests, ">u8").reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        ordered = halves[order]
        new = np.ones(len(ordered), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        numbers = np.empty(len(ordered), np.int64)
        numbers[order] = np.cumsum(new) - 1
        shapes = np.empty(int(new.sum()), _WINDOW)
        shapes["rest"] = ordered[new, 1]
        shapes["several"] = np.bincount(numbers, minlength=len(shapes)) > 1
        return starts, numbers, ordered[new, 0].astype(np.uint64), shapes

    def segments(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Of the anchors that occur elsewhere and are not crowded: their numbers, each one's segment, and the distinct segments with
        their shapes, ordered by the anchor's hash."""
        hits = np.flatnonzero(known[self.key_of] == SHARED)
        hits = hits[np.argsort(self.key_of[hits], kind="stable")]
        before = (self.anchors - self.first)[hits]
        beyond = self.beyond(hits)
        numbers: dict[tuple[int, bytes], int] = {}
        counts: list[int] = []
        of_hit = np.empty(len(hits), np.int64)
        for k, (a, b, left) in enumerate(zip(self.first[hits].tolist(), beyond.tolist(), before.tolist())):
            number = numbers.setdefault((left, self.joined[a:b]), len(counts))
            if number == len(counts):
                counts.append(0)
            counts[number] += 1
            of_hit[k] = number
        shapes = np.empty(len(counts), _SHAPE)
        shapes["before"] = [left for left, _ in numbers]
        shapes["length"] = [len(s) for _, s in numbers]
        shapes["several"] = np.array(counts, np.int64) > 1
        keys = np.empty(len(counts), np.uint64)
        keys[of_hit] = self.keys[self.key_of[hits]]
        return hits, of_hit, [s for _, s in numbers], shapes, keys


def _known(crowd: int):  # noqa: ANN202
    """Answers what is known of each anchor, given what all blocks hold of it."""

    def answer(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
        order, starts = blocks.groups(keys)
        lengths = np.diff(np.append(starts, len(keys)))
        held = held[order].astype(np.int64)
        shared = (lengths > 1) | (np.maximum.reduceat(held & 1, starts) > 0)
        of_key = np.where(shared, np.where(np.add.reduceat(held >> 1, starts) > crowd, CROWDED, SHARED), ALONE)
        out = np.empty(len(keys), np.uint8)
        out[order] = np.repeat(of_key, lengths)
        return out

    return answer


def _windows_elsewhere(keys: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each window a block holds, whether another block holds it or its own does several times."""
    order = np.lexsort((windows["rest"], keys))
    keys, rest, several = keys[order], windows["rest"][order], windows["several"][order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rest[1:] != rest[:-1])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(keys)))
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat((lengths > 1) | (np.maximum.reduceat(several, starts) > 0), lengths)
    return out


def repeated_windows(segments: list[bytes], before: np.ndarray, groups: np.ndarray, window: int, reach: int) -> np.ndarray:
    """Which windows of each segment occur in another of its group: a row per segment, a column per start.

    The segments are aligned at their anchors and built up column by column: each round takes one symbol of every
    segment, moves the segments, stably, into the order of that symbol within their group, and updates, between
    neighbours, the column from which they agree. The order after a column is that of the segments read backwards
    from it, so the symbols taken in that order are the column's Burrows-Wheeler string, and the longest common
    strings that end there are those of neighbours. ``segments`` must be distinct, ``groups`` ascending.
    """
    m, columns = len(segments), reach - 1 + window
    lengths = np.fromiter(map(len, segments), np.int64, m)
    left = reach - 1 - before
    rows = np.full((m, columns), 256, np.uint16)  # 256: outside the segment
    for row, start, segment in zip(rows, left.tolist(), segments):
        row[start : start + len(segment)] = np.frombuffer(segment, np.uint8)
    symbols = np.ascontiguousarray(rows.T)
    del rows
    order = np.arange(m)
    new_group = np.concatenate([[True], groups[1:] != groups[:-1]])
    agree = np.where(new_group, columns + 1, 0)  # a segment and the one before it agree from this column on
    group_key = (np.cumsum(new_group) - 1) * 512
    out = np.zeros((m, reach), bool)
    for column in range(columns):
        taken = symbols[column][order]
        keyed = group_key + taken
        moved = np.argsort(keyed, kind="stable")
        keyed = keyed[moved]
        same = np.flatnonzero(keyed[1:] == keyed[:-1]) + 1
        low, high = moved[same - 1] + 1, moved[same] + 1
        now = np.full(m, column + 1)
        now[new_group] = columns + 1
        if len(same):
            far = high - low > 1
            values = agree[low]
            if far.any():
                edges = np.column_stack([low[far], high[far]]).ravel()
                values[far] = np.maximum.reduceat(np.append(agree, 0), edges)[::2]
            now[same] = values
        order, agree = order[moved], now
        if column >= window - 1:
            long = agree <= column - window + 1
            long[:-1] |= long[1:]
            hit = order[long]
            start = column - window + 1 - left[hit]
            fits = (start >= 0) & (start <= lengths[hit] - window)
            out[hit[fits], start[fits]] = True
    return out


def dedup_bytes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 200,
    gram: int = 64,
    block_bytes: int = 3_000_000,
    bucket_bytes: int = 5_000_000,
    crowd: int = 5_000,
) -> DataFrame:
    """Removes each byte in a ``window``-byte string that also starts anywhere else, in the same text or another.

    Texts are UTF-8 bytes. Returns per row of ``docs``: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs), ``kept`` (the other bytes, binary), ``kept_sha256`` and ``spans`` (first and past-the-last byte of
    each run). Strings are judged on the input, overlapping ones too.

    Column-wise construction takes a round per symbol of the longest document, each over the whole collection. Here
    documents are cut at anchors found in the text itself (each window's ``gram``-byte string of smallest hash), so
    that equal windows lie in segments with equal anchors, and no segment is longer than 2 * ``window`` - ``gram``
    bytes: that bounds the rounds. Blocks ask which anchors occur elsewhere, send the distinct segments around those,
    and the collection of each bucket of anchors is sorted column by column (``repeated_windows``). A segment's
    copies travel once per block. ``block_bytes`` and ``bucket_bytes`` are the text behind one task.

    A phrase that is an anchor in very many texts has a segment in each. Anchors with more than ``crowd`` segments,
    added up over blocks, are split by their windows instead: those are dealt by a 128-bit digest, each once per
    block, and repeated where two blocks hold the digest. So no task has more of one key than ``crowd`` segments or an
    entry for each block.

    A NULL or empty text has no bytes; texts shorter than the window are kept whole. Each row is a text of its own,
    whatever its id: of repeated rows every one loses what they share.
    """
    if not 0 < gram <= window < 2**15:
        raise ValueError("gram must be between 1 and window")
    reach = window - gram + 1
    n_blocks, total = blocks.sizes(docs, text_col, block_bytes)
    n_buckets = max(1, -(-total // bucket_bytes))
    dealt = blocks.into_blocks(docs, n_blocks, id_col=id_col, text_col=text_col)
    width = -(-reach // 8)

    def anchors(table: pa.Table) -> pa.Table:
        block = _Block(table, window, gram)
        return blocks.ask(table["block"][0].as_py(), block.keys, block.held, n_buckets)

    asked = dealt.groupBy("block").applyInArrow(anchors, blocks.ASKED)
    known = blocks.answered(asked, n_buckets, "<u4", _known(crowd))

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows:
            block, number = _Block(table, window, gram), table["block"][0].as_py()
            of_anchors = blocks.replies_of(replies, "u1")
            _, _, segments, shapes, keys = block.segments(of_anchors)
            edges = np.arange(1, n_buckets, dtype=np.uint64) * np.uint64((2**64 - 1) // n_buckets)
            cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[b], cuts[b + 1])
                rows.append((b, number, b"".join(segments[part]), shapes[part].tobytes()))
            _, _, halves, windows = block.crowded(of_anchors)
            for row in blocks.ask(number, halves, windows, n_buckets).to_pylist():  # buckets of their own
                rows.append((n_buckets + row["bucket"], number, row["keys"], row["values"]))
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "block", "segments", "shapes"])

    sent = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send, SEGMENTS)

    def answers_to(table: pa.Table, answers: list[bytes]) -> pa.Table:
        return pa.table({"block": table["block"], "bucket": table["bucket"], "answers": pa.array(answers, pa.binary())})

    def sort(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() >= n_buckets:
            keys = [np.frombuffer(k, np.uint64) for k in table["segments"].to_pylist()]
            windows = np.concatenate([np.frombuffer(v, _WINDOW) for v in table["shapes"].to_pylist()])
            elsewhere = _windows_elsewhere(np.concatenate(keys), windows)
            cuts = np.cumsum([0, *map(len, keys)])
            return answers_to(table, [elsewhere[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])
        numbers: dict[tuple[bytes, int, bytes], int] = {}
        several: list[bool] = []
        of_block: list[list[int]] = []
        for joined, raw in zip(table["segments"].to_pylist(), table["shapes"].to_pylist()):
            shapes, at, mine = np.frombuffer(raw, _SHAPE), 0, []
            for before, length, more in shapes.tolist():
                segment = joined[at : at + length]
                at += length
                number = numbers.setdefault((segment[before : before + gram], before, segment), len(several))
                if number == len(several):
                    several.append(bool(more))
                else:
                    several[number] = True
                mine.append(number)
            of_block.append(mine)
        ordered = sorted(numbers)
        names = [numbers[s] for s in ordered]
        found = np.zeros((len(names), reach), bool)
        grams = [s[0] for s in ordered]
        group = np.cumsum([True, *(a != b for a, b in zip(grams, grams[1:]))]) - 1 if grams else np.empty(0, int)
        varied = np.flatnonzero(np.bincount(group)[group] > 1) if grams else group
        if len(varied):
            before = np.array([ordered[i][1] for i in varied], np.int64)
            windows = repeated_windows([ordered[i][2] for i in varied], before, group[varied], window, reach)
            found[np.array(names)[varied]] = windows
        found[np.array(several, bool)] = True
        packed = np.packbits(found, axis=1)
        return answers_to(table, [packed[mine].tobytes() for mine in of_block])

    found = sent.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(sort, blocks.ANSWERS)
    question = F.when(F.col("bucket") < n_buckets, 1).otherwise(2)
    replies = known.withColumn("question", F.lit(0)).unionByName(found.withColumn("question", question))

    def removed(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows:
            asked = replies["question"].to_numpy()
            of_anchors, answers, of_windows = (blocks.replies_of(replies.filter(pa.array(asked == q)), "u1") for q in range(3))
            block = _Block(table, window, gram)
            hits, of_hit, _, _, _ = block.segments(of_anchors)
            answers = answers.reshape(-1, width)
            starts, numbers, _, _ = block.crowded(of_anchors)
            gone = starts[of_windows[numbers] > 0]
            marks = np.zeros(len(block.joined) + 1, np.int32)
            np.add.at(marks, gone, 1)
            np.add.at(marks, gone + window, -1)
            for part in range(0, len(hits), 50_000):
                some = hits[part : part + 50_000]
                bits = np.unpackbits(answers[of_hit[part : part + 50_000]], axis=1)[:, :reach]
                hit, start = np.nonzero(bits & (np.arange(reach) < block.n_windows[some][:, None]))
                gone = block.first[some][hit] + start
                np.add.at(marks, gone, 1)
                np.add.at(marks, gone + window, -1)
            covered = (np.cumsum(marks[:-1], dtype=np.int32) > 0).view(np.uint8)
            for (id_, missing, text), start, n in zip(block.rows, block.starts.tolist(), block.sizes.tolist()):
                cut = covered[start : start + n]
                kept = np.frombuffer(text, np.uint8)[cut == 0].tobytes() if cut.any() else text
                edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
                spans = [{"first": a, "beyond": b} for a, b in edges.reshape(-1, 2).tolist()]
                digest = hashlib.sha256(kept).hexdigest()
                rows.append((None if missing else id_, n, n - len(kept), len(spans), kept, digest, spans))
        columns = list(zip(*rows)) or [()] * 7
        span = pa.list_(pa.struct([("first", pa.int64()), ("beyond", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), span)
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    out = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        removed,
        "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string, "
        "spans array<struct<first: bigint, beyond: bigint>>",
    )
    return out.withColumnRenamed("id", id_col)
