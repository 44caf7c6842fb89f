"""Best-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.shared import keep

#: fixed values: how the vocabulary's tokenizer splits normalised text
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of these characters are their own NFC form and have no white space; others go through the whole tokenizer.
_PLAIN = r"[!-~¡-ɏ]*"


class ChunkEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, with a bounded cache of chunks.

    The tokenizer never joins across white space, so a text's ids are those of its blank-separated chunks. Chunks
    repeat, which makes this several times faster than encoding whole texts; the ids are the same.
    """

    def __init__(self, tokenizer_file: str, max_chunks: int = 600_000) -> None:
        import regex
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(tokenizer_file)
        self._model = self._whole.model
        self._pieces = regex.compile(_SPLIT).findall
        self._plain = regex.compile(_PLAIN).fullmatch
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in kept]
        self._byte_chars = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}
        self._max = max_chunks
        self._cache: dict[str, bytes] = {"": b""}
        self._ids: dict[str, bytes] = {}

    def _encode(self, chunk: str) -> bytes:
        if "<|" in chunk or not self._plain(chunk):
            ids = self._whole.encode(chunk, add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        out = []
        for piece in self._pieces(chunk.lower()):
            ids = self._ids.get(piece)
            if ids is None:
                tokens = self._model.tokenize(piece.encode().decode("latin-1").translate(self._byte_chars))
                ids = self._ids[piece] = b"".join(t.id.to_bytes(4, "little") for t in tokens)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        cache = self._cache
        if len(cache) > self._max:
            cache.clear()
            self._ids.clear()
        for chunk in set(chunks).difference(cache):
            cache[chunk] = self._encode(chunk)
        return b"".join(map(cache.__getitem__, chunks)) if chunks else b""


_encoders: dict[str, ChunkEncoder] = {}  # a Python worker serves many tasks


def token_pieces(
    docs: DataFrame, tokenizer_file: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of a document's token ids (with ``end_id`` after them): the id, ``piece``, ``start``,
    ``length``, ``ids_crc32`` and the ids themselves (``ids``, little-endian unsigned 32-bit).

    Only documents of more than ``capacity`` tokens are cut. A NULL or empty text is the end id alone. The file must
    lie where every executor can read it.
    """
    step = 4 * capacity
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer_file)
        if encoder is None:
            encoder = _encoders[tokenizer_file] = ChunkEncoder(tokenizer_file)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for number, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(rows, (doc, number, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`")).mapInArrow(
        cut, "doc bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    )
    return out.withColumnRenamed("doc", id_col)


class _Capacities:
    """A segment tree over the remaining capacities: the smallest one in use that is at least ``n``, in log time."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.size)

    def mark(self, at: int, used: bool) -> None:
        at += self.size
        self.used[at] = used
        while at > 1:
            at //= 2
            self.used[at] = self.used[2 * at] or self.used[2 * at + 1]

    def tightest(self, n: int) -> int | None:
        at = n + self.size
        while not self.used[at]:
            while at % 2:  # a right child: what follows lies above
                at //= 2
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last leaf of this level
                return None
        while at < self.size:
            at *= 2
            if not self.used[at]:
                at += 1
        return at - self.size


def best_fit(counts: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``(length, how many)``, as batches ``(length, first, n, each, sequence, offset)``.

    Items of one length are alike, so they are placed in batches: items number ``first`` to ``first + n - 1`` of the
    length, ``each`` to a sequence from ``sequence`` on, the first at ``offset`` of its sequence and the others
    behind it. Every sequence gets what it would get if items were placed one by one, longest first, each in the
    open sequence it leaves the least room in. Work and result depend on the number of lengths, not of items.
    """
    open_at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity: ranges of sequences
    tree, batches, sequences = _Capacities(capacity), [], 0

    def put(room: int, sequence: int, n: int) -> None:
        if n and room:
            open_at[room].append((sequence, n))
            tree.mark(room, True)

    for length, count in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a sequence of {capacity}")
        first = 0
        while first < count:
            room = tree.tightest(length)
            left = count - first
            each = (capacity if room is None else room) // length
            if room is None:
                room, sequence, n = capacity, sequences, -(-left // each)
                sequences += n
            else:
                sequence, n = open_at[room].pop()
                if not open_at[room]:
                    tree.mark(room, False)
            full = min(n, left // each)
            if full:
                batches.append((length, first, full * each, each, sequence, capacity - room))
                put(room - each * length, sequence, full)
                first, left = first + full * each, left - full * each
            if full < n and left:  # fewer than a sequence can take
                batches.append((length, first, left, left, sequence + full, capacity - room))
                put(room - left * length, sequence + full, 1)
                first, full = first + left, full + 1
            put(room, sequence + full, n - full)
    return batches


def pack(pieces: DataFrame, *, capacity: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece"), group: int = 20_000) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset`` of their place.

    The placement is that of best-fit decreasing over the whole table. Only the number of pieces of each length comes
    to the driver, at most ``capacity`` rows; the plan made of it is as bounded, and is broadcast. Pieces find their
    place by their number within their length, counted within salted groups of about ``group`` and the sizes of
    the groups before, so a length shared by many pieces is spread over many tasks. Repeated rows each get a place.
    ``pieces`` is read twice and must be the same both times: a table, not a query over a source that moves.
    """
    spark = pieces.sparkSession
    counts = [(r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]
    batches = spark.createDataFrame(
        best_fit(counts, capacity),
        "length bigint, _first bigint, _n bigint, _each bigint, _sequence bigint, _offset bigint",
    )
    groups = spark.createDataFrame([(x, -(-n // group)) for x, n in counts], "length bigint, _groups bigint")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn(
        "_group", F.pmod(F.xxhash64(*keys), F.col("_groups"))
    )
    sizes = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_size"))
    ahead = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "_group", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_group").orderBy(*keys)
    numbered = (
        dealt.withColumn("_number", F.row_number().over(within) - 1)
        .join(before, ["length", "_group"])
        .withColumn("_number", F.col("_number") + F.col("_before"))
    )
    placed = numbered.join(F.broadcast(batches), "length").filter(
        (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_first") + F.col("_n"))
    )
    at = F.col("_number") - F.col("_first")
    return placed.select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes, cuts and packs; one row per piece, as ``token_pieces`` names it, with its place.

    The pieces are kept in the shared folder without their ids, which ``token_pieces`` gives again.
    """
    pieces = token_pieces(docs, tokenizer_file, capacity=capacity, id_col=id_col, text_col=text_col).drop("ids")
    return pack(keep(pieces, "pieces"), capacity=capacity, keys=(id_col, "piece", "start", "ids_crc32"))
