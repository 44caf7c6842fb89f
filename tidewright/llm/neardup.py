"""Near-duplicate documents: MinHash signatures find candidates, full shingle sets confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from tidewright.llm import blocks
from tidewright.llm.shared import keep
from tidewright.operators.keys import lookup_join

COORDINATES = 64
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 2**63, COORDINATES, np.uint64)
_TAGS = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
#: members of a candidate group compared in one task; larger groups are cut into parts of this many
GROUP = 600
#: members of a larger group that each of its parts is compared with, to tie the parts together
PIVOTS = 16
#: a longer list of documents under one coordinate-value joins its members into one candidate group untested
LIST = 1500


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted, distinct 64-bit hashes of a text's ``width``-word shingles, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width))
    for j in range(width):
        out = (out ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(found: np.ndarray) -> np.ndarray:
    """For each coordinate the smallest value a hash function of its own gives the shingles, tagged with the
    coordinate."""
    low = np.full(COORDINATES, np.uint64(2**64 - 1))
    for part in range(0, len(found), 4096):
        some = found[part : part + 4096, None]
        low = np.minimum(low, ((some ^ _MASKS) * _FACTORS).min(axis=0))
    return (low >> np.uint64(32)) ^ _TAGS


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(2):
            found = shingles(text.as_py() or b"")
            print_ = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
            rows.append((len(found), print_, signature(found).tobytes() if len(found) else None))
        n, prints, signatures = zip(*rows) if rows else ((), (), ())
        columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "version", "n_shingles", "print", "signature"])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``component``, the smallest node connected with it, of every node of ``edges`` (``a``, ``b``).

    Alternates two contractions until nothing changes: each node ties its larger neighbours, then its smaller ones, to
    the smallest node next to it. Rounds grow with the logarithm of the size of a component; each is a written table. The
    smallest neighbour is an aggregate with map-side combine, and the join that hands it out can be split.
    """
    current = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    state = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        larger = lookup_join(both, low, ["a"], "inner").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        larger = keep(larger.distinct(), label)
        low = larger.groupBy("a").agg(F.min("b").alias("low"))
        tied = lookup_join(larger, low, ["a"], "inner")
        smaller = tied.select("a", F.col("low").alias("b")).unionByName(
            tied.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        current = keep(smaller.distinct(), label)
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _connected(close: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the smallest index connected with it."""
    label = np.arange(len(close))
    linked = close | np.eye(len(close), dtype=bool)
    while True:
        low = np.where(linked, label, len(close)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _list_edges(tokens: np.ndarray, ids: np.ndarray, signatures: np.ndarray, least: int) -> np.ndarray:
    """Pairs of ids that connect the documents under each token with ``least`` equal coordinates or more."""
    order, starts = blocks.groups(tokens)
    lengths = np.diff(np.append(starts, len(tokens)))
    edges = []
    twos = starts[lengths == 2]
    a, b = order[twos], order[twos + 1]
    alike = (signatures[a] == signatures[b]).sum(axis=1) >= least
    edges.append(np.column_stack([ids[a[alike]], ids[b[alike]]]))
    for start, n in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist()):
        members = order[start : start + n]
        if n > LIST:
            edges.append(np.column_stack([ids[members[1:]], np.full(n - 1, ids[members[0]])]))
            continue
        of_list = signatures[members]
        equal = np.zeros((n, n), np.uint8)
        for coordinate in range(COORDINATES):
            equal += of_list[:, coordinate, None] == of_list[None, :, coordinate]
        label = _connected(equal >= least)
        moved = np.flatnonzero(label != np.arange(n))
        edges.append(np.column_stack([ids[members[moved]], ids[members[label[moved]]]]))
    return np.unique(np.concatenate(edges), axis=0)


def confirmed(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each shingle set, the smallest index connected with it by links between sets at least ``percent`` alike."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(inverse, minlength=len(every)) > 1
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    owner, place = owner[use], column[inverse[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((n, n), np.float32)
    width = 2048
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, [first, first + width])
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], place[a:b] - first] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    return _connected(100 * common >= percent * union)


def _still_apart(large: DataFrame, tied: DataFrame, numbered: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Cells that bring the members of each large group that are not in its largest component together with every part
    of the group whose set sizes allow a link."""
    known = lookup_join(large, tied.withColumnRenamed("node", "rep"), ["rep"], "left")
    known = keep(known.withColumn("component", F.coalesce("component", "rep")), "tied-groups")
    sizes = known.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n_tied"))
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n_tied"), "component"))
    largest = sizes.withColumn("rank", rank).filter("rank = 1").select("group", F.col("component").alias("largest"))
    apart = lookup_join(known, largest, ["group"], "inner").filter("component <> largest")
    apart = keep(numbered(apart.select("rep", "version", "group", "n_shingles")), "still-apart")

    def spans(frame: DataFrame, prefix: str) -> DataFrame:
        ends = F.min("n_shingles").alias(f"{prefix}_least"), F.max("n_shingles").alias(f"{prefix}_most")
        return frame.groupBy("group", F.col("part").alias(f"{prefix}_part")).agg(*ends)

    low, high = F.greatest("a_least", "b_least"), F.least("a_most", "b_most")  # the larger part's least, the smaller's most
    meets = spans(apart, "a").join(spans(large, "b"), "group").filter(F.lit(100) * high >= F.lit(percent) * low)
    meets = meets.withColumn("cell", F.concat_ws("/", "group", "a_part", "b_part"))
    sides = [
        frame.join(meets.select("group", F.col(f"{prefix}_part").alias("part"), "cell"), ["group", "part"])
        for prefix, frame in (("a", apart), ("b", large))
    ]
    return sides[0].select("rep", "version", "group", "cell").unionByName(sides[1].select("rep", "version", "group", "cell"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    least_equal: int = 42,
    part_rows: int = 20_000,
    bucket_rows: int = 50_000,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id`` and ``kept`` (the id is its component's).

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets of 5-word shingles (fewer words:
    the whole text as one); the component is the smallest id reachable over links. Texts with equal sets are one
    class, told apart by nothing below.

    Each class posts its smallest id under its coordinate-value pairs. By how many classes share each pair, only the
    rarest are posted: two signatures with ``least_equal`` of 64 equal coordinates share one of the 65 - ``least_equal``
    rarest, and pairs no other class has are skipped. Documents under one pair whose signatures
    agree in ``least_equal`` coordinates or more join a candidate group; lists of more than 1,500 are joined
    untested. Inside a group full sets are compared, so what the untested lists add costs time and no result. Groups of
    more than 600 are cut into parts by set size. Each part is first compared within itself and with 16 members drawn from
    the whole group, which ties most copies into one component; then only documents outside the group's largest component
    are compared with the parts whose sizes allow a link, so that work grows with the group times what stays apart in it,
    in tasks of bounded size. Tasks return what connects their documents, not the pairs. Up to ``broadcast_rows`` keys of
    group members (two numbers each) are sent to the tasks that read the texts; of more, the texts are shuffled to them. A
    link at exactly 85 % has 42 equal coordinates with a probability of all but about 1 in 100,000.

    NULL or empty texts, and texts of white space, have no shingles and no links. Rows with one id are one document with
    the links of each of its texts. Rows with a NULL id are linked with nothing: ``component_id`` is NULL and ``kept`` is true.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("version"),
        F.col(f"`{text_col}`").cast("binary").alias("text"),
    )
    described = keep(
        rows.mapInArrow(_describe, "id bigint, version bigint, n_shingles bigint, print binary, signature binary"), "signatures"
    )
    classes = keep(
        described.filter("id is not null and n_shingles > 0")
        .groupBy("print")
        .agg(F.min(F.struct("id", "version", "n_shingles", "signature")).alias("of"))
        .select("print", F.col("of.id").alias("rep"), "of.version", "of.n_shingles", "of.signature"),
        "classes",
    )
    n_classes = classes.count()
    n_parts = max(1, -(-n_classes // part_rows))
    n_buckets = max(1, -(-n_classes // bucket_rows))
    parts = classes.select(
        F.pmod(F.xxhash64("print"), F.lit(n_parts)).cast("int").alias("block"), "rep", "print", "signature"
    ).repartition(n_parts, "block")

    def tokens_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = sorted(range(table.num_rows), key=table["print"].to_pylist().__getitem__)
        raw = table["signature"].to_pylist()
        signatures = np.frombuffer(b"".join(raw[i] for i in order), np.uint64).reshape(-1, COORDINATES)
        mixed = signatures * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return table["rep"].to_numpy()[order], signatures, mixed * np.uint64(0xBF58476D1CE4E5B9)

    def ask(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(tokens_of(table)[2], return_counts=True)
        return blocks.ask(table["block"][0].as_py(), keys, counts.astype(np.uint32), n_buckets)

    def add_up(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        order, starts = blocks.groups(keys)
        out = np.empty(len(keys), np.uint32)
        sums = np.add.reduceat(counts[order], starts) if len(keys) else counts
        out[order] = np.repeat(sums, np.diff(np.append(starts, len(keys))))
        return out

    holders = blocks.answered(parts.groupBy("block").applyInArrow(ask, blocks.ASKED), n_buckets, "<u4", add_up)

    def post(table: pa.Table, replies: pa.Table) -> pa.Table:
        if table.num_rows:
            reps, signatures, tokens = tokens_of(table)
            keys, inverse = np.unique(tokens, return_inverse=True)
            frequency = blocks.replies_of(replies, "<u4")[inverse].reshape(tokens.shape)
            rarest = np.lexsort((tokens, frequency), axis=1)[:, : COORDINATES + 1 - least_equal]
            row = np.repeat(np.arange(len(reps)), rarest.shape[1])
            at = rarest.ravel()
            use = frequency[row, at] > 1
            row, at = row[use], at[use]
            posted = tokens[row, at]
            bits = np.ascontiguousarray((signatures & np.uint64(255)).astype(np.uint8)[row])
            signature_rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), len(row), [None, pa.py_buffer(bits)])
            bucket = (posted % np.uint64(n_buckets)).astype(np.int32)
            columns = (bucket, posted.view(np.int64), reps[row], signature_rows.cast(pa.binary()))
        else:
            columns = ([], [], [], [])
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.table(arrays, ["bucket", "token", "rep", "bits"])

    posted = parts.groupBy("block").cogroup(holders.groupBy("block")).applyInArrow(
        post, "bucket int, token bigint, rep bigint, bits binary"
    )

    def candidates(table: pa.Table) -> pa.Table:
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
        edges = _list_edges(table["token"].to_numpy(), table["rep"].to_numpy(), bits, least_equal)
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    edges = posted.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(candidates, "a bigint, b bigint")
    grouped = components(edges, "candidates").withColumnRenamed("node", "rep").withColumnRenamed("component", "group")

    def numbered(frame: DataFrame) -> DataFrame:  # a class's place by set size in its group, for the large groups
        return frame.withColumn(
            "part", F.floor((F.row_number().over(Window.partitionBy("group").orderBy("n_shingles", "rep")) - 1) / GROUP).cast("int")
        )

    members = keep(lookup_join(classes.select("rep", "version", "n_shingles"), grouped, ["rep"], "inner"), "members")
    texts = rows.filter("id is not null").select(F.col("id").alias("rep"), "version", "text")
    wanted = members.select("rep", "version")
    if wanted.count() <= broadcast_rows:  # else both sides are shuffled
        wanted = F.broadcast(wanted)
    texts = keep(texts.join(wanted, ["rep", "version"]).dropDuplicates(["rep", "version"]), "member-texts")
    group_sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    placed = lookup_join(members, group_sizes, ["group"], "inner")
    small = placed.filter(F.col("n") <= GROUP).select(
        "rep", "version", "group", F.pmod(F.xxhash64("group"), F.lit(max(1, n_classes // 2000))).cast("string").alias("cell")
    )
    large = keep(numbered(placed.filter(F.col("n") > GROUP)), "large-groups")
    drawn = Window.partitionBy("group").orderBy(F.xxhash64("rep", "version"), "rep", "version")
    pivots = large.withColumn("place", F.row_number().over(drawn)).filter(F.col("place") <= PIVOTS)
    of_parts = large.select("group", "part").distinct().join(pivots.select("rep", "version", "group"), "group")
    within = large.select("rep", "version", "group", "part").unionByName(of_parts)
    within = within.select("rep", "version", "group", F.concat_ws("/", "group", "part").alias("cell"))

    def confirm(table: pa.Table) -> pa.Table:
        reps, of_group, versions = (table[c].to_numpy() for c in ("rep", "group", "version"))
        texts_ = table["text"]
        order, starts = blocks.groups(of_group)
        found: list[np.ndarray] = []
        for part in np.split(order, starts[1:]):
            part = part[np.lexsort((versions[part], reps[part]))]
            r, v = reps[part], versions[part]
            part = part[np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])]  # repeated rows
            label = confirmed([shingles(texts_[i].as_py() or b"") for i in part.tolist()], percent)
            moved = np.flatnonzero(label != np.arange(len(part)))
            found.append(np.column_stack([reps[part[moved]], reps[part[label[moved]]]]))
        edges = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    def linked(cells: DataFrame) -> DataFrame:
        together = texts.join(cells, ["rep", "version"]).select("cell", "group", "rep", "version", "text")
        return keep(together.groupBy("cell").applyInArrow(confirm, "a bigint, b bigint"), "links-of-cells")

    links = linked(small.unionByName(within))
    if not large.isEmpty():
        links = links.unionByName(linked(_still_apart(large, components(links, "links-within"), numbered, percent)))
    known = lookup_join(
        described.select("id", "n_shingles", "print"), classes.select("print", "rep"), ["print"], "left"
    )
    known = keep(known.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "class-of-row")
    own = known.filter("id is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last"))
    several = own.filter("a <> last").select("id", "a")  # one id, different texts
    same_id = known.join(several, "id").select("a", F.col("rep").alias("b"))
    joined = components(links.unionByName(same_id), "links").withColumnRenamed("node", "rep")
    out = lookup_join(known, joined, ["rep"], "left").select(
        F.col("id"), "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    # an id that is no class's smallest stands with its class
    return out.select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
