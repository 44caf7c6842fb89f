"""Finds passages of a benchmark in documents, word substitutions allowed."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import doc_key, keep

#: Spaced seeds: a 1 takes the word at this place, a 0 ignores it. ``masks_by_length`` picks those for items of each
#: length; the first five leave a seed wherever three of 13 words are changed.
MASKS = ("1110111", "1101001011", "110110011", "11000101011", "1110000111", "1")
#: What items of 2 to 11 words need besides.
SHORT_MASKS = ("1101011", "1100000111", "111011", "110100011", "10011101", "11101", "100000111", "11011", "10111", "1111", "111", "11")

#: words of a document that travel together where the seeds are too many to be sent around
PIECE = 64


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case; empty at either end of a text that begins or ends with others."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def _places(mask: str) -> list[int]:
    return [place for place, bit in enumerate(mask) if bit == "1"]


def masks_by_length(masks: Sequence[str], window: int, min_equal: int) -> dict[str, list[int]]:
    """Masks, each with the item lengths it is for (``window`` stands for all from there on), such that every way to
    change as many words as the rule allows leaves a place for one of the length's masks.

    Takes heavy masks first, and of ``masks`` and ``SHORT_MASKS`` only those that add something. Where they do not suffice, the unchanged
    run that any such change leaves is a mask as well.
    """
    if not 0 < min_equal <= window:
        raise ValueError("min_equal must be between 1 and window")
    out: dict[str, list[int]] = {}
    for length in range(1, window + 1):
        equal = -(-length * min_equal // window)
        changes = length - equal
        left = None
        if math.comb(length, changes) <= 20_000:
            left = [set(c) for c in itertools.combinations(range(length), changes)]
            for mask in sorted((*masks, *SHORT_MASKS), key=lambda m: -m.count("1")):
                taken = [{start + p for p in _places(mask)} for start in range(length - len(mask) + 1)]
                still = [c for c in left if not any(t.isdisjoint(c) for t in taken)]
                if len(still) < len(left):
                    out.setdefault(mask, []).append(length)
                left = still
        if left is None or left:
            out.setdefault("1" * -(-equal // (changes + 1)), []).append(length)
    return out


def _seed(words_: Column, start: Column, number: Column, masks: dict[int, str]) -> Column:
    """The hash of the words that the mask of a number takes from ``start`` on."""
    return functools.reduce(
        lambda other, m: F.when(
            number == m[0], F.xxhash64(F.lit(m[0]), *[F.get(words_, start + p) for p in _places(m[1])])
        ).otherwise(other),
        masks.items(),
        F.lit(None).cast("bigint"),
    )


def benchmark_seeds(items: DataFrame, masks: dict[str, list[int]], window: int) -> DataFrame:
    """``item``, ``item_version``, ``item_at``, ``number`` (of the mask), ``seed`` for each place a mask for its length
    fits in ``item_words``, and the seed's rarest word: ``anchor`` (its hash) and ``anchor_at`` within the mask.

    Rare is what the benchmark itself has seldom, then what is long. Looking for a seed only where its rarest word is
    spares hashing the others everywhere.
    """
    placed = items.select("item", "item_version", F.posexplode("item_words").alias("at", "word"))
    counts = placed.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    listed = (
        placed.join(counts, "word")
        .groupBy("item", "item_version", "at", "word")
        .agg(F.min(F.struct("n", (-F.length("word")).alias("short"), F.xxhash64("word").alias("hash"))).alias("rank"))
        .groupBy("item", "item_version")  # the words of one item
        .agg(F.sort_array(F.collect_list(F.struct("at", "word", "rank"))).alias("listed"))
        .select("item", "item_version", F.col("listed.word").alias("words"), F.col("listed.rank").alias("ranks"))
    )
    choices = [
        F.struct(
            F.lit(number).alias("number"),
            F.lit(len(mask)).alias("span"),
            F.array(*map(F.lit, _places(mask))).alias("places"),
            F.array(*map(F.lit, lengths)).alias("lengths"),
        )
        for number, (mask, lengths) in enumerate(masks.items())
    ]
    fits = (
        listed.withColumn("mask", F.explode(F.array(*choices)))
        .filter(F.array_contains("mask.lengths", F.least(F.size("words"), F.lit(window))))
        .withColumn("item_at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("mask.span"))))
    )
    at_places = F.transform("mask.places", lambda p: F.struct(F.get("ranks", F.col("item_at") + p).alias("rank"), p.alias("at")))
    return fits.withColumn("rarest", F.array_min(at_places)).select(
        "item",
        "item_version",
        "item_at",
        "mask.number",
        _seed(F.col("words"), F.col("item_at"), F.col("mask.number"), dict(enumerate(masks))).alias("seed"),
        F.col("rarest.rank.hash").alias("anchor"),
        F.col("rarest.at").alias("anchor_at"),
    )


def _seeded_by_pieces(split: DataFrame, anchors: DataFrame, masks: dict[int, str], start: Column) -> DataFrame:
    """``doc, version, start, seed`` of every anchor found, with rows of bounded size in every shuffle.

    Positions travel as hashes to the anchors; where one is met, it meets the piece of ``PIECE`` words it lies in, with
    as many words on either side as a mask is long.
    """
    margin = max(map(len, masks.values()), default=0)
    at = split.select("doc", "version", F.posexplode(F.transform("doc_words", lambda w: F.xxhash64(w))).alias("at", "anchor"))
    met = at.join(anchors, "anchor").withColumn("start", start).filter("start >= 0")
    met = met.select("doc", "version", F.floor(F.col("at") / PIECE).cast("int").alias("piece"), "start", "number")
    number = F.explode(F.sequence(F.lit(0), F.floor((F.size("doc_words") - 1) / PIECE).cast("int")))
    pieces = split.filter(F.size("doc_words") > 0).select("doc", "version", "doc_words", number.alias("piece"))
    first = F.greatest(F.col("piece") * PIECE - margin, F.lit(0))
    pieces = pieces.select(
        "doc", "version", "piece", first.alias("first"), F.slice("doc_words", first + 1, PIECE + 2 * margin).alias("words")
    )
    # equal rows of a text give equal pieces; one of them is enough
    joined = met.join(pieces.distinct(), ["doc", "version", "piece"])
    seed = _seed(F.col("words"), F.col("start") - F.col("first"), F.col("number"), masks)
    return joined.select("doc", "version", "start", seed.alias("seed")).filter("seed IS NOT NULL")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: Sequence[str] = MASKS,
    window: int = 13,
    min_equal: int = 10,
    broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """Pairs of a document and a benchmark item it quotes: ``window`` aligned words, ``min_equal`` of them equal.

    Returns ``id_col``, ``item_col``, ``n_equal`` (equal words of the best window), ``n_overlap`` (equal words over
    the whole alignment), ``doc_word`` (where the item's first word would lie in the document's words; can be
    negative) and ``window`` (words compared), the best alignment of each pair. Documents without a hit are absent.

    Each word of each document is looked up among the anchors, the rarest words of the benchmark's seeds; where
    one is found, the seed around it is hashed and meets the benchmark's hashes in an equi-join. Both tables are
    broadcast while the benchmark is counted to have no more than ``broadcast_rows`` seeds (about 50 bytes each);
    beyond that positions travel as hashes and meet pieces of ``PIECE`` words, so that no row grows with its text. Hits are reduced to document, item and alignment, and only the documents
    that have any are read again to compare the words around the hits.

    Items of fewer than ``window`` words are compared whole, with as many differences in proportion: two in 9 to 12
    words, one in 5 to 8, none in fewer. Every pair within the rule is found, wherever the differences lie
    (``masks_by_length``). Texts or items without words have no hit; items with a NULL id and documents with a NULL id
    are left out, since a pair could not name them.
    """
    rows = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(
        doc_key(id_col).alias("doc"), F.col(f"`{text_col}`").alias("text")
    )
    rows = rows.withColumn("version", F.xxhash64("text"))
    items = benchmark.filter(F.col(f"`{item_col}`").isNotNull()).select(
        F.col(f"`{item_col}`").alias("item"),
        F.filter(words(F.col(f"`{item_text_col}`")), lambda w: w != "").alias("item_words"),
    )
    items = items.withColumn("item_version", F.xxhash64("item_words")).distinct()
    by_length = masks_by_length(masks, window, min_equal)
    seeds = benchmark_seeds(items, by_length, window)
    n_seeds = {r["number"]: r["count"] for r in seeds.groupBy("number").count().collect()}
    bounded = sum(n_seeds.values()) <= broadcast_rows
    send = F.broadcast if bounded else (lambda df: df)
    anchors = seeds.select("anchor", "number", "anchor_at").distinct()
    postings = seeds.select("seed", "item", "item_version", "item_at").distinct()
    used = {number: mask for number, mask in enumerate(by_length) if number in n_seeds}
    taken = _seed(F.col("doc_words"), F.col("start"), F.col("number"), used)
    split = rows.select("doc", "version", words(F.col("text")).alias("doc_words"))
    start = F.col("at") - F.col("anchor_at")
    if bounded:  # the words stay beside each position: nothing is shuffled, so none is copied
        placed = split.select("doc", "version", "doc_words", F.posexplode("doc_words").alias("at", "word"))
        hits = placed.withColumn("anchor", F.xxhash64("word")).join(send(anchors), "anchor").withColumn("start", start)
        seeded = hits.filter("start >= 0").select("doc", "version", "start", taken.alias("seed"))
    else:
        seeded = _seeded_by_pieces(split, anchors, used, start)
    found = (
        seeded.join(send(postings), "seed")
        .select("doc", "version", "item", "item_version", (F.col("start") - F.col("item_at")).alias("doc_word"))
        .distinct()
    )
    alignments = keep(found, "alignments")  # read twice below
    quoting = alignments.select("doc", "version").distinct()
    texts = rows.join(quoting, ["doc", "version"], "left_semi").select(
        "doc", "version", words(F.col("text")).alias("doc_words")
    )
    compared = (
        alignments.join(items, ["item", "item_version"])
        .join(texts, ["doc", "version"])
        .withColumn("first", F.greatest(F.lit(0), -F.col("doc_word")))
        .withColumn("beyond", F.least(F.size("item_words"), F.size("doc_words") - F.col("doc_word")))
        .withColumn(
            "equal",
            F.transform(
                F.sequence(F.col("first"), F.col("beyond") - 1),
                lambda j: (F.get("item_words", j) == F.get("doc_words", j + F.col("doc_word"))).cast("int"),
            ),
        )
        .withColumn("window", F.least(F.lit(window), F.size("item_words")))
        .filter(F.size("equal") >= F.col("window"))
        .withColumn(
            "n_equal",
            F.array_max(
                F.transform(
                    F.sequence(F.lit(1), F.size("equal") - F.col("window") + 1),
                    lambda s: F.aggregate(F.slice("equal", s, F.col("window")), F.lit(0), lambda a, x: a + x),
                )
            ),
        )
        .filter(F.col("n_equal") * window >= F.col("window") * min_equal)
    )
    best = F.struct(
        F.col("n_equal"),
        F.aggregate("equal", F.lit(0), lambda a, x: a + x).alias("n_overlap"),
        (-F.col("doc_word")).alias("order"),
        F.col("window"),
    )
    return (
        compared.groupBy("doc", "item")
        .agg(F.max(best).alias("best"))
        .select(
            F.col("doc").alias(id_col),
            F.col("item").alias(item_col),
            F.col("best.n_equal").cast("bigint").alias("n_equal"),
            F.col("best.n_overlap").cast("bigint").alias("n_overlap"),
            (-F.col("best.order")).cast("bigint").alias("doc_word"),
            F.col("best.window").cast("bigint").alias("window"),
        )
    )
