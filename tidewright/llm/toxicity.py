"""Toxicity scores from class-conditional Kneser-Ney word models."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewright.llm.shared import keep

_WORD = re.compile(r"[^\W_]+")
DISCOUNT = 0.75
#: words of the corpus that a task adds up at a time
COUNTED_WORDS = 4_000_000


def word_hashes(text: str) -> np.ndarray:
    """A 63-bit hash of each run of letters and digits, in lower case; never 0, which stands for a text's start."""
    words = _WORD.findall(text.lower())
    hashes = np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))
    return (hashes >> np.uint64(1)) | np.uint64(1)


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((before << np.uint64(1)) ^ words).view(np.int64)


def pairs_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of neighbouring words of a text, each once, the first word after a 0."""
    words = word_hashes(text or "")
    before = np.concatenate([np.zeros(1, np.uint64), words[:-1]]) if len(words) else words
    _, first = np.unique(pair_keys(before, words), return_index=True)
    return before[first].view(np.int64), words[first].view(np.int64)


@dataclass(frozen=True)
class ToxicityModel:
    """Log-ratios of the toxic and the ordinary model by sorted keys: of pairs with counts of their own, and of words
    where the pair has none. All else has the same backoff probability in both models, so its ratio is 0."""

    words: np.ndarray
    word_ratio: np.ndarray
    pairs: np.ndarray
    pair_ratio: np.ndarray
    prior_words: int = 30
    slope: float = 1.0
    offset: float = 0.0

    def mean_ratios(self, texts: pd.Series) -> np.ndarray:
        """The sum of the log-ratios of each text's distinct pairs over their number, ``prior_words`` added to it so
        that a few words decide little; 0 for a text without words."""
        found = [pairs_of(t) for t in texts]
        sizes = np.fromiter((len(w) for _, w in found), np.int64, len(found))
        if not sizes.sum():
            return np.zeros(len(found))
        before, words = (np.concatenate(c) for c in zip(*found))
        ratio = np.zeros(len(words))
        keys = pair_keys(before.view(np.uint64), words.view(np.uint64))
        for known, of_known, looked_up in ((self.words, self.word_ratio, words), (self.pairs, self.pair_ratio, keys)):
            if len(known):
                at = np.minimum(np.searchsorted(known, looked_up), len(known) - 1)
                hit = known[at] == looked_up
                ratio[hit] = of_known[at[hit]]
        totals = np.bincount(np.repeat(np.arange(len(found)), sizes), ratio, len(found))
        return totals / (sizes + self.prior_words)

    def scores(self, texts: pd.Series) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.mean_ratios(texts) + self.offset, -60, 60)))


def _word_pairs(sample: DataFrame) -> DataFrame:
    """``toxic``, ``before`` and ``word`` of every text's distinct pairs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                before, words = pairs_of(text.as_py())
                kinds = pa.array(np.full(len(words), toxic, np.int32))
                yield pa.RecordBatch.from_arrays([kinds, pa.array(before), pa.array(words)], ["toxic", "before", "word"])

    return sample.select(F.col("toxic").cast("int"), "text").mapInArrow(cut, "toxic int, before bigint, word bigint")


def _corpus_counts(texts: DataFrame) -> DataFrame:
    """Every word of all texts and ``n``, how many distinct pairs of neighbouring words end in it, counted in each text.

    A row per word of the corpus. Tasks add up some texts at a time, Spark the rest before and after its shuffle.
    """

    def added_up(parts: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(n, pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                parts.append(pairs_of(text.as_py())[1])
                held += len(parts[-1])
                if held >= COUNTED_WORDS:
                    yield added_up(parts)
                    parts, held = [], 0
        if held:
            yield added_up(parts)

    return texts.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _differs(of_one: str, of_other: str, all_one: float, all_other: float, deviations: float) -> Column:
    """Where two counts differ, given the totals of their classes, by more than chance explains."""
    both = F.col(of_one) + F.col(of_other)
    share = all_one / max(1.0, all_one + all_other)
    return F.abs(F.col(of_one) - both * share) > deviations * F.sqrt(both * share * (1 - share) + 0.25)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_toxic: int = 2000,
    max_ordinary: int = 8000,
    calibration_docs: int = 4000,
    deviations: float = 4.0,
) -> ToxicityModel:
    """Fits the two models to labelled documents and the calibration to others.

    Of the labelled ids, taken in the order of a hash, up to ``calibration_docs`` (at most a quarter of all) calibrate
    and up to ``max_toxic`` and ``max_ordinary`` of the rest train; these bound what is counted and sent to tasks.

    Both are interpolated Kneser-Ney models of word pairs: a pair's count (documents of the class that hold it) is
    discounted and backs off to the word's number of contexts in the class, discounted as well, and that to the
    word's share of the contexts of all words of ``docs``, labelled or not, which is a table with a row for every
    word there is. Expressions whose counts in the two classes differ by no more than ``deviations`` standard
    deviations of chance are rare or indifferent and are left to the shared counts in both models, with one backoff
    weight for both, so that they cancel instead of adding noise.

    NULL labels and ids are ignored, labels of a repeated id count once (toxic if any is). Without documents of one
    of the classes no expression differs and the scores follow the calibration alone.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit("sample"), "id")
    known = (
        labels.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
        .filter("id is not null and toxic is not null")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    n_known = known.count()
    held = known.orderBy(order, "id").limit(min(calibration_docs, n_known // 4))
    rest = known.join(held.select("id"), "id", "left_anti")
    chosen = held.withColumn("part", F.lit("calibrate"))
    for toxic, most in ((0, max_ordinary), (1, max_toxic)):
        of_class = rest.filter(F.col("toxic") == toxic).orderBy(order, "id").limit(most)
        chosen = chosen.unionByName(of_class.withColumn("part", F.lit("train")))
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # at most calibration_docs + max_toxic + max_ordinary rows of ids
    sample = keep(texts.join(F.broadcast(chosen), "id").select("toxic", "part", "text"), "toxicity-sample")

    pairs = keep(
        _word_pairs(sample.filter("part = 'train'"))
        .groupBy("before", "word")
        .agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")),
        "toxicity-pairs",
    )
    seen = lambda c: F.sum((F.col(c) > 0).cast("int"))
    words = pairs.groupBy("word").agg(seen("n1").alias("k1"), seen("n0").alias("k0"))
    contexts = pairs.groupBy("before").agg(F.sum("n1").alias("total1"), F.sum("n0").alias("total0"))
    whole = pairs.agg(*[F.sum(c).cast("double").alias(c) for c in ("n0", "n1")], seen("n0").alias("k0"), seen("n1").alias("k1"))
    whole = whole.na.fill(0).first()
    own_words = words.filter(_differs("k1", "k0", whole["k1"], whole["k0"], deviations))
    own_pairs = pairs.filter(_differs("n1", "n0", whole["n1"], whole["n0"], deviations))
    counts = keep(_corpus_counts(texts.select("text")), "toxicity-counts")
    total = float(max(1, counts.agg(F.sum("n")).first()[0] or 0))
    kinds = own_words.agg(seen("k0").alias("v0"), seen("k1").alias("v1")).na.fill(0).first()
    backoff = max(0.001, *(DISCOUNT * kinds[f"v{c}"] / max(1, whole[f"k{c}"]) for c in (0, 1)))

    asked = own_words.select("word").union(own_pairs.select("word")).distinct()
    singles = asked.join(counts, "word").join(own_words, "word", "left")
    shared = backoff * F.col("n") / total
    own = {c: F.greatest(F.coalesce(F.col(f"k{c}"), F.lit(0)) - DISCOUNT, F.lit(0.0)) / float(max(1, whole[f"k{c}"])) for c in (0, 1)}
    singles = singles.select("word", F.col("k0").isNotNull().alias("differs"), *[(own[c] + shared).alias(f"p{c}") for c in (0, 1)])
    by_word = singles.filter("differs").select("word", F.log(F.col("p1") / F.col("p0")).alias("ratio")).toArrow()
    of_class = [
        F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"total{c}"), F.lit(1))
        + backoff * F.when(F.col("differs"), F.col(f"p{c}")).otherwise(F.col("p0"))
        for c in (0, 1)
    ]
    by_pair = (
        own_pairs.join(contexts, "before")
        .join(singles, "word")
        .select(F.shiftleft("before", 1).bitwiseXOR(F.col("word")).alias("pair"), F.log(of_class[1] / of_class[0]).alias("ratio"))
        .toArrow()
    )
    w_order, p_order = np.argsort(by_word["word"].to_numpy()), np.argsort(by_pair["pair"].to_numpy())
    model = ToxicityModel(
        by_word["word"].to_numpy()[w_order],
        by_word["ratio"].to_numpy()[w_order],
        by_pair["pair"].to_numpy()[p_order],
        by_pair["ratio"].to_numpy()[p_order],
    )
    calibrating = sample.filter("part = 'calibrate'")
    ratios = _with_udf(spark, model, ToxicityModel.mean_ratios)
    measured = calibrating.select("toxic", ratios("text").alias("x")).toArrow()
    slope, offset = _calibrate(measured["x"].to_numpy(), measured["toxic"].to_numpy())
    return ToxicityModel(**(model.__dict__ | {"slope": slope, "offset": offset}))


def _calibrate(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's steps with a weak pull towards 0."""
    if len(x) == 0 or toxic.min() == toxic.max():
        return 20.0, -0.4
    scale = max(1e-6, float(np.std(x)))
    z = np.column_stack([x / scale, np.ones(len(x))])
    ridge = np.diag([0.05, 0.05])
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (toxic - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def _with_udf(spark: SparkSession, model: ToxicityModel, method):  # noqa: ANN001, ANN202
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def apply(text: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([method(sent.value, text[k : k + 500]) for k in range(0, max(1, len(text)), 500)]))

    return apply


def scorer(spark: SparkSession, model: ToxicityModel):  # noqa: ANN201
    """A function of a text column: its score from 0 to 1, over the whole text; a NULL text scores as an empty one."""
    return _with_udf(spark, model, ToxicityModel.scores)


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text, in the scan's tasks; a column of that name is replaced."""
    return docs.withColumn(score_col, scorer(docs.sparkSession, model)(F.col(f"`{text_col}`")))
