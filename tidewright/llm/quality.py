"""Quality rules: measure once, keep a ledger of failed rules as bits, apply versions of a policy to it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a UTF-8 character after its first
REPEAT_WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_stutters")


def _repeat_words(ids: np.ndarray, window: int) -> int:
    """Words inside a window of ``window`` ids that occurs twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    ranks, width = ids, 1
    mixed = np.zeros(n, np.uint64)
    spread = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    for j in range(window):
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + spread[j : j + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows hash alike, so there are none
        return 0
    while width < window:  # exact ranks of windows of twice the width
        step = min(width, window - width)
        pairs = ranks[: len(ranks) - step].astype(np.int64) * (len(ids) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        width += step
    repeated = np.bincount(ranks)[ranks] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(repeated), 1)
    np.add.at(edges, np.flatnonzero(repeated) + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure_text(text: bytes) -> tuple[int, ...]:
    words = text.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    bare = text.translate(None, _FOLLOWING + _SPACE)
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    repeated_lines = 0
    for line in lines:
        if line in seen:
            repeated_lines += bool(line.strip())
        seen.add(line)
    return (
        len(words),
        len(bare),
        len(text) - len(text.translate(None, SYMBOLS)),
        repeated_lines,
        _repeat_words(ids, REPEAT_WINDOW),
        sum(1 for line in lines if line.strip()),
        len(numbers),
        int((ids[1:] == ids[:-1]).sum()),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure_text(t.as_py() or b"") for t in batch.column(1)]
        columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *MEASURES])


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of every text, one row per row of ``docs``; a NULL text measures as an empty one.

    Words are runs without ``[\\x20\\x09-\\x0D]``. ``word_chars``: their code points; ``n_symbols``: characters of
    ``#*$%&|<>``; ``n_dup_lines``: lines with a word that equal an earlier line; ``n_repeat_words``: words in a
    window of 8 words that occurs twice or more in the text; ``n_lines``: lines with a word; ``n_stutters``: words equal to the word before. Each text is read once,
    in the scan's own tasks, and nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{m} bigint" for m in MEASURES)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary"))
    return rows.mapInArrow(_measure, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


#: Every rule ever used, by its bit in the ledger. A rule's bit and meaning never change; a new threshold is a new
#: rule with a new bit, so that old policies keep their verdicts. A rule fails where its condition is true.
RULES: dict[str, tuple[int, str]] = {}


def _rule(name: str, bit: int, fails: str) -> None:
    RULES[name] = (bit, fails)


_rule("few_words", 0, "n_words < 20")
_rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words")
_rule("symbols", 2, "10 * n_symbols > 3 * n_words")
_rule("repeated_lines", 3, "n_dup_lines >= 4 and 10 * n_dup_lines > 3 * n_lines")
_rule("short_words", 4, "word_chars < 2 * n_words")
_rule("long_words", 5, "word_chars > 20 * n_words")
_rule("few_distinct_words", 6, "n_words >= 50 and 10 * n_distinct_words < n_words")
_rule("stutters", 7, "5 * n_stutters > n_words")


@dataclass(frozen=True)
class Policy:
    """A named version of what must hold: rows that fail one of ``rules`` go."""

    name: str
    version: int
    rules: tuple[str, ...] = field(default_factory=tuple)

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, (*BASE.rules, "symbols", "repeated_lines", "short_words", "long_words", "stutters"))
STRICT = Policy("standard", 2, (*STANDARD.rules, "few_distinct_words"))


def ledger(measured: DataFrame, rules: Mapping[str, tuple[int, str]] = RULES) -> DataFrame:
    """``measured`` with ``failed``: a bit for each rule that fails. Each rule is evaluated once, whatever policies
    are applied later. A condition that is NULL (a missing measurement) counts as failed."""
    bits = F.lit(0).cast("bigint")
    for bit, fails in rules.values():
        bits = bits.bitwiseOR(F.when(F.coalesce(F.expr(fails), F.lit(True)), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn("failed", bits)


def passes(policy: Policy, failed: str = "failed") -> Column:
    """Whether a ledger row satisfies the policy."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def ablations(rows: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """For each policy and rule of it: how many rows fail the rule, and how many fail no other rule of the policy.

    ``n_only`` rows would come back if the rule were taken out. Rows are first reduced to counts per pattern of
    bits, at most two to the number of rules, with map-side combine; all policies are computed from those.
    """
    spark = rows.sparkSession
    used = 0
    for policy in policies:
        used |= policy.mask
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(used).cast("bigint")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    cases = spark.createDataFrame(
        [(p.name, p.version, p.mask, r, 1 << RULES[r][0]) for p in policies for r in sorted(set(p.rules))],
        "policy string, version int, mask bigint, rule string, bit bigint",
    )
    own = F.col("bits").bitwiseAND(F.col("mask"))
    hit = own.bitwiseAND(F.col("bit")) != 0
    return (
        patterns.join(F.broadcast(cases))  # both sides bounded: patterns of bits, rules of the given policies
        .groupBy("policy", "version", "rule")
        .agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(own != 0, F.col("n"))), F.lit(0)).alias("n_rejected"),
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(own == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        )
    )
