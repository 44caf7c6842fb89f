import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tests.llm.samples import SCHEMA, key, ordered, prose, rows, sha, split
from tidewright.llm import blocks, neardup, passages, suffixes


def expected_passages(table, window=13):
    first = {}
    for r in table:
        w = split(r[1])
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, key(r)), key(r))
    out = []
    for r in table:
        w = split(r[1])
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < key(r) for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), kept, sha(kept)))
    return ordered(out)


@pytest.mark.parametrize("block_bytes", [10**7, 3000])
def test_passages_against_brute_force(spark, block_bytes):
    table = rows()
    out = passages.dedup_passages(spark.createDataFrame(table, SCHEMA), block_bytes=block_bytes, bucket_bytes=block_bytes)
    got = out.collect()
    assert ordered((r.doc_id, r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in got) == expected_passages(table)
    assert all(sum(s.beyond - s.first for s in r.spans) == r.n_removed for r in got)
    assert passages.dedup_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_cover_brings_every_pair_of_positions_together():
    period, cover = passages.PERIOD, passages.COVER
    for a in range(period):
        for b in range(period):
            assert any((a + t) % period in cover and (b + t) % period in cover for t in range(period))


def expected_bytes(table, window):
    texts = [(r[1] or "").encode() for r in table]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for r, t in zip(table, texts):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i + 1 : i + window + 1] = True
        kept = bytes(c for i, c in enumerate(t) if not gone[i + 1])
        out.append((r[0], len(t), len(t) - len(kept), int((gone[1:] & ~gone[:-1]).sum()), kept, sha(kept)))
    return ordered(out)


@pytest.mark.parametrize(("block_bytes", "window", "gram"), [(10**7, 200, 64), (3000, 200, 64), (5000, 40, 40), (5000, 30, 5)])
def test_bytes_against_brute_force(spark, block_bytes, window, gram):
    table = rows(2) + [rows(2)[4]] * 30
    out = suffixes.dedup_bytes(
        spark.createDataFrame(table, SCHEMA), window=window, gram=gram, block_bytes=block_bytes, bucket_bytes=block_bytes
    ).collect()
    got = ordered((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) for r in out)
    assert got == expected_bytes(table, window)
    assert all(sum(s.beyond - s.first for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in out)


@pytest.mark.parametrize("window, gram", [(200, 64), (30, 5), (9, 9)])
def test_runs_do_not_depend_on_the_pieces(monkeypatch, window, gram):
    """The anchors of a block hashed piece by piece are those of the block hashed at once, ties and document ends too."""
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (0, 5, 250, 3000, 199, 200, 201)] + [b"x" * 2500]
    table = pa.table({"id": list(range(len(texts))), "missing": [False] * len(texts), "text": texts})
    whole = suffixes._Block(table, window, gram)
    assert whole.n_windows.sum() == sum(max(0, len(t) - window + 1) for t in texts)
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        block = suffixes._Block(table, window, gram)
        for name in ("anchors", "first", "n_windows", "keys", "key_of", "held"):
            assert (getattr(block, name) == getattr(whole, name)).all(), (piece, name)


@pytest.mark.parametrize("crowd, block_bytes", [(0, 3000), (4, 3000), (4, 10**7), (10**6, 3000)])
def test_bytes_under_crowded_anchors(spark, crowd, block_bytes):
    """A phrase shorter than the window and a passage longer than it in a third of all texts, other text around them."""
    rng = random.Random(5)
    phrase, passage = prose(rng, 10)[:45], prose(rng, 30)[:110]
    table = [list(r) for r in rows(7, 90)]
    for k, row in enumerate(table[3:60]):
        shared = phrase if k % 2 else passage if k % 3 else phrase + passage
        row[1] = f"{prose(rng, 12)} {k} {shared} {k} {prose(rng, rng.choice([0, 12]))}" + shared * (k % 10 == 0)
    out = suffixes.dedup_bytes(
        spark.createDataFrame(table, SCHEMA), window=60, gram=20, block_bytes=block_bytes, bucket_bytes=block_bytes, crowd=crowd
    )
    got = ordered((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) for r in out.collect())
    assert got == expected_bytes(table, 60)


def test_crowded_anchors_are_named():
    text = [bytes(f"{k:04}" * 20, "ascii") + b"the same phrase in every text" + bytes(f"{k:05}" * 20, "ascii") for k in range(30)]
    table = pa.table({"id": list(range(30)), "missing": [False] * 30, "text": text})
    block = suffixes._Block(table, 60, 20)
    known = suffixes._known(20)(block.keys, block.held)
    crowded = np.flatnonzero(known == suffixes.CROWDED)
    assert len(crowded) and (block.held[crowded] >> 1 > 20).all()
    assert not (suffixes._known(30)(block.keys, block.held) == suffixes.CROWDED).any()
    starts, numbers, halves, windows = block.crowded(known)
    texts = [block.joined[a : a + 60] for a in starts.tolist()]
    assert len(set(zip(texts, numbers.tolist()))) == len(set(texts)) == len(halves) == len(windows)
    assert (np.sort(halves) == halves).all()
    assert {n: texts.count(t) > 1 for t, n in zip(texts, numbers.tolist())} == dict(enumerate(windows["several"].astype(bool).tolist()))


def test_bytes_of_a_text_beyond_2_to_the_24(spark):
    """One text of 18 MB in a block of its own, with a passage of another text inside."""
    rng = np.random.default_rng(3)
    long, passage = rng.integers(97, 123, 18_000_000, np.uint8).tobytes().decode(), "q" + "yz" * 150
    docs = spark.createDataFrame([(1, long + passage), (2, "start " + passage)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.dedup_bytes(docs).collect())
    assert got == [(1, 18_000_301, 301, 1), (2, 307, 301, 1)]


def test_equal_rows_spread_over_blocks(spark):
    docs = spark.createDataFrame([(1, "same text")] * 400, "doc_id bigint, text string").repartition(8)
    dealt = blocks.into_blocks(docs, 8, id_col="doc_id", text_col="text")
    assert dealt.select("block").distinct().count() > 1 and dealt.count() == 400


def test_bytes_of_an_empty_table(spark):
    assert suffixes.dedup_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_columns_find_the_windows_segments_share():
    rng = random.Random(6)
    for _ in range(60):
        reach, window = rng.randint(1, 6), rng.randint(1, 7)
        made, groups = set(), rng.randint(1, 3)
        for _ in range(rng.randint(2, 30)):
            before = rng.randint(0, reach - 1)
            length = rng.randint(window, window + reach - 1)
            if before + window >= length - (reach - 1 - before) and length - before <= window + reach - 1 - before + before:
                made.add((rng.randrange(groups), before, bytes(rng.choice(b"ab") for _ in range(min(length, window + before)))))
        listed = sorted(made)
        if not listed:
            continue
        group = np.array([g for g, _, _ in listed])
        out = suffixes.repeated_windows([s for _, _, s in listed], np.array([b for _, b, _ in listed]), group, window, reach)
        for i, (g, before, s) in enumerate(listed):
            for start in range(reach):
                # aligned at the anchor: the same window at the same distance from it
                mine = s[start : start + window]
                others = [
                    t[start - before + b : start - before + b + window]
                    for j, (h, b, t) in enumerate(listed)
                    if j != i and h == g and start - before + b >= 0
                ]
                assert out[i, start] == (len(mine) == window and mine in others)


def expected_near(table, percent):
    ids = sorted({r[0] for r in table if r[0] is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = []
    for r in table:
        w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (table[i][0], table[j][0]) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(table[i][0]), find(table[j][0])
                root[max(x, y)] = min(x, y)
    return ordered(
        (r[0], len(s), None if r[0] is None else find(r[0]), r[0] is None or find(r[0]) == r[0]) for r, s in zip(table, sets)
    )


def chained(n, rng):
    """A group of near copies: each differs from one made before by a word or more."""
    texts = [prose(rng, 90)]
    for _ in range(n):
        words = rng.choice(texts).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("group", "pivots", "longest"), [(600, 16, 1500), (25, 16, 10), (6, 1, 10)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, group, pivots, longest):
    monkeypatch.setattr(neardup, "GROUP", group)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    monkeypatch.setattr(neardup, "LIST", longest)
    rng = random.Random(7)
    table = rows() + [(1000 + i, t, *[None] * 7) for i, t in enumerate(chained(90, rng))]
    table += [(5, prose(rng, 30), *[None] * 7), (1000, "another text of the same id as one above", *[None] * 7)]
    sent = 10**6 if pivots == 16 else 0
    out = neardup.near_duplicates(spark.createDataFrame(table, SCHEMA), part_rows=50, bucket_rows=40, broadcast_rows=sent)
    assert ordered(out.select("doc_id", "n_shingles", "component_id", "kept").collect()) == expected_near(table, 85)


def test_only_what_stays_apart_meets_the_rest_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 10)
    members = [(i, 0, 1, 40 if i < 95 else 100, i // 10) for i in range(100)]
    large = spark.createDataFrame(members, "rep bigint, version bigint, group bigint, n_shingles bigint, part int")
    number = lambda f: f.withColumn("part", F.floor((F.row_number().over(Window.orderBy("n_shingles", "rep")) - 1) / 10))
    tied = [(i, 0) for i in range(95)] + [(99, 98), (98, 98)]
    cells = lambda tied: neardup._still_apart(large, spark.createDataFrame(tied, "node bigint, component bigint"), number, 85)
    met = cells(tied).collect()
    # the five of size 100 are one part and meet only the part that has such sizes
    assert {r.cell for r in met} == {"1/0/9"} and {r.rep for r in met} == set(range(90, 100))
    assert cells([(i, 0) for i in range(100)]).count() == 0
    one_left = cells([(i, 0) for i in range(100) if i != 20])
    assert one_left.select("cell").distinct().count() == 10  # a row of cells, not their square


def test_long_lists_join_their_members(monkeypatch):
    monkeypatch.setattr(neardup, "LIST", 3)
    tokens, ids = np.array([1, 1, 1, 1, 2, 2]), np.array([9, 4, 7, 5, 4, 8])
    edges = neardup._list_edges(tokens, ids, np.zeros((6, 64), np.uint8), 42)
    assert {frozenset(e) for e in edges.tolist()} == {frozenset((9, x)) for x in (4, 7, 5)} | {frozenset((4, 8))}


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = spark.createDataFrame([(1, "only one text is here today", *[None] * 7)], SCHEMA)
    assert [tuple(r) for r in neardup.near_duplicates(lone).collect()] == [(1, 2, 1, True)]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(100, 160)] + [(i, 7) for i in range(200, 260)] + [(3, 3), (7, 201)]
    got = dict(neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]}
    assert got == want


def test_answers_come_back_in_the_order_asked():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 500, np.uint64))
    for n in (1, 2, 7):
        asked = blocks.ask(4, keys, np.ones(len(keys), np.uint8), n)
        assert b"".join(asked["keys"].to_pylist()) == keys.tobytes()
        assert set(asked["bucket"].to_pylist()) <= set(range(n))


def test_repeated_keys():
    keys = np.array([5, 9, 5, 3, 8], np.uint64)
    assert blocks.in_two_or_more(keys, np.array([0, 1, 0, 0, 0], np.uint8)).tolist() == [1, 1, 1, 0, 0]
