import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.samples import SCHEMA, ordered, rows
from tidewright.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    rooms, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        opened += room == capacity and at == len(rooms)
        bisect.insort(rooms, room - n)
    return sorted(rooms)


def test_batches_place_as_one_by_one():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([1, 5, 16, 17, 100, 2048])
        lengths = [rng.randint(1, min(capacity, rng.choice([3, 50, capacity]))) for _ in range(rng.randint(0, 300))]
        sequences = defaultdict(list)
        for length, _, n, each, sequence, offset in packing.best_fit(Counter(lengths).items(), capacity):
            for i in range(n):
                sequences[sequence + i // each].append((offset + i % each * length, length))
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
        assert Counter(x for places in sequences.values() for _, x in places) == Counter(lengths)
        assert sorted(capacity - sum(x for _, x in p) for p in sequences.values()) == one_by_one(lengths, capacity)


def test_segment_tree_finds_the_tightest():
    rng = random.Random(4)
    tree, used = packing._Capacities(37), set()
    for _ in range(2000):
        at = rng.randint(1, 37)
        tree.mark(at, at not in used)
        used ^= {at}
        n = rng.randint(1, 37)
        assert tree.tightest(n) == min((u for u in used if u >= n), default=None)


def test_lengths_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="does not fit"):
        packing.best_fit([(9, 1)], 8)


def test_chunks_encode_as_whole_texts():
    whole, chunks, rng = Tokenizer.from_file(FILE), packing.ChunkEncoder(FILE, max_chunks=500), random.Random(5)
    letters = "abc ABC\n\t\r é́̈Σς'ſK<|>endoftext1２ \xa0\x1c\x85日本👍‍'ll's'veÅßÇñİ²½\xad"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        if rng.random() < 0.1:
            text += "<|endoftext|>" + text
        assert np.frombuffer(chunks.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [64, 2048])
def test_documents_are_cut_and_packed(spark, capacity):
    table = rows()
    out = packing.pack_documents(spark.createDataFrame(table, SCHEMA), FILE, capacity=capacity).collect()
    whole, want = Tokenizer.from_file(FILE), []
    for r in table:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((r[0], piece, start, len(part), zlib.crc32(part.tobytes())))
    assert ordered(r[:5] for r in out) == ordered(want)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == len(one_by_one([w[3] for w in want], capacity))


def test_hot_lengths_are_numbered_in_groups(spark):
    pieces = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 3 = 0, 7, 5) as bigint) as length")
    pieces = pieces.unionAll(pieces.limit(10))
    out = packing.pack(pieces, capacity=20, group=100)
    assert out.count() == 5010
    assert out.select("sequence_id", "offset").distinct().count() == 5010
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 20").count() == 0


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), FILE).count() == 0
