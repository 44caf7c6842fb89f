"""The repair of conversations against every possible edit, with chunks of all sizes and awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tests.conftest import rows as rows_of
from tidewright.llm import conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, letter int, chunk string"


def cheapest(marks):
    """(cost, audit, roles) of the best of all edits of rows given as (initial, must go, truncated)."""
    best = None
    todo = [(0, 0, "", "")]
    while todo:
        i, cost, audit, out = todo.pop()
        if best and cost > best[0] or not re.fullmatch(r"(s?(ua)*u?)?", out):
            continue
        if i == len(marks):
            if re.fullmatch(r"(s?(ua)+)?", out) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
        else:
            initial, must, truncated = marks[i]
            todo.append((i + 1, cost + 4, audit + "D", out))
            if not must:
                todo.append((i + 1, cost + 3 * truncated, audit + "K", out + (initial or "?")))
                todo += [(i + 1, cost + 3 + 3 * truncated, audit + "R", out + r) for r in "ua"]
        if len(out) < 2 * len(marks) + 2:
            todo += [(i, cost + 3, audit + "I", out + r) for r in "ua"]
    return best


def repaired(table, harm=True):
    """What ``repair`` gives for (conv_id, turn, role, text) rows, by trying everything."""
    grouped, names, out = defaultdict(list), {"u": "user", "a": "assistant"}, []
    for conv, turn, role, text in table:
        rows = grouped[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if harm else 9
        role, text = (" " if v is None else v for v in (role, text))
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, rows in grouped.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marks, faults = set(), [], [0, 0, 0]
        for _, role, text in rows:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not core else 1 if (role, text) in seen else 2 if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            marks.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit, roles = cheapest(marks)
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        kept, left, roles = [], iter(rows), iter(roles)
        for edit in audit:
            if edit == "I":
                kept.append(names[next(roles)] + ":")
                continue
            _, role, text = next(left)
            if edit != "D":
                now = next(roles)
                kept.append(f"{role if edit == 'K' else names[now]}:{text}")
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *faults, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def sample(seed=3, n=40):
    rng = random.Random(seed)
    table = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?", "", " \n", None, f"Text {rng.random()}!", f"Text {rng.random()}", "Ünd. "])
            table.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), role, text))
    table += [(None, None, None, None), (None, 1, "user", "Hi."), (7, None, "user", "long. " * 30_000)]
    return table + table[:2]


def frame(spark, table):
    return spark.createDataFrame([(*row, "x", 1, "y") for row in table], SCHEMA).repartition(5)


@pytest.mark.parametrize("chunk", [1, 4, 1 << 16])
def test_repair_is_the_cheapest_of_all(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    table = sample()
    got = conversations.repair(conversations.damage(frame(spark, table)), lost="lost")
    assert rows_of(got) == repaired(table)


def test_repaired_rows_are_legal(spark):
    table = sample(8)
    places = conversations.ordered(frame(spark, table))
    plans = conversations.plan(places)
    by_conv = defaultdict(list)
    for row in conversations.repaired_rows(places, plans).collect():
        by_conv[row.conv_id].append(row)
    assert set(by_conv) == {r[0] for r in table}
    for conv, rows in by_conv.items():
        now = "".join(r.role[:1] for r in rows if r.edit != "D")
        assert re.fullmatch("(s?(ua)+)?", now), (conv, now)
        assert all(r.text == "" and r.old_role is None for r in rows if r.edit == "I")
        assert all(r.role == r.old_role for r in rows if r.edit in "KD")
    assert sum(r.edit != "I" for rows in by_conv.values() for r in rows) == len(table)


def test_hot_conversation_is_cut(spark, monkeypatch):
    """One conversation with most rows, many of them equal: no chunk holds more than its share, the result is the same."""
    table = [(1, i // 3, "user" if i % 2 else "assistant", "Same." if i % 3 else f"Text {i}") for i in range(3000)]
    table += [(1, 5, "user", "Same.")] * 500 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    whole = rows_of(conversations.repair(frame(spark, table)))
    monkeypatch.setattr(conversations, "CHUNK", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    places = conversations.ordered(frame(spark, table))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert places.groupBy("conv_id", (places.place / 64).cast("bigint")).count().agg({"count": "max"}).first()[0] <= 64
    assert len({r[0] >> 33 for r in places.filter("conv_id = 1").select("place").collect()}) > 1
    assert rows_of(conversations.repair(frame(spark, table))) == whole
    assert whole[1][6:8] == (0, "KK")


def test_lost_and_empty(spark):
    lost = frame(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")]).selectExpr("*", "true lost")
    empty = hashlib.sha256(b"").hexdigest()
    assert rows_of(conversations.repair(lost, "lost")) == [(1, 0, 0, 0, 0, 0, 0, "", empty)]
    assert rows_of(conversations.repair(frame(spark, []))) == []


def test_ambiguous_stacks_are_refused():
    with pytest.raises(ValueError, match="share a top"):
        conversations.Automaton({"C": ("P", "sP"), "P": ("ua", "Pua")})
