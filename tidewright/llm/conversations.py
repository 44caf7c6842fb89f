"""Repair of the turn structure of conversations.

The legal sequences of role initials form a small context-free grammar. A conversation is parsed by an LR automaton of
that grammar with weighted edits: rows may be kept, given another role or deleted, and empty rows inserted. The
parsers alive after a row are the tops of one graph-structured stack; equal tops merge, and the merged top keeps the
minimum of (cost, audit), where the audit is the string of edit initials. In the role grammar a top fixes the whole
stack below it, which the automaton checks, so nothing is lost by merging.

A conversation of any length is parsed in chunks of ``CHUNK`` rows at once: per chunk the cheapest way from each top to
each other one, folded over the chunks of a conversation, names the tops at which each chunk begins and ends; then
all chunks write their part of the audit at once. No task holds more of a conversation than a chunk of row codes, the
conversation's audit, and a batch of its rows.

Rows are taken by turn, NULL first. Rows of one turn follow by role, then by the first 64 characters of the text, then
by its hash; identical rows are interchangeable. NULL roles and texts count as one space; rows with a NULL ``conv_id``
are one conversation. Only the four named columns are read. An empty table gives empty frames.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.llm.shared import SPACE, keep

#: rows of a conversation that are parsed in one piece
CHUNK = 1 << 16
#: what each edit costs; a truncated row that stays costs ``TRUNCATED`` more
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: role initials: nothing, or pairs of user and assistant, perhaps after one system row
GRAMMAR = {"C": ("", "P", "Q"), "P": ("ua", "Pua"), "Q": ("sua", "Qua")}
ROLES = {"u": "user", "a": "assistant"}
#: letters of a row: its initial (``o`` for any other), in upper case if truncated, a digit if blank
INITIALS, BLANK = "suao", "0123"


class Automaton:
    """LR(0) automaton of a grammar whose stacks are fixed by their tops; tops are numbered from 0, the empty stack."""

    def __init__(self, grammar: dict[str, tuple[str, ...]], start: str = "C"):
        self.grammar, self.start = grammar, start
        self.symbols = sorted({s for rules in grammar.values() for r in rules for s in r if s not in grammar})
        stacks = [(self._closure({(start, rule, 0) for rule in grammar[start]}),)]
        self.shifts: list[dict[str, int]] = []
        for stack in stacks:  # grows while it is walked
            moves = {}
            for symbol in self.symbols:
                after = self._shift(stack, symbol)
                if after is not None:
                    if after not in stacks:
                        if any(after[-1] == other[-1] for other in stacks):
                            raise ValueError("two different stacks share a top")
                        stacks.append(after)
                    moves[symbol] = stacks.index(after)
            self.shifts.append(moves)
        self.final = [any(head == start and dot == len(rule) for head, rule, dot in s[-1]) for s in stacks]

    def _closure(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            _, rule, dot = todo.pop()
            for new in ((rule[dot], r, 0) for r in self.grammar.get(rule[dot : dot + 1], ())):
                if new not in items:
                    items.add(new)
                    todo.append(new)
        return frozenset(items)

    def _goto(self, stack: tuple, symbol: str) -> tuple | None:
        moved = {(h, r, dot + 1) for h, r, dot in stack[-1] if r[dot : dot + 1] == symbol}
        return (*stack, self._closure(moved)) if moved else None

    def _shift(self, stack: tuple, symbol: str) -> tuple | None:
        """Reads a symbol, then reduces whatever rule is complete; the start rules wait for the end."""
        stack = self._goto(stack, symbol)
        while stack:
            done = [(h, r) for h, r, dot in stack[-1] if h != self.start and dot == len(r)]
            if not done:
                break
            stack = self._goto(stack[: len(stack) - len(done[0][1])], done[0][0])
        return stack


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton(GRAMMAR)


@lru_cache(maxsize=1 << 10)
def inserts(top: int) -> tuple[tuple[int, int], ...]:
    """The tops that inserted rows lead to, with the least number of them."""
    found = {top: 0}
    for at in (order := [top]):
        for symbol, after in automaton().shifts[at].items():
            if symbol in ROLES and after not in found:
                found[after] = found[at] + 1
                order.append(after)
    return tuple(found.items())


@lru_cache(maxsize=1 << 10)
def row_edits(top: int, letter: str) -> tuple[tuple[int, int, str], ...]:
    """(next top, cost, edits) for a row: rows inserted before it, then what happens to it. ``x`` must be deleted."""
    out = []
    extra = TRUNCATED if letter.isupper() else 0
    for at, n in inserts(top):
        shifts, before = automaton().shifts[at], "I" * n
        out.append((at, n * INSERT + DELETE, before + "D"))
        if letter != "x":
            if (after := shifts.get(letter.lower())) is not None:
                out.append((after, n * INSERT + KEEP + extra, before + "K"))
            out += [(shifts[r], n * INSERT + REROLE + extra, before + "R") for r in ROLES if r in shifts]
    return tuple(out)


def parse(letters: str, start: int) -> tuple[dict[int, tuple[int, int]], list[dict]]:
    """Reads row letters from one top on: {top: (cost, rank of its audit among the tops')}, and the links of each row.

    After a row no two audits are equal and none begins another, since each ends in the row's own edit and letters fix
    the cost. So audits are compared by the rank of what they continue, then by the edits of the row.
    """
    alive, links = {start: (0, 0)}, []
    for letter in letters:
        best: dict[int, tuple] = {}
        for top, (cost, rank) in alive.items():
            for after, price, edits in row_edits(top, letter):
                found = (cost + price, rank, edits, top)
                if after not in best or found < best[after]:
                    best[after] = found
        ranked = sorted(best, key=lambda t: best[t][1:3])
        alive = {top: (best[top][0], rank) for rank, top in enumerate(ranked)}
        links.append({top: best[top][2:] for top in ranked})
    return alive, links


def audit_to(links: list[dict], end: int) -> str:
    parts = []
    for link in reversed(links):
        edits, end = link[end]
        parts.append(edits)
    return "".join(reversed(parts))


def finish(alive: dict[int, tuple[int, int]]) -> tuple[int, int, int, int]:
    """(cost, rank, rows inserted at the end, top) of the cheapest way to accept."""
    return min(
        (cost + n * INSERT, rank, n, top)
        for top, (cost, rank) in alive.items()
        for at, n in inserts(top)
        if automaton().final[at]
    )


def row_letters(marked: str) -> tuple[str, int, int, int]:
    """Letters to parse, and the numbers of blank, duplicate and truncated rows; ``!`` marks what is not seen before."""
    letters, blank, duplicate, truncated, first = [], 0, 0, 0, False
    for c in marked:
        if c == "!":
            first = True
            continue
        if c in BLANK:
            blank += 1
        elif not first:
            duplicate += 1
        elif c.isupper():
            truncated += 1
        letters.append(c if first and c not in BLANK else "x")
        first = False
    return "".join(letters), blank, duplicate, truncated


def damage(rows: DataFrame) -> DataFrame:
    """Damages rows by the CRC of ``conv_id:turn`` modulo 20 and adds ``lost``: 0 loses the row, 1 empties its text, 2
    takes its ``.!?`` away, 3 repeats it, 4 makes the role ``user``. NULLs count as one space."""
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text, role = text_of("text"), text_of("role")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _letter(role: Column, text: Column) -> Column:
    initial = F.substring(role, 1, 1)
    initial = F.when(initial.isin(*"sua"), initial).otherwise("o")
    stripped = F.rtrim(text, F.lit(SPACE))
    return (
        F.when(stripped == "", F.translate(initial, INITIALS, BLANK))
        .when(~F.right(stripped, F.lit(1)).isin(*".!?"), F.upper(initial))
        .otherwise(initial)
    )


def ordered(rows: DataFrame, lost: str | None = None) -> DataFrame:
    """Every row with its ``place``, kept in the shared folder. Places grow with conversation and turn, also across files.

    Rows are dealt by ranges, so that a conversation of any size, or any number of identical rows, spreads over tasks.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    gone = F.coalesce(F.col(f"`{lost}`"), F.lit(False)) if lost else F.lit(False)
    named = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), gone.alias("lost"))
    keyed = named.select(
        "*", F.substring("text", 1, 64).alias("_head"), F.xxhash64("text").alias("_hash"),
        F.monotonically_increasing_id().alias("_salt"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_head", "_hash", "_salt"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(
        dealt.select(
            "conv_id", "turn", "role", "text", "lost", _letter(F.col("role"), F.col("text")).alias("letter"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "conversation-rows",
    )


def _rows(batch: pa.RecordBatch, names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names.split()))


def _chunks(places: DataFrame) -> DataFrame:
    """Per conversation and chunk of places the letters in order, ``!`` before the first row of each role and text."""
    there = places.filter(~F.col("lost"))
    same = (F.xxhash64("role", "text").alias("_a"), F.xxhash64(F.lit(1), "text", "role").alias("_b"))
    firsts = there.groupBy("conv_id", *same).agg(F.min("place").alias("place"))
    firsts = firsts.select("conv_id", "place", F.lit("!").alias("letter"))
    letters = places.select("conv_id", "place", F.when(F.col("lost"), "").otherwise(F.col("letter")).alias("letter"))
    # places count on from a multiple of 2**33 in each file, so a chunk lies in one file
    chunk = F.shiftright("place", CHUNK.bit_length() - 1).alias("chunk")
    entries = F.sort_array(F.collect_list(F.struct("place", "letter")))
    out = letters.unionByName(firsts).groupBy("conv_id", chunk).agg(entries.alias("_entries"))
    marked = F.array_join("_entries.letter", "").alias("marked")
    return keep(out.select("conv_id", "chunk", marked), "conversation-chunks")


def _schema(frame: DataFrame, names: str, more: str) -> StructType:
    """Columns of a frame, then further ones as DDL."""
    return StructType([frame.schema[n] for n in names.split()] + StructType.fromDDL(more).fields)


def _ends(chunks: DataFrame) -> DataFrame:
    """For conversations in several chunks: the tops at which each chunk begins and ends, and rows inserted after it."""
    spans = chunks.groupBy(F.col("conv_id").alias("_c")).agg(F.count("*").alias("_n")).filter("_n > 1")
    several = chunks.join(spans, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = range(len(automaton().shifts))
        for batch in batches:
            rows = []
            for marked in batch.column("marked").to_pylist():
                letters = row_letters(marked)[0]
                rows.append([[start, end, *way] for start in tops for end, way in parse(letters, start)[0].items()])
            found = pa.array(rows, pa.list_(pa.list_(pa.int64())))
            columns = [batch.column("conv_id"), batch.column("chunk"), found]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    schema = _schema(chunks, "conv_id chunk", "ways array<array<bigint>>")
    parts = F.sort_array(F.collect_list(F.struct("chunk", "ways"))).alias("_all")
    folded = several.mapInArrow(ways, schema).groupBy("conv_id").agg(parts)

    pairs = _schema(chunks, "conv_id", "_ends array<struct<chunk:bigint,begin:bigint,end:bigint,after:bigint>>")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("_all").to_pylist():
                alive, before = {0: (0, 0)}, []
                for part in parts:
                    best: dict[int, tuple] = {}
                    for start, end, cost, rank in part["ways"]:
                        if start in alive:
                            found = (alive[start][0] + cost, alive[start][1], rank, start)
                            if end not in best or found < best[end]:
                                best[end] = found
                    ranked = sorted(best, key=lambda t: best[t][1:3])
                    alive = {end: (best[end][0], rank) for rank, end in enumerate(ranked)}
                    before.append({end: best[end][3] for end in best})
                _, _, after, end = finish(alive)
                rows = []
                for part, start_of in zip(reversed(parts), reversed(before)):
                    rows.append({"chunk": part["chunk"], "begin": start_of[end], "end": end, "after": after})
                    end, after = start_of[end], 0
                out.append(rows)
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("chunk", "begin", "end", "after")]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out, kind)], ["conv_id", "_ends"])

    ends = F.inline("_ends").alias("_k", "begin", "end", "after")
    return folded.mapInArrow(fold, pairs).select(F.col("conv_id").alias("_c"), ends)


def plan(places: DataFrame) -> DataFrame:
    """Per conversation ``blank``, ``duplicate`` and ``truncated`` rows, the least ``cost`` of a repair and its ``audit``.

    Of equally cheap repairs it is the one whose audit, the initials of Keep, Rerole, Delete and Insert in order, is
    the least by ASCII. Blank rows and rows repeating an earlier role and text must be deleted.
    """
    chunks = _chunks(places)
    ends = _ends(chunks)
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, counts = [], []
            for marked, begin, end, after in _rows(batch, "marked begin end after"):
                letters, *faults = row_letters(marked)
                alive, links = parse(letters, begin or 0)
                if end is None:
                    _, _, after, end = finish(alive)
                audits.append(audit_to(links, end) + "I" * after)
                counts.append([*faults, alive[end][0] + after * INSERT])
            counts = [pa.array(c, pa.int64()) for c in zip(*counts)] or [pa.array([], pa.int64())] * 4
            columns = [batch.column("conv_id"), batch.column("chunk"), *counts, pa.array(audits, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    schema = _schema(
        chunks, "conv_id chunk", "blank bigint, duplicate bigint, truncated bigint, cost bigint, audit string"
    )
    known = chunks.join(ends, same, "left").select("conv_id", "chunk", "marked", "begin", "end", "after")
    parts = known.mapInArrow(write, schema)
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")]
    audit = F.array_join(F.sort_array(F.collect_list(F.struct("chunk", "audit")))["audit"], "")
    return keep(parts.groupBy("conv_id").agg(*sums, audit.alias("audit")), "conversation-plans")


def repaired_rows(places: DataFrame, plans: DataFrame) -> DataFrame:
    """Every row of every conversation, inserted ones too, with its ``edit``, the role it came with and its role now.

    The rows of a conversation lie in one partition, in order. They stream past; only their audit is held.
    """
    turn = F.lit(None).cast(places.schema["turn"].dataType).alias("turn")
    place, role = F.lit(-1).cast("bigint").alias("place"), F.lit("").alias("role")
    head = plans.select("conv_id", place, turn, role, F.col("audit").alias("text"))
    body = places.filter(~F.col("lost")).select("conv_id", "place", "turn", "role", "text")
    lined = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    schema = _schema(places, "conv_id turn", "edit string, old_role string, role string, text string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, last = "", 0, ""
        for batch in batches:
            out: list[tuple] = []
            for conv, place, turn, role, text in _rows(batch, "conv_id place turn role text"):
                if place < 0:
                    audit, at, last = text, 0, ""
                else:
                    while audit[at] == "I":
                        last, at = "a" if last == "u" else "u", at + 1
                        out.append((conv, None, "I", None, ROLES[last], ""))
                    edit, new, at = audit[at], role, at + 1
                    if edit == "R":
                        new = ROLES["a" if last == "u" else "u"]
                    if edit != "D":
                        last = new[:1]
                    out.append((conv, turn, edit, role, new, text))
                if place < 0 and not audit.strip("I") or place >= 0 and not audit[at:].strip("I"):
                    for _ in range(len(audit) - at):  # what is inserted after the last row
                        last = "a" if last == "u" else "u"
                        out.append((conv, None, "I", None, ROLES[last], ""))
                    at = len(audit)
            kinds = [batch.schema.field("conv_id").type, batch.schema.field("turn").type, *[pa.string()] * 4]
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.fieldNames())

    return lined.mapInArrow(apply, schema)


def _marks(rows: DataFrame) -> DataFrame:
    """Per conversation, from its rows in order: ``gaps`` in turns, ``illegal`` neighbours, the repaired rows' digest."""
    schema = _schema(rows, "conv_id", "gaps bigint, illegal bigint, repaired_sha256 string")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def done() -> tuple:
            low, high, turns, _, illegal, _, digest, _ = state
            return conv, 0 if turns == 0 else high - low + 1 - turns, illegal, digest.hexdigest()

        kind = None
        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for c, turn, edit, old, role, text in _rows(batch, "conv_id turn edit old_role role text"):
                if state is None or c != conv:
                    if state is not None:
                        out.append(done())
                    conv, state = c, [None, None, 0, None, 0, None, hashlib.sha256(), False]
                if edit != "I":
                    if turn is not None and turn != state[1]:  # turns come in order
                        state[0] = turn if state[0] is None else state[0]
                        state[1], state[2] = turn, state[2] + 1
                    if state[5] is not None and state[5] + old[:1] not in ("su", "ua", "au"):
                        state[4] += 1
                    state[5] = old[:1]
                if edit != "D":
                    state[6].update((("\n" if state[7] else "") + f"{role}:{text}").encode())
                    state[7] = True
            yield _batch(out, kind)
        if state is not None:
            yield _batch([done()], kind)

    def _batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        kinds = [kind, pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.fieldNames())

    return rows.mapInArrow(walk, schema)


def repair(rows: DataFrame, lost: str | None = None) -> DataFrame:
    """One row per ``conv_id``: faults found, the cost and audit of the cheapest repair, and the repaired rows' digest.

    Rows whose boolean column ``lost`` is true take no part, but their conversation is reported. ``repaired_rows`` has
    the rows themselves.
    """
    places = ordered(rows, lost)
    plans = plan(places)
    marks = _marks(repaired_rows(places, plans)).withColumnRenamed("conv_id", "_c")
    out = plans.join(marks, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return out.select(
        "conv_id",
        F.coalesce("gaps", F.lit(0)).alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        F.coalesce("illegal", F.lit(0)).alias("illegal"),
        "cost",
        "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
