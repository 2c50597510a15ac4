"""Conversation structure repair: the cheapest edits to ``system? (user assistant)+``, by block tables.

Rows of a conversation, in the order of their turns, have at most one fault each: *blank* (no
character but white space), *duplicate* (role and text occurred before) or *truncated* (the
last character that is no white space is none of ``.!?``). Edits are Keep (0), Rerole to user or
assistant (3), Delete (4; the only choice for blank rows and duplicates) and Insert of an
empty row of user or assistant (3); a truncated row that stays costs 3 more. The repaired
roles, by their first letters, are ``s?(ua)+`` or nothing. Among the cheapest repairs the one
whose string of edits (their first letters) is least in ASCII is taken; as that string fixes
all roles, it is unique.

The method is that of the Four Russians. What a rest of a conversation costs depends on the
state before it (nothing yet, system, user, assistant last), so a rest is a vector of four
costs. Less their least, there are only a few different vectors, so for every vector and every
block of ``BLOCK`` row kinds the vector before the block is computed once and looked up. A
first pass reads the rows from their last to their first and notes the vector behind each
block; a second one reads them forward, expands each block back from the noted vector and
walks it from the state reached so far, taking the least letter that keeps the cost. The walk of
a block is remembered too. Blank rows and duplicates are always deleted, and never with an
insert before them, so they take no part in the tables.

Both passes are streams over rows that Spark sorts within the partitions of the
conversations; a task holds one block of rows, not a conversation. A conversation's digest is a
chain over its whole text, so one task reads a whole conversation, however long; its audit
is one value. Copies are found before by grouping (with partial sums): no row meets another.

Defined cases: null roles, texts and, in keys, ids and turns are one space; rows of a null id
are one conversation; null turns come first; rows of one turn are ordered by role, then by
the first 64 characters of the text, then by its SHA-256; roles are told by their first letter
(an empty role, or another letter, must be changed or deleted); a conversation without rows has
zeros, an empty audit and the digest of an empty text. Texts of any length pass through whole;
extra columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import in_arrow
from orderlens.session import stage

DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
#: Rows in a block of the tables.
BLOCK = 4
#: The first letters of roles; all others are one kind. A row's kind is 2 * letter + truncated, the last kind stands for no row.
LETTERS = "sua"
KINDS, NO_ROW = 9, 8
#: States: nothing yet, system, user, assistant last. Inserting or reroling leads to the next wanted role.
WANTED = (2, 2, 3, 2)
#: The state after keeping a row, by letter and state.
KEEP = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None, None, None, None))
ROLE = {2: "user", 3: "assistant"}
#: Costs behind the last row: what is still to be inserted.
END = (0, 2 * INSERT, INSERT, 0)

_WHITE = " \t\n\x0b\f\r"
_KEY = ("turn", "role", "head", "digest")


def before(rest: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """The costs before a row of this kind from those behind it."""
    if kind == NO_ROW:
        return rest
    letter, extra = kind // 2, CUT_OFF * (kind % 2)
    cost = []
    for q in range(4):
        choices = [DELETE + rest[q], REROLE + extra + rest[WANTED[q]]]
        if (kept := KEEP[letter][q]) is not None:
            choices.append(extra + rest[kept])
        cost.append(min(choices))
    for _ in range(2):  # inserts before the row: user, then assistant
        cost = [min(cost[q], INSERT + cost[WANTED[q]]) for q in range(4)]
    return tuple(cost)


def _less_least(costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(c - min(costs) for c in costs)


class BlockTables:
    """Cost vectors, the step of every block of kinds, and walks of blocks met so far."""

    def __init__(self, length: int = BLOCK):
        self.length = length
        self.vectors, number, steps = [END], {END: 0}, []
        for vector in self.vectors:  # grows while it is read
            steps.append([])
            for kind in range(KINDS):
                step = _less_least(before(vector, kind))
                if step not in number:
                    number[step] = len(self.vectors)
                    self.vectors.append(step)
                steps[-1].append(number[step])
        one = np.array(steps, np.int16)  # [vector behind, kind] -> vector before
        table = one
        for _ in range(length - 1):
            table = one[table].transpose(0, 2, 1).reshape(len(one), -1)  # a row to the left is the higher digit
        self.step = table.tolist()
        self._walks: dict[tuple[int, int, int], tuple[list[str], int]] = {}

    def code(self, kinds: list[int]) -> int:
        """The number of a block; one with fewer rows has none to its left."""
        number = 0
        for kind in [NO_ROW] * (self.length - len(kinds)) + kinds:
            number = number * KINDS + kind
        return number

    def walk(self, behind: int, kinds: list[int], state: int) -> tuple[list[str], int]:
        """The edits up to each row of a block, and the state behind it."""
        key = (behind, self.code(kinds), state)
        if key not in self._walks:
            self._walks[key] = self._expand(self.vectors[behind], kinds, state)
        return self._walks[key]

    @staticmethod
    def _expand(rest: tuple[int, ...], kinds: list[int], q: int) -> tuple[list[str], int]:
        costs = [rest]
        for kind in reversed(kinds):
            costs.append(before(costs[-1], kind))
        costs.reverse()
        edits = []
        for i, kind in enumerate(kinds):
            letter, extra, now, then, made = kind // 2, CUT_OFF * (kind % 2), costs[i], costs[i + 1], ""
            while True:
                if now[q] == DELETE + then[q]:
                    made += "D"
                    break
                if now[q] == INSERT + now[WANTED[q]]:
                    made, q = made + "I", WANTED[q]
                    continue
                kept = KEEP[letter][q]
                if kept is not None and now[q] == extra + then[kept]:
                    made, q = made + "K", kept
                else:
                    made, q = made + "R", WANTED[q]
                break
            edits.append(made)
        return edits, q


@cache
def tables() -> BlockTables:
    return BlockTables()


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` of conversations, damaged by a checksum of id and turn.

    Of twenty remainders, 0 drops the row (copies 0), 1 empties the text, 2 removes its full
    stops, exclamation and question marks, 3 repeats it (copies 2), and 4 sets the role user.
    """
    space = F.lit(" ")
    part = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = df.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), part.alias("part"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("part") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("part") == 0, 0).when(F.col("part") == 3, 2).otherwise(1).alias("copies"),
    )


def _sorted_by_conversation(df: DataFrame, backward: bool) -> DataFrame:
    order = [F.col(c).desc_nulls_last() if backward else F.col(c).asc_nulls_first() for c in _KEY]
    return df.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *order, *([] if backward else ["sort"]))


def _vectors_behind(live: DataFrame) -> DataFrame:
    """``live`` rows with the number of their block, counted from the last, and the vector behind that block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        current, block, behind, held = object(), 0, 0, []
        for batch in batches:
            blocks, vectors = [], []
            for conv, kind in zip(batch.column("conv").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                if conv != current:
                    current, block, behind, held = conv, 0, 0, []
                elif len(held) == t.length:
                    held.reverse()
                    behind, block, held = t.step[behind][t.code(held)], block + 1, []
                held.append(kind)
                blocks.append(block)
                vectors.append(behind)
            columns = {n: batch.column(n) for n in batch.schema.names} | {"block": pa.array(blocks, pa.int64()), "behind": pa.array(vectors, pa.int32())}
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in live.schema)
    return in_arrow(_sorted_by_conversation(live, True), work, f"{schema}, block long, behind int")


def _sheet(rows: DataFrame) -> DataFrame:
    """All that the forward pass reads, one sorted stream of three sorts of rows.

    Sort 0 is a row that is neither blank nor a copy, with its block and vector; sort 1 its text;
    sort 2 counts the rows of one turn, role and text.
    """
    rows = rows.withColumn("text", F.when(F.col("copies") > 0, F.col("text")).otherwise(""))
    solid = F.rtrim(F.col("text"), F.lit(_WHITE))
    looks = [
        F.substring("text", 1, 64).alias("head"),
        F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("digest"),
    ]
    marks = rows.select(
        F.col("conv_id").alias("conv"), F.when(F.col("copies") > 0, F.col("turn")).alias("turn"),
        F.when(F.col("copies") > 0, F.col("role")).otherwise("").alias("role"), *looks, (solid == "").alias("blank"), "copies",
    )
    marks = marks.groupBy("conv", *_KEY, "blank").agg(F.sum("copies").alias("copies"))
    first = rows.where((F.col("copies") > 0) & (solid != "")).groupBy(F.col("conv_id").alias("conv"), "role", "text")
    first = first.agg(F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("turn"))
    letter = F.substring("role", 1, 1)
    kind = F.when(letter == "s", 0).when(letter == "u", 2).when(letter == "a", 4).otherwise(6)
    whole = F.substring(solid, -1, 1).isin(".", "!", "?")
    first = first.select("conv", F.when(~F.col("none"), F.col("turn")).alias("turn"), "role", *looks, (kind + F.when(whole, 0).otherwise(1)).alias("kind"), "text")
    first = stage(first, "messages")
    coded = _vectors_behind(first.drop("text"))
    sheet = coded.withColumn("sort", F.lit(0))
    sheet = sheet.unionByName(first.drop("kind").withColumn("sort", F.lit(1)), allowMissingColumns=True)
    return _sorted_by_conversation(sheet.unionByName(marks.withColumn("sort", F.lit(2)), allowMissingColumns=True), False)


class _Conversation:
    """One conversation while its rows are read: faults, and the edits of all closed blocks."""

    def __init__(self, conv):
        self.conv = conv
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.low = self.high = self.turn = self.letter = None
        self.turns = self.state = 0
        self.block = self.behind = None
        self.kinds: list[int] = []
        self.held: list = []  # rows of the open block [role, text], and numbers of deleted ones between them

    def mark(self, turn, role: str, blank: bool, copies: int, live: bool) -> None:
        if not copies:
            return
        if turn is not None:
            if turn != self.turn:
                self.turns, self.turn = self.turns + 1, turn
            self.low, self.high = turn if self.low is None else self.low, turn
        letter = role[:1]
        if self.letter is not None and self.letter + letter not in ("su", "ua", "au"):
            self.faults["illegal"] += 1
        self.faults["illegal"] += copies - 1
        self.letter = letter
        gone = copies - live
        self.faults["blank" if blank else "duplicate"] += gone
        if gone and self.held and isinstance(self.held[-1], int):
            self.held[-1] += gone
        elif gone:
            self.held.append(gone)

    def live(self, block: int, behind: int, kind: int) -> Iterator[tuple]:
        if block != self.block:
            yield from self.close()
            self.block, self.behind = block, behind
        self.kinds.append(kind)
        self.held.append([None, None])
        self.faults["truncated"] += kind % 2

    def close(self) -> Iterator[tuple]:
        """Edits (letter, times, cost, role, text) of the rows held."""
        state = self.state
        edits, self.state = tables().walk(self.behind, self.kinds, state) if self.kinds else ([], state)
        rows = iter(zip(edits, self.kinds, strict=True))
        for entry in self.held:
            if isinstance(entry, int):
                yield "D", entry, DELETE * entry, None, None
                continue
            made, kind = next(rows)
            for letter in made:
                extra = CUT_OFF * (kind % 2)
                if letter == "D":
                    yield "D", 1, DELETE, None, None
                elif letter == "K":
                    state = KEEP[kind // 2][state]
                    yield "K", 1, extra, *entry
                else:
                    state = WANTED[state]
                    yield (letter, 1, INSERT, ROLE[state], "") if letter == "I" else (letter, 1, REROLE + extra, ROLE[state], entry[1])
        self.kinds, self.held = [], []

    def finish(self) -> Iterator[tuple]:
        yield from self.close()
        while self.state in (1, 2):
            self.state = WANTED[self.state]
            yield "I", 1, INSERT, ROLE[self.state], ""

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, tuple | None]]:
    """(conversation, edit) in order; an edit of None ends a conversation."""
    names = ("conv", *_KEY, "sort", "kind", "block", "behind", "text", "blank", "copies")
    now, live = None, None
    for batch in batches:
        for conv, turn, role, head, digest, sort, kind, block, behind, text, blank, copies in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    yield from ((now, e) for e in now.finish())
                    yield now, None
                now, live = _Conversation(conv), None
            if sort == 0:
                yield from ((now, e) for e in now.live(block, behind, kind))
                live = (turn, role, head, digest)
            elif sort == 1:
                now.held[-1][:] = role, text
            else:
                now.mark(turn, role, blank, copies, live == (turn, role, head, digest))
    if now is not None:
        yield from ((now, e) for e in now.finish())
        yield now, None


#: Rows of one batch handed back to Spark, and characters of text in them.
_ROWS, _CHARACTERS = 2_000, 4 << 20


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= _ROWS or size >= _CHARACTERS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies; a frame without copies has each row once."""
    copies = F.col("copies") if "copies" in df.columns else F.lit(1)
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("long").alias("copies"))


def repair(df: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text and the edit (K, R or I) that made the row."""
    sheet = _sheet(_rows(df))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def noted():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv").type
                yield batch

        def rows():
            position = 0
            for conversation, edit in _edits(noted()):
                if edit is None:
                    position = 0
                elif edit[0] != "D":
                    yield conversation.conv, position, edit[3], edit[4], edit[0]
                    position += 1

        produced = rows()
        first = next(produced, None)
        if first is not None:
            schema = pa.schema([("conv_id", kind), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
            yield from _batches(_with(first, produced), schema)

    return in_arrow(sheet, work, f"conv_id {df.schema['conv_id'].dataType.simpleString()}, position long, role string, text string, edit string")


def _with(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def audit(df: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, the cost and letters of its edits, the digest of its repaired rows.

    Rows are ``role:text``, joined by line feeds. gaps counts the turns missing between the
    first and the last, illegal the neighbours whose roles are not su, ua or au.
    """
    sheet = _sheet(_rows(df))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def noted():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv").type
                yield batch

        def rows():
            cost, letters, lines, empty = 0, [], hashlib.sha256(), True
            for conversation, edit in _edits(noted()):
                if edit is not None:
                    cost += edit[2]
                    letters.append(edit[0] * edit[1])
                    if edit[0] != "D":
                        lines.update(f"{'' if empty else chr(10)}{edit[3]}:{edit[4]}".encode())
                        empty = False
                    continue
                yield conversation.conv, conversation.gaps(), *conversation.faults.values(), cost, "".join(letters), lines.hexdigest()
                cost, letters, lines, empty = 0, [], hashlib.sha256(), True

        produced = rows()
        first = next(produced, None)
        if first is not None:
            schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            yield from _batches(_with(first, produced), schema)

    return in_arrow(sheet, work, f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")
