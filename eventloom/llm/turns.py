"""Repair of the turns of conversations: the cheapest edits that make the roles an optional system turn and pairs of user and
assistant.

Turns are aligned with each length of the grammar's string that can be reached (Wagner-Fischer), within the band of cells that
the best cost so far leaves (Ukkonen); among equal costs the audits, traced back, are compared. A long conversation is aligned
in blocks of rows: of a block only the place in the grammar where it begins and ends matters. Blocks hand the cost of what
follows backwards, and the place reached forwards. Inserts come before a row and never after a block's last one, so no audit
of a block is another's beginning and the least audit is the least of each block in turn.

Conversations of a bounded size are repaired where their rows meet. Those that are larger are spread over many tasks as chunks.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import saved

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a block, and rows and characters from which a conversation, or a chunk of one, is large.
BLOCK, LARGE_ROWS, LARGE_SIZE = 12, 4096, 4 << 20
#: Places in the grammar: nothing yet, after the system turn, after a user's, after an assistant's; where a conversation may end.
PLACES, NEVER = range(4), 1 << 40
FINAL = (0, NEVER, NEVER, 0)
#: The same where inserts may still follow.
ENDED = (0, 2 * INSERT, INSERT, 0)
_AFTER = {"s": 1, "u": 2, "a": 3}
_ROLE = {"u": "user", "a": "assistant"}
_BLANK = " \t\n\v\f\r"

NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def targets(place: int, length: int) -> list[str]:
    """The grammar's strings of a length from a place on."""
    plain = (("au" if place == 2 else "ua") * length)[:length]
    return [plain, ("s" + plain)[:length]] if place == 0 and length else [plain]


def _table(rows: str, target: str, last: bool, most: int) -> dict[tuple[int, int], int]:
    """Least cost from each cell (rows used, symbols written) to the end, for cells that a path of cost `most` can touch."""
    m, n, cost = len(rows), len(target), {}

    def gap(rows_left: int, symbols_left: int) -> int:
        return DELETE * (rows_left - symbols_left) if rows_left > symbols_left else INSERT * (symbols_left - rows_left)

    for i in range(m, -1, -1):
        for j in range(n, -1, -1):
            if gap(i, j) + gap(m - i, n - j) > most:
                continue
            best = 0 if i == m and j == n else NEVER
            if j < n and target[j] != "s" and (i < m or last):
                best = min(best, INSERT + cost.get((i, j + 1), NEVER))
            if i < m:
                best = min(best, DELETE + cost.get((i + 1, j), NEVER))
                if j < n:
                    best = min(best, _match(rows[i], target[j]) + cost.get((i + 1, j + 1), NEVER))
            if best < NEVER:
                cost[i, j] = best
    return cost


def _match(row: str, symbol: str) -> int:
    """Cost of a row's staying as a symbol."""
    if row == "x":
        return NEVER
    own = row.lower()
    return (0 if own == symbol else NEVER if symbol == "s" else REROLE) + (TRUNCATED if own != row or row == "_" else 0)


def _trace(rows: str, target: str, cost: dict[tuple[int, int], int]) -> str:
    """The ASCII-least audit of those that the table's cost allows."""
    i = j = 0
    out = []
    while i < len(rows) or j < len(target):
        here = cost[i, j]
        if i < len(rows) and here == DELETE + cost.get((i + 1, j), NEVER):
            out.append("D")
            i += 1
        elif j < len(target) and target[j] != "s" and here == INSERT + cost.get((i, j + 1), NEVER):
            out.append("I")
            j += 1
        else:
            out.append("K" if rows[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return "".join(out)


@functools.lru_cache(maxsize=1 << 16)
def align(rows: str, place: int, after: tuple[int, ...], last: bool) -> tuple[int, str, int]:
    """(cost, audit, place reached) of a block of rows from a place on, where `after` is the cost of what follows each place.

    A row is x (it must go), or its role's initial, - for any other, and S, U, A, _ if it is truncated.
    """
    m = len(rows)
    best = (NEVER, "", place)
    for length in sorted(range(2 * m + 3), key=lambda n: abs(n - m + rows.count("x"))):
        least = DELETE * (m - length) if m > length else INSERT * (length - m)
        for target in targets(place, length):
            reached = _AFTER[target[-1]] if target else place
            if after[reached] >= NEVER or least + after[reached] > best[0]:
                continue
            cost = _table(rows, target, last, min(best[0], NEVER - 1) - after[reached])
            total = cost.get((0, 0), NEVER) + after[reached]
            if total < NEVER and total <= best[0]:
                best = min(best, (total, _trace(rows, target, cost), reached))
    return best


def blocks(rows: str) -> list[str]:
    return [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)] or [""]


def _before(block: str, after: tuple[int, ...], last: bool) -> tuple[int, ...]:
    """The cost of a block and of what follows, for each place before it."""
    least = min(after)
    even = tuple(min(x - least, NEVER) if x < NEVER else NEVER for x in after)
    return tuple(min(align(block, p, even, last)[0] + least, NEVER) for p in PLACES)


def backwards(rows: str, after: tuple[int, ...], last: bool) -> list[tuple[int, ...]]:
    """For each block of rows the cost of what follows it, by place; before them, that of all."""
    parts = blocks(rows)
    out = [after]
    for k, block in reversed(list(enumerate(parts))):
        out.append(_before(block, out[-1], last and k == len(parts) - 1))
    return out[::-1]


def forwards(rows: str, place: int, costs: list[tuple[int, ...]], last: bool) -> tuple[str, int]:
    """The audit of rows from a place on, and the place reached."""
    parts, out = blocks(rows), []
    for k, block in enumerate(parts):
        least = min(costs[k + 1])
        even = tuple(x - least if x < NEVER else NEVER for x in costs[k + 1])
        _, audit, place = align(block, place, even, last and k == len(parts) - 1)
        out.append(audit)
    return "".join(out), place


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str  # blank, duplicate, truncated or nothing


def _initial(role: str) -> str:
    return role[:1] if role[:1] in _AFTER else "-"


def coded(rows: Iterable[Row]) -> str:
    out = []
    for r in rows:
        own = _initial(r.role)
        out.append("x" if r.fault in ("blank", "duplicate") else own.upper().replace("-", "_") if r.fault == "truncated" else own)
    return "".join(out)


class Tally:
    """Counts and digest of one conversation, whose rows and audit come piece by piece in order."""

    def __init__(self):
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.turns = 0
        self.first = self.turn = self.initial = None
        self.place, self.audit, self.written, self.sha = 0, [], False, hashlib.sha256()

    def rows(self, rows: list[Row]) -> None:
        for r in rows:
            if r.fault:
                self.faults[r.fault] += 1
            own = _initial(r.role)
            self.illegal += self.initial is not None and self.initial + own not in ("su", "ua", "au")
            self.initial = own
            if r.turn is not None and r.turn != self.turn:
                self.first, self.turn, self.turns = r.turn if self.first is None else self.first, r.turn, self.turns + 1

    def edits(self, rows: list[Row], audit: str) -> None:
        i = 0
        for edit in audit:
            wanted = "a" if self.place == 2 else "u"
            if edit != "D":
                symbol = _initial(rows[i].role) if edit == "K" else wanted
                said = "" if edit == "I" else rows[i].text
                role = rows[i].role if edit == "K" else _ROLE[symbol]
                self.sha.update(f"{chr(10) if self.written else ''}{role}:{said}".encode())
                self.place, self.written = _AFTER[symbol], True
            i += edit != "I"
        self.audit.append(audit)

    def result(self, cost: int) -> tuple:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.sha.hexdigest()


def repaired(rows: list[Row]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of one conversation's rows in order."""
    tally, code = Tally(), coded(rows)
    costs = backwards(code, FINAL, True)
    tally.rows(rows)
    tally.edits(rows, forwards(code, 0, costs, True)[0])
    return tally.result(costs[0][0])


def damaged(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turn, role, text and how often each row then stands there (0 if it was dropped). Nulls are one space."""
    turn = F.col("turn")
    code = F.crc32(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        key,
        turn,
        F.when(code == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def _fault(role: str, text: str, seen: bool) -> str:
    left = text.rstrip(_BLANK)
    return "blank" if not left else "duplicate" if seen else "" if left[-1] in ".!?" else "truncated"


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _schema(key: str, kind: pa.DataType) -> pa.Schema:
    return pa.schema([(key, kind), *((k, pa.int64()) for k in NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _batched(rows: Iterable[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    for some in itertools.batched(rows, most):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def _each(schema: pa.Schema):
    """Conversations of a bounded size, whose rows follow one another in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results():
            for key, rows in itertools.groupby(_rows_of(batches), lambda r: r[0]):
                seen, found = set(), []
                for _, turn, role, text, copies in rows:
                    for _ in range(copies):
                        found.append(Row(turn, role, text, _fault(role, text, (role, text) in seen)))
                        seen.add((role, text))
                yield key, *repaired(found)

        yield from _batched(results(), schema)

    return run


def _chunks(schema: pa.Schema):
    """Rows in order as chunks: their turns, roles, texts and faults, and the cost from each place before to each place after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def single():
            for key, turn, role, text, copies, seen in _rows_of(batches):
                for k in range(copies):
                    yield key, Row(turn, role, text, _fault(role, text, seen or k > 0))

        def results():
            for key, rows in itertools.groupby(single(), lambda r: r[0]):
                number, found, size = 0, [], 0
                for row in itertools.chain((r for _, r in rows), [None]):
                    if found and (row is None or len(found) >= LARGE_ROWS or size >= LARGE_SIZE):
                        code = coded(found)
                        ways = [backwards(code, tuple(0 if p == q else NEVER for q in PLACES), False)[0] for p in PLACES]
                        yield key, part, number, *map(list, zip(*found, strict=True)), [way[p] for p in PLACES for way in ways]
                        number, found, size = number + 1, [], 0
                    if row is not None:
                        found.append(row)
                        size += len(row.text)

        yield from _batched(results(), schema, 1)

    return run


def _following(chunks: pd.DataFrame) -> pd.DataFrame:
    """For each chunk of a conversation the cost of what follows it, by place."""
    chunks = chunks.sort_values(["part", "number"])
    after, out = ENDED, []
    for ways in reversed(list(chunks["ways"])):
        out.append(list(after if out else FINAL))
        after = tuple(min(min(int(ways[4 * p + q]) + after[q], NEVER) for q in PLACES) for p in PLACES)
    return chunks.assign(after=out[::-1], cost=after[0]).drop(columns="ways")


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's audit from each place on."""
    for batch in batches:
        audits = []
        for turns, roles, texts, faults, after, last in zip(*(batch.column(k).to_pylist() for k in ("turns", "roles", "texts", "faults", "after", "last")), strict=True):
            code = coded(map(Row, turns, roles, texts, faults))
            costs = backwards(code, tuple(after), last)
            audits.append([forwards(code, p, costs, last)[0] if costs[0][p] < NEVER else None for p in PLACES])
        yield batch.append_column("audits", pa.array(audits, pa.list_(pa.string())))


def _joined(schema: pa.Schema):
    """Conversations whose chunks follow one another in order: one chunk at a time, and the audit, are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results():
            for key, chunks in itertools.groupby(_rows_of(batches), lambda r: r[0]):
                tally = Tally()
                for _, cost, turns, roles, texts, faults, audits in chunks:
                    rows = list(map(Row, turns, roles, texts, faults))
                    tally.rows(rows)
                    tally.edits(rows, audits[tally.place])
                yield key, *tally.result(cost)

        yield from _batched(results(), schema)

    return run


def _order(key: str) -> list[Column]:
    return [F.col(f"`{key}`"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _large(rows: DataFrame, key: str, schema: pa.Schema, ddl: str, kind: str) -> DataFrame:
    """Large conversations: alike rows become one with a number, the others are range-sorted into chunks wherever they lie."""
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    rows = rows.where("copies > 0").groupBy(key, "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = rows.groupBy(F.col(f"`{key}`").alias("of"), F.col("said").alias("same")).agg(F.min(place).alias("first"))
    rows = rows.join(first, F.col(f"`{key}`").eqNullSafe(F.col("of")) & (F.col("said") == F.col("same")))
    rows = rows.select(key, "turn", "role", "text", "copies", (place > F.col("first")).alias("seen"))
    rows = rows.repartitionByRange(*_order(key)).sortWithinPartitions(*_order(key))
    lists = "turns array<long>, roles array<string>, texts array<string>, faults array<string>"
    made = pa.schema(
        [schema.field(0), ("part", pa.int64()), ("number", pa.int64()), ("turns", pa.list_(pa.int64())), *((k, pa.list_(pa.string())) for k in ("roles", "texts", "faults")), ("ways", pa.list_(pa.int64()))]
    )
    chunks = saved(rows.mapInArrow(_chunks(made), f"`{key}` {kind}, part long, number long, {lists}, ways array<long>"))
    ends = chunks.groupBy(key).agg(F.max(F.struct("part", "number")).alias("end"))
    after = chunks.select(key, "part", "number", "ways").groupBy(key).applyInPandas(_following, f"`{key}` {kind}, part long, number long, after array<long>, cost long")
    after = after.join(ends.withColumnRenamed(key, "of"), F.col(f"`{key}`").eqNullSafe(F.col("of")))
    after = after.select(F.col(f"`{key}`").alias("of"), F.col("part").alias("p"), F.col("number").alias("n"), "after", "cost", (F.struct("part", "number") == F.col("end")).alias("last"))
    joined = chunks.drop("ways").join(after, F.col(f"`{key}`").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")) & (F.col("number") == F.col("n"))).drop("of", "p", "n")
    traced = joined.mapInArrow(_audits, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in joined.schema)}, audits array<string>")
    traced = traced.repartition(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`"), "part", "number")
    return traced.select(key, "cost", "turns", "roles", "texts", "faults", "audits").mapInArrow(_joined(schema), ddl)


def repair(conversations: DataFrame, key: str = "conv_id", large_rows: int = LARGE_ROWS, large_size: int = LARGE_SIZE) -> DataFrame:
    """One row for each key of conversations (key, turn, role, text), damaged by rule first: gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    A null key is a conversation of its own; null turns come first, null roles and texts are one space. Rows of one turn are taken
    in order of role and text, so repeated rows lie beside each other. A conversation all of whose rows were dropped has zeros,
    an empty audit and the hash of nothing. An empty table gives no rows. A conversation of more than large_rows rows or
    large_size characters takes the way over chunks; its digest, which no two tasks can share, is read chunk by chunk.
    """
    kind = conversations.schema[key].dataType
    schema = _schema(key, to_arrow_type(kind))
    ddl = f"`{key}` {kind.simpleString()}, {', '.join(f'{k} long' for k in NUMBERS)}, audit string, repaired_sha256 string"
    rows = damaged(conversations, key)
    sizes = rows.groupBy(F.col(f"`{key}`").alias("of")).agg(F.sum("copies").alias("n"), F.sum(F.length("text")).alias("size"))
    large = saved(sizes.where((F.col("n") > large_rows) | (F.col("size") > large_size)).select("of"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("of"))
    small = rows.join(large, same, "left_anti").repartition(F.col(f"`{key}`")).sortWithinPartitions(*_order(key))
    out = small.mapInArrow(_each(schema), ddl)
    if large.isEmpty():
        return out
    return out.unionByName(_large(rows.join(large, same, "left_semi"), key, schema, ddl, kind.simpleString()))
