"""Shortest-pack-first packing over the histogram of piece lengths.

Documents longer than the capacity give full pieces and one remainder. Lengths are placed longest first, each into the
emptiest pack (if that has no room, none has); packs alike are one pattern with a count, so the work follows the number of
lengths, not of documents. What a pattern still misses is then filled by cutting the emptiest packs up, and what the last
pack holds goes to sequences of a power of two, so no sequence is padded. Patterns meet the pieces again by rank.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved
from .packing import Encoder
from .ranks import ranked, salts_of

CAPACITY, END = 1024, 0


@dataclass(frozen=True)
class Packs:
    """`count` packs alike, each with `fill` ids: the n-th of them holds, one after another, for each member (length, rank) the
    piece of that length and of rank + n."""

    count: int
    fill: int
    members: tuple[tuple[int, int], ...]

    def split(self, n: int) -> tuple[Packs, Packs | None]:
        """The first n packs, and the others."""
        rest = self.count - n
        return Packs(n, self.fill, self.members), Packs(rest, self.fill, tuple((a, r + n) for a, r in self.members)) if rest else None


def placed(counts: dict[int, int], capacity: int) -> list[Packs]:
    """Packs of whole pieces: lengths longest first, each into the emptiest pack with room."""
    by_fill: dict[int, list[Packs]] = defaultdict(list)
    fills: list[int] = []

    def put(packs: Packs) -> None:
        if not by_fill[packs.fill]:
            heapq.heappush(fills, packs.fill)
        by_fill[packs.fill].append(packs)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            while fills and not by_fill[fills[0]]:
                heapq.heappop(fills)
            if fills and fills[0] + length <= capacity:
                found = by_fill[fills[0]].pop()
                taking, others = found.split(min(found.count, left))
                if others:
                    by_fill[others.fill].append(others)
                put(Packs(taking.count, taking.fill + length, (*taking.members, (length, rank))))
                rank, left = rank + taking.count, left - taking.count
                continue
            # new packs, each with as many pieces of this length as it holds; the last may hold fewer
            per = capacity // length
            for n, copies in ((left // per, per), (1, left % per)):
                if n and copies:
                    put(Packs(n, copies * length, tuple((length, rank + i * n) for i in range(copies))))
                    rank += n * copies
            left = 0
    return [p for packs in by_fill.values() for p in packs]


def powers(n: int) -> Iterator[tuple[int, int]]:
    """(exponent, start) of n's powers of two, the largest first, laid one after another."""
    at = 0
    while n > at:
        b = (n - at).bit_length() - 1
        yield b, at
        at += 1 << b


@dataclass(frozen=True)
class Plan:
    """members (length, low, high, slot, slots): pieces of a length, ranks low to under high, have the parts of `slots` slots
    from `slot` on. parts (slot, low, high, start, size, first, offset): in that slot the piece of rank low + n has its ids
    start..start+size in sequence first + n at offset; ranks that no part names have none there."""

    members: np.ndarray
    parts: np.ndarray


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Packs of whole pieces, whose gaps the emptiest packs fill: of those that aren't full, as many of the fullest are filled as
    all their ids can fill. The others are cut into powers of two, and so are the gaps; a power that is left over on one side
    is halved. What is then left is less than a pack, and makes sequences of powers of two."""
    packs = sorted(placed(counts, capacity), key=lambda p: -p.fill)
    ids = sum(p.count * p.fill for p in packs)
    full = ids // capacity
    keys: list[tuple[int, int, int]] = []  # a member's length and ranks
    cells: list[list] = []  # a member's (start, size, low, high, first, offset)
    need, have = defaultdict(list), defaultdict(list)
    first = 0
    for p in packs:
        here, there = p.split(min(p.count, max(0, full - first))) if first < full else (None, p)
        at = 0
        for length, rank in here.members if here else ():
            keys.append((length, rank, rank + here.count))
            cells.append([(0, length, rank, rank + here.count, first, at)])
            at += length
        if here:
            for b, start in powers(capacity - here.fill):
                need[b].append((here.count, first, here.fill + start))
            first += here.count
        for length, rank in there.members if there else ():
            for b, start in powers(length):
                have[b].append((there.count, len(keys), start, rank))
            keys.append((length, rank, rank + there.count))
            cells.append([])
    for b, _ in powers(ids - full * capacity):
        need[b].append((1, first, 0))
        first += 1
    for b in range(capacity.bit_length() - 1, -1, -1):
        given, wanted, half = have[b], need[b], 1 << b >> 1
        while given and wanted:
            (n, member, start, rank), (m, sequence, offset) = given.pop(), wanted.pop()
            k = min(n, m)
            cells[member].append((start, 1 << b, rank, rank + k, sequence, offset))
            if n > k:
                given.append((n - k, member, start, rank + k))
            if m > k:
                wanted.append((m - k, sequence + k, offset))
        for n, member, start, rank in given:
            have[b - 1] += [(n, member, start, rank), (n, member, start + half, rank)]
        for m, sequence, offset in wanted:
            need[b - 1] += [(m, sequence, offset), (m, sequence, offset + half)]
    members, parts, slots = [], [], 0
    for k in sorted(range(len(keys)), key=keys.__getitem__):
        kinds = {c: slots + i for i, c in enumerate(dict.fromkeys((c[0], c[1]) for c in sorted(cells[k])))}
        members.append((*keys[k], slots, len(kinds)))
        parts += [(kinds[c[:2]], c[2], c[3], c[0], c[1], c[4], c[5]) for c in cells[k]]
        slots += len(kinds)
    return Plan(np.array(members, np.int64).reshape(-1, 5), np.array(sorted(parts), np.int64).reshape(-1, 7))


def _pieces(tokenizer: str, capacity: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = Encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                ids = np.array([*encoder.ids(batch.column(1)[i].as_py() or ""), END], "<u4")
                whole = len(ids) // capacity * capacity
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity].tobytes()
                    out.append((row, i, start, len(part) // 4, len(ids), zlib.crc32(part), part if start >= whole else None))
                    row += 1
            rows, at, start, length, tokens, crc, left = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, tokens, crc)), pa.array(left, pa.binary())],
                ["row", key, "start", "length", "doc_tokens", "crc", "ids"],
            )

    return run


def _ragged(counts: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with `counts` places from `firsts` on each: the row and the place of every one."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + firsts[row]


def _parts(found: Plan, key: str):
    """The parts of each ranked piece."""
    members, parts = found.members, found.parts
    by_member, by_slot = members[:, 0] << 44 | members[:, 1], parts[:, 0] << 40 | parts[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length"), np.int64), np.asarray(batch.column("rank"), np.int64) - 1
            k = members[np.searchsorted(by_member, length << 44 | rank, "right") - 1]
            row, slot = _ragged(k[:, 4], k[:, 3])
            hit = parts[np.maximum(np.searchsorted(by_slot, slot << 40 | rank[row], "right") - 1, 0)]
            there = (hit[:, 0] == slot) & (hit[:, 2] > rank[row])
            row, hit = row[there], hit[there]
            taken = batch.take(pa.array(row))
            start = np.asarray(taken.column("start"), np.int64) + hit[:, 3]
            values = (hit[:, 3], start, hit[:, 4], hit[:, 5] + rank[row] - hit[:, 1], hit[:, 6])
            yield pa.RecordBatch.from_arrays(
                [*(taken.column(c) for c in ("row", key, "doc_tokens", "crc")), *(pa.array(v, pa.int64()) for v in values), pa.array(hit[:, 4] < length[row])],
                ["row", key, "doc_tokens", "crc", "within", "start", "length", "sequence_id", "offset", "is_cut"],
            )

    return run


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        within, length = batch.column("within").to_pylist(), batch.column("length").to_pylist()
        crc = [zlib.crc32(memoryview(ids.as_buffer())[4 * a : 4 * (a + n)]) for ids, a, n in zip(batch.column("ids"), within, length, strict=True)]
        yield batch.drop_columns(["ids", "within"]).append_column("ids_crc32", pa.array(crc, pa.int64()))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs (key, text).

    Null and empty texts are the end id alone. Rows of equal key, null ones too, are packed each for itself. An empty table
    gives no rows. Every id lies in one piece; sequences are full or of a power of two. Which of several equally long pieces
    takes which place follows from a hash of the piece, so reruns agree. Only the lengths' counts reach the driver; the plan
    that goes back depends on the capacity, whatever the number of documents.
    """
    kind = docs.schema[key].dataType.simpleString()
    pieces = docs.select(key, "text").mapInArrow(_pieces(tokenizer, capacity, key), f"row long, `{key}` {kind}, start long, length long, doc_tokens long, crc long, ids binary")
    pieces = saved(pieces, "zstd")
    counts = {x["length"]: x["n"] for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = ranked(pieces.drop("ids").withColumn("level", F.lit(0)), ["length"], "level", [F.col(f"`{k}`") for k in (key, "start", "crc", "row")], salts_of(sum(counts.values())))
    rows = rows.select("row", key, "start", "length", "doc_tokens", "crc", "rank")
    parts = rows.mapInArrow(
        _parts(plan(counts, capacity), key), f"row long, `{key}` {kind}, doc_tokens long, crc long, within long, start long, length long, sequence_id long, offset long, is_cut boolean"
    )
    parts = saved(parts)
    names = [F.col(f"`{key}`"), *map(F.col, ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    whole = parts.where("not is_cut").withColumnRenamed("crc", "ids_crc32").select(*names)
    cut = parts.where("is_cut").drop("crc", "is_cut").join(pieces.where("ids is not null").select("row", "ids"), "row")
    cut = cut.select("row", key, "doc_tokens", "start", "length", "sequence_id", "offset", "within", "ids")
    cut = cut.mapInArrow(_crc, f"row long, `{key}` {kind}, doc_tokens long, start long, length long, sequence_id long, offset long, ids_crc32 long")
    return whole.unionByName(cut.select(*names))
