"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Lengths are integers up to the capacity, so documents range-sorted by length and gaps range-sorted by size are runs of
equal numbers. A round takes the longest documents that are left and sweeps the gaps for each one's successor (the least
gap that holds it); documents of one length and gaps of one size are matched by rank, a document per gap; the gaps shrink,
and the next round follows. A round's matches are ranges of ranks, whatever the number of documents: the sweep works on
the lengths' counts, and the pieces find their places by a join of their ranks with those ranges.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved
from .ranks import ranked, salts_of

CAPACITY, END = 1024, 2
_SPECIAL = "<|endoftext|>"


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


class Encoder:
    """Ids of texts, as `tokenizers` gives them for the file: its byte-level ranks run by tiktoken, which is faster and
    gives the same ids; a text that holds a special token's string goes to `tokenizers` itself."""

    def __init__(self, tokenizer: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        with open(tokenizer.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if _SPECIAL in text:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _cut(tokenizer: str, capacity: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            keys, out = batch.column(0), ([], [], [], [], [])
            for i in range(batch.num_rows):
                ids = np.array([*encoder.ids(batch.column(1)[i].as_py() or ""), END], "<u4")
                for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    for values, v in zip(out, (i, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        values.append(v)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], [key, "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit of counts[length] documents: (length, first rank, end rank, first sequence, offset) of each matched range.

    Gaps of one size are kept as ranges of sequence numbers, so the work follows the number of lengths, not of documents.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []  # with gaps, ascending
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            # a sweep: every gap that holds the length takes one document, least gaps first
            now = [g for g in sorted(sizes) if g >= length]
            if not now:
                # new sequences, which hold `per` documents of this length each; the last may hold fewer
                per = capacity // length
                full, rest = divmod(left, per)
                for turn in range(per):
                    if n := full + (turn < rest):
                        out.append((length, rank, rank + n, opened, turn * length))
                        rank += n
                if full:
                    gaps[capacity - per * length].append((opened, opened + full))
                if rest:
                    gaps[capacity - rest * length].append((opened + full, opened + full + 1))
                opened, left = opened + full + (rest > 0), 0
            for g in now:
                moved = gaps[g]
                gaps[g] = []
                while moved and left:
                    a, b = moved.pop()
                    n = min(b - a, left)
                    out.append((length, rank, rank + n, a, capacity - g))
                    gaps[g - length].append((a, a + n))
                    if n < b - a:
                        moved.append((a + n, b))
                    rank, left = rank + n, left - n
                gaps[g] += moved
                if not left:
                    break
            sizes = [g for g, x in gaps.items() if x and g]
        sizes = [g for g, x in gaps.items() if x and g]
    return out


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (key, text).

    Null and empty texts are the end id alone. Rows of equal key are packed each for itself. Texts over the capacity are
    cut, the remainder first. An empty table gives no rows. Which of several equally long pieces takes which place follows
    from a hash of the piece, so reruns agree.
    """
    kind = docs.schema[key].dataType.simpleString()
    pieces = saved(docs.select(key, "text").mapInArrow(_cut(tokenizer, capacity, key), f"{key} {kind}, piece int, start long, length long, ids_crc32 long"))
    counts = {x["length"]: x["n"] for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spark = docs.sparkSession
    ranges = spark.createDataFrame(plan(counts, capacity) or [], "length long, low long, high long, first long, offset long")
    rows = ranked(pieces.withColumn("level", F.lit(0)), ["length"], "level", [F.col(k) for k in (key, "piece", "start", "ids_crc32")], salts_of(sum(counts.values())))
    # a length has as many ranges as gap sizes at most: a join on the length and the rank's place among the ranges
    starts = ranges.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "first", "offset"))).alias("ranges"))
    rows = rows.join(F.broadcast(starts), "length")
    hit = F.filter("ranges", lambda x: (x["low"] < F.col("rank")) & (x["high"] >= F.col("rank")))[0]
    rows = rows.withColumn("hit", hit)
    return rows.select(key, "piece", "start", "length", "ids_crc32", (F.col("hit.first") + F.col("rank") - 1 - F.col("hit.low")).alias("sequence_id"), F.col("hit.offset").alias("offset"))
