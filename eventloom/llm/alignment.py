"""Links between the tokens that two tokenizers cut the same bytes into.

Tokens and bytes make an incidence matrix for each tokenizer. The row products A.Bt, added up row by row after Gustavson, are
the overlaps of tokens; runs of tokens that overlaps connect are the groups between shared ends. The products of ids by groups
with groups by ids are then the links within groups, and their values say how often each pair of ids is linked.

How many documents hold a pair takes the whole corpus. A block of documents sends every pair it holds once, with the number of
its documents that hold it, and gets the pair's count back once; its documents' links wait in between as numbers of the
block's own list of pairs.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved

#: Characters of text that one step takes (a longer text is a step of its own): few enough for a processor's cache.
STEP = 1 << 18
#: Characters of text, and pairs, after which a task begins a new block.
BLOCK_SIZE, BLOCK_PAIRS = 32 << 20, 1 << 21
#: Products that are added up at a time; a row of more is one step of its own.
PRODUCTS = 1 << 21


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has values[at[i]:at[i+1]] in columns[at[i]:at[i+1]]."""

    at: np.ndarray
    columns: np.ndarray
    values: np.ndarray


def gathered(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sum of each one's values."""
    if len(keys) > 1 and not (keys[1:] >= keys[:-1]).all():
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values[:0]


def csr(rows: np.ndarray, columns: np.ndarray, height: int, width: int) -> Csr:
    """The matrix that counts each (row, column)."""
    keys, values = gathered(rows * width + columns, np.ones(len(rows), np.int64))
    row = keys // width
    return Csr(np.append(0, np.cumsum(np.bincount(row, minlength=height))), keys - row * width, values)


def product(a: Csr, b: Csr, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a.b row by row: each entry of a row of a brings the row of b that it points to, times its value; what falls on one column
    is added up. Yields (rows, columns, values) of blocks of rows, in order."""
    sizes = b.at[a.columns + 1] - b.at[a.columns]
    before = np.append(0, np.cumsum(sizes))[a.at]
    height, lo = len(a.at) - 1, 0
    while lo < height:
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PRODUCTS, "right")) - 1)
        part = slice(a.at[lo], a.at[hi])
        n = sizes[part]
        entry = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b.at[a.columns[part]], n)
        row = np.repeat(np.arange(lo, hi), np.diff(a.at[lo : hi + 1]))[entry]
        keys, values = gathered(row * width + b.columns[place], a.values[part][entry] * b.values[place])
        row = keys // width
        yield row, keys - row * width, values
        lo = hi


def bytes_of(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Token of each byte, in order, and the number of bytes."""
    return np.repeat(np.arange(len(ids)), lengths[ids]), int(lengths[ids].sum())


def groups_of(a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two token sequences of the same bytes: the group of each token of a, of each of b, and for each overlap the token of a.

    A token of a begins a group if the last token of b that the token before overlaps isn't the first that it overlaps itself:
    then both sequences have an end between them.
    """
    by_byte, n = bytes_of(a, a_lengths)
    owner, _ = bytes_of(b, b_lengths)
    incidence = Csr(np.append(0, np.cumsum(a_lengths[a])), np.arange(n), np.ones(n, np.int8))
    transposed = Csr(np.arange(n + 1), owner, np.ones(n, np.int8))
    found = [(r, c) for r, c, _ in product(incidence, transposed, max(len(b), 1))]
    rows, columns = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    edge = np.append(0, np.cumsum(np.bincount(rows, minlength=len(a))))
    starts = np.ones(len(a), bool)
    starts[1:] = columns[edge[1:-1]] != columns[edge[1:-1] - 1]
    group = np.cumsum(starts) - 1
    of_b = np.zeros(len(b), np.int64)
    of_b[columns] = group[rows]
    return group, of_b, rows


def _digits(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of every id, left-aligned in rows of one width with a place for a separator, and their number."""
    text = np.array([str(i).encode() for i in range(vocabulary)])
    width = text.dtype.itemsize
    return np.concatenate([text.view(np.uint8).reshape(-1, width), np.zeros((vocabulary, 1), np.uint8)], axis=1), np.char.str_len(text)


def written(ids: np.ndarray, after: np.ndarray, digits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each with the byte `after` it, as bytes, and the place after each id."""
    rows, n = digits[ids], size[ids]
    rows[np.arange(len(ids)), n] = after
    return rows[np.arange(rows.shape[1]) <= n[:, None]], np.cumsum(n + 1)


class Tokenizers:
    """Tokenizer A (byte-level BPE) and B (pieces with byte fallback), with every token's bytes.

    A's ids are those of `tokenizers` with special tokens' strings taken as plain text: its ranks, run by tiktoken.
    """

    def __init__(self, byte_level: str, pieces: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(byte_level.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.digits, self.sizes = _digits(max(len(self.a_bytes), len(self.b_bytes)))

    def ids(self, text: str | None) -> tuple[np.ndarray, list[int]]:
        """A's and B's ids; none where there is no text, or where either's bytes aren't the text's. A loses no byte of any text,
        so its length tells."""
        if text:
            whole = " " + text
            a, b, raw = np.array(self.a.encode_ordinary(whole), np.int64), self.b.encode(text, num_threads=1), whole.encode()
            if b"".join(map(self.b_bytes.__getitem__, b)) == raw and self.a_lengths[a].sum() == len(raw):
                return a, b
        return np.zeros(0, np.int64), []


@functools.lru_cache(maxsize=1)
def _tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


class Aligned(NamedTuple):
    """Per document: numbers of tokens, groups, links and overlaps, the digest of its groups, and its pairs: (document, pair id,
    times linked), ascending."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    n_overlaps: np.ndarray
    digests: list[str]
    document: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def aligned(texts: list[str | None], t: Tokenizers) -> Aligned:
    """Groups and links of some texts, which stand one after another in the matrices; a text's end is a shared end."""
    both = [t.ids(x) for x in texts]
    n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
    a = np.concatenate([x[0] for x in both]) if both else np.zeros(0, np.int64)
    b = np.fromiter(itertools.chain.from_iterable(x[1] for x in both), np.int64, int(n_b.sum()))
    doc_a, doc_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    group_a, group_b, overlaps = groups_of(a, b, t.a_lengths, t.b_lengths)
    doc_of = doc_a[np.flatnonzero(np.append(True, group_a[1:] != group_a[:-1]))] if len(a) else doc_a
    groups = len(doc_of)
    # ids of A in a document, by groups; groups by ids of B
    u, row = np.unique(doc_a * len(t.a_bytes) + a, return_inverse=True)
    width = len(t.b_bytes)
    found = list(product(csr(row, group_a, len(u), max(groups, 1)), csr(group_b, b, groups, width), width))
    rows, columns, times = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    document, pair = u[rows] // len(t.a_bytes), u[rows] % len(t.a_bytes) * width + columns
    # the text of groups: A's ids, then B's; a token's place follows the other side's tokens of earlier groups (for B, of its own too)
    sizes_a, sizes_b = (np.bincount(g, minlength=groups) for g in (group_a, group_b))
    place_a = np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(sizes_a)[group_b]
    ids, after = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    ends = np.cumsum(sizes_a + sizes_b)
    after[ends - 1], after[ends - 1 - sizes_b] = ord(";"), ord("|")
    text, ends = written(ids, after, t.digits, t.sizes)
    text, tokens = text.tobytes(), np.append(0, np.cumsum(n_a + n_b))
    edges = np.append(0, ends)[tokens]
    digests = [hashlib.sha256(text[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    count = functools.partial(np.bincount, minlength=len(texts))
    links = np.bincount(document, times, len(texts)).astype(np.int64) if len(times) else np.zeros(len(texts), np.int64)
    return Aligned(n_a, n_b, count(doc_of), links, count(doc_a[overlaps]), digests, document, pair, times)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes of seven bits each, all but a number's last with the eighth bit set."""
    n = 1 + sum((values >> (7 * k) > 0).astype(np.int64) for k in range(1, 9))
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(n.max(initial=0))):
        has = n > k
        out[ends[has] - n[has] + k] = (values[has] >> (7 * k) & 127) | np.where(n[has] > k + 1, 128, 0)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    first = np.flatnonzero(np.append(True, raw[:-1] < 128)) if len(raw) else np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, first) if len(first) else np.zeros(0, np.int64)


class _Pairs:
    """A block's list of pairs, numbered as they come, with the number of documents that hold each."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.documents = np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray) -> np.ndarray:
        """Counts pairs, each of which stands for one document; their numbers."""
        u, inverse, n = np.unique(pairs, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, u)
        known = np.zeros(len(u), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == u[at < len(self.keys)]
        number = np.zeros(len(u), np.int64)
        number[known] = self.numbers[at[known]]
        number[~known] = np.arange(int((~known).sum())) + len(self.keys)
        self.keys = np.insert(self.keys, at[~known], u[~known])
        self.numbers = np.insert(self.numbers, at[~known], number[~known])
        self.documents = np.append(self.documents, np.zeros(int((~known).sum()), np.int64))
        self.documents[number] += n
        return number[inverse]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def _blocks(byte_level: str, pieces: str, key: str, kind: pa.DataType):
    """Rows of documents, each with its links by the numbers of its block's pairs, and the pairs of each block."""
    none = {k: None for k in ("key", *_COUNTS, "groups_sha256", "links", "pair", "number", "documents")}
    kinds = {"key": kind, "groups_sha256": pa.string(), "links": pa.binary()}
    names = {"key": key}

    def batch_of(block: int, n: int, **columns) -> pa.RecordBatch:
        made = {"block": pa.array(np.full(n, block, np.int64))}
        for k in none:
            v = columns.get(k)
            made[names.get(k, k)] = pa.nulls(n, kinds.get(k, pa.int64())) if v is None else v if isinstance(v, pa.Array) else pa.array(v, kinds.get(k, pa.int64()))
        return pa.RecordBatch.from_pydict(made)

    def listed(block: int, pairs: _Pairs) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(pairs.keys), 1 << 16):
            number = pairs.numbers[lo : lo + (1 << 16)]
            yield batch_of(block, len(number), pair=pairs.keys[lo : lo + (1 << 16)], number=number, documents=pairs.documents[number])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, block, pairs, held = _tokenizers(byte_level, pieces), TaskContext.get().partitionId() << 32, _Pairs(), 0
        for batch in batches:
            lo, n = 0, batch.num_rows
            while lo < n:
                hi, size = lo, 0
                texts = []
                while hi < n and (hi == lo or size < STEP):
                    texts.append(batch.column(1)[hi].as_py())
                    size, hi = size + len(texts[-1] or ""), hi + 1
                x = aligned(texts, t)
                number = pairs.add(x.pair)
                edges = np.searchsorted(x.document, np.arange(len(texts) + 1))
                links = []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    order = np.argsort(number[a:b])
                    links.append(packed(np.stack([np.diff(number[a:b][order], prepend=0), x.times[a:b][order]]).ravel()))
                yield batch_of(block, hi - lo, key=batch.column(0).slice(lo, hi - lo), **{k: getattr(x, k) for k in _COUNTS}, groups_sha256=x.digests, links=links)
                held, lo = held + size, hi
                if held >= BLOCK_SIZE or len(pairs.keys) >= BLOCK_PAIRS:
                    yield from listed(block, pairs)
                    block, pairs, held = block + 1, _Pairs(), 0
        yield from listed(block, pairs)

    return run


def _summed(names: list[str]):
    """A block's documents with the sums of their links' counts."""

    def run(documents: pa.Table, counts: pa.Table) -> pa.Table:
        number = counts.column("number").to_numpy()
        count, best = np.zeros((2, len(number)), np.int64)
        count[number], best[number] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
        best = count == best
        sums, bests = [], []
        for data in documents.column("links"):
            number, times = unpacked(data.as_py()).reshape(2, -1)
            number = np.cumsum(number)
            sums.append(int((count[number] * times).sum()))
            bests.append(int(times[best[number]].sum()))
        out = documents.select(names)
        return out.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    return run


def links(docs: DataFrame, byte_level: str, pieces: str, key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps of every row of docs (key, text).

    Texts null, empty or not given back by both tokenizers have no tokens: zeros and an empty digest. Rows stand for themselves,
    and count as one document each, repeated keys and null ones too. No rows, no rows. A task holds one block of documents'
    pairs, or one document's.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    numbers = ", ".join(f"{k} long" for k in _COUNTS)
    made = docs.select(key, "text").mapInArrow(
        _blocks(byte_level, pieces, key, to_arrow_type(kind)), f"block long, `{key}` {kind.simpleString()}, {numbers}, groups_sha256 string, links binary, pair long, number long, documents long"
    )
    made = saved(made, "zstd")
    pairs = made.where("pair is not null").select("block", "pair", "number", "documents")
    width = len(_tokenizers(byte_level, pieces).b_bytes)
    counts = pairs.groupBy("pair").agg(F.sum("documents").alias("count")).withColumn("a", F.floor(F.col("pair") / width))
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    counts = counts.join(best, "a").select("pair", "count", "best")
    answers = pairs.join(counts, "pair").select(F.col("block").alias("of"), "number", "count", "best")
    documents = made.where("pair is null").select("block", key, *_COUNTS, "groups_sha256", "links")
    names = [key, *_COUNTS, "groups_sha256"]
    out = documents.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(
        _summed(names), f"`{key}` {kind.simpleString()}, {numbers}, groups_sha256 string, n_best long, count_sum long"
    )
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
