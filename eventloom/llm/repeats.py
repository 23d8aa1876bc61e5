"""Suffix-array deduplication by bucket-pointer refinement.

Bytes of a text go where a string of `length` bytes that covers them also starts in a document with a smaller doc_id.

Every string of `length` bytes holds one anchor: its q-gram of least hash. Equal strings have equal anchors at equal
places, so the suffixes are dealt out by anchor, and the strings around one anchor make one stretch of text (at most
2 * length - q bytes). The q-gram buckets are counted first, and a bucket of one document is done. What is left is
refined: dense bucket ids of 8-grams, of pairs of those ids at later offsets (16, 32, `length` bytes), each level's ids
being used by the next. A class of equal strings then knows its smallest doc_id.

Texts are dealt into groups by a hash of doc_id. Each group sends a bucket once, however many of its documents hold it,
and gets one answer; so no hot passage is more than one row a group anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CHUNK, U64, byte_column, chunks, mix

Q = 16
GROUP_BYTES = 8 << 20
LEAST_GROUPS = 64
#: Bytes of text, and of stretches to refine, that one numpy step holds: steps take some 100 times that.
STEP = CHUNK >> 2
NO_ID = np.iinfo(np.int64).min


def words_at(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes at each of the places 0..n-1 as numbers; data has 8 more bytes at least."""
    return np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


def stretches(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, start and number of strings of each stretch in a chunk, and its anchor's hash."""
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, U64),)
    if n < length:
        return none
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = words_at(padded, n + 8)
    h = mix(eight[:-8] * U64(0x9E3779B97F4A7C15) + (eight[8:] ^ (eight[8:] >> U64(29))) * U64(0xC2B2AE3D27D4EB4F))
    bits = max(23, n.bit_length())
    low = U64((1 << bits) - 1)
    least = (h & ~low) | np.arange(n, dtype=U64)
    wide, width = length - Q + 1, 1
    while width * 2 <= wide:
        least[: n - width] = np.minimum(least[: n - width], least[width:])
        width *= 2
    if wide > width:
        step = wide - width
        least[: n - step] = np.minimum(least[: n - step], least[step:])
    anchor = (least & low).astype(np.int64)
    del least
    good = np.zeros(n + 1, np.int8)
    sizes = np.diff(at)
    long = sizes >= length
    np.add.at(good, at[:-1][long], 1)
    np.add.at(good, at[1:][long] - length + 1, -1)
    good = np.cumsum(good[:n], dtype=np.int8) > 0
    anchor[~good] = -1
    edge = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate([[0], edge])
    count = np.diff(np.concatenate([first, [n]]))
    keep = anchor[first] >= 0
    first, count = first[keep], count[keep]
    return np.searchsorted(at, first, "right") - 1, first, count, h[anchor[first]]


class Group:
    """The texts of one group, in order of doc_id and text, and their stretches."""

    def __init__(self, rows: pa.Table, length: int):
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.rows, self.length = rows, length
        ids = rows.column("doc_id")
        self.known = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(NO_ID).to_numpy()
        self.data, self.at = byte_column(rows.column("text"))
        parts = []
        for lo, _hi, data, at in chunks(self.data, self.at, STEP):
            row, start, count, h = stretches(data, at, length)
            parts.append((row + lo, start + self.at[lo], count, h))
        self.row, self.start, self.count, self.hash = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else stretches(self.data, self.at, length)
        if not self.known.all():
            keep = self.known[self.row]
            self.row, self.start, self.count, self.hash = (x[keep] for x in (self.row, self.start, self.count, self.hash))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.count[i] + self.length - 1].tobytes()


def _buckets(parts: int, length: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """One row a part: the group's distinct anchors, first those that two of its own documents hold."""
        g = Group(rows, length)
        order = np.lexsort((g.row, g.hash))
        h, d = g.hash[order], g.ids[g.row[order]]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(h) else np.zeros(0, bool)
        h = h[first]
        part = (h % U64(parts)).astype(np.int64)
        order = np.lexsort((~several, part))
        h, part, several = h[order], part[order], several[order]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(h) else np.zeros(0, np.int64)
        ends = np.concatenate([cut[1:], [len(h)]]).astype(np.int64) if len(h) else cut
        return pa.table({
            "g": pa.array([key[0].as_py()] * len(cut), pa.int64()), "part": pa.array(part[cut], pa.int64()),
            "several": pa.array([int(several[a:b].sum()) for a, b in zip(cut, ends, strict=True)], pa.int64()), "anchors": pa.array([h[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
        })

    return run


def _shared(key: tuple, rows: pa.Table) -> pa.Table:
    """For each group, its anchors of a part that another document holds as well."""
    g, several = rows.column("g").to_numpy(), rows.column("several").to_numpy()
    each = [np.frombuffer(x, U64) for x in rows.column("anchors").to_pylist()]
    every = np.concatenate(each)
    values, counts = np.unique(every, return_counts=True)
    common = values[counts > 1]
    out = []
    for own, k in zip(each, several, strict=True):
        place = np.searchsorted(common, own)
        hit = np.zeros(len(own), bool) if not len(common) else common[np.minimum(place, len(common) - 1)] == own
        hit[:k] = True
        out.append(own[hit].tobytes())
    keep = [i for i, x in enumerate(out) if x]
    return pa.table({"g": pa.array(g[keep], pa.int64()), "part": pa.array([key[0].as_py()] * len(keep), pa.int64()), "anchors": pa.array([out[i] for i in keep], pa.binary())})


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    among = np.sort(among)
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _stretches(parts: int, length: int):
    def run(key: tuple, texts: pa.Table, asked: pa.Table) -> pa.Table:
        """One row a part: the distinct stretches of the group around shared anchors, with their least and greatest doc_id."""
        out: dict[str, list] = {k: [] for k in ("g", "part", "first", "hash", "low", "high", "size", "bytes")}
        if texts.num_rows and asked.num_rows:
            g = Group(texts, length)
            wanted = np.concatenate([np.frombuffer(x, U64) for x in asked.column("anchors").to_pylist()])
            hits = np.flatnonzero(member(g.hash, wanted))
            number: dict[bytes, int] = {}
            which = np.fromiter((number.setdefault(g.text(i), len(number)) for i in hits.tolist()), np.int64, len(hits))
            docs, n = g.ids[g.row[hits]], len(number)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, NO_ID)
            np.minimum.at(low, which, docs)
            np.maximum.at(high, which, docs)
            first = np.zeros(n, np.int64)
            first[which[::-1]] = hits[::-1]
            pieces = list(number)
            part = (g.hash[first] % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if n else []:
                out["g"].append(key[0].as_py())
                out["part"].append(int(part[own[0]]))
                out["first"].append(first[own].astype(np.int64).tobytes())
                out["hash"].append(g.hash[first[own]].tobytes())
                out["low"].append(low[own].tobytes())
                out["high"].append(high[own].tobytes())
                out["size"].append(np.array([len(pieces[i]) for i in own], np.uint16).tobytes())
                out["bytes"].append(pa.compress(b"".join(pieces[i] for i in own), "zstd", asbytes=True))
        return pa.table({k: pa.array(v, pa.int64() if k in ("g", "part") else pa.binary()) for k, v in out.items()})

    return run


def refine(texts: list[bytes], low: np.ndarray, length: int) -> np.ndarray:
    """The least `low` of each string of `length` bytes in the texts, text after text: bucket-pointer refinement.

    Buckets of 8-grams come first. A level sorts on (own bucket, bucket at a later offset) and its dense ids are the next
    level's buckets, so strings of 8, 16, 32 and `length` bytes are told apart in turn.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
    n = len(data) - 16
    at = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    window = np.arange(n) + length <= at[1:][owner]
    places = np.flatnonzero(window)
    _, bucket = np.unique(words_at(data, n), return_inverse=True)
    reach = 8
    while reach < length:
        step = min(reach, length - reach)
        later = bucket[np.minimum(np.arange(n) + step, n - 1)]
        pairs = (bucket.astype(U64) << U64(32)) | later.astype(U64)
        reach += step
        if reach == length:
            pairs = pairs[places]
        _, bucket = np.unique(pairs, return_inverse=True)
    best = np.full(bucket.max() + 1 if len(bucket) else 0, np.iinfo(np.int64).max)
    np.minimum.at(best, bucket, low[owner[places]])
    return best[bucket]


def whole_buckets(sizes: np.ndarray, bucket: np.ndarray, most: int) -> list[np.ndarray]:
    """The stretches' numbers, in runs of whole buckets with about `most` bytes, one bucket at least."""
    order = np.argsort(bucket, kind="stable")
    end = np.flatnonzero(np.append(np.diff(bucket[order]) != 0, True)) + 1
    total = np.cumsum(sizes[order])[end - 1]
    cut, lo = [], 0
    while lo < len(end):
        lo = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        cut.append(int(end[lo - 1]))
    return np.split(order, cut[:-1])


def _classes(length: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """For each group: (its stretch, first and last string, least doc_id) wherever a document of the group is not the least."""
        number: dict[bytes, int] = {}
        which, lows, highs, firsts, hashes, owners = [], [], [], [], [], []
        groups = rows.column("g").to_pylist()
        for k in range(rows.num_rows):
            size = np.frombuffer(rows.column("size")[k].as_py(), np.uint16).astype(np.int64)
            end = np.cumsum(size)
            blob = pa.decompress(rows.column("bytes")[k].as_py(), int(end[-1]), "zstd", asbytes=True)
            which += [number.setdefault(blob[b - s : b], len(number)) for b, s in zip(end.tolist(), size.tolist(), strict=True)]
            lows.append(np.frombuffer(rows.column("low")[k].as_py(), np.int64))
            highs.append(np.frombuffer(rows.column("high")[k].as_py(), np.int64))
            firsts.append(np.frombuffer(rows.column("first")[k].as_py(), np.int64))
            hashes.append(np.frombuffer(rows.column("hash")[k].as_py(), U64))
            owners.append(np.full(len(size), k))
        which_, low, high, first, h, owner = np.array(which, np.int64), *(np.concatenate(x) for x in (lows, highs, firsts, hashes, owners))
        texts, n = list(number), len(number)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, which_, low)
        bucket = np.zeros(n, U64)
        bucket[which_] = h
        values, inverse, counts = np.unique(bucket, return_inverse=True, return_counts=True)
        count = np.array([len(x) - length + 1 for x in texts], np.int64)
        # a bucket of one stretch is done; the others are refined
        begin, end, best, of = [np.zeros(n, np.int64)], [count - 1], [least], [np.arange(n)]
        open_ = np.flatnonzero(counts[inverse] > 1)
        if len(open_):
            done = np.ones(n, bool)
            done[open_] = False
            begin, end, best, of = ([x[0][done]] for x in (begin, end, best, of))
            # equal strings have one anchor, so buckets are refined apart
            for some in whole_buckets(count[open_] + length - 1, inverse[open_], STEP):
                own = open_[some]
                mins = refine([texts[i] for i in own], least[own], length)
                each = np.repeat(own, count[own])
                offset = np.arange(len(each)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
                edge = np.flatnonzero(np.concatenate([[True], (each[1:] != each[:-1]) | (mins[1:] != mins[:-1])]))
                last = np.concatenate([edge[1:], [len(each)]]) - 1
                begin.append(offset[edge])
                end.append(offset[last])
                best.append(mins[edge])
                of.append(each[edge])
        begin, end, best, of = (np.concatenate(x) for x in (begin, end, best, of))
        order = np.argsort(of, kind="stable")
        begin, end, best, of = begin[order], end[order], best[order], of[order]
        lo, hi = np.searchsorted(of, which_), np.searchsorted(of, which_, "right")
        entry = np.repeat(np.arange(len(which_)), hi - lo)
        run_ = np.arange(len(entry)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[entry]
        keep = best[run_] < high[entry]
        entry, run_ = entry[keep], run_[keep]
        cut = np.flatnonzero(np.diff(owner[entry])) + 1
        out: dict[str, list] = {k: [] for k in ("g", "first", "begin", "end", "least")}
        for own, r in zip(np.split(entry, cut), np.split(run_, cut), strict=True):
            if len(own):
                out["g"].append(groups[owner[own[0]]])
                out["first"].append(first[own].tobytes())
                out["begin"].append(begin[r].astype(np.uint8 if length < 256 else np.uint32).tobytes())
                out["end"].append(end[r].astype(np.uint8 if length < 256 else np.uint32).tobytes())
                out["least"].append(best[r].tobytes())
        return pa.table({k: pa.array(v, pa.int64() if k == "g" else pa.binary()) for k, v in out.items()})

    return run


def _left(g: Group, lo: int, hi: int, start: np.ndarray, end: np.ndarray, with_text: bool) -> list[pa.Array]:
    """Of the group's rows lo..hi-1, without the bytes of the ranges (in order of start): what is left as text; or n_bytes, n_removed, n_spans, kept_sha256."""
    at = g.at[lo : hi + 1] - g.at[lo]
    data = g.data[g.at[lo] : g.at[hi]]
    own = slice(*np.searchsorted(start, g.at[[lo, hi]]))
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, start[own] - g.at[lo], 1)
    np.add.at(mark, end[own] - g.at[lo], -1)
    gone = np.cumsum(mark[:-1]) > 0
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[at[1:]] - before[at[:-1]]
    kept = [data[a:b][~gone[a:b]].tobytes() if r else data[a:b].tobytes() for a, b, r in zip(at[:-1], at[1:], removed, strict=True)]
    if with_text:
        return [pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())]
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    edge = at[:-1][at[:-1] < len(gone)]
    starts[edge] = gone[edge]
    runs = np.concatenate([[0], np.cumsum(starts)])
    return [pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs[at[1:]] - runs[at[:-1]], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]


def _removed(length: int, with_text: bool):
    def run(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        g = Group(texts, length)
        start, end = np.zeros((2, 0), np.int64)
        if found.num_rows:
            kind = np.uint8 if length < 256 else np.uint32
            get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in found.column(name).to_pylist()])
            first, begin, end_, least = get("first", np.int64), get("begin", kind).astype(np.int64), get("end", kind).astype(np.int64), get("least", np.int64)
            runs: dict[bytes, list[int]] = {}
            for k, i in enumerate(first.tolist()):
                runs.setdefault(g.text(i), []).append(k)
            hits = np.flatnonzero(member(g.hash, np.unique(g.hash[first]))).tolist()
            pairs = [(i, k) for i in hits for k in runs.get(g.text(i), ())]
            if pairs:
                i, k = np.array(pairs, np.int64).T
                keep = least[k] < g.ids[g.row[i]]
                i, k = i[keep], k[keep]
                start, end = g.start[i] + begin[k], g.start[i] + end_[k] + length
                order = np.argsort(start)
                start, end = start[order], end[order]
        parts = [_left(g, lo, hi, start, end, with_text) for lo, hi, *_ in chunks(g.data, g.at, STEP)]
        columns = [pa.chunked_array(x) for x in zip(*parts, strict=True)] if parts else _left(g, 0, 0, start, end, with_text)
        if with_text:
            out = {"whole": g.rows.column("whole"), "kept": columns[0]}
        else:
            out = {"doc_id": g.rows.column("doc_id")} | dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), columns, strict=True))
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text, ...): what is left when every byte covered by a `length`-byte string that also
    starts in a document with a smaller doc_id is gone.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256; or, `with_text`, those of docs with what is left as text,
    without the bytes of code points that a cut has split.

    Null text is empty. A row of null doc_id neither loses bytes nor takes them from others. Rows of equal doc_id don't
    take from each other. Texts under `length` bytes stay as they are. An empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(LEAST_GROUPS, size // GROUP_BYTES)
    parts = 2 * groups
    whole = F.struct(*[F.col(f"`{k}`") for k in docs.columns if k != "text"]).alias("whole")
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(groups)).alias("g")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key, *[whole] * with_text)
    buckets = texts.groupBy("g").applyInArrow(_buckets(parts, length), "g long, part long, several long, anchors binary")
    shared = buckets.groupBy("part").applyInArrow(_shared, "g long, part long, anchors binary")
    sent = texts.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_stretches(parts, length), "g long, part long, first binary, hash binary, low binary, high binary, size binary, bytes binary")
    found = sent.groupBy("part").applyInArrow(_classes(length), "g long, first binary, begin binary, end binary, least binary")
    if not with_text:
        return texts.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(_removed(length, False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    schema = texts.select("whole").schema.add("kept", "string")
    left = texts.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(_removed(length, True), schema)
    return left.select(*[F.col("kept").alias(k) if k == "text" else F.col(f"whole.`{k}`") for k in docs.columns])
