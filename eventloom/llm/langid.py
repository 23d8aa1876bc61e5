"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public byte-level vocabulary. A word's probability is the sum
over all its segmentations into pieces (forward algorithm); a text's is the product over its words. The probabilities are
fitted by expectation-maximisation (forward-backward) on a bounded sample of labelled texts.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALPHA, U64, byte_column, chunks, mix, powers, saved, seeds, span_hashes, spans

#: About as many texts of each language are read to learn from, with all their words.
SAMPLE_TEXTS = 1500
ROUNDS, SMOOTH = 4, 0.2
#: Words of fewer bytes are read many at a time; longer ones, which texts without blanks have, one by one. To learn from, those
#: are taken in parts of that size.
LONGEST = 40
#: Expected counts are added up as whole numbers of this part of one, so that sums don't depend on their order.
UNIT = 1 << 24
#: Words whose segmentations are held at once while learning.
BLOCK = 10_000
#: Tasks that share the words to learn from.
WORD_TASKS = 24
UNKNOWN = "und"
_VALUES = seeds(256, 23)
_SLOTS = 20


class Pieces:
    """A vocabulary's pieces that can stand in a word (a blank, then lower-case letters), by hash."""

    def __init__(self, pieces: list[bytes]):
        keep = [x for x in pieces if x and all(b == 0x20 and i == 0 or b >= 0x80 or 0x61 <= b <= 0x7A for i, b in enumerate(x)) and len(x) <= LONGEST]
        self.n, self.longest = len(keep), max(map(len, keep), default=1)
        data = np.frombuffer(b"".join(keep), np.uint8)
        ends = np.cumsum([len(x) for x in keep])
        h = hashes(data, np.concatenate([[0], ends[:-1]]), ends)
        self.keys = np.append(h, U64(0))
        self.slots = []
        rest = np.arange(self.n)
        for turn in range(3):
            slots = np.full(1 << _SLOTS, self.n, np.int32)
            slots[place(h[rest], turn)] = rest
            self.slots.append(slots)
            rest = rest[slots[place(h[rest], turn)] != rest]
        assert not len(rest)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or n."""
        out = np.full(len(h), self.n, np.int32)
        for turn, slots in enumerate(self.slots):
            got = slots[place(h, turn)]
            hit = self.keys[got] == h
            out[hit] = got[hit]
        return out


def place(h: np.ndarray, turn: int) -> np.ndarray:
    return ((h >> U64(turn * 20)) & U64((1 << _SLOTS) - 1)).astype(np.int64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64)) | U64(1)


@functools.lru_cache(maxsize=1)
def load(path: str) -> Pieces:
    """The pieces of a .tiktoken file (a base64 piece and its rank a line)."""
    with open(path, "rb") as f:
        return Pieces([base64.b64decode(line.split()[0]) for line in f if line.strip()])


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (letters and bytes from 0x80), and each row's first."""
    return spans(data, at, ALPHA)


def parts(word: bytes) -> list[bytes]:
    """A word in parts of fewer than LONGEST bytes that end where a character ends."""
    out, lo = [], 0
    while len(word) - lo >= LONGEST:
        hi = lo + LONGEST - 1
        while hi > lo + 1 and word[hi] & 0xC0 == 0x80:
            hi -= 1
        out.append(word[lo:hi])
        lo = hi
    return [*out, word[lo:]]


def long_log(word: bytes, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """[language]: log probability of one word of any length, summed over all its segmentations. Of the places behind only as many
    are held as the longest piece has bytes, brought back to size where they grow small."""
    low = np.frombuffer(b" " + word, np.uint8).copy()
    low[(low >= 65) & (low <= 90)] += 32
    n, m = len(low), pieces.longest + 1
    ends, sizes, found = [], [], []
    for k in range(1, min(n, pieces.longest) + 1):
        start = np.arange(n - k + 1)
        got = pieces.find(hashes(low, start, start + k))
        hit = np.flatnonzero(got < pieces.n)
        ends.append(hit + k), sizes.append(np.full(len(hit), k)), found.append(got[hit])
    end, size, got = (np.concatenate(x) for x in (ends, sizes, found))
    order = np.argsort(end, kind="stable")
    end, size, got = end[order], size[order], got[order]
    edge = np.searchsorted(end, np.arange(n + 2))
    window, scale = np.zeros((m, p.shape[1])), np.zeros(p.shape[1])
    window[0] = 1
    for j in range(1, n + 1):
        own = slice(edge[j], edge[j + 1])
        window[j % m] = (window[(j - size[own]) % m] * p[got[own]]).sum(0)
        small = window.max(0) < 1e-100
        if small.any():
            window[:, small] *= 1e100
            scale[small] -= np.log(1e100)
    return np.log(np.maximum(window[n % m], 1e-300)) + scale


class Lattice:
    """All segmentations of a set of words: for each (end, length), the words that have a piece there."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces):
        size = ends - starts + 1
        order = np.argsort(-size, kind="stable")
        self.order, self.size = order, size[order]
        width = int(self.size[0]) if len(order) else 0
        grid = np.full((len(order), width), 0x20, np.uint8)
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        column = np.arange(1, width)
        inside = column[None, :] < self.size[:, None]
        source = starts[order][:, None] + column[None, :] - 1
        grid[:, 1:][inside] = low[data[source[inside]]]
        self.width, self.edges = width, []
        up, down = powers(width + 1)
        sums = np.zeros((width + 1, len(order)), U64)
        for j in range(width):
            sums[j + 1] = sums[j] + _VALUES[grid[:, j]] * up[j]
        for j in range(1, width + 1):
            n = int(np.searchsorted(-self.size, -j, "right"))  # words with j bytes at least
            for k in range(1, min(j, pieces.longest) + 1):
                h = mix((sums[j, :n] - sums[j - k, :n]) * down[j - k] + U64(k)) | U64(1)
                got = pieces.find(h)
                hit = np.flatnonzero(got < pieces.n)
                if len(hit):
                    self.edges.append((j, k, hit, got[hit]))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """[place, word, language]: the summed probability of the segmentations up to a place."""
        alpha = np.zeros((self.width + 1, len(self.order), p.shape[1]))
        alpha[0] = 1
        for j, k, hit, got in self.edges:
            alpha[j, hit] += alpha[j - k, hit] * p[got]
        return alpha

    def ends(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.size, np.arange(len(self.order))]

    def log(self, p: np.ndarray) -> np.ndarray:
        """[word in its first order, language]: log probability."""
        out = np.empty((len(self.order), p.shape[1]))
        out[self.order] = np.log(np.maximum(self.ends(self.forward(p)), 1e-300))
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Each piece's expected count in each language, its words having these weights."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        n = np.arange(len(self.order))
        beta[self.size, n] = weight[self.order] / np.maximum(self.ends(alpha), 1e-300)
        out = np.zeros_like(p)
        for j, k, hit, got in reversed(self.edges):
            back = beta[j, hit] * p[got]
            np.add.at(out, got, back * alpha[j - k, hit])
            beta[j - k, hit] += back
        return out


def expected(texts: list[bytes], weight: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Each piece's expected count in each language, of words with weights [word, language]."""
    ends = np.cumsum([len(x) for x in texts])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    by_size = np.argsort(starts - ends, kind="stable")
    count = np.zeros_like(p)
    for i in range(0, len(texts), BLOCK):
        own = by_size[i : i + BLOCK]
        count += Lattice(data, starts[own], ends[own], pieces).expected(p, weight[own])
    return count


def _expected(vocabulary: str, p: np.ndarray):
    """Words (word, n of each language) to the counts, in units, of the pieces they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, count = load(vocabulary), np.zeros_like(p)
        for batch in batches:
            weight = np.array(batch.column("n").to_pylist(), np.float64).reshape(batch.num_rows, p.shape[1])
            count += expected(batch.column("word").to_pylist(), weight, pieces, p)
        piece, language = np.nonzero(count)
        units = np.rint(count[piece, language] * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(language, pa.int32()), pa.array(units)], ["piece", "language", "units"])

    return run


class Model:
    def __init__(self, languages: list[str], pieces: Pieces, p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p

    def scores(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[row, language] log probability, and the number of words."""
        starts, ends, row = words(data, at)
        h = span_hashes(data, starts, ends)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        first = first.astype(np.int64)
        each, size = np.zeros((len(first), len(self.languages))), (ends - starts)[first]
        by_size = np.argsort(-size, kind="stable")
        many = int((size >= LONGEST).sum())
        for k in by_size[:many]:
            each[k] = long_log(data[starts[first[k]] : ends[first[k]]].tobytes(), self.pieces, self.p)
        step = max(1000, 2_000_000 // ((LONGEST + 1) * len(self.languages)))
        for i in range(many, len(first), step):
            own = by_size[i : i + step]
            each[own] = Lattice(data, starts[first[own]], ends[first[own]], self.pieces).log(self.p)
        total = np.zeros((len(starts) + 1, len(self.languages)))
        np.cumsum(each[inverse], axis=0, out=total[1:])
        return total[row[1:]] - total[row[:-1]], np.diff(row)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, at = byte_column(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for lo, _hi, data, own in chunks(text, at):
            starts, ends, row = words(data, own)
            count: dict[tuple[str, bytes], int] = {}
            raw = data.tobytes().lower()
            for i in range(len(row) - 1):
                for s, e in zip(starts[row[i] : row[i + 1]].tolist(), ends[row[i] : row[i + 1]].tolist(), strict=True):
                    for part in parts(raw[s:e]):
                        count[langs[lo + i], part] = count.get((langs[lo + i], part), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.binary()), pa.array(list(count.values()), pa.int64())], ["lang", "word", "n"])


def train(labelled: DataFrame, vocabulary: str) -> Model:
    """A model of the languages in labelled (doc_id, text, lang): from all words of about SAMPLE_TEXTS texts each, chosen by
    a hash of doc_id. Rows of null text or lang are left out; rows of one doc_id are chosen together, and repeated ones count
    as often as they come. Without a row there is no language. What comes to the driver is one number for each piece of the
    vocabulary and language, whatever the texts."""
    labelled = labelled.where("text is not null and lang is not null")
    sizes = {x["lang"]: x["n"] for x in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    pieces = load(vocabulary)
    if not sizes:
        return Model([], pieces, np.ones((pieces.n, 0)))
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, SAMPLE_TEXTS / n))])[F.col("lang")]
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < rate * 1_000_000).select("text", "lang")
    languages = sorted(sizes)
    found = sample.mapInArrow(_counted, "lang string, word binary, n long")
    found = found.groupBy("word").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)) for k in languages]).alias("n"))
    # each task's words in order, so that reruns add up in the same order
    found = saved(found.repartition(WORD_TASKS, "word").sortWithinPartitions("word"))
    p = np.ones((pieces.n, len(languages))) / pieces.n
    for _ in range(ROUNDS):
        sums = found.mapInArrow(_expected(vocabulary, p), "piece int, language int, units long").groupBy("piece", "language").agg(F.sum("units").alias("units")).toArrow()
        count = np.full_like(p, SMOOTH)
        count[sums.column("piece").to_numpy(), sums.column("language").to_numpy()] += sums.column("units").to_numpy() / UNIT
        p = count / count.sum(0)
    return Model(languages, pieces, p)


def lettered(text: bytes) -> bool:
    """Whether it has a letter (\\p{L})."""
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


_ASCII = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            text, at = byte_column(batch.column(batch.num_columns - 1))
            for lo, hi, data, own in chunks(text, at):
                n = hi - lo
                best, score = np.full(n, len(names) - 1), np.zeros(n)
                if model.languages:
                    ascii_ = np.concatenate([[0], np.cumsum(_ASCII[data])])
                    has = ascii_[own[1:]] > ascii_[own[:-1]]
                    for i in np.flatnonzero(~has & (own[1:] > own[:-1])):
                        has[i] = lettered(data[own[i] : own[i + 1]].tobytes())
                    logs, _count = model.scores(data, own)
                    top = logs.argmax(1)
                    share = 1 / np.exp(np.maximum(logs - logs.max(1, keepdims=True), -700)).sum(1)
                    best[has], score[has] = top[has], share[has]
                columns = [batch.column(i).slice(lo, n) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(score)], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns `keep` of docs, lang_pred and score (the language's share of the probability, 0 to 1).

    lang_pred is `und`, with score 0, where the text is null or has no letter or nothing was learned. Whole texts count,
    however long; equal texts get equal results; an empty table gives no rows.
    """
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, "text").mapInArrow(_predicted(model), schema)


#: The documents to learn from; the others are held out.
TRAINING = "lang is not null and crc32(cast(doc_id as string)) % 5 <> 0"
