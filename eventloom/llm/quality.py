"""A quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

A text's tokens are its runs of letters and digits and its runs of other signs. Features are hashed n-grams of one and two
tokens, and delexicalised n-grams of PATTERN tokens, that say only which of them are equal; a feature's value is its share
of the text's n-grams, times SCALE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM, NOT_SPACE, U64, byte_column, chunks, mix, span_hashes, spans

BITS = 20
#: About as many labelled texts are read to learn from, chosen by a hash of doc_id.
SAMPLE_TEXTS, EPOCHS = 8000, 4
SCALE, ALPHA, BETA, L1, L2 = 20.0, 0.5, 1.0, 0.02, 0.01
#: Tokens of a delexicalised n-gram.
PATTERN = 4
SIGN = NOT_SPACE & ~ALNUM
TRAINING = "crc32(cast(doc_id as string)) % 4 <> 2"


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each row, row after row, and each row's first (rows + 1 numbers)."""
    s1, e1, _ = spans(data, at, ALNUM)
    s2, e2, _ = spans(data, at, SIGN)
    starts, ends = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    row = np.searchsorted(starts, at)
    one = span_hashes(data, starts, ends, lower=False)
    count = np.diff(row)
    first = np.concatenate([[0], np.cumsum(np.maximum(2 * count - 1, 0) + np.maximum(count - PATTERN + 1, 0))])
    out = np.empty(first[-1], np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(one)) - row[owner]
    shift = U64(64 - BITS)
    out[first[owner] + k] = (one >> shift).astype(np.int64)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    two = mix(one[pair] * U64(0x9E3779B97F4A7C15) + one[pair + 1])
    out[first[owner[pair]] + count[owner[pair]] + k[pair]] = (two >> shift).astype(np.int64)
    many = np.flatnonzero(k + PATTERN <= count[owner])
    equal = np.zeros(len(many), U64)
    for i in range(PATTERN):
        for j in range(i + 1, PATTERN):
            equal = equal * U64(2) + (one[many + i] == one[many + j])
    out[first[owner[many]] + 2 * count[owner[many]] - 1 + k[many]] = (mix(equal + U64(0xA24BAED4963EE407)) >> shift).astype(np.int64)
    return out, first


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on rows of hashed features, one example at a time."""
    size = (1 << BITS) + 1  # the last is the bias
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    examples = []
    for own in rows:
        index, count = np.unique(own, return_counts=True)
        examples.append((np.append(index, size - 1), np.append(count * (SCALE / max(len(own), 1)), 1.0)))
    for _ in range(epochs):
        for (index, x), y in zip(examples, labels, strict=True):
            zi, ni = z[index], n[index]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - y) * x
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[index] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w[:-1], float(w[-1])


def _fitted(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("order", "ascending"), ("text", "ascending")])
    text, at = byte_column(rows.column("text"))
    each: list[np.ndarray] = []
    for _lo, _hi, data, own in chunks(text, at):
        index, first = features(data, own)
        each += np.split(index, first[1:-1])
    w, bias = ftrl(each, rows.column("label").to_numpy().astype(float))
    index = np.flatnonzero(w)
    return pa.table({"feature": pa.array(np.append(index, -1), pa.int64()), "weight": pa.array(np.append(w[index], bias), pa.float64())})


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from docs (doc_id, text) and labels (doc_id, label 0/1). Rows of null label are left out; null
    texts are empty; repeated rows of either count as often as they meet. The labels are sampled first; as the sample is bounded, it is sent to where the texts are."""
    labels = labels.where("label in (0, 1)").select("doc_id", "label")
    size = labels.count()
    if not size:
        return np.zeros(1 << BITS), 0.0
    order = F.xxhash64("doc_id", F.lit(5))
    sample = labels.where(F.pmod(order, F.lit(1_000_000)) < min(1.0, SAMPLE_TEXTS / size) * 1_000_000)
    sample = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = sample.select(order.alias("order"), "text", "label", F.lit(0).alias("all")).groupBy("all")
    found = one.applyInArrow(_fitted, "feature long, weight double").toArrow()
    weights, bias = np.zeros(1 << BITS), 0.0
    index, value = found.column("feature").to_numpy(), found.column("weight").to_numpy()
    weights[index[index >= 0]] = value[index >= 0]
    if (index < 0).any():
        bias = float(value[index < 0][0])
    return weights, bias


def scores(data: np.ndarray, at: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    index, first = features(data, at)
    total = np.concatenate([[0.0], np.cumsum(weights[index])])
    count = np.diff(first)
    return 1 / (1 + np.exp(-np.clip(bias + SCALE * (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1), -35, 35)))


def _scored(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, at = byte_column(batch.column("text"))
            for lo, hi, data, own in chunks(text, at):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(scores(data, own, weights, bias))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs (doc_id, text): null and empty texts get the bias's score; repeated
    rows get equal scores. An empty table gives no rows."""
    return docs.select("doc_id", "text").mapInArrow(_scored(weights, bias), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
