"""Exact top-k search by pivot-table elimination.

Distances to many pivots are computed once for every vector. For a query and a candidate, the greatest difference of their
distances to a pivot is a lower bound of their distance, so an upper bound of their inner product. Candidates of one
nearest pivot and of like distances to it lie in one tile, whose bound is that of its closest possible member. Tiles are
evaluated in order of bound, and a query stops where no tile that is left can reach its k-th best score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots come from a sample of about so many vectors; every vector is in the table.
PIVOTS, SAMPLE = 64, 2000
#: Candidates and queries of one task at most, and tasks at least.
BLOCK, QUERIES, LEAST_TASKS = 32768, 4096, 16
#: Vectors of a tile, tiles evaluated at once, queries that are searched for together.
TILE, ROUND, TOGETHER = 128, 8, 512
#: Products of integers below this are exact in doubles.
EXACT = float(1 << 53)


def pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    chosen = [int(np.argmax((sample**2).sum(1)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * x @ p.T
    return np.sqrt(np.maximum(square, 0))


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, score) numbers of each query's k best rows, its own id excepted, ties to the smaller id; and how many
    scores were computed."""
    q, x = queries.astype(float), rows.astype(float)
    limit = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    exact = limit < EXACT
    dx = distances(x, p)
    near = dx.argmin(1)
    order = np.lexsort((dx[np.arange(len(x)), near], near))
    x, dx, own_ids, raw = x[order], dx[order], ids[order], rows[order]
    _, ranks = np.unique(own_ids, return_inverse=True)
    cut = np.arange(0, len(x), TILE)
    low, high = np.minimum.reduceat(dx, cut), np.maximum.reduceat(dx, cut)
    square = (x**2).sum(1)
    top = np.maximum.reduceat(square, cut)
    kind = np.float32 if limit < EXACT // (1 << 29) else float
    product = x.astype(kind) if exact else raw
    nothing = -np.inf if exact else np.iinfo(np.int64).min
    found, scored = [], 0
    for at in range(0, len(q), TOGETHER):
        part = slice(at, at + TOGETHER)
        dq, qq = distances(q[part], p), (q[part] ** 2).sum(1)
        least = np.zeros((len(qq), len(cut)))
        for j in range(p.shape[0]):
            np.maximum(least, np.maximum(low[None, :, j] - dq[:, j, None], dq[:, j, None] - high[None, :, j]), out=least)
        bound = (qq[:, None] + top[None, :] - least**2) / 2
        bound += 1e-6 * (1 + qq.max(initial=0) + square.max(initial=0))
        own = q[part].astype(kind) if exact else queries[part]
        best, which = np.full((len(qq), k), nothing), np.zeros((len(qq), k), np.int64)
        todo = np.argsort(-bound.max(0), kind="stable")
        for lo in range(0, len(todo), ROUND):
            tiles, kth = todo[lo : lo + ROUND], best.min(1)
            live = np.flatnonzero((bound[:, tiles] >= kth[:, None]).any(1))
            if not len(live):
                if not (bound[:, todo[lo:]] >= kth[:, None]).any():
                    break
                continue
            col = np.concatenate([np.arange(cut[t], min(cut[t] + TILE, len(x))) for t in tiles])
            score = own[live] @ product[col].T
            scored += score.size
            # what is better than a query's k-th best, or as good and of smaller id
            worst = np.where(best[live] == kth[live, None], ranks[which[live]], -1).max(1)
            hit = score > kth[live, None]
            if (tie := score == kth[live, None]).any():
                hit |= tie & (ranks[col][None, :] < worst[:, None])
            i, j = np.nonzero(hit)
            other = query_ids[part][live[i]] != own_ids[col[j]]
            i, j = i[other], j[other]
            if not len(i):
                continue
            some = np.unique(i)
            held = best[live[some]] > nothing
            a, b = np.nonzero(held)
            who = np.concatenate([live[some[a]], live[i]])
            value, place = np.concatenate([best[live[some]][held], score[i, j].astype(best.dtype)]), np.concatenate([which[live[some]][held], col[j]])
            by = np.lexsort((ranks[place], -value, who))
            who, value, place = who[by], value[by], place[by]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            keep = rank < k
            best[who[keep], rank[keep]], which[who[keep], rank[keep]] = value[keep], place[keep]
        i, j = np.nonzero(best > nothing)
        found.append((at + i, order[which[i, j]], (queries[at + i] * raw[which[i, j]]).sum(1)))
    none = np.zeros(0, np.int64)
    return *(np.concatenate([f[n] for f in found]) if found else none for n in range(3)), scored


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return np.floor(flat.flatten().to_numpy(zero_copy_only=False).astype(float) * 64).astype(np.int64).reshape(-1, width)


def _pair(tables: dict[int, np.ndarray], k: int):
    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        width = key[0].as_py()
        if queries.num_rows and rows.num_rows:
            query_ids, ids = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
            q, r, s, _ = search(_matrix(queries.column("embedding"), width), query_ids, _matrix(rows.column("embedding"), width), ids, tables[width], k)
        else:
            query_ids = ids = q = r = s = np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(query_ids[q], pa.int64()), "vec_id": pa.array(ids[r], pa.int64()), "score": pa.array(s, pa.int64())})

    return run


def top(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) that the condition `queries` selects, the
    k rows of highest integer inner product, components being floor(64 * x); ties go to the smaller vec_id.

    Vectors that are null or hold null or non-finite components, and those without a vec_id, take no part. A row is not
    its own neighbour, nor are rows of its vec_id; repeated rows of another vec_id each count; a query id with several
    rows is searched for with the first in order of components. Vectors meet only vectors of their length; empty ones
    take no part. Components must be small enough for the products to fit a long. No rows, no result.

    A block of queries meets each block of rows once; what leaves a block is k rows a query.
    """
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vectors.where("vec_id is not null and size(embedding) > 0").where(good)
    rows = ok.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("width"))
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("width", F.size("embedding"))
    n, n_asked = (int(x or 0) for x in rows.agg(F.count("*"), F.count_distinct(F.when(F.expr(queries), F.col("vec_id")))).first())
    rate = min(1.0, SAMPLE / max(n, 1)) * 1_000_000
    # `rate` rows in a million, and one of each length at least
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) < rate).unionByName(rows.groupBy("width").agg(F.min(F.struct("vec_id", "embedding")).alias("s")).select("s.vec_id", "s.embedding", "width"))
    by: dict[int, list] = {}
    for r in sample.select("embedding", "width").toArrow().to_pylist():
        by.setdefault(r["width"], []).append(r["embedding"])
    tables = {w: pivots(np.floor(np.array(v, float) * 64)) for w, v in by.items()}
    parts = -(-n_asked // QUERIES)
    blocks = max(-(-n // BLOCK), LEAST_TASKS // max(parts, 1), 1)
    deal = lambda df, own, size, other, count: df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(max(size, 1)))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(count, 1) - 1).cast("long"))))
    key = ["width", "part", "block"]
    left, right = deal(asked, "part", parts, "block", blocks), deal(rows, "block", blocks, "part", parts)
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_pair(tables, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
