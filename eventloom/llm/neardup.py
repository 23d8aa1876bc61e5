"""MinHash near-duplicates by an inverted join of signature coordinates.

A signature has COORDINATES numbers, each made of ROWS min-values, so two sets of Jaccard similarity s agree in one with
probability s**ROWS. Documents are posted under their coordinate values. A pair has to agree in MATCHES coordinates; so it
agrees in one of the first COORDINATES - MATCHES + 1 (the prefix), and only those are joined; the others are looked up in
the signatures of pairs that got that far (the skip). At a similarity of 0.85 a pair has fewer than 3 of 32 agreements
with a probability of 4e-8, at 0.8 with one of 1.2e-5. Pairs that pass are confirmed on their full shingle sets.

Equal sets are one document. Documents whose shingles mostly stand alone leave the lists first, as they can have no link.
Within a posting list documents are then compared with one leader, first each with the leader of most of its lists, then with
all, for STARS rounds or until a round links few. Last, documents of lists that still hold several components are paired by
their rarest shingles: two sets whose intersection has to be o or more share one of the n - o + 1 rarest of each. Edits of
one text share the text, but seldom an edit; so neither copies nor edits too far apart to link make all their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import CHUNK, NOT_SPACE, U64, byte_column, chunks, mix, saved, seeds, span_hashes, spans
from .graph import components

WORDS, ROWS, COORDINATES, MATCHES, STARS = 5, 4, 32, 3, 2
PREFIX = COORDINATES - MATCHES + 1
_STEP = seeds(WORDS, 11) | U64(1)
_XOR, _MUL = seeds(ROWS * COORDINATES, 13), seeds(ROWS * COORDINATES, 17) | U64(1)


def shingles(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of each row's shingles, row after row, repeats included, and each row's first (rows + 1 numbers)."""
    starts, ends, row = spans(data, at, NOT_SPACE)
    w = span_hashes(data, starts, ends)
    count = np.diff(row)
    made = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    index = np.arange(first[-1]) - np.repeat(first[:-1], made) + np.repeat(row[:-1], made)
    room = np.concatenate([w, np.zeros(words, U64)])
    total = np.zeros(len(index), U64)
    length = np.repeat(np.minimum(count, words), made)
    for j in range(words):
        total += np.where(length > j, room[index + j] * _STEP[j], U64(0))
    return mix(total + length.astype(U64)), first


def distinct_sorted(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in order, and each row's first."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(first) - 1))])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, at = byte_column(batch.column("text"))
        for lo, hi, data, own in chunks(text, at):
            h, first = distinct_sorted(*shingles(data, own))
            n = np.diff(first)
            full = np.flatnonzero(n)
            begin = first[:-1][full]
            sig = np.zeros((len(n), COORDINATES), U64)
            sums = np.zeros((2, len(n)), U64)
            if len(full):
                sums[0, full] = np.add.reduceat(mix(h + U64(1)), begin)
                sums[1, full] = np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), begin)
                for i in range(COORDINATES):
                    c = np.full(len(full), U64(i))
                    for j in range(i * ROWS, (i + 1) * ROWS):
                        c = mix(c + np.minimum.reduceat((h ^ _XOR[j]) * _MUL[j], begin))
                    sig[full, i] = c
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * COORDINATES), pa.array(sig.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], ["doc_id", "n_shingles", "s1", "s2", "sig"])


#: Pairs whose sets are held at once.
PAIRS = 128


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(lo, PAIRS)
                n = batch.num_rows
                text, at = byte_column(pa.concat_arrays([batch.column("ta"), batch.column("tb")]))
                each: list[np.ndarray] = []
                for _lo, _hi, data, own in chunks(text, at):
                    h, first = distinct_sorted(*shingles(data, own))
                    each += np.split(h, first[1:-1])
                keep = []
                for x, y in zip(each[:n], each[n:], strict=True):
                    union = len(np.unique(np.concatenate([x, y])))
                    keep.append(100 * (len(x) + len(y) - union) >= percent * union)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _spread(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (part, hashes, owners, ids): the shingles of a run of documents, by part; one that several of them hold is
        sent once, without an owner."""
        for batch in batches:
            text, at = byte_column(batch.column("text"))
            for lo, hi, data, own in chunks(text, at, 4 * CHUNK):
                # bytes are read in smaller steps than shingles are gathered: each byte takes many times its size
                each, n = zip(*[(h, np.diff(first)) for h, first in (distinct_sorted(*shingles(x, y)) for _lo, _hi, x, y in chunks(data, own))], strict=True)
                h, row = np.concatenate(each), np.repeat(np.arange(hi - lo, dtype=np.int32), np.concatenate(n))
                order = np.argsort(h, kind="stable")
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                begin = np.flatnonzero(new)
                alone = np.diff(np.append(begin, len(h))) == 1
                h, row = h[begin], np.where(alone, row[begin], -1).astype(np.int32)
                part = (h % U64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                ids = batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()).to_numpy(zero_copy_only=False)
                each = [x for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([int(part[x[0]]) for x in each], pa.int64()), *(pa.array([v[x].tobytes() for x in each], pa.binary()) for v in (h, row)), pa.array([ids.tobytes()] * len(each), pa.binary())], ["part", "hashes", "owners", "ids"])

    return run


def _alone(key: tuple, rows: pa.Table) -> pa.Table:
    """(doc_id, alone): how many of a part's shingles each document holds that no other does."""
    each = [np.frombuffer(x, U64) for x in rows.column("hashes").to_pylist()]
    values, counts = np.unique(np.concatenate(each), return_counts=True)
    once = values[counts == 1]
    ids, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own, owner, doc in zip(each, rows.column("owners").to_pylist(), rows.column("ids").to_pylist(), strict=True):
        owner, doc = np.frombuffer(owner, np.int32), np.frombuffer(doc, np.int64)
        hit = (owner >= 0) & (once[np.minimum(np.searchsorted(once, own), len(once) - 1)] == own if len(once) else False)
        count = np.bincount(owner[hit], minlength=len(doc))
        ids.append(doc[count > 0])
        n.append(count[count > 0])
    return pa.table({"doc_id": pa.array(np.concatenate(ids), pa.int64()), "alone": pa.array(np.concatenate(n), pa.int64())})


#: Shingles of one part, and parts at least.
PART_SHINGLES, LEAST_PARTS = 2_000_000, 64
#: How often documents that can't have a link are taken out of the lists; each time more shingles stand alone.
TURNS = 2


def _linkable(signed: DataFrame, docs: DataFrame, several: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, texts, signed) of the documents that may have a link.

    A posting list of one document tells of none. And a shingle that no other candidate holds is in no intersection; so
    with `alone` such shingles of n, a document's similarity to any other is (n - alone) / n at most.
    """
    posts = signed.select(F.col("doc_id").alias("d"), F.explode(F.slice("sig", 1, PREFIX)).alias("v"))
    for turn in range(TURNS):
        posts = saved(posts.join(posts.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "v", "left_semi").select("d", "v"))
        ends = posts.select(F.col("d").alias("doc_id")).distinct()
        docs = saved(docs.join(ends, "doc_id", "left_semi"))
        signed = saved(signed.drop("alone").join(ends, "doc_id", "left_semi"))
        parts = max(LEAST_PARTS, (signed.agg(F.sum("n_shingles")).first()[0] or 0) // PART_SHINGLES)
        alone = docs.mapInArrow(_spread(parts), "part long, hashes binary, owners binary, ids binary").groupBy("part").applyInArrow(_alone, "doc_id long, alone long")
        # of a doc_id with several sets it isn't known which of them holds a shingle
        alone = alone.groupBy("doc_id").agg(F.sum("alone").alias("alone")).join(several, "doc_id", "left_anti")
        signed = signed.join(alone, "doc_id", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
        signed = saved(signed.where(F.lit(100) * (F.col("n_shingles") - F.col("alone")) >= percent * F.col("n_shingles")))
        posts = posts.join(signed.select(F.col("doc_id").alias("d")).distinct(), "d", "left_semi")
        if turn + 1 < TURNS:
            docs = docs.join(signed.select("doc_id").distinct(), "doc_id", "left_semi")
    return posts, docs, signed


def _agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in MATCHES coordinates."""
    side = lambda name: signed.select(F.col("doc_id").alias(name), F.col("sig").alias(f"sig_{name}"))
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(agree >= MATCHES).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    text = lambda name: docs.select(F.col("doc_id").alias(name), F.col("text").alias(f"t{name}"))
    return saved(pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_confirm(percent), "a long, b long").distinct())


#: Classes of set sizes in a band.
CLASSES = 4


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, component, n, s, hashes): a document's distinct shingles, their number and their sum, which tells its sets apart."""
    for batch in batches:
        text, at = byte_column(batch.column("text"))
        for lo, hi, data, own in chunks(text, at):
            h, first = distinct_sorted(*shingles(data, own))
            n = np.diff(first)
            s = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(1)))])
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in ("d", "component")), pa.array(n, pa.int64()), pa.array((s[first[1:]] - s[first[:-1]]).view(np.int64)), lists], ["d", "component", "n", "s", "hashes"])


def _by_rare_shingles(docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different components of docs (d, component, text) whose sets may be similar enough: all that are, and few others.

    Shingles are ordered by how many of these documents hold them, then by hash. The first common one of two sets of n
    and m shingles stands at n - o and m - o at most, counted from 0, where o = percent * (n + m) / (100 + percent) is
    the least intersection that links. Sets are posted by size class, their own and the other's, so that o is known
    well enough; shingles of one component make no pairs.
    """
    sets = docs.mapInArrow(_distinct, "d long, component long, n long, s long, hashes array<long>").where("n > 0").dropDuplicates(["d", "s", "n"])
    # rows are dealt evenly, whatever their sizes were dealt by
    each = saved(sets.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("d", "component", "n", "s", F.explode("hashes").alias("h")))
    held = each.groupBy("h").agg(F.count("*").alias("c"), F.min("component").alias("x"), F.max("component").alias("y")).where("c > 1")
    known = each.join(held, "h")
    # those that one set alone holds come first; they are counted, not listed
    own = Window.partitionBy("d", "s", "n")
    at = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "h")) - 1
    step = math.log(100 / percent) / CLASSES
    size = F.floor(F.log("n") / step).cast("int")
    least = lambda k: F.ceil(percent / (100 + percent) * (F.col("n") + F.exp(k * step) * (1 - 1e-9)) - 1e-6)
    other = F.filter(F.sequence(F.col("size") - (CLASSES + 1), F.col("size") + (CLASSES + 1)), lambda k: F.col("at") <= F.col("n") - least(k))
    posts = known.withColumn("at", at).where("x <> y").withColumn("size", size).select("h", "d", "component", "n", "at", "size", F.explode(other).alias("other"))
    posts = saved(posts.withColumn("low", F.least("size", "other")).withColumn("high", F.greatest("size", "other")).drop("other"))
    keys = ["h", "low", "high"]
    # a list of one component tells of none
    mixed = posts.groupBy(*keys).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(*keys)
    posts = posts.join(mixed, keys, "left_semi")
    left = posts.where("size = low").select(*keys, F.col("d").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("component").alias("ca"))
    right = posts.where("size = high").select(*keys, F.col("d").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("component").alias("cb"))
    once = (F.col("low") < F.col("high")) | (F.col("a") < F.col("b"))
    enough = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    pairs = left.join(right, keys).where((F.col("ca") != F.col("cb")) & once & enough)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: A turn of leaders that links less than this share of what is linked is the last.
FEW = 0.02


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text): the smallest doc_id reachable over
    links of Jaccard similarity percent / 100 or more between sets of 5-word shingles.

    Texts under five words are one shingle; null, empty or blank texts have none and link with nothing. Rows of equal
    doc_id are one document of several texts, linked if any of them is. A row of null doc_id is its own: its component
    is null and it isn't kept. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, s1 long, s2 long, sig array<long>"))
    known = rows.where("n_shingles > 0 and doc_id is not null")
    # a table, so that a hot set's rows meet its representative in a join of two shuffles, which Spark splits
    sets = saved(known.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    member = saved(rows.select("doc_id", "n_shingles", "s1", "s2").join(sets, ["n_shingles", "s1", "s2"], "left").select("doc_id", "n_shingles", "rep"))
    reps = sets.select(F.col("rep").alias("doc_id"), "n_shingles", "s1", "s2")
    signed = saved(known.join(reps, ["doc_id", "n_shingles", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "n_shingles", "s1", "s2"]))
    # equal doc_ids with several sets stay together
    several = saved(known.select("doc_id", "n_shingles", "s1", "s2").distinct().groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    posts, docs, signed = _linkable(signed, docs, several, percent)
    band = F.floor(F.log(F.col("n_shingles")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")  # sizes that allow a link are one band apart at most
    sizes = signed.select(F.col("doc_id").alias("d"), F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.col("alone")).alias("m"), band.alias("band"))
    posts = saved(posts.join(sizes, "d"))
    # the intersection of two sets is the smaller of their shared parts at most
    possible = lambda x, y: F.least(f"m{x}", f"m{y}") * (100 + percent) >= (F.col(f"n{x}") + F.col(f"n{y}")) * percent
    named = lambda df, x: df.withColumnsRenamed({"d": x, "n": f"n{x}", "m": f"m{x}"})
    edges = member.where("doc_id <> rep").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    labels, linked = None, 0
    for turn in range(STARS + 1):
        # the first leader is the document that shares most of its set, as the common source of copies does
        by = F.struct(-F.col("m") / F.col("n") if turn < 2 else F.xxhash64("d", F.lit(turn)), F.col("d"))
        now = _labelled(posts, labels)
        mixed = now.groupBy("v", "band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(by).getField("d").alias("a")).where("x <> y").select("v", "band", "a")
        lead = now.select("v", F.col("d").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("component").alias("ca")).join(mixed, ["v", "a"]).distinct()
        pairs = named(now, "b").join(lead, ["v", "band"]).where((F.col("component") != F.col("ca")) & (F.col("a") != F.col("b")) & possible("a", "b"))
        if turn == 0:
            # one leader a document, that of most of its values: copies of one source meet there, and what the others would
            # tell of them needs no comparing any more; the next turns take all leaders of other components
            pairs = pairs.groupBy("b", "a").agg(F.count("*").alias("c")).groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = _confirmed(_agreeing(pairs, signed), docs, percent)
        new = more.count()
        if new or labels is None:
            labels = saved(components(edges.unionByName(more)))
            edges = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        linked += new
        if turn and new <= FEW * linked:
            break
    # what is left: documents of different components under one value, of sizes that allow a link
    now = _labelled(posts, labels)
    right = now.select("v", "d", "component", F.explode(F.array("band", F.col("band") + 1)).alias("k"))
    mixed = right.groupBy("v", "k").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("v", "k")
    ends = right.join(mixed, ["v", "k"], "left_semi").select(F.col("d").alias("doc_id"), "component").distinct()
    more = _confirmed(_by_rare_shingles(docs.join(ends, "doc_id").select(F.col("doc_id").alias("d"), "component", "text"), percent), docs, percent)
    labels = components(edges.unionByName(more)) if more.count() else labels
    found = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _labelled(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """posts with the component of their document so far: itself where nothing is known."""
    if labels is None:
        return posts.withColumn("component", F.col("d"))
    return posts.join(labels.select(F.col("node").alias("d"), "component"), "d", "left").withColumn("component", F.coalesce("component", "d"))
