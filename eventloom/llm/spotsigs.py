"""SpotSigs fingerprints: chains of content words that follow common words.

A spot is a common word (anchor) and the next CHAIN words that aren't common; the text's start counts as an anchor. In a
text where common words are rarer than one in SPARSE, as in other languages than theirs, words whose hash is a multiple of
SPARSE are anchors too, so that its spots follow from all of it. A
fingerprint is the set of a text's spots, each a 32-bit hash, in order, in hex. Two fingerprints are compared by Jaccard
similarity; where only those of a least similarity matter, sets whose lengths differ too much are never compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import ALNUM, CHUNK, U64, mix, saved, span_hashes, spans

CHAIN = 2
#: Common words of four languages.
COMMON = """
the of and to in is that for it as was with be by on not this are from at or an have but
der die und das den dem von mit ist im zu ein eine auf nicht als für auch sich es
de la le et les des un une que qui dans pour par sur du est pas au en plus
el los las y por con para una del se al lo como más su sus
""".split()
#: Without enough common words, about one word in so many is an anchor.
SPARSE = 16
#: A range of ids is a power of two of them: 2 ** LEAST_BITS, or more (STEP bits at a time) while none holds more than MOST rows.
LEAST_BITS, STEP, MOST = 11, 2, 4096
#: Tasks of the shuffle, and rows of one; ranges of a window; ranges up to which their list is sent to every task.
LEAST_PARTS, ROWS_A_TASK, RANGES, FEW = 64, 4096, 1 << 12, 1_000_000
_FIRST = np.iinfo(np.int64).min


def _hashed(words: list[str]) -> np.ndarray:
    blob = " ".join(words).encode()
    data = np.frombuffer(blob, np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]), ALNUM)
    return np.unique(span_hashes(data, starts, ends))


_COMMON = _hashed(COMMON)


def spots(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Each row's sorted distinct spots (uint32)."""
    starts, ends, row = spans(data, at, ALNUM)
    h = span_hashes(data, starts, ends)
    common = _COMMON[np.minimum(np.searchsorted(_COMMON, h), len(_COMMON) - 1)] == h
    count = np.diff(row)
    owner = np.repeat(np.arange(len(at) - 1), count)
    sparse = np.bincount(owner[common], minlength=len(count)) * SPARSE < count
    extra = sparse[owner] & ~common & (h % U64(SPARSE) == 0)
    content = np.flatnonzero(~common)
    words, whose = np.append(h[content], np.zeros(CHAIN, U64)), np.append(owner[content], np.full(CHAIN, -1))
    # anchors: common words, and the start of each row
    anchors = np.flatnonzero(common | extra)
    begin = np.flatnonzero(count)
    # the words after an anchor; an anchor that is a content word itself isn't in its own chain
    where = np.concatenate([np.searchsorted(content, anchors + 1), np.searchsorted(content, row[:-1][begin])])
    mine = np.concatenate([owner[anchors], begin])
    spot = np.concatenate([h[anchors], np.zeros(len(begin), U64)])
    whole = np.ones(len(where), bool)
    for k in range(CHAIN):
        at_ = np.minimum(where + k, len(whose) - 1)
        # a row with fewer content words than a chain has the chain of those it has
        inside = whose[at_] == mine
        whole &= inside | (k > 0) & (np.arange(len(where)) >= len(anchors))
        spot = mix(spot * U64(0x9E3779B97F4A7C15) + np.where(inside, words[at_], U64(0)) + U64(k))
    # a row of common words alone has one spot, of all of them
    bare = begin[np.bincount(owner[content], minlength=len(at) - 1)[begin] == 0]
    total = np.concatenate([np.zeros(1, U64), np.cumsum(h)])
    spot, mine = np.append(spot[whole], mix(total[row[bare + 1]] - total[row[bare]])), np.append(mine[whole], bare)
    spot = (spot >> U64(32)).astype(np.uint32)
    order = np.lexsort((spot, mine))
    spot, mine = spot[order], mine[order]
    new = np.ones(len(spot), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (mine[1:] != mine[:-1])
    spot, mine = spot[new], mine[new]
    return np.split(spot, np.searchsorted(mine, np.arange(1, len(at) - 1)))


def fingerprint(spot: np.ndarray) -> str:
    return spot.astype(">u4").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without a comparison if their lengths rule out `least`. Two empty sets are
    alike."""
    small, large = sorted((len(x), len(y)))
    if not large:
        return 1.0
    if not small or small < least * large:
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (small + large - both)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many code points (or all) of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(rows: list[tuple], following: list[str]) -> pa.RecordBatch:
    texts = [r[1] for r in rows]
    changed = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    blobs = [t.encode() for t in (*texts, *changed, following[-1])]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
    each = spots(np.frombuffer(b"".join(blobs), np.uint8), at)
    n = len(rows)
    own, other, after = each[:n], each[n : 2 * n], [*each[1:n], each[-1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in blobs[n : 2 * n]], pa.string()),
            pa.array([fingerprint(x) for x in own], pa.string()), pa.array([fingerprint(x) for x in other], pa.string()),
            pa.array([likeness(x, y) for x, y in zip(own, other, strict=True)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(own, after, strict=True)], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, own rows before carried ones, each with the text that follows it."""
    rows: list[tuple] = []
    size, part, done = 0, None, False
    for batch in batches:
        columns = [batch.column(k) for k in ("part", "carried", "doc_id", "text")]
        for i in range(batch.num_rows):
            p, carried, doc_id, text = (c[i].as_py() for c in columns)
            text = text or ""
            if p != part:
                rows, size, part, done = [], 0, p, False
            if done:
                continue
            rows.append((doc_id, text))
            size += len(text)
            done = carried  # the first carried row follows the last own one
            if done or size >= CHUNK // 2 and len(rows) > 1:
                yield _compare(rows[:-1], [r[1] for r in rows[1:]])
                rows, size = rows[-1:], len(text)


def ranges(ids: DataFrame) -> tuple[DataFrame, int]:
    """Ranges of ids (k), and of how many bits of an id they are: (part, top, above) of each that has rows: its greatest
    id, and the next range above it that has rows; of the highest range, the lowest.

    An id tells its range, so no row looks for it among cuts. Where ids are dense, a range is as many rows; where they are
    sparse everywhere, ranges are wider."""
    fine = saved(ids.groupBy(F.shiftright("k", LEAST_BITS).alias("part")).agg(F.count("*").alias("rows"), F.max("k").alias("top")))
    wide = 0
    while LEAST_BITS + wide + STEP < 63:
        counts = fine.groupBy(F.shiftright("part", wide + STEP).alias("part")).agg(F.sum("rows").alias("rows"))
        most, n = counts.agg(F.max("rows"), F.count("*")).first()
        if n == 0 or most > MOST:
            break
        wide += STEP
        if n == 1:
            break
    found = fine.groupBy(F.shiftright("part", wide).alias("part")).agg(F.max("top").alias("top")).withColumn("block", F.floor(F.col("part") / RANGES))
    # the next range within a block of ranges; of a block's last one, the first of the next block
    blocks = found.groupBy("block").agg(F.min("part").alias("lowest"))
    order = Window.orderBy("block")
    blocks = blocks.withColumn("beyond", F.coalesce(F.lead("lowest").over(order), F.min("lowest").over(Window.partitionBy()))).drop("lowest")
    found = found.withColumn("above", F.lead("part").over(Window.partitionBy("block").orderBy("part"))).join(blocks, "block")
    return found.select("part", "top", F.coalesce("above", "beyond").alias("above")), LEAST_BITS + wide


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs
    (doc_id, text). The next document is the one of the next smaller doc_id; after the last comes the first.

    Null text is empty; a text of one content word, or of none, still has a spot; one without words has the empty fingerprint;
    equal texts have equal fingerprints. Rows of equal doc_id follow each other in order of text; null doc_id comes last.
    A single row follows itself. An empty table gives no rows.

    Documents are dealt into ranges of doc_id; the first row of the range below is carried to the end of each range.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", F.coalesce("doc_id", F.lit(_FIRST)))
    ids = docs.select("k")
    tasks = max(LEAST_PARTS, ids.count() // ROWS_A_TASK)
    found, bits = ranges(ids)
    carry = saved(found.select(F.col("top").alias("k"), "above"))
    # the greatest id of each range says where its row is carried
    rows = docs.withColumn("part", F.shiftright("k", bits)).join(F.broadcast(carry) if carry.count() <= FEW else carry, "k", "left")
    places = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("carried")), F.struct(F.col("above").alias("part"), F.lit(True).alias("carried")))
    rows = rows.select("k", "doc_id", "text", F.explode(F.filter(places, lambda x: x["part"].isNotNull())).alias("p")).select("p.part", "p.carried", "k", "doc_id", "text")
    rows = rows.repartition(tasks, "part").sortWithinPartitions("part", "carried", F.desc("k"), "text")
    return rows.select("part", "carried", "doc_id", "text").mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _spotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from ._common import byte_column, chunks

    for batch in batches:
        text, at = byte_column(batch.column("text"))
        for lo, hi, data, own in chunks(text, at):
            each = spots(data, own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))], ["doc_id", "spots"])


def similar(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs (a, b, likeness) of representatives of docs (doc_id, text) with different fingerprints of a Jaccard
    similarity of percent / 100 or more. Equal fingerprints count as one document, that of the smallest doc_id.

    Sets are partitioned by length, so that only neighbouring partitions hold candidates. Spots are ordered by rarity, and
    a set is posted under the rarest of its spots, as many as a similar set must share one of; so frequent spots are no
    join keys.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(_spotted, "doc_id long, spots array<long>")
    sets = rows.where("size(spots) > 0").groupBy("spots").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("spots"))
    each = sets.select("doc_id", "n", F.explode("spots").alias("spot"))
    often = each.groupBy("spot").agg(F.count("*").alias("often"))
    ranked = each.join(often, "spot").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "spot"))).alias("s"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    band = F.floor(F.log(F.col("n")) / (np.log(100 / percent) * (1 + 1e-9))).cast("int")
    posts = ranked.select("doc_id", "n", band.alias("band"), F.explode(F.slice(F.col("s.spot"), F.lit(1), prefix.cast("int"))).alias("spot"))
    left = posts.select("spot", F.col("band").alias("k"), F.col("doc_id").alias("a"), F.col("n").alias("na"))
    right = posts.select("spot", F.col("band"), F.explode(F.array("band", F.col("band") + 1)).alias("k"), F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, ["spot", "k"]).where(f"(k > band or a < b) and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b").distinct()
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("spots").alias(f"s{name}"))
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", both).withColumn("all", F.size("sa") + F.size("sb") - F.col("both"))
    return pairs.where(f"100 * both >= {percent} * `all`").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("both") / F.col("all")).alias("likeness"))
