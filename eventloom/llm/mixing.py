"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import saved
from .ranks import ranked, salts_of

#: Weights of the sources in order of name, repeating; a target is CAP times its source's size at most.
WEIGHTS, CAP = (5, 2, 1), 3
#: Random offsets that are tried for each source; the one that brings its words nearest to its target is its offset.
SEED, OFFSETS = 17, 16


def targets(sizes: DataFrame) -> DataFrame:
    """(src, missing, source_size, target) of sizes (src, missing, source_size): shares of the whole by weight, none above
    CAP times its source; what a capped source can't use is shared by weight among the others.

    Sources are taken in order of (CAP * size / weight): those that are capped come first, so the prefix sums of caps and
    of weights tell where the shares stop being capped. A row here is a source.
    """
    every = Window.orderBy("missing", "src")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", (F.lit(CAP) * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "missing", "src")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    caps = caps.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level at the first source that isn't capped; none is left if all are
    first = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "missing", "src", "level"))).over(Window.partitionBy())
    caps = caps.withColumn("free", first.getField("level"))
    return caps.select("src", "missing", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("free") * F.col("weight")).alias("target"))


def _crossed(start: Column) -> Column:
    """The integers that a document's step of the prefix sum, from `low` to `high`, crosses."""
    return F.least(F.floor(F.col("high") + start) - F.floor(F.col("low") + start), F.lit(CAP))


def _ranked(rows: DataFrame, shares: DataFrame, salts: int) -> DataFrame:
    """rows with their source's shares and their step of the prefix sum."""
    level = F.floor(F.log2(F.col("size") + 1) * 8).cast("int")
    rows = ranked(rows.withColumn("level", level), ["src", "missing"], "level", [F.col(k) for k in ("size", "doc_id", "tie")], salts)
    return rows.join(shares, ["src", "missing"]).withColumn("high", F.col("rank") * F.col("step")).withColumn("low", (F.col("rank") - 1) * F.col("step"))


def offsets(sizes: DataFrame, salts: int) -> DataFrame:
    """Of each source of sizes (size, src, missing, doc_id, tie): source_size, target, step (copies expected of a document)
    and start (its offset)."""
    shares = targets(sizes.groupBy("src", "missing").agg(F.sum("size").alias("source_size")))
    shares = shares.withColumn("step", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    # multiples of 2**-20, so that a rank and an offset add exactly
    random = F.transform(F.sequence(F.lit(SEED), F.lit(SEED + OFFSETS - 1)), lambda i: F.pmod(F.xxhash64("src", "missing", i), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    shares = saved(shares.withColumn("starts", random))
    rows = _ranked(sizes, F.broadcast(shares) if shares.count() <= FEW else shares, salts)
    words = [F.sum(_crossed(F.get("starts", F.lit(i))) * F.col("size")).alias(f"t{i}") for i in range(OFFSETS)]
    tried = rows.groupBy("src", "missing").agg(*words).select("src", "missing", F.array(*[f"t{i}" for i in range(OFFSETS)]).alias("words"))
    off = F.zip_with("words", "starts", lambda w, s: F.struct(F.abs(w - F.col("target")).alias("off"), s.alias("start")))
    return saved(shares.join(tried, ["src", "missing"]).withColumn("start", F.array_min(off)["start"]).drop("starts", "words"))


#: Sources up to which their shares are sent to every task.
FEW = 10_000


def _placed(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (size, src, missing, doc_id, tie, ...) with source_size, target and copies; `sizes` are the same rows alone."""
    salts = salts_of(sizes.count())
    shares = offsets(sizes, salts)
    return _ranked(rows, F.broadcast(shares) if shares.count() <= FEW else shares, salts).withColumn("copies", _crossed(F.col("start")).cast("long"))


def _sized(docs: DataFrame, *more) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), size.alias("size"), F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("missing"))


def sample_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs (doc_id, text, source, ...).

    A document of a source is expected target / source_size times. Documents of a source stand in order of size (in
    steps of a tenth or so), then of a hash; the expected copies are summed along it from one random offset a source, and
    a document is emitted once for each integer that its step of the sum crosses. So a source's words come near its
    target, and a document comes CAP times at most. Of OFFSETS random offsets a source takes the one that comes nearest.

    Null text has size 0. Sources stand in order of code points, null last, as a source of its own. Equal rows are
    interchangeable: the results are the same whichever gets which count. Sources without words have target 0. An empty
    table gives no rows.
    """
    sizes = saved(_sized(docs))
    rows = _placed(sizes, sizes)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as sample_sizes() counts it; no rows of an empty table."""
    rows = _placed(_sized(docs, F.struct(*[F.col(f"`{k}`") for k in docs.columns]).alias("whole")), saved(_sized(docs)))
    return rows.where("copies > 0").select("whole", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select("whole.*")
