"""Order-dependent rules. Spark rows have no order, so every rule here takes an explicit ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, keys: list[str], ord_: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(ord_)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def last_of_each(rows: DataFrame, keys: list[str], ord_: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(ord_))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def best_of_each(rows: DataFrame, keys: list[str], priority: str, ord_: str) -> DataFrame:
    """The row of highest priority of each key, the first of equals; `place` is where the key first appeared."""
    own = Window.partitionBy(*keys)
    rows = rows.withColumn("place", F.min(ord_).over(own)).withColumn("_rank", F.row_number().over(own.orderBy(F.desc(priority), ord_)))
    return rows.where("_rank = 1").drop("_rank")


def within_budget(rows: DataFrame, keys: list[str], ord_: str, budget: int, ok: Column | None = None) -> DataFrame:
    """rows with `outcome`: `rejected` where not ok, `skipped` beyond the budget of their key, else `taken`.

    Without `ok` every row uses the budget up; with it, only those that are ok do.
    """
    if ok is None:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(ord_))
        return rows.withColumn("outcome", F.when(n <= budget, "taken").otherwise("skipped"))
    used = F.sum(ok.cast("int")).over(Window.partitionBy(*keys).orderBy(ord_).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("outcome", F.when(~ok, "rejected").when(used <= budget, "taken").otherwise("skipped"))


def reserved(rows: DataFrame, host: str, ord_: str, run: int = 40, per_host: int = 10, keys: list[str] | None = None) -> DataFrame:
    """rows with `outcome`: `run` once a run's budget is used up, `host` beyond a host's, else `reserved`.

    The run is checked first, and a request that its host turns down doesn't use the run up. `keys` tell runs apart; the
    run's budget is a running sum over each, so independent runs are what spreads over a cluster.
    """
    keys = keys or []
    fits = F.row_number().over(Window.partitionBy(*keys, host).orderBy(ord_)) <= per_host
    before = Window.partitionBy(*keys).orderBy(ord_).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_fits", fits).withColumn("_used", F.coalesce(F.sum(F.col("_fits").cast("int")).over(before), F.lit(0)))
    return rows.withColumn("outcome", F.when(F.col("_used") >= run, "run").when(F.col("_fits"), "reserved").otherwise("host")).drop("_fits", "_used")


def in_locale_order(links: Column) -> Column:
    """Addresses in the order of their letters, not of their bytes."""
    return F.transform(F.array_sort(F.transform(links, lambda x: F.struct(F.collate(x, "UNICODE").alias("k"), x.alias("x")))), lambda x: x["x"])


def top_children(links: Column, most: int = 3) -> Column:
    """struct(taken, left): the first links in order, and how many are left over."""
    ordered = in_locale_order(F.array_distinct(links))
    return F.struct(F.slice(ordered, 1, most).alias("taken"), F.greatest(F.size(ordered) - most, F.lit(0)).alias("left"))


def only_value(values: Column) -> Column:
    """The one distinct value, or null."""
    distinct = F.array_distinct(F.array_compact(values))
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def unambiguous(*ranked: Column) -> Column:
    """The value of the first list that has any; null if that list has several."""
    out = F.lit(None)
    for values in reversed(ranked):
        distinct = F.array_distinct(F.array_compact(values))
        out = F.when(F.size(distinct) > 1, None).when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).otherwise(out)
    return out


def in_order(*sources: DataFrame) -> DataFrame:
    """All rows of the sources, with source_index; the order of the sources is their priority."""
    out = None
    for i, df in enumerate(sources):
        df = df.withColumn("source_index", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def distinct_in_order(values: Column) -> Column:
    """Values of a list of lists, each at its first place."""
    return F.array_distinct(F.flatten(values))
