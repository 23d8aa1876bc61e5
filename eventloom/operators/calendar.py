"""Calendar questions over events: filters, months, options, day grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_key

#: Ordinals of one block: what a task ranks at most, of a date's events.
BLOCK = 1 << 16


def matches(region: str = "", course: str = "", status: str = "") -> Column:
    """Exact values, all of them; an empty one allows any, and a missing region matches none."""
    ok = F.lit(True)
    if region:
        ok &= F.col("region") == region
    if course:
        ok &= F.exists("courses", lambda c: c["name"] == course)
    if status:
        ok &= F.col("registration_status") == status
    return F.coalesce(ok, F.lit(False))


def in_month(date: Column, year: int, month: int) -> Column:
    return (F.year(date) == year) & (F.month(date) == month)


def by_month(events: DataFrame, date: str, ord_: str, *keep: str) -> DataFrame:
    """month, n and the month's events in order of date, then of input; months in order of time."""
    rows = F.array_sort(F.collect_list(F.struct(date, ord_, *keep)))
    return events.groupBy(month_key(F.col(date)).alias("month")).agg(F.count("*").alias("n"), rows.alias("events")).orderBy("month")


def placed(events: DataFrame, date: str, ord_: str, block: int = BLOCK) -> DataFrame:
    """Events with their month, `place` in it (from 1, in order of date, then of `ord_`, a number of their own) and `n`, the month's
    events. Those without a date are in no month.

    Only a block of a date's ordinals is ranked in one task; what comes before it is known from the blocks' counts, of which there is one for
    each date and block.
    """
    rows = events.where(F.col(date).isNotNull()).withColumns({"month": month_key(F.col(date)), "_block": F.floor(F.col(ord_) / block)})
    keys, month = ["month", date, "_block"], Window.partitionBy("month")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(month.orderBy(date, "_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(month).alias("n"))
    inside = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(ord_)))
    return inside.join(counts, keys).withColumn("place", F.col("_before") + F.col("_at")).drop("_block", "_before", "_at")


def options(months: DataFrame, year: str = "") -> DataFrame:
    """kind (year, month) and value: the choices there are, months being those of the chosen year."""
    all_ = months.select("month").distinct()
    years = all_.select(F.lit("year").alias("kind"), F.left("month", F.lit(4)).alias("value"))
    own = all_ if not year else all_.where(F.col("month").startswith(f"{year}-"))
    return years.unionByName(own.select(F.lit("month").alias("kind"), F.substr("month", F.lit(6), F.lit(2)).alias("value"))).distinct()


def is_visible(month: Column, year: str = "", number: str = "") -> Column:
    """Whether a month (yyyy-MM) belongs to the chosen year and month number; an empty choice allows any."""
    ok = F.lit(True)
    if year:
        ok &= month.startswith(f"{year}-")
    if number:
        ok &= month.endswith(f"-{number}")
    return ok


def day_grid(events: DataFrame, date: str, months: DataFrame) -> DataFrame:
    """month, day, cell (its place in the grid, weeks from Sunday) and n, for every day of the months (month: yyyy-MM)."""
    first = F.to_date(F.concat("month", F.lit("-01")))
    days = months.select("month", first.alias("first"), F.explode(F.sequence(first, F.last_day(first))).alias("date"))
    n = events.groupBy(F.to_date(date).alias("date")).agg(F.count("*").alias("n"))
    cell = F.dayofweek("first") - 1 + F.dayofmonth("date") - 1
    return days.join(n, "date", "left").select("month", F.dayofmonth("date").alias("day"), cell.alias("cell"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
