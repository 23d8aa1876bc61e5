"""Dates and statuses over Columns. Time never comes from a clock: callers give `as_of`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, nothing, squeezed

SOON_DAYS = 14
#: Texts that say a date isn't known yet.
PLACEHOLDERS = ["tbd", "tba", "추후 공지", "추후공지"]
LIST_DATE = r"(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})"
BODY_DATE = r"(20\d{2})\s*[년./-]\s*(\d{1,2})\s*(?:월|[./-])\s*(\d{1,2})"


def is_iso_date(c: Column) -> Column:
    """Whether a text is a real, padded date."""
    return F.coalesce(c.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def iso_date(c: Column) -> Column:
    return let(c, lambda x: F.when(is_iso_date(x), x))


def registration_status(deadline: Column, event_date: Column, as_of: Column) -> Column:
    """Dates are midnights in UTC; a missing deadline is unknown, whatever the event's date."""
    days = (F.unix_micros(deadline.cast("timestamp")) - F.unix_micros(as_of)) / 86_400_000_000
    return (
        F.when(deadline.isNull(), "unknown")
        .when(as_of > event_date.cast("timestamp"), "closed")
        .when(as_of > deadline.cast("timestamp"), "closed")
        .when(days <= 0, "closed")
        .when(days <= SOON_DAYS, "closing-soon")
        .otherwise("open")
    )


def structured_date(c: Column) -> Column:
    """struct(kind, value, raw) of a structured date: absent, valid (the date as written, no shift of zones) or invalid."""
    form = r"\A(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?:Z|[+-](\d{2}):(\d{2}))?\z"

    def of(x: Column) -> Column:
        parts = F.split(F.regexp_replace(x, form, "$1,$2,$3,$4,$5,$6"), ",")
        number = lambda p, i: F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(0))
        zone = lambda p: (number(p, 4) <= 14) & (number(p, 5) <= 59) & ((number(p, 4) < 14) | (number(p, 5) == 0))
        timed = lambda p: F.when(is_iso_date(F.get(p, F.lit(0))) & (number(p, 1) <= 23) & (number(p, 2) <= 59) & (number(p, 3) <= 59) & zone(p), F.get(p, F.lit(0)))
        value = F.when(is_iso_date(x), x).when(x.rlike(form), let(parts, timed))
        absent = x.isNull() | F.lower(squeezed(x)).isin(PLACEHOLDERS)
        kind = lambda v: F.when(v.isNotNull(), "valid").otherwise("invalid")
        known = let(value, lambda v: F.struct(kind(v).alias("kind"), v.alias("value"), F.when(v.isNull(), x).alias("raw")))
        return F.when(absent, F.struct(F.lit("absent").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("raw"))).otherwise(known)

    return let(c, of)


def padded(c: Column, pattern: str) -> Column:
    """yyyy-MM-dd of the pattern's three groups, or null."""
    y, m, d = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def body_date(c: Column) -> Column:
    """The last date written in a text, if it is a real one."""
    found = F.regexp_extract_all(c, F.lit(BODY_DATE), 0)
    return iso_date(padded(F.try_element_at(found, F.lit(-1)), BODY_DATE))


def list_date(c: Column) -> Column:
    """The first date of a list entry, padded and not validated."""
    return padded(c, LIST_DATE)


def leading_date(c: Column) -> Column:
    """A real date at the start of a text, alone or before a time."""
    return iso_date(nothing(F.regexp_extract(c, r"\A(\d{4}-\d{2}-\d{2})(?:\z|T)", 1)))


def only_date(c: Column) -> Column:
    """The one distinct real date in a text, or null."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), 0), is_iso_date))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")
