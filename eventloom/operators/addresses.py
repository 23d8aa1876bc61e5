"""Addresses of both families against a table of prefixes: a join of intervals over 128-bit values.

Values are hexadecimal texts of one width a family, so their order is the numbers' order. The table is made disjoint first, each
interval under the rule that comes first there, and cut at its first byte, on which addresses meet it; so an address
finds one interval at most, and rules may overlap as they like.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

#: Rules of whether an address is public: (prefix, public), the first that holds.
PUBLIC = [*[(n, True) for n in urls.IPV6_PUBLIC], *[(n, False) for n in (*urls.IPV6_BLOCKED, *urls.IPV4_BLOCKED)], (urls.IPV6_GLOBAL, True), ("0.0.0.0/0", True)]
_INTERVAL = "family int, bin string, low string, high string, verdict boolean"


def intervals(spark: SparkSession, rules: list[tuple[str, bool]] = PUBLIC) -> DataFrame:
    """(family, bin, low, high, verdict): disjoint intervals of prefixes (text, verdict), of which the first in the list counts,
    cut at each first byte. What no prefix holds has no interval."""
    nets = [(ipaddress.ip_network(text), verdict) for text, verdict in rules]
    rows = []
    for family, width in ((4, 8), (6, 32)):
        own = [(int(n.network_address), int(n.broadcast_address), v) for n, v in nets if n.version == family]
        byte = 1 << (4 * width - 8)
        edges = sorted({e for low, high, _ in own for e in (low, high + 1)} | {k * byte for k in range(257)})
        for low, after in zip(edges, edges[1:], strict=False):
            verdict = next((v for a, b, v in own if a <= low <= b), None)
            if verdict is not None:
                rows.append((family, f"{low // byte:02x}", f"{low:0{width}x}", f"{after - 1:0{width}x}", verdict))
    return spark.createDataFrame(rows, _INTERVAL)


def parsed(address: Column) -> Column:
    """struct(family, value) of an address as text; nulls where it is none."""
    number = urls.ipv4_value(address)
    sides = F.split(F.lower(address), "::", -1)
    groups = lambda s: F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(s, ":", -1))
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    n = F.size(left) + F.size(right)
    written = F.forall(F.concat(left, right), lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
    six = written & F.when(F.size(sides) == 1, n == 8).otherwise((F.size(sides) == 2) & (n <= 7))
    hexed = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
    value = F.when(number.isNotNull(), F.lpad(F.lower(F.hex(number)), 8, "0")).when(six, F.concat(hexed(left), F.repeat(F.lit("0000"), 8 - n), hexed(right)))
    return F.struct(F.when(number.isNotNull(), 4).when(six, 6).alias("family"), value.alias("value"))


def judged(rows: DataFrame, table: DataFrame, address: str = "address", verdict: str = "public") -> DataFrame:
    """rows with the verdict of the table's interval that holds their address; false where none does, or where it is no address.
    Rows stay as they are, repeated ones too."""
    value = parsed(F.col(f"`{address}`"))
    rows = rows.withColumn("_a", value)
    t = table.select(F.struct(*table.columns).alias("_t"))
    meets = (F.col("_a.family") == F.col("_t.family")) & (F.left(F.col("_a.value"), F.lit(2)) == F.col("_t.bin")) & F.col("_a.value").between(F.col("_t.low"), F.col("_t.high"))
    found = rows.join(t, meets, "left").withColumn(verdict, F.coalesce("_t.verdict", F.lit(False)))
    return found.drop("_a", "_t")
