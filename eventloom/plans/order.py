"""Queries over order-dependent rules, budgets, joins of evidence and unions; events stand for ordered evidence."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import addresses, chains, frontier, ordered
from .registry import query, table


@query("""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.first_of_each(table(spark, sf, "documents"), ["text"], "doc_id").select("doc_id", "lang")


@query("""
SELECT user_id, event_id, event_type, place FROM (SELECT user_id, event_id, event_type, min(event_id) OVER (PARTITION BY user_id) AS place,
row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END DESC, event_id) AS k FROM events) WHERE k = 1""")
def priority_argmax(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    rows = table(spark, sf, "events").withColumn("priority", priority)
    return ordered.best_of_each(rows, ["user_id"], "priority", "event_id").select("user_id", "event_id", "event_type", "place")


@query("""
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 20 THEN 'taken' ELSE 'skipped' END AS outcome FROM events""")
def detail_budget_index(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.within_budget(table(spark, sf, "events"), ["user_id"], "event_id", 20).select("event_id", "outcome")


@query("""
SELECT event_id, CASE WHEN value < 20 THEN 'rejected' WHEN count(*) FILTER (value >= 20) OVER (PARTITION BY user_id ORDER BY event_id) <= 20 THEN 'taken' ELSE 'skipped' END AS outcome FROM events""")
def detail_budget_counter(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.within_budget(table(spark, sf, "events"), ["user_id"], "event_id", 20, F.col("value") >= 20).select("event_id", "outcome")


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) <= 2 AS fits FROM events),
u AS (SELECT *, coalesce(sum(fits::INT) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f)
SELECT event_id, CASE WHEN used >= 150 THEN 'run' WHEN fits THEN 'reserved' ELSE 'host' END AS outcome FROM u""")
def host_run_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("host", F.col("user_id"))
    return ordered.reserved(rows, "host", "event_id", run=150, per_host=2, keys=["event_type"]).select("event_id", "outcome")


@query("""
SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey::VARCHAR))[1:3], ',') AS taken, greatest(count(DISTINCT l_partkey) - 3, 0)::INTEGER AS left_over FROM lineitem GROUP BY 1""")
def top_children(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("links"))
    top = ordered.top_children(F.col("links"))
    return rows.select("l_orderkey", F.array_join(top["taken"], ",").alias("taken"), top["left"].alias("left_over"))


@query("""
WITH c AS (SELECT o_orderpriority AS s, o_custkey AS d, max(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'order ' || k ELSE 'own ' || o_orderkey END AS title FROM orders JOIN c ON s = o_orderpriority AND d = o_custkey""")
def seed_candidate_join(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds without evidence take that of their detail page's last candidate."""
    none, strings = F.array().cast("array<string>"), "array<string>"
    hints = lambda c: F.struct(c.alias("title_hints"), none.alias("date_hints"), none.alias("organizer_hints"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source_id"), F.col("o_custkey").cast("string").alias("source_detail_url"))
    own = F.when(F.col("o_orderkey") % 2 == 0, none).otherwise(F.array(F.concat(F.lit("own "), F.col("o_orderkey"))).cast(strings))
    candidates = orders.select("source_id", "source_detail_url", F.col("o_orderkey").alias("ord"), hints(F.array(F.concat(F.lit("order "), F.col("o_orderkey")))).alias("evidence"))
    seeds = orders.withColumn("evidence", hints(own))
    return chains.with_evidence(seeds, candidates).select("o_orderkey", F.get("evidence.title_hints", F.lit(0)).alias("title"))


@query("""
SELECT user_id, CASE WHEN count(DISTINCT event_type) FILTER (value > 120) = 1 THEN max(event_type) FILTER (value > 120) END AS only_type,
CASE WHEN count(DISTINCT event_type) FILTER (value > 200) > 1 THEN NULL WHEN count(DISTINCT event_type) FILTER (value > 200) = 1 THEN max(event_type) FILTER (value > 200)
WHEN count(DISTINCT event_type) FILTER (value > 150 AND value <= 200) = 1 THEN max(event_type) FILTER (value > 150 AND value <= 200) END AS picked FROM events GROUP BY 1""")
def ambiguous_pick(spark: SparkSession, sf: str) -> DataFrame:
    """The only value there is; the value of the first list that has any, unless it has several."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(*[F.collect_list(F.when(ok, F.col("event_type"))).alias(k) for k, ok in (("a", F.col("value") > 120), ("b", F.col("value") > 200), ("c", (F.col("value") > 150) & (F.col("value") <= 200)))])
    return rows.select("user_id", ordered.only_value(F.col("a")).alias("only_type"), ordered.unambiguous(F.col("b"), F.col("c")).alias("picked"))


@query("""
SELECT 0 AS source_index, r_name AS name, r_regionkey AS key FROM region UNION ALL SELECT 1, n_name, n_nationkey FROM nation UNION ALL SELECT 2, s_name, s_nationkey FROM supplier""")
def ordered_union(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda t, name, key: table(spark, sf, t).select(F.col(name).alias("name"), F.col(key).alias("key"))
    return ordered.in_order(read("region", "r_name", "r_regionkey"), read("nation", "n_name", "n_nationkey"), read("supplier", "s_name", "s_nationkey"))


@query("""
SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS sources FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL) GROUP BY 1""")
def distinct_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds of a user's events, each at its first place."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.array("event_type").alias("s")))).alias("l"))
    return rows.select("user_id", F.array_join(ordered.distinct_in_order(F.col("l.s")), ",").alias("sources"))


@query("""
SELECT count(DISTINCT user_id) AS seed, sum((event_type = 'view')::INT)::BIGINT AS fetched, 'seed=' || count(DISTINCT user_id) || ' fetched=' || sum((event_type = 'view')::INT) || ' accepted=' || sum((event_type = 'purchase')::INT)
|| ' rejected=' || sum((event_type IN ('error', 'click'))::INT) || ' policy=' || sum((event_type = 'error')::INT) || ' fetch=' || sum((event_type = 'click')::INT) || ' identity=0 depth=0 cycle=0 host_budget=0 run_budget=0' AS message FROM events""")
def stage_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by outcome, summed over chains, and the message made of them."""
    rows = {"fetched": "view", "accepted": "purchase", "policy": "error", "fetch": "click"}
    per_chain = table(spark, sf, "events").groupBy("user_id").agg(*[(F.count_if(F.col("event_type") == rows[k]) if k in rows else F.lit(0)).alias(k) for k in frontier.COUNTS])
    counts = frontier.totals(per_chain)
    return counts.select("seed", "fetched").crossJoin(frontier.message(counts))


@query("""
WITH s AS (SELECT regexp_replace(url, '#.*', '') AS chain, page_id, 'p' || (page_id % 50) AS title, CASE WHEN page_id % 4 <> 0 THEN strftime(DATE '2026-01-01' + (page_id % 90)::INTEGER, '%Y-%m-%d') END AS d FROM pages),
k AS (SELECT *, coalesce(d, '9999-12-31') AS sd FROM s WHERE d IS NULL OR d >= '2026-02-01')
SELECT chain, min(sd) AS sort_date, arg_min(title, (sd, title, page_id)) AS sort_name, count(DISTINCT (title, d))::INTEGER AS evidence FROM k GROUP BY 1""")
def seed_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds of one address as one chain: past events go, undated ones stay, the earliest stands for the chain."""
    day = F.when(F.col("page_id") % 4 != 0, F.array(F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 90).cast("int")), "yyyy-MM-dd"))).otherwise(F.array().cast("array<string>"))
    evidence = F.struct(F.array(F.concat(F.lit("p"), F.col("page_id") % 50)).alias("title_hints"), day.alias("date_hints"), F.array().cast("array<string>").alias("organizer_hints"))
    trusted = F.lit(None).cast("struct<source_detail_url:string,event_date:string,venue:string>")
    seeds = table(spark, sf, "pages").select("url", F.lit("application").alias("kind"), F.lit("s").alias("source_id"), evidence.alias("evidence"), trusted.alias("trusted"), F.col("page_id").alias("ord"))
    return chains.chains(seeds, F.lit("2026-02-01")).select("chain", "sort_date", "sort_name", F.size("evidence").alias("evidence"))


@query("""
SELECT o_orderkey, NOT (v < 16777216 OR v BETWEEN 167772160 AND 184549375 OR v BETWEEN 1681915904 AND 1686110207 OR v BETWEEN 2130706432 AND 2147483647 OR v BETWEEN 2851995648 AND 2852061183
 OR v BETWEEN 2886729728 AND 2887778303 OR v BETWEEN 3221225472 AND 3221225727 OR v BETWEEN 3221225984 AND 3221226239 OR v BETWEEN 3227017984 AND 3227018239 OR v BETWEEN 3232235520 AND 3232301055
 OR v BETWEEN 3323068416 AND 3323199487 OR v BETWEEN 3325256704 AND 3325256959 OR v BETWEEN 3405803776 AND 3405804031 OR v >= 3758096384) AS public
FROM (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS v FROM orders)""")
def ip_prefix(spark: SparkSession, sf: str) -> DataFrame:
    v = (F.col("o_orderkey") * 2654435761) % 4294967296
    octet = lambda i: F.floor(v / 2 ** (8 * i)) % 256
    return table(spark, sf, "orders").select("o_orderkey", urls.is_public_ipv4(F.concat_ws(".", *[octet(i).cast("string") for i in (3, 2, 1, 0)])).alias("public"))


_GROUPS = ([0x2001, 0x2001, 0x2001, 0x2001, 0x2002, 0x3FFF, 0x2400, 0x64, 0xFE80, 0xFC00, 0, 0xFF02, 0x2620, 0x5F00, 0x2001, 0x2001], [0, 1, 2, 3, 0x1234, 0xFFF, 0xCB00, 0xFF9B, 0, 0, 0, 0, 0, 0, 0xDB8, 0x30])
_RULES = ", ".join(f"({n.version}, '{int(n.network_address)}'::UHUGEINT, '{int(n.broadcast_address)}'::UHUGEINT, {i}, {v})" for i, (t, v) in enumerate(addresses.PUBLIC) for n in [ipaddress.ip_network(t)])


@query(f"""
WITH o AS (SELECT o_orderkey AS k, {_GROUPS[0]}[o_orderkey % 16 + 1] AS g1, {_GROUPS[1]}[o_orderkey % 16 + 1] AS g2 FROM orders), p(f, low, high, i, v) AS (VALUES {_RULES}),
a AS (SELECT k, 4 AS f, ((k * 2654435761) % 4294967296)::UHUGEINT AS x FROM o UNION ALL
SELECT k, 6, list_reduce(list_concat([g1::UHUGEINT, g2::UHUGEINT], [CASE WHEN k % 5 = 0 THEN 0 ELSE (k * j * 7919) % 65536 END::UHUGEINT for j in range(3, 8)], [(k % 4)::UHUGEINT]), lambda s, g: s * 65536::UHUGEINT + g) FROM o)
SELECT k AS o_orderkey, a.f AS family, coalesce(arg_min(v, i), false) AS public FROM a LEFT JOIN p ON a.f = p.f AND x BETWEEN low AND high GROUP BY ALL""")
def address_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Two addresses of each order, one a family, in several spellings: whether they are public by the table of prefixes."""
    k, v = F.col("o_orderkey"), (F.col("o_orderkey") * 2654435761) % 4294967296
    four = F.concat_ws(".", *[(F.floor(v / 2 ** (8 * i)) % 256).cast("string") for i in (3, 2, 1, 0)])
    first = [F.get(F.array(*map(F.lit, g)), (k % 16).cast("int")) for g in _GROUPS]
    group = lambda n: F.hex(n.cast("bigint"))
    short = F.concat(group(first[0]), F.lit(":"), group(first[1]), F.lit("::"), group(k % 4))
    long_ = F.concat_ws(":", *map(group, first), *[group((k * j * 7919) % 65536) for j in range(3, 8)], F.lpad(group(k % 4), 4, "0"))
    six = F.when(k % 5 == 0, short).otherwise(F.lower(long_))
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(F.struct(F.lit(4).alias("family"), four.alias("address")), F.struct(F.lit(6).alias("family"), six.alias("address")))).alias("x")).select("o_orderkey", "x.*")
    return addresses.judged(rows, addresses.intervals(spark)).select("o_orderkey", "family", "public")
