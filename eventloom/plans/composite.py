"""Whole flows over pages and listings that Spark makes of the given tables: identity, records, traversal, collection."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import chains, collect, dedupe, discover, frontier, ordered, resolve
from ..operators.stages import folder, kept
from ..sources import published
from .registry import query, table

AS_OF = "1998-06-15 12:00:00"


def _spread(spark: SparkSession, sf: str) -> DataFrame:
    """Orders on all cores: one small file is one task, and a page costs far more than its order. A table of more files, or of
    larger ones, is read as it lies."""
    orders, cores = table(spark, sf, "orders"), spark.sparkContext.defaultParallelism
    return orders.repartition(cores) if orders.rdd.getNumPartitions() < cores else orders


def _later(day: Column) -> Column:
    """The day after a day, which it never is."""
    return F.date_add(day.cast("date"), 1).cast("string")


def official_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Of each order, an event (name, event_date) and a page that is said to be about it: by its text, by structured data,
    of another date, of another name, with a wrong date, without a venue."""
    k, d = F.col("o_orderkey") % 6, F.date_format(F.add_months("o_orderdate", 120), "yyyy-MM-dd")
    name = F.concat(F.lit("Order Run "), F.col("o_orderkey"))
    heading = F.when(k == 3, "Another Cup").otherwise(name)
    day = F.when(k == 2, _later(d)).otherwise(d)
    body = F.concat(F.lit("<h1>"), heading, F.lit("</h1><p>대회일시: "), day, F.lit("</p>"), F.when(k == 5, "").otherwise(F.concat(F.lit("<p>장소: Hall "), F.col("o_custkey"), F.lit("</p>"))), F.lit("<p>종목: 하프 50,000원 / 5K 무료</p>"))
    start = F.when(k == 4, "2026-02-30").otherwise(F.concat(d, F.lit("T09:00:00+09:00")))
    data = F.concat(F.lit('<script type="application/ld+json">{"@context":"x","@graph":[{"@type":"Event","name":"'), name, F.lit('","startDate":"'), start, F.lit('","location":{"name":"Arena '), F.col("o_custkey"), F.lit('"},"offers":[{"name":"10km","price":"30000"}]}]}</script>'))
    source = F.concat(F.when(k.isin(1, 4), data).otherwise(""), body)
    return _spread(spark, sf).select("o_orderkey", name.alias("name"), d.alias("event_date"), F.concat(F.lit("https://www.order"), F.col("o_custkey"), F.lit(".example.com/race/"), F.col("o_orderkey")).alias("page_url"), source.alias("html"))


def _identified(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.identified(resolve.parsed(official_pages(spark, sf)))


@query("""
SELECT o_orderkey, k NOT IN (2, 3, 4) AS accepted, CASE k WHEN 2 THEN 'date-mismatch' WHEN 3 THEN 'name-mismatch' WHEN 4 THEN 'invalid-date' END AS reason, k = 1 AS structured
FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)""")
def identity_check(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("identity")
    return _identified(spark, sf).select("o_orderkey", i["accepted"].alias("accepted"), i["reason"].alias("reason"), i["event"].isNotNull().alias("structured"))


@query("""
SELECT o_orderkey, CASE WHEN k = 5 THEN NULL WHEN k = 1 THEN 'Arena ' || o_custkey ELSE 'Hall ' || o_custkey END AS venue, CASE WHEN k = 5 THEN 'missing-venue' END AS reason,
CASE WHEN k = 1 THEN '10K:30000,하프:50000,5K:0' ELSE '하프:50000,5K:0' END AS courses, 'https://www.order' || o_custkey || '.example.com/race/' || o_orderkey AS application_url
FROM (SELECT o_orderkey, o_custkey, o_orderkey % 6 AS k FROM orders) WHERE k NOT IN (2, 3, 4)""")
def materialize(spark: SparkSession, sf: str) -> DataFrame:
    """Records of accepted pages: structured fields first, the text's where it names the event too."""
    rows = _identified(spark, sf).where("identity.accepted").withColumn("final_url", F.col("page_url"))
    trusted = F.lit(None).cast("struct<conflict:boolean,detail:struct<source_detail_url:string,event_date:string,venue:string>>")
    done = resolve.materialized(rows.withColumn("trusted", trusted), F.lit(AS_OF).cast("timestamp"))
    listed = F.array_join(F.transform("courses", lambda x: F.concat_ws(":", x["name"], F.coalesce(x["price"].cast("string"), F.lit("-")))), ",")
    return done.select("o_orderkey", "venue", "reason", listed.alias("courses"), "application_url")


@query("""
SELECT o_orderkey AS page_id, 'https://race' || o_custkey || '.example.com/cup?id=' || o_orderkey AS url, 'application' AS kind, 'explicit-label' AS evidence FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'https://race' || o_custkey || '.example.com/home/' || o_orderkey, 'official', 'explicit-label' FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'https://event' || o_custkey || '.example.com/e', 'official', 'structured-event' FROM orders WHERE o_orderkey % 5 = 0""")
def discover_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of detail pages made of orders: labelled anchors, field links, structured data; repeats, files, social and own
    hosts go."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    apply_ = F.concat(F.lit('<a href="https://RACE'), cust, F.lit(".example.com/cup?id="), key, F.lit('&amp;utm_source=x#top">참가 신청</a>'))
    home = F.concat(F.lit('<table><tr><th>홈페이지</th><td><a href="https://race'), cust, F.lit(".example.com/home/"), key, F.lit('">https://race.example.com</a></td></tr></table>'))
    name, day = F.concat(F.lit("Order Run "), key), F.date_format("o_orderdate", "yyyy-MM-dd")
    data = F.concat(F.lit('<script type="application/ld+json">{"@type":"Event","name":"order RUN, '), key, F.lit('","startDate":"'), day, F.lit('","url":"https://event'), cust, F.lit('.example.com/e"}</script>'))
    noise = F.lit('<nav><a href="https://other.example.com/a">공식 홈페이지</a></nav><a href="https://x.com/p">공식 홈페이지</a><a href="/own">대회 홈페이지</a><a href="https://f.example.com/form.pdf">접수</a>')
    source = F.concat(F.when(key % 2 == 0, F.concat(apply_, apply_)).otherwise(""), F.when(key % 3 == 0, home).otherwise(""), F.when(key % 5 == 0, data).otherwise(""), noise)
    pages = _spread(spark, sf).select(key.alias("page_id"), F.concat(F.lit("https://list.example.org/d/"), key).alias("page_url"), name.alias("name"), day.alias("event_date"), source.alias("html"))
    return discover.discovered(pages, F.array(F.lit("list.example.org"))).select("page_id", "url", "kind", "evidence")


@query("""
WITH c AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n, o_orderpriority AS p FROM orders)
SELECT count(*) AS chains, sum((k <> 3)::INT)::BIGINT AS accepted, sum(CASE WHEN k = 2 THEN 2 ELSE 1 END)::BIGINT AS fetched, sum((k = 3)::INT)::BIGINT AS identity, sum(CASE WHEN k = 2 THEN 3 ELSE 0 END)::BIGINT AS depth FROM c""")
def traverse_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Chains made of orders, all of one run: official seeds, failing ones, and applications with four children, of which one is
    fetched and three are beyond the chain's depth. The run has no budget; traverse_run and traverse_budgets have one."""
    key, k = F.col("o_orderkey"), F.col("o_orderkey") % 4
    url, host = F.concat(F.lit("https://h"), key, F.lit(".example.com/")), F.concat(F.lit("h"), key)
    none = F.array().cast("array<string>")
    children = F.transform(F.array(*map(F.lit, "abcd")), lambda c: F.concat(url, c))
    step = lambda u, ok, kids: F.struct(u.alias("url"), host.alias("host"), u.alias("final"), ok.alias("outcome"), F.lit(True).alias("official"), F.lit(False).alias("application"), kids.alias("children"), F.lit(0).alias("child_policy"))
    seed = step(url, F.when(k == 3, "identity").otherwise("ok"), F.when(k == 2, children).otherwise(none))
    below = F.when(k == 2, F.transform(children, lambda c: step(c, F.lit("ok"), none))).otherwise(F.array().cast(f"array<{frontier.STEP}>"))
    steps = F.concat(F.array(seed).cast(f"array<{frontier.STEP}>"), below.cast(f"array<{frontier.STEP}>"))
    chains = table(spark, sf, "orders").select(F.lit(0).alias("run_id"), key.alias("ord"), url.alias("chain"), F.when(k == 2, "application").otherwise("official").alias("kind"), steps.alias("steps"))
    found = frontier.traversed(chains, run=None, per_host=None)
    return frontier.totals(found).select(F.col("seed").alias("chains"), "accepted", "fetched", "identity", "depth")


_BUDGETS = """
WITH c AS (SELECT o_orderkey AS k, o_orderkey // 64 AS run, CASE WHEN o_orderkey % 3 = 0 THEN 'shared' ELSE 'h' || o_orderkey END AS host FROM orders),
h AS (SELECT *, row_number() OVER (PARTITION BY run, host ORDER BY k) <= 10 AS fits FROM c), u AS (SELECT *, coalesce(sum(fits::INT) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h)
"""


@query(_BUDGETS + """SELECT run::BIGINT AS run_id, sum((used < 40 AND fits)::INT)::BIGINT AS accepted, sum((used < 40 AND NOT fits)::INT)::BIGINT AS host_budget, sum((used >= 40)::INT)::BIGINT AS run_budget FROM u GROUP BY run""")
def traverse_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of which a third share a host, in runs of 64 order keys: budgets of 40 fetches a run and 10 a host."""
    return frontier.traversed(_sharing(spark, sf)).groupBy("run_id").agg(*[F.sum(k).alias(k) for k in ("accepted", "host_budget", "run_budget")])


@query(_BUDGETS + """SELECT count(*) AS seed, sum((used < 40 AND fits)::INT)::BIGINT AS accepted, sum((used < 40 AND fits)::INT)::BIGINT AS fetched, sum((used < 40 AND NOT fits)::INT)::BIGINT AS host_budget,
sum((used >= 40)::INT)::BIGINT AS run_budget, 0::BIGINT AS rejected FROM u""")
def traverse_counters(spark: SparkSession, sf: str) -> DataFrame:
    """The sums over the chains of traverse_budgets as metrics of the job that writes them."""
    watch = Observation()
    kept(frontier.watched(frontier.traversed(_sharing(spark, sf)), watch))
    return spark.createDataFrame([watch.get]).select("seed", "accepted", "fetched", "host_budget", "run_budget", "rejected")


def _sharing(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of orders of which a third share a host, in runs of 64 order keys."""
    key = F.col("o_orderkey")
    url, host = F.concat(F.lit("https://h"), key, F.lit(".example.com/")), F.when(key % 3 == 0, "shared").otherwise(F.concat(F.lit("h"), key))
    step = F.struct(url.alias("url"), host.alias("host"), url.alias("final"), F.lit("ok").alias("outcome"), F.lit(True).alias("official"), F.lit(False).alias("application"), F.array().cast("array<string>").alias("children"), F.lit(0).alias("child_policy"))
    return table(spark, sf, "orders").select(F.floor(key / 64).alias("run_id"), key.alias("ord"), url.alias("chain"), F.lit("official").alias("kind"), F.array(step.cast(frontier.STEP)).alias("steps"))


@query("""
WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_custkey AS c, o_orderkey % 3 AS m FROM orders),
w AS (SELECT 0::BIGINT AS n, 0 AS used, 0 AS shop, map([]::BIGINT[], []::INT[]) AS own, false AS seed, false AS child, 0 AS refused UNION ALL
SELECT n, used + seed::INT + child::INT, shop + (m = 2 AND seed)::INT + (child AND kid = 0)::INT, map_concat(own, CASE WHEN child AND kid > 0 THEN map([c], [coalesce(own[c], 0) + 1]) ELSE map([]::BIGINT[], []::INT[]) END),
seed, child, CASE WHEN NOT seed THEN 1 WHEN m > 0 THEN 0 WHEN child THEN kid ELSE 2 END FROM (
SELECT *, seed AND m = 0 AND used + 1 < 40 AND kid < 2 AS child FROM (
SELECT o.n, o.c, o.m, w.used, w.shop, w.own, w.used < 40 AND (o.m < 2 OR w.shop < 10) AS seed, CASE WHEN w.shop < 10 THEN 0 WHEN coalesce(w.own[o.c], 0) < 10 THEN 1 ELSE 2 END AS kid FROM w JOIN o ON o.n = w.n + 1 WHERE w.used < 40)))
SELECT count(*) AS chains, (SELECT sum(seed::INT + child::INT) FROM w)::BIGINT AS fetched, (SELECT count(*) FROM w WHERE n > 0 AND child)::BIGINT + (SELECT count(*) FROM w JOIN o USING (n) WHERE seed AND m > 0)::BIGINT AS accepted,
(SELECT count(*) FROM o) - (SELECT max(n) FROM w) + (SELECT coalesce(sum(CASE WHEN used = 40 AND seed AND m = 0 AND NOT child THEN 2 ELSE 0 END), 0) FROM w JOIN o USING (n))::BIGINT AS run_budget FROM o""")
def traverse_run(spark: SparkSession, sf: str) -> DataFrame:
    """All chains made of orders in one run with the run's 40 fetches and ten of a host: an application leads to a page of a shared
    host and to one of the customer's own, which is fetched once the shared one is used up; a third of the seeds share that
    host, too."""
    key, m = F.col("o_orderkey"), F.col("o_orderkey") % 3
    seed, none, no = F.concat(F.lit("https://seed"), key, F.lit(".example.com/")), F.array().cast("array<string>"), F.lit(False)
    shop, own = F.concat(F.lit("https://shop.example.com/"), key), F.concat(F.lit("https://c"), F.col("o_custkey"), F.lit(".example.com/"), key)
    step = lambda u, host, kids: F.struct(u, host, u, F.lit("ok"), F.lit(True), no, kids, F.lit(0)).cast(frontier.STEP)
    first = step(seed, F.when(m == 2, "shop").otherwise(F.concat(F.lit("s"), key)), F.when(m == 0, F.array(shop, own)).otherwise(none))
    steps = F.array(first, step(shop, F.lit("shop"), none), step(own, F.concat(F.lit("c"), F.col("o_custkey")), none))
    rows = table(spark, sf, "orders").select(F.lit(0).alias("run_id"), key.alias("ord"), seed.alias("chain"), F.when(m == 0, "application").otherwise("official").alias("kind"), steps.alias("steps"))
    return frontier.totals(frontier.traversed(rows)).select(F.col("seed").alias("chains"), "fetched", "accepted", "run_budget")


def _text(k: Column, *forms: str) -> Column:
    """The form of a key's remainder, with {k} and {d} filled in."""
    return F.get(F.array(*map(F.lit, forms)), (k % len(forms)).cast("int"))


def _filled(form: Column, **values: Column) -> Column:
    for name, value in values.items():
        form = F.replace(form, F.lit("{" + name + "}"), value.cast("string"))
    return form


def seeded_chains(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(seeds, loaded pages) of orders: an accepted page; an application that leads to one; a page of another date; a page
    that failed to load; an accepted one without a venue, filled up from a trusted detail; one without a venue at all; one
    whose evidence has no date."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format(F.add_months("o_orderdate", 360), "yyyy-MM-dd")
    m = k % 7
    name, site = F.concat(F.lit("Order Run "), k), F.concat(F.lit("https://www.order"), c, F.lit(".example.com"))
    url = F.concat(site, F.when(m == 1, F.lit("/entry?id=")).otherwise("/race/"), k)
    orders = _spread(spark, sf).select(k.alias("k"), c.alias("c"), m.alias("m"), day.alias("day"), name.alias("name"), site.alias("site"), url.alias("url"))
    trusted = F.when(F.col("m") == 4, F.struct(F.concat(F.lit("https://marathongo.co.kr/raceDetail/domestic/r-"), F.col("k")).alias("source_detail_url"), F.col("day").alias("event_date"), F.lit("Trusted Hall").alias("venue")))
    none = F.array().cast("array<string>")
    evidence = F.struct(F.array(F.lit("Something Else 9"), F.col("name")).alias("title_hints"), F.when(F.col("m") == 6, none).otherwise(F.array("day")).alias("date_hints"), none.alias("organizer_hints"))
    seeds = orders.select("url", F.when(F.col("m") == 1, "application").otherwise("official").alias("kind"), F.lit("marathongo").alias("source_id"), evidence.alias("evidence"), trusted.alias("trusted"), F.col("k").alias("ord"))
    about = "<h1>{n}</h1><p>대회일시: {d}</p>"
    form = _text(F.col("k"), about + "<p>장소: Hall {c}</p>", about + '<a href="{s}/race/home-{k}">대회 홈페이지</a>', "<h1>{n}</h1><p>대회일시: {later}</p><p>장소: Hall</p>", "", about, about, about)
    fill = {"n": F.col("name"), "d": F.col("day"), "later": _later(F.col("day")), "c": F.col("c"), "s": F.col("site"), "k": F.col("k")}
    loaded = orders.select("url", F.lit(None).cast("string").alias("final_url"), _filled(form, **fill).alias("html"), F.when(F.col("m") == 3, "http-status").alias("reason"))
    child = orders.where("m = 1").select(F.concat("site", F.lit("/race/home-"), "k").alias("url"), F.lit(None).cast("string").alias("final_url"), _filled(F.lit(about + "<p>장소: Child {c}</p>"), **fill).alias("html"), F.lit(None).cast("string").alias("reason"))
    return seeds, loaded.unionByName(child)


_LATER = "2020-01-01 12:00:00"
_ENRICHED = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 7 AS m, strftime(o_orderdate + INTERVAL 360 MONTH, '%Y-%m-%d') AS d, 'https://www.order' || o_custkey || '.example.com/' AS s FROM orders),
r AS (SELECT k, m, 'Order Run ' || k AS name, d AS event_date, CASE m WHEN 0 THEN 'Hall ' || c WHEN 1 THEN 'Child ' || c ELSE 'Trusted Hall' END AS venue, s || CASE WHEN m = 1 THEN 'race/home-' ELSE 'race/' END || k AS application_url,
CASE WHEN m = 4 THEN 'official-sites,marathongo' ELSE 'official-sites' END AS sources FROM o WHERE m IN (0, 1, 4) AND d >= '2022-01-01')
"""


def _enriched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    seeds, loaded = seeded_chains(spark, sf)
    return collect.enriched(seeds, loaded, F.lit("2022-01-01"), F.lit(_LATER).cast("timestamp"), F.lit(0), None, None)


@query(_ENRICHED + "SELECT name, event_date, venue, application_url, sources FROM r")
def enrich_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Chains joined to their pages and those pages' children, traversed in one run without a budget, and turned into records."""
    records, _ = _enriched(spark, sf)
    return records.select("name", "event_date", "venue", "application_url", F.array_join("sources", ",").alias("sources"))


@query("""
WITH o AS (SELECT o_orderkey % 7 AS m FROM orders WHERE o_orderkey % 7 = 6 OR strftime(o_orderdate + INTERVAL 360 MONTH, '%Y-%m-%d') >= '2022-01-01')
SELECT count(*) AS chains, sum((m IN (0, 1, 4, 5))::INT)::BIGINT AS accepted, sum((m IN (0, 1, 4))::INT)::BIGINT AS recorded, sum(CASE m WHEN 1 THEN 2 WHEN 6 THEN 0 ELSE 1 END)::BIGINT AS fetched, sum((m = 3)::INT)::BIGINT AS fetch,
sum((m IN (2, 6))::INT)::BIGINT AS identity FROM o""")
def enrich_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of the chains: accepted pages without a venue give no record, a chain without a dated event is rejected."""
    _, counts = _enriched(spark, sf)
    sums = [F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k) for k in ("accepted", "recorded", "fetched", "fetch", "identity")]
    return counts.agg(F.count("*").alias("chains"), *sums)


@query("WITH RECURSIVE" + _ENRICHED.replace("WITH", "", 1) + """, e AS (SELECT 0 AS i, r.k, r.m, o.c, name, event_date, venue, application_url, sources, true AS verified FROM r JOIN o ON r.k = o.k UNION ALL
SELECT 1, k, m, c, 'Order Run ' || k, d, '미상', 'https://www.order' || c || '.example.com/race/' || k, 'source' || k % 2, false FROM o WHERE k % 5 < 2),
n AS (SELECT *, 'order' || regexp_replace(k::VARCHAR, '20[0-9]{2}', '', 'g') AS x, lower(replace(venue, ' ', '')) AS v,
row_number() OVER (PARTITION BY event_date, c ORDER BY i, i = 0 AND m <> 1, CASE i WHEN 0 THEN k::VARCHAR END, k) AS p FROM e),
g AS (SELECT *, list_distinct([x[j:j+1] for j in range(1, length(x))]) AS gx, list_distinct([v[j:j+1] for j in range(1, length(v))]) AS gv FROM n),
s AS (SELECT b.event_date, b.c, b.p, a.p AS q, a.k = b.k AND a.application_url = b.application_url AS same, len(list_intersect(a.gx, b.gx)) / len(list_distinct(a.gx || b.gx)) AS names,
len(list_intersect(a.gv, b.gv)) / len(list_distinct(a.gv || b.gv)) AS venues FROM g b JOIN g a ON a.event_date = b.event_date AND a.c = b.c AND a.p < b.p),
near AS (SELECT event_date, c, p, list(q) AS near FROM s WHERE same OR names >= 0.5 AND venues >= 0.35 GROUP BY ALL),
f AS (SELECT n.*, coalesce(near, []) AS near FROM n LEFT JOIN near USING (event_date, c, p)),
w AS (SELECT event_date, c, p, p AS anchor, [p] AS anchors FROM f WHERE p = 1 UNION ALL
SELECT f.event_date, f.c, f.p, coalesce(list_min(list_intersect(near, anchors)), f.p), CASE WHEN len(list_intersect(near, anchors)) = 0 THEN list_append(anchors, f.p) ELSE anchors END
FROM w JOIN f ON f.event_date = w.event_date AND f.c = w.c AND f.p = w.p + 1),
b AS (SELECT event_date, arg_min(name, p) AS name, coalesce(arg_min(venue, p) FILTER (venue <> '미상'), '미상') AS venue, arg_min(application_url, p) AS application_url,
flatten(list(string_split(sources, ',') ORDER BY p)) AS z, count(*) AS members, bool_or(verified) AS verified FROM f JOIN w USING (event_date, c, p) GROUP BY event_date, c, anchor)
SELECT left(event_date, 7) AS month, name, event_date, venue, application_url, array_to_string([z[j] for j in range(1, len(z) + 1) if list_position(z, z[j]) = j], ',') AS sources, members, verified, 'unknown' AS status FROM b""")
def collect_events(spark: SparkSession, sf: str) -> DataFrame:
    """The whole flow: pages of chains verified, and listings of two sources, deduplicated, merged and dated. A listed event of
    an unknown venue is the verified one of its date and name if both have one address; events of one host and date are one
    where names and venues are alike."""
    c = F.col
    records, _ = _enriched(spark, sf)
    none, k = F.lit(None).cast("string"), c("o_orderkey")
    day = F.date_format(F.add_months("o_orderdate", 360), "yyyy-MM-dd")
    url = F.concat(F.lit("https://www.order"), c("o_custkey"), F.lit(".example.com/race/"), k)
    listed = table(spark, sf, "orders").where(k % 5 < 2).select(
        k.alias("ord"), F.concat(F.lit("Order Run "), k).alias("name"), day.alias("event_date"), none.alias("registration_deadline"), F.lit("미상").alias("venue"), none.alias("region"), F.array().cast("array<struct<name:string,price:bigint,price_source:string>>").alias("courses"),
        url.alias("application_url"), none.alias("official_site_url"), none.alias("logo_url"), none.alias("notes"), none.alias("url_scheme"), F.array(F.concat(F.lit("source"), k % 2)).alias("sources"), F.lit(False).alias("verified"), F.lit(None).cast("timestamp").alias("last_verified"), F.lit("unknown").alias("registration_status"),
    )
    done = collect.collected(listed, records.drop("chain"), F.lit(_LATER).cast("timestamp"))
    status = dates.registration_status(c("registration_deadline"), c("event_date"), F.lit(_LATER).cast("timestamp"))
    return done.select("month", "name", "event_date", "venue", "application_url", F.array_join("sources", ",").alias("sources"), "members", "verified", status.alias("status"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS m, o_custkey AS c FROM orders)
SELECT k AS page_id, 'https://img' || c || '.example.com/' || CASE m WHEN 0 THEN 'logo' WHEN 1 THEN 'race-logo' ELSE 'mark' END || '-' || k || '.png' AS logo FROM o WHERE m < 3 UNION ALL SELECT k, NULL FROM o WHERE m >= 3""")
def logo_pages(spark: SparkSession, sf: str) -> DataFrame:
    """An event's logo: of structured data, of an image there that says so, of a marked image in its card; none where two
    differ, or where the address isn't safe."""
    from ..functions import html, urls

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name, day = F.concat(F.lit("Order Run "), k, F.lit(" Cup")), F.date_format("o_orderdate", "yyyy-MM-dd")
    data = '<script type="application/ld+json">{"@graph":[[{"@type":"SportsEvent","name":"{n}","startDate":"{d}",%s}]]}</script>'
    form = _text(
        k, data % '"logo":{"@type":"ImageObject","contentUrl":"https://img{c}.example.com/logo-{k}.png"},"image":"https://img{c}.example.com/logo-other.png"', data % '"image":"https://img{c}.example.com/race-logo-{k}.png"',
        '<article><h3>{n}</h3><p>{d}</p><img src="https://img{c}.example.com/mark-{k}.png" alt="{n} 로고"></article>', (data % '"logo":"https://img{c}.example.com/a-{k}.png"') + (data % '"logo":"https://img{c}.example.com/b-{k}.png"'),
        data % '"logo":"https://img{c}.example.com/favicon.png"',
    )
    pages = _spread(spark, sf).select(k.alias("page_id"), name.alias("name"), day.alias("event_date"), _filled(form, n=name, d=day, c=c, k=k).alias("html"))
    rows = pages.withColumn("facts", html.page_facts("html")).withColumn("records", discover.records(F.col("facts.scripts")))
    rows = resolve.logos(rows.withColumn("candidates", resolve.logo_candidates(F.col("facts"), F.col("records"))), ["page_id"])
    return rows.withColumn("u", urls.url(F.col("raw"))).select("page_id", urls.safe_logo(F.col("raw"), F.col("u")).alias("logo"))


def _faulty(spark: SparkSession, sf: str, faults: int) -> DataFrame:
    """Events of orders with one fault each, or none."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    m = k % faults
    course = F.struct(F.when(m == 3, "21K").otherwise("하프").alias("name"), F.when(m == 9, -1).otherwise(50000).cast("bigint").alias("price"), F.lit("structured").alias("price_source"))
    site = F.concat(F.lit("https://www.order"), F.col("o_custkey"), F.lit(".example.com/race/"), k)
    logo = F.when(m == 6, "http://img.example.com/a.png").when(m == 7, "https://IMG.example.com/a.png").when(m == 11, F.concat(F.lit("https://img.example.com/"), k, F.lit(".png")))
    return _spread(spark, sf).select(
        k.alias("ord"), F.when(m == 1, "").otherwise(F.concat(F.lit("Run "), k)).alias("name"), F.when(m == 2, "2026-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("event_date"), F.when(m == 10, "2026-13-01").alias("registration_deadline"), F.lit("Hall").alias("venue"),
        none.alias("region"), F.array(course).alias("courses"), F.when(m == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("official-sites"))).alias("sources"), F.when(m == 5, "http://127.0.0.1/race/1").otherwise(site).alias("application_url"), site.alias("official_site_url"),
        logo.alias("logo_url"), F.when(m == 12, 'a "b"\n,c').alias("notes"), F.when(m == 8, "http://10.0.0.1/x").when(m == 11, site).alias("url_scheme"), F.lit(True).alias("verified"), F.lit(AS_OF).cast("timestamp").alias("last_verified"), F.lit(AS_OF).cast("timestamp").alias("updated_at"),
        F.lit("open").alias("registration_status"),
    )


@query("""SELECT o_orderkey, o_orderkey % 13 IN (0, 11, 12) AS valid FROM orders""")
def valid_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with one fault each, or none: an empty name, no such day, a foreign course, no source, links that aren't safe, a logo
    of another spelling than its own, a negative price, a deadline in no month."""
    return published.linked(_faulty(spark, sf, 13)).select(F.col("ord").alias("o_orderkey"), published.is_valid().alias("valid"))


@query("""
WITH r(rule, m) AS (VALUES ('name', 1), ('event-date', 2), ('courses', 3), ('sources', 4), ('application-url', 5), ('logo-url', 6), ('logo-url', 7), ('url-scheme', 8), ('courses', 9), ('registration-deadline', 10), ('venue', -1), ('official-site-url', -1), ('registration-status', -1))
SELECT rule, count(o_orderkey) AS n FROM r LEFT JOIN orders ON o_orderkey % 13 = m GROUP BY rule""")
def broken_rules(spark: SparkSession, sf: str) -> DataFrame:
    """How many events break each rule of the published document."""
    return published.broken_rules(published.linked(_faulty(spark, sf, 13)), published.faults())


@query("""
SELECT 'Run ' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%d') AS event_date, 'https://www.order' || o_custkey || '.example.com/race/' || o_orderkey AS link,
CASE o_orderkey % 13 WHEN 11 THEN 'https://img.example.com/' || o_orderkey || '.png' END AS logo, CASE o_orderkey % 13 WHEN 12 THEN 'a "b"' || chr(10) || ',c' END AS notes, 50000 AS price FROM orders WHERE o_orderkey % 13 IN (0, 11, 12)""")
def published_document(spark: SparkSession, sf: str) -> DataFrame:
    """The valid events of orders as a document that is written, checked, made the current one, and read again."""
    path = f"{folder(spark)}/document-{uuid.uuid4().hex}"
    events = _faulty(spark, sf, 13).where(F.col("ord") % 13 % 11 < 2).where(F.col("ord") % 13 != 1)
    metadata = spark.createDataFrame([("b", True, True, 1, "ok"), ("a", True, False, 0, "no answer")], "id string, attempted boolean, succeeded boolean, record_count bigint, message string")
    published.publish(kept(events), metadata, AS_OF, path)
    read, _, _ = published.read(spark, published.current(spark, path))
    return read.select("name", "event_date", published.race_link().alias("link"), F.col("logo_url").alias("logo"), "notes", F.col("courses")[0]["price"].alias("price"))


@query("""
SELECT p_partkey, count(*) AS aliases, count(DISTINCT v)::BIGINT AS venues FROM (SELECT p_partkey, unnest([0, 1, 2]) AS v FROM part) GROUP BY p_partkey""")
def alias_map(spark: SparkSession, sf: str) -> DataFrame:
    """Each part listed three times, at venues written in three ways: all keys lead to that of the first record."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k, F.explode(F.array(*map(F.lit, range(3)))).alias("v"))
    venue = F.concat(F.get(F.array(F.lit("Hall"), F.lit("Hall of"), F.lit("Hall of the")), F.col("v")), F.lit(" number "), k)
    rows = rows.select("p_partkey", F.concat(F.lit("Alias Cup "), k).alias("name"), F.lit("2026-05-03").alias("event_date"), venue.alias("venue"), F.col("v"), (k * 3).alias("anchor"), (k * 3 + F.col("v")).alias("ord"))
    records = rows.where("v = 0").select("name", "event_date", "venue", "ord", "p_partkey")
    key = lambda df: text.dedup_key(df["name"], df["event_date"], df["venue"])
    found = dedupe.aliases(rows, records).join(records.select(key(records).alias("key"), "p_partkey"), "key")
    return found.groupBy("p_partkey").agg(F.count("*").alias("aliases"), F.count_distinct("alias").alias("venues"))


@query("""
SELECT o_orderkey, ['접수 중', '마감 임박', '접수 마감', '정보 확인 필요'][o_orderkey % 4 + 1] AS status, CASE WHEN o_orderkey % 3 = 0 THEN '코스 미정' ELSE '하프 · 5K' END AS courses FROM orders""")
def display_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, ("open", "closing-soon", "closed", "other"))), (k % 4).cast("int"))
    course = lambda n: F.struct(F.lit(n).alias("name"))
    courses = F.when(k % 3 == 0, F.slice(F.array(course("하프")), 1, 0)).otherwise(F.array(course("하프"), course("5K")))
    return table(spark, sf, "orders").select("o_orderkey", text.lookup(status, text.STATUS_LABELS, text.STATUS_LABELS["unknown"]).alias("status"), text.courses_label(courses).alias("courses"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 AS m, o_custkey AS c FROM orders), e AS (SELECT k, c, unnest([1, 2]) AS j, m FROM o)
SELECT k AS chain, 'Title ' || j || ' of ' || k AS name, (2 - j)::INTEGER AS turn FROM e WHERE m <> 0 UNION ALL SELECT k, 'Only ' || k, 0 FROM o WHERE m = 1""")
def expected_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events that chains may be about: of each dated evidence its titles, the last first."""
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    both = F.struct(F.array(F.concat(F.lit("Title 1 of "), k), F.concat(F.lit("Title 2 of "), k)).alias("title_hints"), F.when(k % 3 == 0, none).otherwise(F.array(F.lit("bad"), F.lit("2026-05-03"))).alias("date_hints"), none.alias("organizer_hints"))
    one = F.struct(F.array(F.concat(F.lit("Only "), k), F.lit(" ")).alias("title_hints"), F.when(k % 3 == 1, F.array(F.lit("2026-06-07"))).otherwise(none).alias("date_hints"), none.alias("organizer_hints"))
    found = chains.expected(table(spark, sf, "orders").select(k.alias("chain"), F.array(both, one).alias("evidence")))
    return found.select("chain", "name", F.when(F.col("name").startswith("Only"), 0).otherwise(F.col("at.j")).alias("turn"))
