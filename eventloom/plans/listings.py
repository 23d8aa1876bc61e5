"""Source queries: listing pages of each source, detail pages, seeds, links and candidates, made of customers and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collect
from ..sources import details, listing
from .registry import query, table

C = "WITH c AS (SELECT c_custkey AS k, DATE '2026-01-01' + (c_custkey % 300)::INTEGER AS d FROM customer)"
O = "WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m, o_custkey AS c, strftime(DATE '2026-01-01' + (o_orderkey % 300)::INTEGER, '%Y-%m-%d') AS d FROM orders)"


def filled(form: str, **values: Column) -> Column:
    """A text with its {names} replaced by columns."""
    parts: list[Column] = []
    for i, piece in enumerate(form.replace("}", "{").split("{")):
        parts.append(F.lit(piece) if i % 2 == 0 else values[piece].cast("string"))
    return F.concat(*parts)


def dated(key: Column) -> dict[str, Column]:
    day = F.date_add(F.lit("2026-01-01").cast("date"), (key % 300).cast("int"))
    return {"k": key, "day": F.date_format(day, "yyyy-MM-dd"), "y": F.year(day), "mo": F.month(day), "d": F.dayofmonth(day)}


def customers(spark: SparkSession, sf: str, form: str) -> DataFrame:
    """A page of each customer."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(key.alias("page_id"), filled(form, **dated(key)).alias("html"))


@query(C + "SELECT k AS page_id, '가을 Run ' || k AS name, strftime(d, '%Y-%m-%d') AS event_date, '/raceDetail/domestic/run-' || k AS detail, 'Org ' || k AS organizer FROM c")
def listing_marathongo(spark: SparkSession, sf: str) -> DataFrame:
    form = (
        '<nav><a href="/raceDetail/domestic/menu">Menu 2026.1.1</a></nav><main><a class="race-card" href="https://marathongo.co.kr/raceDetail/domestic/run-{k}"><b class="title">가을 Run {k}</b> {y}년 {mo}월 {d}일 <i class="organizer">Org {k}</i></a>'
        '<a href="/raceDetail/domestic/run-{k}">again 2026.1.1</a><div class="related-list"><a href="/raceDetail/domestic/other">Other 2026.1.1</a></div></main><a href="/raceDetail/domestic/late">Late 2026.1.1</a>'
    )
    return listing.marathongo(customers(spark, sf, form)).select("page_id", "name", "event_date", "detail", "organizer")


@query(C + """
SELECT k AS page_id, 'Big Run ' || k AS name, strftime(d, '%Y-%m-%d') AS event_date, '/ko/race/r-' || k AS detail FROM c
UNION ALL SELECT k, 'Stream Run ' || k, strftime(d, '%Y-%m-%d'), '/ko/race/s-' || k FROM c UNION ALL SELECT k, 'Card Run ' || k, strftime(d, '%Y-%m-%d'), NULL FROM c""")
def listing_kormarathon(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    v = dated(key)
    data = F.concat(F.lit('<script type="application/ld+json">{"@type":"Event","name":"Big Run '), v["k"], F.lit('","startDate":"'), v["y"], F.lit("."), v["mo"], F.lit("."), v["d"], F.lit('","identifier":"r-'), v["k"], F.lit('"}</script>'))
    stream = F.concat(F.lit('<script>self.__next_f.push([1,"a:{\\"id\\":\\"s-'), v["k"], F.lit('\\",\\"name\\":\\"Stream Run '), v["k"], F.lit('\\",\\"date\\":\\"'), v["day"], F.lit('\\"}"])</script>'))
    card = filled('<div class="race-card"><h3>Card Run {k}</h3><p>{day}</p></div>', **v)
    return listing.kormarathon(table(spark, sf, "customer").select(key.alias("page_id"), F.concat(data, stream, card).alias("html"))).select("page_id", "name", "event_date", "detail")


@query(C + "SELECT k AS page_id, 'Em Run ' || k || ' ' AS name, strftime(d, '%Y-%m-%d') AS event_date, '/race/view/' || k || '?a=1&b=2' AS detail FROM c")
def listing_emarathon(spark: SparkSession, sf: str) -> DataFrame:
    form = '<ul class="event-list"><li class="event-item"><p class="fz_gallery_title">[10k] Em Run {k} 링크<span class="fz_gallery_content">memo</span></p><a href="/race/view/{k}?a=1&amp;b=2">x</a> {y}년 {mo}월 {d}일</li><li class="event-item">no date</li></ul>'
    return listing.emarathon(customers(spark, sf, form)).select("page_id", "name", "event_date", "detail")


@query(C + """SELECT k AS page_id, 'Maple Run ' || k AS name, strftime(d, '%Y-%m-%d') AS event_date, '/races/u-' || k AS detail FROM c
UNION ALL SELECT k, 'Plain Run ' || k, strftime(d, '%Y-%m-%d'), '/races/v-' || k FROM c UNION ALL SELECT k, '마라톤 대회', strftime(d, '%Y-%m-%d'), '/races/w-' || k FROM c""")
def listing_maedal(spark: SparkSession, sf: str) -> DataFrame:
    form = (
        '<div class="race-list"><section class="race-card" title="Maple Run {k}"><a href="/races/u-{k}">x</a><time>{day}</time><a href="/races/u-{k}">again</a></section>'
        '<section class="race-card"><a href="/races/v-{k}">Plain Run {k}</a><p>{day}</p></section><section class="race-card"><a href="/races/w-{k}">가을런</a><p>일시: {day}</p></section></div>'
    )
    return listing.maedal(customers(spark, sf, form)).select("page_id", "name", "event_date", "detail")


@query(C + "SELECT k AS page_id, '전국 마라톤 ' || k AS name, strftime(d, '%Y-%m-%d') AS event_date, 'inside_view.asp?no=' || k AS detail FROM c")
def listing_kaaf(spark: SparkSession, sf: str) -> DataFrame:
    form = '<table><tr><td>{y}.{mo}.{d}</td><td><a href="inside_view.asp?no={k}">전국 마라톤 {k}</a><a href="home.asp">대회 홈페이지</a></td></tr><tr><td>2020.1.1</td><td><a href="notice.asp">공지</a></td></tr></table>'
    return listing.kaaf(customers(spark, sf, form)).select("page_id", "name", "event_date", "detail")


@query(C + """SELECT k AS page_id, 'Listed Run ' || k AS name, strftime(d, '%Y-%m-%d') AS event_date, '/race/l-' || k AS detail, 'Hall ' || k AS venue FROM c
UNION ALL SELECT k, 'Map Run ' || k, strftime(d, '%Y-%m-%d'), '/race/view/' || k, 'Field ' || k FROM c""")
def listing_runningmap(spark: SparkSession, sf: str) -> DataFrame:
    v = dated(F.col("c_custkey"))
    data = F.concat(F.lit('<script type="application/ld+json">{"itemListElement":[{"url":"/race/l-'), v["k"], F.lit('","item":{"name":"Listed Run '), v["k"], F.lit('","startDate":"'), v["day"], F.lit('T09:00","location":{"name":"Hall '), v["k"], F.lit('"}}}]}</script>'))
    link = filled('<div><p>{day}</p><a href="/race/view/{k}">Map Run {k}</a><p>장소: Field {k}</p></div>', **v)
    return listing.runningmap(table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), F.concat(data, link).alias("html"))).select("page_id", "name", "event_date", "detail", "venue")


@query(C + "SELECT k AS page_id, 'Mate Marathon ' || k AS name, strftime(d, '%Y-%m-%d') AS event_date, '/race/m-' || k AS detail FROM c")
def listing_marathonmate(spark: SparkSession, sf: str) -> DataFrame:
    form = '<ul class="card-list"><li class="card"><a href="/race/m-{k}">Mate Marathon {k}</a> {day}</li><li class="card"><a href="/race/n-{k}">Swimming</a> {day}</li></ul>'
    return listing.marathonmate(customers(spark, sf, form)).select("page_id", "name", "event_date", "detail")


@query(C + r"""
, s(source, href, radius, mark) AS (VALUES ('runningmap', '/race/view/', 300, '<a '), ('marathonmate', '/race/view/', 300, '<a '), ('kaaf', 'view.asp?no=', 500, '<a '), ('maedal', '/races/u-', 500, 'href=')),
p AS (SELECT source, radius, mark, k, href || k AS detail, '<p>' || strftime(d, '%Y-%m-%d') || '</p>' || repeat('<i></i>', (k % 90)::INTEGER) || '<a href="' || href || k || '">대회 Marathon ' || k || '</a>' || repeat('<u></u>', (k * 7 % 80)::INTEGER) || '<p>장소: Field ' || k || '</p>' AS html FROM c, s),
i AS (SELECT *, strpos(html, mark) - 1 AS i FROM p), w AS (SELECT *, substr(html, greatest(i - radius, 0) + 1, i + radius - greatest(i - radius, 0)) AS m FROM i)
SELECT source AS source_id, k AS page_id, CASE WHEN source <> 'maedal' THEN '대회 Marathon ' || k ELSE coalesce(nullif(regexp_extract(m, '>([^<가-힣]{4,60})<', 1), ''), '마라톤 대회') END AS name, regexp_extract(m, '\d{4}-\d{2}-\d{2}') AS event_date, detail,
coalesce(CASE WHEN source = 'runningmap' THEN nullif(trim(regexp_extract(m, '장소[^<]*?:\s*([^<\n]{2,30})', 1)), '') END, '미상') AS venue FROM w WHERE regexp_matches(m, '\d{4}-\d{2}-\d{2}')""")
def listing_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Links outside of rows and items, at many distances from a date and a place: what counts is the markup between."""
    key = F.col("c_custkey")
    form = '<p>{day}</p>{before}<a href="{href}{k}">대회 Marathon {k}</a>{after}<p>장소: Field {k}</p>'
    pads = {"before": F.repeat(F.lit("<i></i>"), (key % 90).cast("int")), "after": F.repeat(F.lit("<u></u>"), (key * 7 % 80).cast("int"))}
    found = []
    for parser, href in ((listing.runningmap, "/race/view/"), (listing.marathonmate, "/race/view/"), (listing.kaaf, "view.asp?no="), (listing.maedal, "/races/u-")):
        pages = table(spark, sf, "customer").select(key.alias("page_id"), filled(form, **dated(key), **pads, href=F.lit(href)).alias("html"))
        found.append(parser(pages).select(F.lit(parser.__name__).alias("source_id"), "page_id", "name", "event_date", "detail", "venue"))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(C + "SELECT k AS page_id, CASE WHEN k % 2 = 0 THEN 'Old Run ' ELSE 'Bare Run ' END || k AS name, CASE WHEN k % 2 = 0 THEN strftime(d, '%Y-%m-%d') ELSE '' END AS event_date, CASE WHEN k % 2 = 0 THEN '/race/view.php?idx=' ELSE '/races/b-' END || k AS detail FROM c")
def listing_gorunning_undated(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without dated headings: rows with a date of their own, or bare links without any."""
    old = customers(spark, sf, '<table><tr><td><a href="/race/view.php?idx={k}">Old Run {k}</a></td><td>{day}</td></tr><tr><td><a href="/race/view.php?idx=0">Undated</a></td></tr></table>').where("page_id % 2 = 0")
    bare = customers(spark, sf, '<a href="/races/b-{k}">Bare <b>Run</b> {k}</a><a href="/races/c">ab</a>').where("page_id % 2 = 1")
    return listing.gorunning(old.unionByName(bare)).select("page_id", "name", "event_date", "detail")


@query(C + "SELECT k AS page_id, 'Item Run ' || k AS name, strftime(d, '%Y-%m-%d') AS event_date, '/e/' || k AS detail, 'Park ' || k AS venue FROM c")
def listing_marathonmoa_items(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without anchor cards: items by class."""
    form = '<div class="post-list"><article class="race-card"><a href="/e/{k}">Item Run {k}</a><p>{y}.{mo}.{d}</p><p>장소: Park {k}</p></article></div>'
    return listing.marathonmoa(customers(spark, sf, form)).select("page_id", "name", "event_date", "detail", "venue")


def detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A detail page of each order: with a block of its own, with a summary, of another address, with a labelled place."""
    key = F.col("o_orderkey")
    v, m = {**dated(key), "c": F.col("o_custkey")}, key % 4
    apply_ = '<a href="https://race{c}.example.com/cup?id={k}">신청하기</a><a href="https://race{c}.example.com/cup?id={k}#again">신청하기</a><a href="https://x.example.com/">신청하기 안내</a>'
    own = '<div class="related"><p class="title">Other</p></div><div class="race-detail"><h2 class="race-title">Block Run {k}</h2><p>{y}년 {mo}월 {d}일</p><p class="venue">장소: Hall {k}</p><p class="organizer">Org {c}</p>' + apply_ + '</div><p class="place">Elsewhere</p>'
    summary = '<html><head><title>Title Run {k} | 마라톤 GO</title><meta property="og:description" content="Run | {day} | 서울 | Gym {k}"></head><body><main><p>{day}</p><nav><h1>Menu</h1></nav></main></body></html>'
    other = "<main><h1>Foreign Run {k}</h1>{day}</main>"
    place = "<main><h1>Place Run {k} - 마라톤GO</h1><p>{day}</p><p>장소 : <b>Field</b> {k}</p>" + apply_ + "</main>"
    source = F.when(m == 0, filled(own, **v)).when(m == 1, filled(summary, **v)).when(m == 2, filled(other, **v)).otherwise(filled(place, **v))
    url = F.when(m == 2, F.lit("https://other.example.com/raceDetail/x")).otherwise(F.concat(F.lit("https://marathongo.co.kr/raceDetail/domestic/run-"), key))
    return table(spark, sf, "orders").select(key.alias("page_id"), url.alias("url"), source.alias("html"))


@query(O + """
SELECT k AS page_id, ['Block', 'Title', '', 'Place'][m + 1] || ' Run ' || k AS name, d AS event_date, CASE m WHEN 0 THEN 'Hall ' WHEN 1 THEN '서울 Gym ' ELSE 'Field ' END || k AS venue, CASE m WHEN 0 THEN 'Org ' || c END AS organizer,
CASE WHEN m <> 1 THEN 2 ELSE 0 END AS applications FROM o WHERE m <> 2""")
def marathongo_details(spark: SparkSession, sf: str) -> DataFrame:
    return details.marathongo(detail_pages(spark, sf)).select("page_id", "name", "event_date", "venue", "organizer", F.size("applications").alias("applications"))


@query(O + """
SELECT k AS page_id, 'https://race' || c || '.example.com/cup?id=' || k AS url, ['Block', '', '', 'Place'][m + 1] || ' Run ' || k AS title, d AS event_date, CASE m WHEN 0 THEN 'Org ' || c ELSE 'Listed ' || k END AS organizer,
'https://marathongo.co.kr/raceDetail/domestic/run-' || k AS trusted_url, CASE m WHEN 0 THEN 'Hall ' ELSE 'Field ' END || k AS trusted_venue FROM o WHERE m IN (0, 3)""")
def marathongo_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Listed entries within the budget, joined to their detail pages: an application seed each, with trusted details."""
    key = F.col("o_orderkey")
    listed = table(spark, sf, "orders").select(key.alias("page_id"), F.lit(0).alias("at"), F.lit("Listed").alias("name"), F.lit("2020-01-01").alias("event_date"), F.lit("미상").alias("venue"), F.concat(F.lit("/raceDetail/domestic/run-"), key).alias("detail"), F.concat(F.lit("Listed "), key).alias("organizer"))
    found = details.discovery_candidates(listed, "marathongo", "https://marathongo.co.kr", "/raceSchedule/domestic", 200, True)
    seeds = details.marathongo_seeds(found, details.marathongo(detail_pages(spark, sf)))
    e, t = F.col("evidence"), F.col("trusted")
    return seeds.select("page_id", "url", e["title_hints"][0].alias("title"), e["date_hints"][0].alias("event_date"), e["organizer_hints"][0].alias("organizer"), t["source_detail_url"].alias("trusted_url"), t["venue"].alias("trusted_venue"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT o_custkey AS page_id, 'gorunning' AS source_id, 'Run & ' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%d') AS event_date, '미상' AS venue, 'https://gorunning.kr/races/' || o_orderkey || '/run-' || o_custkey || '/' AS application_url, false AS verified FROM r WHERE n <= 5""")
def transient_events(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of listing pages, and the events they stand for until their pages are read."""
    from .webpages import listing_pages

    found = details.discovery_candidates(listing.gorunning(listing_pages(spark, sf)), "gorunning", "https://gorunning.kr", "/races/", 5, True)
    return details.transient(found).select("page_id", "source_id", "name", "event_date", "venue", "application_url", "verified")


@query("""
WITH l AS (SELECT o_orderkey AS k, o_orderkey % 6 AS m FROM orders), u AS (SELECT k, m, ['https://gorunning.kr/apply?id=' || k, 'https://sub.gorunning.co.kr/apply?id=' || k, 'https://cup' || k || '.example.com/', 'https://cup' || k || '.example.com/entry?id=' || k, 'https://cup' || k || '.example.com/2026/result', 'https://cup' || k || '.example.com/about'][m + 1] AS url, CASE WHEN m < 4 THEN 'application' ELSE 'official' END AS kind FROM l)
SELECT k AS page_id, url, m NOT IN (0, 1, 2) AS others, m = 5 AS official, CASE WHEN m = 3 THEN url END AS preferred FROM u""")
def source_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links that a source's own rules keep, and the one application that is preferred."""
    key = F.col("o_orderkey")
    cup = F.concat(F.lit("https://cup"), key, F.lit(".example.com"))
    forms = [F.concat(F.lit("https://gorunning.kr/apply?id="), key), F.concat(F.lit("https://sub.gorunning.co.kr/apply?id="), key), F.concat(cup, F.lit("/")), F.concat(cup, F.lit("/entry?id="), key), F.concat(cup, F.lit("/2026/result")), F.concat(cup, F.lit("/about"))]
    links = table(spark, sf, "orders").select(key.alias("page_id"), F.lit(0).alias("at"), F.get(F.array(*forms), (key % 6).cast("int")).alias("url"), F.when(key % 6 < 4, "application").otherwise("official").alias("kind"))
    mark = lambda df, name: df.select("page_id", F.lit(True).alias(name))
    rows = links.join(mark(details.without_own(links, "gorunning"), "others"), "page_id", "left").join(mark(details.official_only(links), "official"), "page_id", "left")
    first = details.preferred_application(details.without_own(links, "gorunning"), ["page_id"]).withColumnRenamed("url", "preferred")
    return rows.join(first, "page_id", "left").select("page_id", "url", F.coalesce("others", F.lit(False)).alias("others"), F.coalesce("official", F.lit(False)).alias("official"), "preferred")


@query("""
SELECT n_name AS id, n_nationkey % 3 = 2 AS succeeded, CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey::BIGINT ELSE 0 END AS record_count, ['not attempted', 'HTTP 500', 'ok'][n_nationkey % 3 + 1] AS message, ['SKIP', 'FAIL', 'OK'][n_nationkey % 3 + 1] AS status FROM nation""")
def source_metadata(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import pages as page_files

    k = F.col("n_nationkey")
    found = details.metadata(table(spark, sf, "nation").select(F.col("n_name").alias("id"), (k % 3 != 0).alias("attempted"), F.when(k % 3 == 1, "HTTP 500").alias("error"), k.alias("n")))
    return found.join(page_files.run_summary(found), "id").select("id", "succeeded", "record_count", "message", "status")


@query("""
SELECT event_id, ['ok', 'policy', 'policy', 'fetch', 'fetch', 'fetch'][(event_id % 6)::INTEGER + 1] AS outcome FROM events""")
def page_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What loads of pages count as; unknown reasons are failed loads."""
    reasons = [F.lit(None).cast("string"), *map(F.lit, ("invalid-url", "dns-failure", "http-status", "body-too-large", "never heard of"))]
    return table(spark, sf, "events").select("event_id", collect.outcome_of(F.get(F.array(*reasons), (F.col("event_id") % 6).cast("int"))).alias("outcome"))
