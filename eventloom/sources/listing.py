"""Listing pages of nine sources as rows: at (its place), name, event_date, venue, detail (raw address).

A page is parsed once (functions/markup.py); what is an entry, and which of its elements tell name, date and venue, are
conditions over the elements as Columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, markup, text
from ..operators.ordered import first_of_each

ENTRY = "at int, name string, event_date string, venue string, detail string"
# Paths of the sources' entries.
GORUNNING, GORUNNING_OLD = r"\A/races/\d+/[A-Za-z0-9_-]+/?\z", r"\A/race/view\.php\?idx=\d+\z"
GORUNNING_ANY = rf"\A/races/[^?#]+\z|{GORUNNING_OLD}"
MARATHONGO = r"\A/raceDetail/domestic/[a-z0-9][a-z0-9-]*\z"
MAEDAL, MARATHONMOA = r"\A/races/[\w-]+\z", r"\A/events/[0-9a-f-]{36}\z"
# Words that tell an event's link from others, and notes in titles that aren't part of a name.
EVENT_WORDS, SITE_LABEL = "(?i)마라톤|대회|race", r"(?i)\A(?:공식\s*)?(?:대회\s*)?홈페이지|참가신청|접수|신청하기|신청\z"
TITLE_NOTES = [r"\A(?:텍스트|파일첨부)\s*", r"(?i)\A\[(?:full|half|10k|5k)\]\s*", r"링크\s*\z"]
KOREAN_DATE = r"(20\d{2})[.\-/년\s]+(\d{1,2})[.\-/월\s]+(\d{1,2})(?:일)?"
# Names and places in markup.
LABEL_WRITTEN, NAME_WRITTEN = r'(?i)(?:aria-label|title|alt)="([^"]{4,80})"', r">([^<가-힣]{4,60})<"
PLACE_WRITTEN = r"(?i)(?:장소|지역|위치)[^<]*?[:：]\s*([^<\n]{2,30})"
PLACE = r"(?i)(?:장소명|장소|지역명|지역|위치)[^:：]{0,10}[:：]\s*([^\n]{2,30})"


def E_() -> Column:  # noqa: N802
    """The element of a row."""
    return F.col("e")


def P_() -> Column:  # noqa: N802
    """The page of a row."""
    return F.col("p")


def elements(pages: DataFrame, ok: Callable[[Column], Column]) -> DataFrame:
    """pages (page_id, html) with p (the parsed page), one row an element e that is ok. Others are left out first, as each row has its page."""
    return pages.select("page_id", "html", markup.page("html").alias("p")).select("page_id", "html", "p", F.explode(F.filter("p.elements", ok)).alias("e"))


def links(pages: DataFrame, path: str = "") -> DataFrame:
    """One row a link whose address is of the form `path`, with label, its text."""
    rows = elements(pages, lambda e: (e["tag"] == "a") & (e["href"] != "") & (e["href"].rlike(path) if path else F.lit(True)))
    return rows.withColumn("label", markup.shown(P_(), E_()))


def of(place: Column) -> Column:
    """The element at a place, or null."""
    return F.get("p.elements", place)


def part(c: Column, pattern: str, i: int = 1) -> Column:
    return text.nothing(F.trim(F.regexp_extract(c, pattern, i)))


def sized(c: Column, least: int, most: int) -> Column:
    """A text of that many characters, or null."""
    return F.when(F.length(c).between(least, most), c)


def entries(rows: DataFrame, name: Column, date: Column, detail: Column, venue: Column | None = None, at: Column | None = None) -> DataFrame:
    """Rows that have a name and a date."""
    place = F.coalesce(venue if venue is not None else F.lit(None), F.lit(text.UNKNOWN_VENUE))
    out = rows.select("page_id", (E_()["at"] if at is None else at).alias("at"), name.alias("name"), date.alias("event_date"), place.alias("venue"), detail.alias("detail"))
    return out.where("name is not null and event_date is not null")


def structured(pages: DataFrame) -> DataFrame:
    """One row a structured-data script: v, its value."""
    rows = pages.select("page_id", markup.page("html").alias("p")).select("page_id", F.posexplode("p.scripts").alias("at", "s"))
    return rows.where(F.col("s.type") == "application/ld+json").withColumn("v", F.try_parse_json(F.col("s.text")))


def value(path: str) -> Column:
    return F.try_variant_get(F.col("v"), path, "string")


def gorunning(pages: DataFrame) -> DataFrame:
    """Rows below dated headings, which give them their date; in a page without any, rows with a date of their own; without
    those, bare links, undated."""
    heading = part(E_()["id"], r"\Arace-(\d{4}-\d{2}-\d{2})\z")
    # the last heading before each element: places are kept with the dates, and the page's text isn't sorted
    parsed = pages.select("page_id", markup.page("html").alias("p"))
    tr = F.col("p.elements")
    rows = parsed.select("page_id", "p", F.posexplode(F.filter(tr, lambda e: e["id"].rlike(r"\Arace-\d{4}-\d{2}-\d{2}\z") | (e["tag"] == "a") & e["href"].rlike(GORUNNING_ANY))).alias("k", "e"))
    row_text = F.when(E_()["row"].isNotNull(), markup.shown(P_(), of(E_()["row"])))
    rows = rows.select("page_id", E_()["at"].alias("at"), E_()["href"].alias("detail"), E_()["row"].alias("row"), heading.alias("heading"), markup.shown(P_(), E_()).alias("name"), part(row_text, r"(\d{4}-\d{2}-\d{2})").alias("own"))
    before = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("dated", F.last("heading", True).over(before)).where("detail is not null")
    kind = (
        F.when(F.col("row").isNotNull() & F.col("dated").isNotNull() & F.col("detail").rlike(GORUNNING), 1)
        .when(F.col("row").isNotNull() & F.col("own").isNotNull() & F.col("detail").rlike(GORUNNING_OLD), 2)
        .when(F.length("name") >= 3, 3)
    )
    rows = rows.withColumn("kind", kind).where("kind is not null").withColumn("_least", F.min("kind").over(Window.partitionBy("page_id"))).where("kind = _least")
    # one link a row, one row an address
    rows = first_of_each(rows.withColumn("k", F.when(F.col("kind") < 3, F.col("row")).otherwise(F.col("at"))), ["page_id", "k"], "at")
    rows = first_of_each(rows.withColumn("k", F.when(F.col("kind") == 1, F.col("detail")).otherwise(F.col("at").cast("string"))), ["page_id", "k"], "at")
    date = F.when(F.col("kind") == 1, F.col("dated")).when(F.col("kind") == 2, F.col("own")).otherwise("")
    return rows.select("page_id", "at", "name", date.alias("event_date"), F.lit(text.UNKNOWN_VENUE).alias("venue"), "detail")


def marathongo(pages: DataFrame) -> DataFrame:
    """Cards inside the main element, the first of each address; with organizer."""
    rows = links(pages).where(E_()["main"] & ~E_()["aside"]).withColumn("path", F.regexp_replace(E_()["href"], r"\Ahttps://marathongo\.co\.kr", "")).where(F.col("path").rlike(MARATHONGO))
    named = lambda *words: F.coalesce(*[text.nothing(markup.shown(P_(), markup.first(markup.inside(P_(), E_()), lambda x: markup.has_word(x, w)))) for w in words])
    name = F.coalesce(named("race-title", "event-name", "title"), text.nothing(text.squeezed(F.regexp_replace("label", KOREAN_DATE, " "))))
    out = rows.select("page_id", E_()["at"].alias("at"), name.alias("name"), dates.padded(F.col("label"), KOREAN_DATE).alias("event_date"), F.lit(text.UNKNOWN_VENUE).alias("venue"), F.col("path").alias("detail"), named("organizer", "host").alias("organizer"))
    return first_of_each(out.where("name is not null and event_date is not null"), ["page_id", "detail"], "at")


def kormarathon(pages: DataFrame) -> DataFrame:
    """Structured data, streamed page data and cards, all of them."""
    script = structured(pages)
    day = F.coalesce(part(value("$.startDate"), r"(\d{4}-\d{2}-\d{2})"), dates.list_date(value("$.startDate")))
    first = entries(script, F.when(F.length(value("$.name")) > 2, value("$.name")), day, F.concat(F.lit("/ko/race/"), value("$.identifier")), at=F.col("at"))
    # streamed data: JSON strings in calls, each a line of values
    calls = pages.select("page_id", markup.page("html").alias("p")).select("page_id", F.posexplode("p.scripts").alias("at", "s"))
    data = calls.withColumn("d", F.try_parse_json(F.regexp_extract("s.text", r'(?s)self\.__next_f\.push\((\[1,".*"\])\)', 1))).withColumn("d", F.try_variant_get("d", "$[1]", "string"))
    field = lambda k, form: part(F.col("d"), rf'"{k}":"({form})"')
    second = entries(data.where("d is not null"), field("name", '[^"]{4,80}'), field("date", r"\d{4}-\d{2}-\d{2}"), F.concat(F.lit("/ko/race/"), field("id", '[^"]+')), at=F.col("at"))
    card = elements(pages, lambda e: (e["tag"] == "div") & F.contains(e["cls"], F.lit("race")))
    heading = markup.first(markup.inside(P_(), E_()), lambda x: x["tag"].isin("h2", "h3"))
    third = entries(card, text.nothing(markup.shown(P_(), heading)), dates.list_date(markup.shown(P_(), E_())), F.lit(None).cast("string"))
    return first.unionByName(second).unionByName(third)


def emarathon(pages: DataFrame) -> DataFrame:
    """Rows by class that hold no such row; the title is the gallery's or the link's text, without notes and course marks."""
    named = lambda x: x["tag"].isin("tr", "li", "div") & F.coalesce(x["cls"], F.lit("")).rlike("(?i)race|event|item|col-sm-12")
    rows = elements(pages, named).where(~F.exists(markup.inside(P_(), E_()), named))
    link = markup.first(markup.inside(P_(), E_()), lambda x: (x["tag"] == "a") & x["href"].isNotNull())
    gallery = markup.first(markup.inside(P_(), E_()), lambda x: F.contains(x["cls"], F.lit("fz_gallery_title")))
    content = markup.first(markup.inside(P_(), E_()), lambda x: F.contains(x["cls"], F.lit("fz_gallery_content")))
    title = text.squeezed(F.substr(P_()["text"], gallery["a"] + 1, F.least(gallery["b"], F.coalesce(content["a"], gallery["b"])) - gallery["a"]))
    name = F.coalesce(text.nothing(title), text.nothing(markup.shown(P_(), link)))
    for note in TITLE_NOTES:
        name = F.regexp_replace(name, note, "")
    whole = markup.shown(P_(), E_())
    day = F.coalesce(dates.list_date(whole), dates.padded(whole, r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"))
    return entries(rows, name, day, link["href"])


def context(radius: int, owner: str = "item", place: str = "start") -> Column:
    """The markup of the row or item around an element, or else that around its tag (place = link: around its address)."""
    own = markup.written(F.col("html"), of(E_()[owner]))
    return F.when(E_()[owner].isNotNull(), own).otherwise(markup.around(F.col("html"), E_()[place], radius))


def maedal(pages: DataFrame) -> DataFrame:
    """Links to events, each once, named by the first label or text that the markup of their item, or around, has."""
    rows = first_of_each(links(pages, MAEDAL).withColumn("at", E_()["at"]).withColumn("k", E_()["href"]), ["page_id", "k"], "at")
    rows = rows.withColumn("m", context(500, place="link"))
    found = [text.nothing(F.regexp_extract("m", form, 1)) for form in (LABEL_WRITTEN, NAME_WRITTEN)]
    return entries(rows, F.trim(F.coalesce(*found, F.lit("마라톤 대회"))), dates.list_date(F.col("m")), E_()["href"])


def kaaf(pages: DataFrame) -> DataFrame:
    """Links whose text is an event's and no label, dated by their table row or the text around."""
    rows = links(pages, r"\.asp").where(F.length("label").between(4, 80) & F.col("label").rlike(EVENT_WORDS) & ~F.col("label").rlike(SITE_LABEL))
    return entries(rows, F.col("label"), dates.list_date(context(500, "row")), E_()["href"])


def marathonmoa(pages: DataFrame) -> DataFrame:
    """Anchor cards; in pages without any, items by class."""
    heading = markup.first(markup.inside(P_(), E_()), lambda x: x["tag"].isin("h2", "h3", "h4"))
    cards = links(pages, MARATHONMOA)
    first = entries(cards, sized(markup.shown(P_(), heading), 4, 100), dates.list_date(F.col("label")), E_()["href"], part(markup.lines(P_(), E_()), r"장소\s+([^\n]{2,80})"))
    items = elements(pages.join(first.select("page_id").distinct(), "page_id", "left_anti"), lambda e: e["item"] == e["at"])
    link = markup.first(markup.inside(P_(), E_()), lambda x: (x["tag"] == "a") & x["href"].isNotNull())
    name = F.coalesce(sized(markup.shown(P_(), link), 4, 80), sized(markup.shown(P_(), heading), 4, 80))
    second = entries(items, name, dates.list_date(markup.shown(P_(), E_())), link["href"], part(markup.lines(P_(), E_()), PLACE))
    return first.unionByName(second)


def runningmap(pages: DataFrame) -> DataFrame:
    """Structured lists, then links with a date around them."""
    items = structured(pages).select("page_id", "at", F.explode(F.try_variant_get("v", "$.itemListElement", "array<variant>")).alias("v"))
    name = F.trim(value("$.item.name"))
    first = entries(items, F.when(F.length(name) > 2, name), part(value("$.item.startDate"), r"\A(\d{4}-\d{2}-\d{2})"), value("$.url"), value("$.item.location.name"), F.col("at"))
    around = markup.around(F.col("html"), E_()["start"], 300)
    second = entries(links(pages, "race|event|마라톤"), sized(F.col("label"), 3, 80), dates.list_date(around), E_()["href"], part(around, PLACE_WRITTEN))
    return first.unionByName(second)


def marathonmate(pages: DataFrame) -> DataFrame:
    """Links to races whose text is an event's, dated by their item or the text around."""
    rows = links(pages, "/race/").where(F.col("label").rlike("(?i)마라톤|marathon|run"))
    return entries(rows, sized(F.col("label"), 3, 80), dates.list_date(context(300)), E_()["href"])


def registration_links(html: Column) -> Column:
    """id -> registration address in streamed page data; a later one of an id wins."""
    pattern = r'(?s)\\"id\\":\\"([0-9a-f-]{36})\\"(?:(?!\\"id\\").)*?\\"registration_url\\":(?:null|\\"([^"\\]*)\\")'
    ids, links = (F.regexp_extract_all(html, F.lit(pattern), i) for i in (1, 2))
    pairs = F.filter(F.arrays_zip(ids.alias("id"), links.alias("link")), lambda x: x["link"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda x: x["id"]))
    last = lambda k: F.try_element_at(F.filter(pairs, lambda x: x["id"] == k), F.lit(-1))["link"]
    return F.map_from_arrays(keys, F.transform(keys, last))


#: Sources in order of priority: id, base, list page, detail pages taken, parser, whether unsafe links use the budget up.
SOURCES = [
    ("gorunning", "https://gorunning.kr", "/races/", 200, gorunning, True),
    ("marathongo", "https://marathongo.co.kr", "/raceSchedule/domestic", 200, marathongo, True),
    ("kormarathon", "https://www.kormarathon.com", "/ko", 20, kormarathon, False),
    ("emarathon", "https://emarathon.or.kr", "/", 20, emarathon, False),
    ("maedal", "https://maedal.com", "/", 20, maedal, False),
    ("kaaf", "https://m.kaaf.or.kr", "/mobile/info/inside_all.asp", 20, kaaf, False),
    ("marathonmoa", "https://marathon.me.kr", "/events", 20, marathonmoa, False),
    ("runningmap", "https://runningmap.kr", "/", 20, runningmap, False),
    ("marathonmate", "https://marathonmate.store", "/", 20, marathonmate, False),
]


def candidates(listed: DataFrame, source: str, base: str, budget: int, counts_unsafe: bool) -> DataFrame:
    """Entries with detail_url (null where policy rules it out) and outcome: taken, skipped (budget) or rejected."""
    from ..functions import urls
    from ..operators.ordered import within_budget

    u = urls.url(F.col("detail"), F.lit(base))
    rows = listed.withColumn("_u", u).withColumn("detail_url", urls.safe_detail(F.col("detail"), F.col("_u"), source)).drop("_u").withColumn("source_id", F.lit(source))
    safe = F.col("detail_url").isNotNull()
    if counts_unsafe:
        return within_budget(rows, ["page_id"], "at", budget).withColumn("outcome", F.when(safe, F.col("outcome")).otherwise("rejected"))
    return within_budget(rows, ["page_id"], "at", budget, safe)


def stage_counts(rows: DataFrame) -> DataFrame:
    """Of each source: candidates found, rejected, beyond the budget."""
    return rows.groupBy("source_id").agg(F.count_if(F.col("detail_url").isNotNull()).alias("candidates"), F.count_if(F.col("outcome") == "taken").alias("taken"), F.count_if(F.col("outcome") == "rejected").alias("rejected"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))
