"""Golden cases of the scalar functions."""

import pytest
from eventloom.functions import dates, html, text, urls, weather
from pyspark.sql import functions as F

X = F.col("x")


@pytest.mark.parametrize(
    "raw, want",
    [("2026 서울  하프마라톤 대회", "2026 서울 하프마라톤"), ("【공지】 제 12회 한강(여의도) 마라톤", "한강"), ("Spring Run Challenge", "spring run"), ("City Race ", "city race"), ("", ""), (None, None)],
)
def test_normalized_name(one, raw, want):
    assert one(text.normalized_name(X), x=raw) == want


def test_comparable_names_and_venues(one):
    assert one(text.comparable_name(X), x="2026 S-OIL 이차전지 전국 마라톤") == "s오일2차전지"
    assert one(text.comparable_venue(X), x="한강 공원 (A-1)") == "한강공원a1"
    assert one(text.bigram_similarity(X, F.lit("seoulfun")), x="seoulrun") == pytest.approx(5 / 9)
    assert one(text.bigram_similarity(X, F.lit("")), x="") == 0
    assert one(text.bigram_similarity(X, F.lit("ab")), x="a") == 0


@pytest.mark.parametrize("raw, want", [("하프 50,000원", 50000), ("무료 (정가 1,000원)", 0), ("5,000 KRW 무료", 5000), ("선착순 1000명", None), ("", None)])
def test_prices(one, raw, want):
    assert one(text.price(X), x=raw) == want


def test_structured_price(one):
    assert one(text.structured_price(X), x="70000.5") == 70000


def test_courses(one):
    got = one(text.body_courses(X), x="하프 50,000원 / 5K 무료")
    assert [(c.name, c.price) for c in got] == [("하프", 50000), ("5K", 0)]
    got = one(text.body_courses(X), x="10K 선착순 1000명")
    assert [(c.name, c.price) for c in got] == [("10K", None)]
    raw = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).cast("bigint").alias("price"), F.lit("s").alias("price_source")) for n, p in (("Half", None), ("unknown", 1), ("21.0975km", 7), ("half course", 9), ("10 km", None), ("10K", None))])
    assert [(c.name, c.price) for c in one(text.canonical_courses(raw))] == [("하프", 7), ("10K", None)]


def test_labels(one):
    page = "<h1>T</h1><p>장소: 서울 광장</p><p>대회일시</p><p>2026년 4월 12일</p><p>접수마감 2026-03-20</p>"
    lines = one(text.lines_of(text.labelled_text(X)), x=page)
    assert lines[1] == "장소: 서울 광장"
    from_lines = lambda k: one(text.labelled_values(F.array(*map(F.lit, lines)), text.LABELS[k]))
    assert from_lines("venue") == ["서울 광장"] and from_lines("event_date") == ["2026년 4월 12일"] and from_lines("deadline") == ["2026-03-20"]
    assert one(text.decode_entities(X), x="&amp;lt;") == "<"
    assert one(text.tag_text(X, "h1"), x="<h1> a <b>b</b>&amp; </h1>") == "a b &"


def test_names_match(one):
    same = lambda a, b: one(text.name_match(X, F.col("y")), x=a, y=b)
    assert same("제 3회 2026 서울하프", "2026 서울하프 대회")
    assert not same("제 3회 서울하프", "제 4회 서울하프") and not same("2025 서울하프", "2026 서울하프") and not same("서울하프", "서울")


def test_titles_notes_regions_links(one):
    assert one(text.title_aliases(X), x="2026 Night Run in Seoul") == ["2026 Night Run in Seoul", "2026 Seoul Night Run"]
    assert one(text.title_aliases(X), x="2026 나이트런 올림픽공원") == ["2026 나이트런 올림픽공원", "2026 나이트런 in 올림픽공원", "2026 올림픽공원 나이트런"]
    assert one(text.merged_notes(X, F.lit("b")), x="a") == "a; b" and one(text.merged_notes(X, F.lit("a")), x="a") == "a"
    assert one(text.region_of(X), x="강원특별자치도 춘천") == "강원" and one(text.region_of(X), x="x") is None
    kinds = {"참가 신청": "application", "대회 공식 홈페이지": "official", "비공식 홈페이지": None, "공식 홈페이지 없음": None, "홈페이지 안내": "official", "홈페이지 접수": "application"}
    assert {k: one(text.link_kind(X), x=k) for k in kinds} == kinds


def test_dedup_key(one):
    key = text.dedup_key(X, F.lit("2026-01-02"), F.col("y"))
    assert one(key, x="서울 마라톤", y="한강 공원") == "서울|2026-01-02|한강공원"
    assert one(key, x="ａ", y="!") == "raw:a|2026-01-02|미상"


@pytest.mark.parametrize("raw, ok", [("2026-02-28", True), ("2026-02-30", False), ("2026-2-3", False), ("2026-02-28\n", False), (None, False)])
def test_iso_dates(one, raw, ok):
    assert one(dates.is_iso_date(X), x=raw) is ok


@pytest.mark.parametrize(
    "raw, kind, value",
    [(None, "absent", None), (" TBD ", "absent", None), ("추후  공지", "absent", None), ("2026-05-01T23:30:00+09:00", "valid", "2026-05-01"), ("2026-05-01T24:00", "invalid", None), ("2026-05-01T10:00+14:30", "invalid", None), ("2026-05-01T10:00-14:00", "valid", "2026-05-01"), ("May 1", "invalid", None)],
)
def test_structured_dates(one, raw, kind, value):
    got = one(dates.structured_date(X), x=raw)
    assert (got.kind, got.value) == (kind, value)


def test_body_dates(one):
    assert one(dates.body_date(X), x="2026. 4. 11 ~ 2026년 4월 12일") == "2026-04-12"
    assert one(dates.body_date(X), x="2026-13-40") is None
    assert one(dates.only_date(X), x="2026-01-02 and 2026-01-02 not 2026-02-31") == "2026-01-02"
    assert one(dates.only_date(X), x="2026-01-02 2026-01-03") is None


@pytest.mark.parametrize("deadline, event, want", [(None, "2020-01-01", "unknown"), ("2026-01-01", "2025-01-01", "closed"), ("2025-01-01", "2027-01-01", "closed"), ("2026-06-20", "2027-01-01", "closing-soon"), ("2026-12-20", "2027-01-01", "open")])
def test_status(one, deadline, event, want):
    assert one(dates.registration_status(X, F.col("y"), F.lit("2026-06-10 12:00:00").cast("timestamp")), x=deadline, y=event) == want


def test_weather(one):
    assert [one(weather.condition(F.lit(c))) for c in (0, 2, 45, 61, 71, 95, 4)] == ["clear", "cloudy", "fog", "rain", "snow", "storm", "unknown"]
    assert [one(weather.air_level(F.lit(c))) for c in (50, 51, 300, 301)] == ["good", "moderate", "very-unhealthy", "hazardous"]
    assert one(weather.half_up(F.lit(-2.5))) == -2 and one(weather.wind_label(F.lit(350.0))) == "북"
    assert one(weather.place(X), x='{"address":{"town":"t","borough":"t"}}') == ("t", None)
    assert one(weather.air_quality(X), x='{"current":{"us_aqi":501,"pm2_5":1,"pm10":1}}') is None


URLS = [
    ("http://x.com/a/../b/./c?q=1#f", None, "http://x.com/b/c?q=1#f"), ("HTTP://EXAMPLE.com:80", None, "http://example.com/"), ("?z=1", "https://h.kr/a/b?x", "https://h.kr/a/b?z=1"), ("c d", "https://h.kr/a/b", "https://h.kr/a/c%20d"),
    ("//o.com/x", "https://h.kr/", "https://o.com/x"), ("http:/\\h.com\\x", None, "http://h.com/x"), ("nope", None, None), ("http://0x7f.1/", None, "http://127.0.0.1/"), ("http://한국.com/", None, "http://xn--3e0b707e.com/"), ("http://[::1]/", None, "http://[::1]/"),
]


@pytest.mark.parametrize("raw, base, want", URLS)
def test_url_parser(raw, base, want):
    got = urls.parse_url(raw, base)
    assert (got and got["href"]) == want


SAFE = {
    "https://race.example.com/e": True, "http://localhost/e": False, "http://a.local/e": False, "http://10.0.0.1/e": False, "http://8.8.8.8/e": True, "https://u:p@race.example.com/": False, "https://pay.example.com/": False,
    "https://e.example.com/check/payment-now": False, "https://e.example.com/%61dmin/": False, "https://e.example.com/wp-admin.php": False, "ftp://e.example.com/": False, "https://e.example.com/%25%32%35zz": False, "http://[2001:db8::1]/": False,
}


def test_safe_urls(spark):
    rows = spark.createDataFrame([(k,) for k in SAFE], "x string").withColumn("u", urls.url(X))
    assert {r.x: r.ok for r in rows.select("x", urls.is_safe(F.col("u")).alias("ok")).collect()} == SAFE


def test_url_policies(spark):
    raw = ["https://example.com/", "https://example.com/?id=3", "https://example.com/apply", "https://www.kormarathon.com/ko/race/abc", "https://kormarathon.com/about", "https://marathongo.co.kr/raceDetail/domestic/a", "https://fedex.com/a", "https://a.com/p/?utm_source=1&b=2#x"]
    rows = spark.createDataFrame([(k,) for k in raw], "x string").withColumn("u", urls.url(X))
    u = F.col("u")
    got = {r.x: r for r in rows.select("x", urls.is_homepage(u).alias("home"), urls.safe_event_application(u).alias("event"), urls.safe_official(u).alias("official"), urls.canonical(u).alias("canonical"), urls.is_allowed_link(u, F.lit("official"), F.array(F.lit("none"))).alias("allowed")).collect()}
    assert got[raw[0]].home and not got[raw[1]].home and got[raw[2]].official is None
    assert got[raw[3]].event == raw[3] and got[raw[4]].event is None and got[raw[5]].event is None
    assert not got[raw[6]].allowed and got[raw[7]].canonical == "https://a.com/p/?b=2"


def test_detail_pages(spark):
    raw = {"/races/12/seoul-run/": True, "/race/view.php?idx=3": True, "/race/view.php?idx=3&x=1": False, "/races/../admin": False, "/races/admin": False, "/races/a#x": False, "https://other.kr/races/a": False, "/races/%2561": True}
    rows = spark.createDataFrame([(k,) for k in raw], "x string").withColumn("u", urls.url(X, F.lit("https://gorunning.kr")))
    got = {r.x: r.v is not None for r in rows.select("x", urls.safe_detail(X, F.col("u"), "gorunning").alias("v")).collect()}
    assert got == raw


def test_addresses(one, spark):
    assert one(urls.is_public_ipv4(X), x="100.64.0.1") is False and one(urls.is_public_ipv4(X), x="1.2.3.4") is True and one(urls.is_public_ipv4(X), x="1.2.3.256") is False
    rows = spark.createDataFrame([("2001:4860::1", True), ("2001:db8::1", False), ("2001:1::1", True), ("fe80::1", False), ("x", False), ("8.8.8.8", True)], "x string, want boolean")
    assert all(r.v == r.want for r in rows.select("want", urls.is_public_address("x").alias("v")).collect())


def test_resolution(spark):
    rows = spark.createDataFrame([("https://a.com/x", [("1.2.3.4", 4, True)], "allowed", None), ("https://a.com/x", [("1.2.3.4", 4, True), ("10.0.0.1", 4, False)], "rejected", "blocked-address"), ("https://a.com/apply", [("1.2.3.4", 4, True)], "rejected", "unsafe-public-url"), ("https://a.com/x", [], "rejected", "dns-failure"), ("http://10.0.0.1/", [], "rejected", "blocked-address"), ("bad", [], "rejected", "invalid-url")], "x string, a array<struct<address:string,family:int,public:boolean>>, kind string, reason string")
    got = rows.withColumn("u", urls.url(X)).select("kind", "reason", urls.resolve(F.col("u"), F.col("a"), F.lit(True)).alias("r")).collect()
    assert all((r.r.kind, r.r.reason) == (r.kind, r.reason) for r in got)


def test_page_facts():
    facts = html.facts_of('<nav><a href="/n">n</a></nav><div><a href="/a">A <b>b</b></a><script type="application/ld+json">{"a":1}</script></div><table><tr><th>홈페이지</th><td><a href="https://h.com">https://h.com</a></td></tr></table>')
    assert [(a["href"], a["text"], a["blocked"]) for a in facts["anchors"]] == [("/n", "n", True), ("/a", "A b", False), ("https://h.com", "https://h.com", False)]
    assert facts["scripts"] == ['{"a":1}'] and facts["errors"] == 0 and [f["href"] for f in facts["fields"]] == ["https://h.com"]
    assert html.facts_of("<div><a href='/x'>x</div>")["errors"] > 0 and html.facts_of(None)["anchors"] == []


def test_marks_are_as_the_words_of_an_address():
    """Against a plain reading of each class, on hosts and paths of all fixed words with what may stand around them."""
    import re

    def plain(host, path):
        labels, names = host.split("."), [re.sub(r"\.+$", "", s.split(";")[0]).split(".")[0] for s in re.split(r"[\\/]", path)]
        words = [w for w in re.split(r"[^a-z0-9]+", path) if w]
        bare = host[4:] if host.startswith("www.") else host
        return {
            urls.PAYMENT: any(x in urls.PAYMENT_HOSTS for x in labels) or any(w in urls.PAYMENT_PATHS for w in words), urls.PRIVATE: any(n in urls.PRIVATE_NAMES for n in names),
            urls.REGISTRATION: any(x in urls.REGISTRATION_NAMES for x in [*labels, *names]), urls.LOGO: any(n in urls.LOGO_NAMES for n in names), urls.FILE: any(path.endswith(f) for f in urls.FILES),
            urls.AGGREGATOR: bare in urls.AGGREGATORS, urls.LOCAL: host == "localhost" or host.endswith(".localhost") or host.endswith(".local"),
        }

    words = sorted({*urls.PAYMENT_PATHS, *urls.PRIVATE_NAMES, *urls.REGISTRATION_NAMES, *urls.LOGO_NAMES, "races", ""})
    hosts = [f"{w or 'a'}{end}" for w in words for end in ("", ".kr", "s.kr", "-x.kr", ".local")] + [f"www.{a}" for a in urls.AGGREGATORS] + ["localhost", "www.localhost", "x.localhost", "www.www.maedal.com"]
    paths = [form % w for w in words for form in ("/%s", "/a/%s.php", "/%s;v=1/b", "/x-%s-y", "/%s../", "\\%s", "/%sx")] + [f"/a{f}" for f in urls.FILES] + ["/a.pdf/", "/"]
    for host in hosts:
        for path in paths[:: 1 if host == "localhost" else 7]:
            want = plain(host, path)
            assert urls.marks(host, path) == sum(bit for bit, on in want.items() if on), (host, path)
    assert urls.marks("pay.kr", None) == urls.PAYMENT


def test_routes_of_aggregators(spark):
    """An event's page by host, path and query; the query counts only where a route names one."""
    want = {
        "https://gorunning.kr/races/12/seoul/": True, "https://www.gorunning.co.kr/races/seoul?x=1": True, "https://gorunning.kr/races/": False, "https://gorunning.kr/race/view.php?idx=3": True, "https://gorunning.kr/race/view.php?idx=3&a=1": False,
        "https://gorunning.kr/race/view.php": False, "https://maedal.com/events/a": False, "https://maedal.com/races/a": True, "https://example.com/races/a": False, "https://m.kaaf.or.kr/a/b/inside_view.asp?no=1": True, "https://m.kaaf.or.kr/a%0Ab/inside_view.asp?no=1": False,
        "https://runningmap.kr/race/view/%EC%84%9C%EC%9A%B8": True, "https://emarathon.or.kr/bbs/board.php?bo_table=emara04_01&wr_id=9": True, "nope": False,
    }
    rows = spark.createDataFrame([(k,) for k in want], "x string").withColumn("u", urls.url(X))
    assert {r.x: r.ok for r in rows.select("x", urls.is_event_page(F.col("u")).alias("ok")).collect()} == want


ERRORS = {
    "<!DOCTYPE html><p>a &amp; b<br/><img src=x alt=''></p>": [], '<div title="<a href=x>">x</div>': [], "<svg><path d='M0'/><![CDATA[x]]></svg>": [], "<math/>": [], "a > b & c &nbspx; ": ["missing-semicolon-after-character-reference"],
    "<a href='?a=1&copy=2&b=3'>x</a>": [], "<a href='?a=1&copy;'>&copy</a>": ["missing-semicolon-after-character-reference"], "&bogus;": ["unknown-named-character-reference"], "&#;": ["absence-of-digits-in-numeric-character-reference"],
    "&#x80;": ["control-character-reference"], "&#0;&#xD800;&#x110000;&#xFFFF;": ["character-reference-outside-unicode-range", "noncharacter-character-reference", "null-character-reference", "surrogate-character-reference"],
    "&#12a;": ["missing-semicolon-after-character-reference"], "a < b": ["invalid-first-character-of-tag-name"], "a <": ["eof-before-tag-name"], "</": ["eof-before-tag-name"], "</>": ["missing-end-tag-name"], "</ p>": ["invalid-first-character-of-tag-name"],
    "<p": ["eof-in-tag"], "<a href='x": ["eof-in-tag"], "<a href=>x</a>": ["missing-attribute-value"], "<a href=x'y>x</a>": ["unexpected-character-in-unquoted-attribute-value"], "<a href='x'id=y>x</a>": ["missing-whitespace-between-attributes"],
    "<a x y x>x</a>": ["duplicate-attribute"], "<a =x>x</a>": ["unexpected-equals-sign-before-attribute-name"], "<a x'>x</a>": ["unexpected-character-in-attribute-name"], "<a / x>x</a>": ["unexpected-solidus-in-tag"],
    "<div/></div>": ["non-void-html-element-start-tag-with-trailing-solidus"], "<p>x</p id=a>": ["end-tag-with-attributes"], "<p>x</p/>": ["end-tag-with-trailing-solidus"], "<!-->": ["abrupt-closing-of-empty-comment"], "<!-- x --!>": ["incorrectly-closed-comment"],
    "<!-- x <!-- y -->": ["nested-comment"], "<!-- x": ["eof-in-comment"], "<!x>": ["incorrectly-opened-comment"], "<?x?>": ["unexpected-question-mark-instead-of-tag-name"], "<![CDATA[x]]>": ["cdata-in-html-content"], "<svg><![CDATA[x": ["eof-in-cdata"],
    "<svg><div><![CDATA[x]]></div>": ["cdata-in-html-content"], "<svg><foreignObject><div/></foreignObject><g/></svg>": ["non-void-html-element-start-tag-with-trailing-solidus"], "<!DOCTYPE>": ["missing-doctype-name"], "<!DOCTYPEhtml>": ["missing-whitespace-before-doctype-name"],
    "<!DOCTYPE html": ["eof-in-doctype"], '<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01//EN" "http://www.w3.org/TR/html4/strict.dtd">': [], "<!DOCTYPE html x>": ["invalid-character-sequence-after-doctype-name"], "<script>a < b && c</script>": [],
    "<script>x": ["eof-in-element-that-can-contain-only-text"], "<script><!-- <script> </script> --></script>": [], "<script><!-- <script> </script>": ["eof-in-element-that-can-contain-only-text", "eof-in-script-html-comment-like-text"], "<script><!--></script>": [],
    "<title>&bogus;</title>": ["unknown-named-character-reference"], "<style>&bogus; < </style>": [], "<textarea><p": ["eof-in-element-that-can-contain-only-text"], "<plaintext>a < </ <p": [], "a\x00\x01﷐": ["control-character-in-input-stream", "noncharacter-in-input-stream", "unexpected-null-character"], "": [],
}


@pytest.mark.parametrize("page", ERRORS)
def test_tokenizer_errors(page):
    from eventloom.functions.strict import tokenizer_errors

    assert tokenizer_errors(page) == ERRORS[page]


def test_pages_with_errors_have_no_anchors():
    from eventloom.functions.strict import tokenizer_errors

    assert tokenizer_errors(None) == []
    for broken in ['<div title="<a href=\'x\'>a</a>', '<a href="x" b</a> <a href="y">c</a>', "<script>x <a href='y'>z</a>"]:
        assert html.facts_of(broken)["error_names"]
    facts = html.facts_of("<b><i>x</b></i></u>")
    assert facts["error_names"] == ["closing-of-element-with-open-child-elements", "end-tag-without-matching-open-element"] and facts["errors"] == 2
    assert html.facts_of("<ul><li>a<li>b</ul>")["errors"] == 0 and html.facts_of("<b>x")["error_names"] == ["open-elements-left-after-eof"]


LINKS = {
    "<div><a href='/x'>x</div>y": [("/x", "x"), ("/x", "y")], "<a href=/x>1<a href=/y>2</a>3": [("/x", "1"), ("/y", "2")], "<div><a href=/x>1</div><a href=/y>2</a>3": [("/x", "1"), ("/y", "2")], "<div><a href=/x>1</div></a>2": [("/x", "1")],
    "<table><tr><td><a href=/x>1</td><td>2</td></tr></table>3": [("/x", "1")], "<div><a href=/x>1</div><p><b>2</b></p>": [("/x", "1"), ("/x", "2")], "<div><a href=/x>1</div><script>2</script><div></div>": [("/x", "1")],
    "<a href=/x>1<b>2</a>3</b>": [("/x", "12")], "<p><b>bold<br><p><a href=/x>1</a>": [("/x", "1")],
}


@pytest.mark.parametrize("page", LINKS)
def test_links_left_open(page):
    assert [(a["href"], a["text"]) for a in html.facts_of(page)["anchors"]] == LINKS[page]


def test_misplaced_elements_hide_no_links(spark):
    pages = {"<b><i>x</b></i><a href=/x>x</a>": 1, "<a href=/x>x</a><div>": 1, "<a href=/x>x</a>&bogus;": 0, "<a href=/x>x</a><p": 0}
    rows = spark.createDataFrame([(k,) for k in pages], "x string").withColumn("facts", html.page_facts("x"))
    assert {r.x: r.n for r in rows.select("x", F.size(html.anchors(F.col("facts"))).alias("n")).collect()} == pages


def test_freshness(one):
    said = lambda time, ids: one(text.freshness(F.lit(time).cast("timestamp"), F.array(*map(F.lit, ids)).cast("array<string>")), x="")
    assert said("2026-07-01 00:05:00", []) == "마지막 수집: 2026. 7. 1. 오전 12:05" and said("2026-12-31 13:00:00", ["x", "maedal", "y"]) == "마지막 수집: 2026. 12. 31. 오후 1:00 · 일부 출처 확인 지연: 기타 일정 출처, 매달"
    assert said(None, ["maedal", "x"]) == "일정 데이터를 불러오지 못했습니다 · 확인 실패: maedal, x"
