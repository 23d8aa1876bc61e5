"""String functions over Columns: names, venues, labelled text, prices, course names. Built-in expressions only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as ECMAScript's \s has it (Java's \s is ASCII).
WS = r"[\s   -     　﻿]"
#: The venue that stands for an unknown one.
UNKNOWN_VENUE = "미상"

# Suffixes of event names, words that don't tell names apart, course names.
NAME_SUFFIX = "대회|마라톤|축제|코스| Challenge|Race|Run"
NAME_NOISE = r"20\d{2}|\d+주년|전국|국제|하프|육상경기|trail|run|utmb"
NAME_COMMON = "마라톤|대회|레이스"
COURSE_NAMES = {
    "풀": "풀", "풀코스": "풀", "full": "풀", "fullcourse": "풀", "42.195k": "풀", "42.195km": "풀",
    "하프": "하프", "하프코스": "하프", "half": "하프", "halfcourse": "하프", "21.0975k": "하프", "21.0975km": "하프",
    "10k": "10K", "10km": "10K", "5k": "5K", "5km": "5K",
}
COURSES = ["풀", "하프", "10K", "5K"]
COURSE_TYPE = "array<struct<name:string,price:bigint,price_source:string>>"
COURSE_TOKEN = r"(?i)(풀코스|풀|하프코스|하프|half|10\s*k(?:m)?|5\s*k(?:m)?)"
LABELS = {
    "venue": "장소|대회장소|집결지|행사장",
    "deadline": "접수마감|신청마감|등록마감|접수기간|신청기간",
    "event_date": "대회일시|대회일|일시|행사일",
    "courses": "참가종목 및 참가비|참가종목|참가비|종목|코스",
}
STATUS_LABELS = {"open": "접수 중", "closing-soon": "마감 임박", "closed": "접수 마감", "unknown": "정보 확인 필요"}
SOURCE_LABELS = {
    "gorunning": "고러닝", "marathongo": "마라톤고", "kormarathon": "전국마라톤협회", "emarathon": "이마라톤", "maedal": "매달",
    "kaaf": "대한육상연맹", "marathonmoa": "마라톤모아", "runningmap": "러닝맵", "marathonmate": "마라톤메이트", "official-sites": "공식 대회 사이트",
}
OTHER_SOURCE = "기타 일정 출처"
#: Patterns of regions, the first that matches counts.
REGIONS = {
    "서울": "서울", "부산": "부산", "대구": "대구", "인천": "인천", "광주": "광주", "대전": "대전", "울산": "울산", "세종": "세종", "경기": "경기(?:도)?",
    "강원": "강원(?:특별자치도|도)?", "충북": "충청북도|충북", "충남": "충청남도|충남", "전북": "전북(?:특별자치도)?", "전남": "전라남도|전남", "경북": "경상북도|경북", "경남": "경상남도|경남",
    "제주": "제주(?:특별자치도)?",
}
JUNK_NAME = r"\bclass=|마라톤\s*대회\s*일정|후기|결과|링크\s*모음"
PLACEHOLDER_NAME = r"(?i)\A(?:마라톤 대회|KorMarathon|대회 등록 안내)\z"
MARKUP_VENUE = r"\bclass=|\">|<[^>]+>"


def let(c: Column, body) -> Column:
    """body(x), x being the value of c, computed once however often body has it."""
    return F.get(F.transform(F.array(c), lambda x: body(x)), F.lit(0))


def remove(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def normalized_name(name: Column) -> Column:
    """A name without brackets, one suffix, ordinals and punctuation, in lower case. Trimming comes last, so a trailing
    blank keeps the suffix."""
    c = F.regexp_replace(name, f"{WS}+", " ")
    c = remove(remove(c, r"[【\[](.*?)[】\]]"), r"[（(](.*?)[）)]")
    c = remove(c, rf"(?i)\s*(?:{NAME_SUFFIX})\z")
    c = remove(remove(c, r"제\s*\d+\s*회"), r"[^\w가-힣\s]")
    return F.lower(F.trim(c))


def compact_name(name: Column) -> Column:
    return remove(normalized_name(name), r"\s+")


def comparable_name(name: Column) -> Column:
    """What is left of a name once years, anniversaries and words of any event are gone."""
    c = F.regexp_replace(normalized_name(name), r"(?i)s[-\s]*oil", "s오일")
    c = F.regexp_replace(c, "이차전지", "2차전지")
    return remove(remove(remove(c, f"(?i){NAME_NOISE}"), f"(?:{NAME_COMMON})"), "(?i)[^a-z0-9가-힣]")


def comparable_venue(venue: Column) -> Column:
    return F.lower(remove(venue, "(?i)[^a-z0-9가-힣]"))


def bigrams(c: Column) -> Column:
    """The distinct pairs of neighbouring characters."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(F.length(c) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def bigram_similarity(left: Column, right: Column, left_pairs: Column | None = None, right_pairs: Column | None = None) -> Column:
    """Jaccard similarity of bigrams; equal texts are alike, empty or one-character ones aren't."""
    x, y = left_pairs if left_pairs is not None else bigrams(left), right_pairs if right_pairs is not None else bigrams(right)
    both = F.size(F.array_intersect(x, y))
    alike = both / (F.size(x) + F.size(y) - both)
    return F.when(left == right, F.when(F.length(left) == 0, 0.0).otherwise(1.0)).when((F.length(left) < 2) | (F.length(right) < 2), 0.0).otherwise(alike)


#: Bigrams that have a bit of their own, and how many a number holds.
MASKED, WORD = 252, 63


def masked(pairs: Column, often: list[str]) -> Column:
    """struct(size, bits, rest) of distinct bigrams: their number, those of `often` (MASKED at most) as bits of numbers, and
    the others."""
    none = F.lit(0).cast("bigint")

    def bits(some: list[str]) -> Column:
        each = F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("bigint") for i, gram in enumerate(some) for x in (gram, 1 << i)])
        return F.aggregate(pairs, none, lambda all_, x: all_.bitwiseOR(F.coalesce(F.try_element_at(each, x), none))) if some else none

    words = [bits(often[at : at + WORD]).alias(f"w{at // WORD}") for at in range(0, MASKED, WORD)]
    rest = F.array_except(pairs, F.array(*map(F.lit, often)).cast("array<string>"))
    return F.struct(F.size(pairs).alias("size"), F.struct(*words).alias("bits"), rest.alias("rest"))


def masked_similarity(left: Column, right: Column, a: Column, b: Column) -> Column:
    """bigram_similarity of texts whose bigrams are masked, by one list."""
    both = F.when((F.size(a["rest"]) > 0) & (F.size(b["rest"]) > 0), F.size(F.array_intersect(a["rest"], b["rest"]))).otherwise(0)
    for i in range(MASKED // WORD):
        both += F.bit_count(a["bits"][f"w{i}"].bitwiseAND(b["bits"][f"w{i}"]))
    alike = both / (a["size"] + b["size"] - both)
    return F.when(left == right, F.when(F.length(left) == 0, 0.0).otherwise(1.0)).when((F.length(left) < 2) | (F.length(right) < 2), 0.0).otherwise(alike)


def nothing(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def name_base(name: Column) -> Column:
    return F.lower(remove(remove(remove(normalized_name(name), r"\s+"), r"20\d{2}"), "(?i)[^0-9a-z가-힣]"))


def name_profile(name: Column) -> Column:
    """struct(base, year, ordinal) by which identities are told."""
    year, ordinal = F.regexp_extract(name, r"(20\d{2})", 1), F.regexp_extract(name, r"제\s*(\d+)\s*회", 1)
    return F.struct(name_base(name).alias("base"), nothing(year).alias("year"), nothing(ordinal).alias("ordinal"))


def profiles_match(target: Column, candidate: Column) -> Column:
    """One base holds the other, the candidate's has 4 characters at least, and neither years nor ordinals differ."""
    differ = lambda k: F.coalesce(target[k] != candidate[k], F.lit(False))
    a, b = target["base"], candidate["base"]
    return F.coalesce((F.length(b) >= 4) & ~differ("year") & ~differ("ordinal") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def name_match(target: Column, candidate: Column) -> Column:
    return profiles_match(name_profile(target), name_profile(candidate))


def decode_entities(c: Column, order: tuple[str, ...] = ("amp", "lt", "gt", "quot", "#39")) -> Column:
    """Five character references, one after the other; `&amp;` comes first, so `&amp;lt;` becomes `<`."""
    signs = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'"}
    for name in order:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(signs[name]))
    return c


def squeezed(c: Column) -> Column:
    """White space in runs of one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def clean_value(c: Column) -> Column:
    """Decoded, without tags, squeezed; null if nothing is left."""
    return nothing(squeezed(F.regexp_replace(decode_entities(c), "<[^>]+>", " ")))


def tag_text(html: Column, tag: str) -> Column:
    """The text of the first element of a name."""
    return clean_value(F.regexp_replace(nothing(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), "<[^>]+>", " "))


def labelled_text(html: Column) -> Column:
    """A page as lines: scripts and styles go, ends of blocks are line breaks, other tags blanks."""
    c = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    c = F.regexp_replace(c, r"(?i)</(?:tr|p|li|dt|dd|th|td|div|h\d)>", "\n")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), " ", " "), r"[ \t]+", " ")
    return decode_entities(c)


def once(c: Column) -> Column:
    """c, computed once a row: as it depends on a row's number, it isn't copied into the expressions that use it."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def lines_of(text: Column) -> Column:
    """The lines of a text that have more than white space, without it at their ends."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n"), "\n"), lambda x: F.regexp_replace(x, rf"\A{WS}+|{WS}+\z", "")), lambda x: x != "")


def labelled_values(lines: Column, label: str) -> Column:
    """The values of a label: what follows it in its line, or the next line if it stands alone. `lines` is a column."""
    alone, inline = rf"\A(?:{label})\z", rf"\A(?:{label})(?:{WS}*[:：]|{WS}+)(.+)\z"
    pick = lambda x, i: F.when(x.rlike(alone), F.get(lines, i + 1)).otherwise(nothing(F.regexp_extract(x, inline, 1)))
    return F.filter(F.transform(F.transform(lines, pick), clean_value), lambda x: x.isNotNull())


def price(text: Column) -> Column:
    """The first amount with a currency; 0 if the word for `free` comes before it."""
    found = F.struct(F.regexp_extract(text, r"(?i)([0-9][0-9,]*)\s*(?:원|KRW)", 1).alias("amount"), F.regexp_instr(text, F.lit(r"(?i)[0-9][0-9,]*\s*(?:원|KRW)")).alias("at"), F.instr(text, "무료").alias("free"))
    value = lambda f: F.when((f["free"] > 0) & ((f["at"] == 0) | (f["free"] < f["at"])), F.lit(0).cast("bigint")).otherwise(F.replace(f["amount"], F.lit(",")).try_cast("bigint"))
    return let(found, value)


def structured_price(value: Column) -> Column:
    """The first run of digits of a number or text."""
    return F.replace(nothing(F.regexp_extract(value, r"([0-9][0-9,]*)", 1)), F.lit(",")).try_cast("bigint")


def course_name(raw: Column) -> Column:
    """The canonical name of a course, or null."""
    names = F.create_map(*[F.lit(x) for pair in COURSE_NAMES.items() for x in pair])
    return F.try_element_at(names, remove(F.lower(raw), f"{WS}+"))


def canonical_courses(raw: Column) -> Column:
    """Courses by canonical name: the first with a price, or else the last of all; in order of first appearance."""
    named = F.filter(F.transform(raw, lambda c: F.struct(course_name(c["name"]).alias("name"), c["price"].alias("price"), c["price_source"].alias("price_source"))), lambda c: c["name"].isNotNull())
    return by_name(named, keep_last=True)


def by_name(courses: Column, keep_last: bool = False) -> Column:
    """One course a name, in order of first appearance: the first with a price; with none, the first (or last) of all."""

    def chosen(all_: Column, name: Column) -> Column:
        priced = lambda own: F.get(F.filter(own, lambda c: c["price"].isNotNull()), F.lit(0))
        return let(F.filter(all_, lambda c: c["name"] == name), lambda own: F.coalesce(priced(own), F.get(own, F.size(own) - 1 if keep_last else F.lit(0))))

    return let(courses, lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda c: c["name"])), lambda name: chosen(all_, name))).cast(COURSE_TYPE)


def body_courses(value: Column) -> Column:
    """Courses named in a text, each with the price that stands before the next one or a slash."""
    names = F.regexp_extract_all(value, F.lit(COURSE_TOKEN), 1)
    tails = F.slice(F.split(value, COURSE_TOKEN), 2, 2**31 - 2)
    raw = F.transform(F.arrays_zip(names.alias("n"), tails.alias("t")), lambda x: F.struct(x["n"].alias("name"), price(F.split_part(x["t"], F.lit("/"), F.lit(1))).alias("price"), F.lit("body-text").alias("price_source")))
    return F.coalesce(canonical_courses(raw), F.array().cast(COURSE_TYPE))


def merged_courses(primary: Column, secondary: Column) -> Column:
    """Both lists by name; a price wins over none."""
    return by_name(F.concat(primary, secondary))


def supplemented_courses(official: Column, body: Column) -> Column:
    """The first list, and those of the second whose name it lacks."""
    names = F.transform(official, lambda c: c["name"])
    return F.concat(official, F.filter(body, lambda c: ~F.array_contains(names, c["name"])))


def priced_from(existing: Column, incoming: Column) -> Column:
    """existing courses, with an incoming price where they have none (their source stays), then the new ones."""
    same = lambda a, b: F.lower(remove(a, f"{WS}+")) == F.lower(remove(b, f"{WS}+"))
    found = lambda c: F.get(F.filter(incoming, lambda i: same(i["name"], c["name"]) & i["price"].isNotNull()), F.lit(0))["price"]
    kept = F.transform(existing, lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["price"], found(c)).alias("price"), c["price_source"].alias("price_source")))
    return F.concat(kept, F.filter(incoming, lambda i: ~F.exists(existing, lambda c: same(c["name"], i["name"])))).cast(COURSE_TYPE)


def merged_notes(a: Column, b: Column) -> Column:
    a, b = nothing(a), nothing(b)
    return F.when(a.isNull(), b).when(b.isNull() | (a == b), a).otherwise(F.concat(a, F.lit("; "), b))


def region_of(venue: Column) -> Column:
    return F.coalesce(*[F.when(venue.rlike(pattern), F.lit(region)) for region, pattern in REGIONS.items()])


def is_junk_name(name: Column) -> Column:
    return name.rlike(JUNK_NAME) | F.trim(name).rlike(PLACEHOLDER_NAME)


def scrubbed_venue(venue: Column) -> Column:
    return F.when(venue.rlike(MARKUP_VENUE), F.lit(UNKNOWN_VENUE)).otherwise(F.replace(venue, F.lit("&amp;"), F.lit("&")))


def title_aliases(name: Column) -> Column:
    """A title and its other word orders: `A in B` is `B A` too, and a trailing park may be the place."""
    parts = F.split(name, rf"(?i){WS}+in{WS}+")
    left, place = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    year, event = nothing(F.regexp_extract(left, rf"\A(20\d{{2}}){WS}+(.+)\z", 1)), F.regexp_extract(left, rf"\A(20\d{{2}}){WS}+(.+)\z", 2)
    event = F.when(year.isNull(), left).otherwise(F.trim(event))
    turned = F.when((F.size(parts) == 2) & (left != "") & (place != "") & (event != ""), F.concat_ws(" ", year, place, event))
    park = rf"\A(20\d{{2}}){WS}+(.+?){WS}+(올림픽공원)\z"
    y, e, p = (F.regexp_extract(name, park, i) for i in (1, 2, 3))
    more = F.when(name.rlike(park), F.array(F.concat_ws(" ", y, e, F.lit("in"), p), F.concat_ws(" ", y, p, e))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(F.array(name, turned), more)))


def courses_label(courses: Column) -> Column:
    return F.coalesce(nothing(F.array_join(F.transform(courses, lambda c: c["name"]), " · ")), F.lit("코스 미정"))


def freshness(generated_at: Column, failed: Column) -> Column:
    """What is said of a document's age, its time in the session's zone, and of the sources that failed (an array of ids, each name
    once); without a time, that there is no document."""
    ids = F.coalesce(failed, F.array().cast("array<string>"))
    names = F.array_distinct(F.transform(ids, lambda x: lookup(x, SOURCE_LABELS, OTHER_SOURCE)))
    time = F.concat(F.date_format(generated_at, "yyyy. M. d. "), F.when(F.hour(generated_at) < 12, "오전 ").otherwise("오후 "), F.date_format(generated_at, "h:mm"))
    late = F.when(F.size(names) > 0, F.concat(F.lit(" · 일부 출처 확인 지연: "), F.array_join(names, ", "))).otherwise("")
    none = F.concat(F.lit("일정 데이터를 불러오지 못했습니다 · 확인 실패: "), F.array_join(ids, ", "))
    return F.when(generated_at.isNull(), none).otherwise(F.concat(F.lit("마지막 수집: "), time, late))


def lookup(c: Column, labels: dict[str, str], other: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), c)
    return found if other is None else F.coalesce(found, F.lit(other))


def link_kind(label: Column) -> Column:
    """`application`, `official` or null (neither or both) for a link's label."""
    compact = remove(label, r"(?U)[\s\p{P}\p{S}]+")
    subject, denial = "(?:공식|대회공식|대회)?홈페이지(?:가|는|를)?", "아님|아니다|아닙니다|없음|없습니다|없어요|(?:존재하지|(?:현재)?운영하지)않(?:습니다|아요)|운영안함|미운영"
    official = compact.rlike(r"공식홈페이지|대회홈페이지|\A홈페이지(?:\z|안내|바로가기)") & ~compact.rlike(r"\A비공식(?:대회)?홈페이지") & ~compact.rlike(rf"\A{subject}(?:{denial})\z")
    application = remove(label, f"{WS}+").rlike("참가신청|접수|신청")
    return F.when(application & ~official, "application").when(official & ~application, "official")


@F.pandas_udf(T.StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no expression for."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def dedup_key(name: Column, event_date: Column, venue: Column) -> Column:
    """name|date|venue; a name of under two characters stands raw, percent-encoded."""
    short = remove(F.lower(nfkc(name)), f"{WS}+")
    raw = F.concat(F.lit("raw:"), F.regexp_replace(F.url_encode(short), r"\+", "%20"))
    compact = compact_name(name)
    place = F.coalesce(nothing(remove(F.lower(nfkc(venue)), "[^a-z0-9가-힣]")), F.lit(UNKNOWN_VENUE))
    return F.concat_ws("|", F.when(F.length(compact) >= 2, compact).otherwise(raw), event_date, place)
