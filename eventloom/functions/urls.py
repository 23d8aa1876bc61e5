"""URLs: one vectorised parser, and policies over its struct as built-in expressions.

The parser also looks the labels of a host and the names and words of a path up among the fixed ones: what they say are bits of
`marks`, so that a policy is a test of bits.
"""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words, hosts and address ranges that the policies know.
PAYMENT_HOSTS = ["pay", "payment", "payments", "checkout", "billing"]
PAYMENT_PATHS = [*PAYMENT_HOSTS, "purchase"]
PRIVATE_NAMES = ["login", "signin", "admin", "administrator", "wp-admin", "member", "members", "private", "api", "graphql"]
REGISTRATION_NAMES = ["register", "registration", "apply", "application", "entry", "signup", "sign-up", "join", "enroll"]
AGGREGATORS = [
    "e-marathon.co.kr", "emarathon.or.kr", "gorunning.co.kr", "gorunning.kr", "kaaf.or.kr", "kormarathon.com", "m.kaaf.or.kr", "maedal.com",
    "marathon.me.kr", "marathongo.co.kr", "marathonmate.com", "marathonmate.store", "marathonmoa.com", "runningmap.com", "runningmap.kr",
]
ID_KEYS = ["event", "eventid", "id", "idx", "no", "race", "raceid", "wr_id"]
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid"]
SOCIAL = ["facebook.", "twitter.", "instagram.", "youtube.", "youtu.be", "band.us", "pf.kakao.com", "story.kakao.com", "x.com"]
FILES = [".pdf", ".hwp", ".hwpx", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp"]
LOGO_NAMES = ["favicon", "apple-touch-icon", "default", "placeholder", "no-image", "noimage"]
SENSITIVE = ["admin", "member", "file"]
RESULT_WORDS = ["record", "records", "result", "results", "timing"]
_ID = "[a-z0-9][a-z0-9_-]*"
#: Of aggregators, the pages of one event: host, path (lower case), query (None: any).
EVENT_PAGES = [
    (["emarathon.or.kr", "e-marathon.co.kr"], rf"/race/view/{_ID}", None),
    (["emarathon.or.kr", "e-marathon.co.kr"], r"/bbs/board\.php", r"\?bo_table=emara04_01&wr_id=\d+"),
    (["gorunning.kr", "gorunning.co.kr"], rf"/races/(?:{_ID}|\d+/{_ID}/?)", None),
    (["gorunning.kr", "gorunning.co.kr"], r"/race/view\.php", r"\?idx=\d+"),
    (["kormarathon.com"], rf"/ko/race/{_ID}", None),
    (["runningmap.kr", "runningmap.com"], r"/race/(?:view/)?[\p{L}\p{N}][\p{L}\p{N}_-]*", None),
    (["maedal.com"], rf"/races/{_ID}", None),
    (["marathon.me.kr", "marathonmoa.com"], rf"/events/{_ID}", None),
    (["marathonmate.store", "marathonmate.com"], rf"/race/{_ID}", None),
    (["kaaf.or.kr", "m.kaaf.or.kr"], r".*/inside_view\.asp", r"\?no=\d+"),
]
_AN = "[A-Za-z0-9][A-Za-z0-9_-]*"
#: A source's own detail pages: base, then (path, query) patterns.
DETAIL_PAGES = {
    "gorunning": [("https://gorunning.kr", [(rf"/races/(?:{_AN}|\d+/{_AN}/?)", ""), (r"/race/view\.php", r"\?idx=\d+")])],
    "kormarathon": [("https://www.kormarathon.com", [(rf"/ko/race/{_AN}", "")])],
    "emarathon": [("https://emarathon.or.kr", [(rf"/race/view/{_AN}", ""), (r"/bbs/board\.php", r"\?bo_table=emara04_01&wr_id=\d+")])],
    "runningmap": [("https://runningmap.kr", [(r"/race/(?:view/)?[\p{L}\p{N}][\p{L}\p{N}_-]*", "")])],
    "maedal": [("https://maedal.com", [(rf"/races/{_AN}", "")])],
    "kaaf": [("https://m.kaaf.or.kr", [(r"/mobile/info/inside_view\.asp", r"\?no=\d+")])],
    "marathonmoa": [(f"https://{h}", [(r"/events/(?i:[0-9a-f]{8}-[0-9a-f-]{27})", "")]) for h in ("marathon.me.kr", "marathonmoa.com")],
    "marathongo": [("https://marathongo.co.kr", [(r"/raceDetail/domestic/[a-z0-9][a-z0-9-]*", "")])],
    "marathonmate": [(f"https://{h}", [(rf"/race/{_AN}", "")]) for h in ("marathonmate.store", "marathonmate.com")],
}
IPV4_BLOCKED = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
IPV6_GLOBAL = "2000::/3"
IPV6_PUBLIC = ["2001:1::1/128", "2001:1::2/128", "2001:1::3/128", "2001:3::/32", "2001:4:112::/48", "2001:30::/28"]
IPV6_BLOCKED = ["2001::/23", "2001::/32", "2001:2::/48", "2001:10::/28", "2001:20::/28", "2001:db8::/32", "2002::/16", "3fff::/20"]

_FIELDS = ["href", "scheme", "host", "port", "path", "query", "fragment", "credentials", "decoded", "deep", "family", "public", "marks"]
URL_TYPE = T.StructType([T.StructField(k, {"credentials": T.BooleanType(), "public": T.BooleanType(), "family": T.IntegerType(), "marks": T.IntegerType()}.get(k, T.StringType())) for k in _FIELDS])
#: Bits of `marks`.
PAYMENT, PRIVATE, REGISTRATION, LOGO, FILE, AGGREGATOR, LOCAL = (1 << i for i in range(7))


def _bits(*classes: tuple[int, list[str]]) -> dict[str, int]:
    """The bits of each word, over all classes that have it."""
    out: dict[str, int] = {}
    for bit, words in classes:
        for word in words:
            out[word] = out.get(word, 0) | bit
    return out


_LABELS = _bits((PAYMENT, PAYMENT_HOSTS), (REGISTRATION, REGISTRATION_NAMES))
_NAMES = _bits((PRIVATE, PRIVATE_NAMES), (REGISTRATION, REGISTRATION_NAMES), (LOGO, LOGO_NAMES))
_WORDS = _bits((PAYMENT, PAYMENT_PATHS))
_HOSTS = _bits((AGGREGATOR, AGGREGATORS), (LOCAL, ["localhost"]))
_SPECIAL = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_PUBLIC6, _BLOCKED6 = ([ipaddress.ip_network(n) for n in x] for x in (IPV6_PUBLIC, IPV6_BLOCKED))
_BLOCKED4, _GLOBAL6 = [ipaddress.ip_network(n) for n in IPV4_BLOCKED], ipaddress.ip_network(IPV6_GLOBAL)
_SAFE = "!$&'()*+,;=:@/-._~%[]|\\^"


def is_public(address) -> bool:
    """Whether an address is globally reachable: exceptions come before blocked ranges."""
    if address.version == 4:
        return not any(address in n for n in _BLOCKED4)
    return address in _GLOBAL6 and (any(address in n for n in _PUBLIC6) or not any(address in n for n in _BLOCKED6))


def _ipv4(host: str) -> str | None:
    """A numeric host in dotted form (parts may be octal, hexadecimal or missing); ValueError if it is none."""
    parts = host.rstrip(".").split(".") if host.endswith(".") else host.split(".")
    if not re.fullmatch(r"\d+|0x[0-9a-f]*", parts[-1]):
        return None
    numbers = [int(p[2:] or "0", 16) if p.startswith("0x") else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError(host)
    return str(ipaddress.IPv4Address(sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1])) + numbers[-1]))


def _host(raw: str) -> str:
    if raw.startswith("["):
        return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]"
    host = unquote_to_bytes(raw).decode("utf-8")
    host = host.lower() if host.isascii() else ".".join(p.encode("idna").decode() if p else "" for p in re.split("[.。]", host))
    if not host or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]", host):
        raise ValueError(raw)
    return _ipv4(host) or host


def _path(raw: str, base: list[str]) -> str:
    out = list(base)
    parts = raw.split("/")
    for i, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
        if plain in (".", ".."):
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/" + quote("/".join(out), safe=_SAFE)


def _decoded(path: str, passes: int, lower: bool) -> str | None:
    """Percent-decoded until it stays the same; null where that isn't UTF-8 or an escape is left."""
    for _ in range(passes):
        if re.search(r"%(?![0-9A-Fa-f]{2})", path):
            return None
        try:
            later = unquote_to_bytes(path).decode("utf-8")
        except UnicodeDecodeError:
            return None
        if later == path:
            return later.lower() if lower else later
        path = later
    return None if re.search(r"%[0-9A-Fa-f]{2}", path) else path.lower() if lower else path


def marks(host: str, path: str | None) -> int:
    """What the labels of a host, without brackets and a final dot, and the names (segments without parameters and
    extensions) and words of a decoded path say."""
    out = _HOSTS.get(host.removeprefix("www."), 0)
    if host.endswith((".localhost", ".local")):
        out |= LOCAL
    for label in host.split("."):
        out |= _LABELS.get(label, 0)
    if path is not None:
        for segment in re.split(r"[\\/]", path):
            out |= _NAMES.get(segment.partition(";")[0].rstrip(".").partition(".")[0], 0)
        for word in re.split("[^a-z0-9]+", path):
            out |= _WORDS.get(word, 0)
        if path.endswith(tuple(FILES)):
            out |= FILE
    return out


def parse_url(raw: str | None, base: str | None = None) -> dict | None:
    """The parts of a URL as browsers see them, resolved against a base; null if it can't be parsed or has no host."""
    if raw is None:
        return None
    text = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", text)
    parent = None
    if scheme is None or scheme[1].lower() in _SPECIAL and not re.match(r"[/\\]", text[scheme.end() :]) and base and base.lower().startswith(scheme[0].lower()):
        parent = parse_url(base) if base else None
        if parent is None:
            return None
        name, rest = parent["scheme"], text[scheme.end() :] if scheme else text
    else:
        name, rest = scheme[1].lower(), text[scheme.end() :]
    if name not in _SPECIAL:
        return {"href": text, "scheme": name, "host": "", "port": "", "path": "", "query": "", "fragment": "", "credentials": False, "decoded": None, "deep": None, "family": 0, "public": False, "marks": 0}
    rest, _, fragment = rest.partition("#")
    rest, mark, query = rest.partition("?")
    rest = rest.replace("\\", "/")
    try:
        if parent is not None and not rest.startswith("//"):
            host, port, credentials = parent["host"], parent["port"], parent["credentials"]
            own = parent["path"][1:].split("/")[:-1]
            path = parent["path"] if not rest else _path(rest.lstrip("/") if rest.startswith("/") and not rest.startswith("//") else rest, [] if rest.startswith("/") else own)
            if not rest and not mark:
                query, mark = parent["query"][1:], parent["query"][:1]
        else:
            authority, slash, path = rest.lstrip("/").partition("/")
            user, at, where = authority.rpartition("@")
            credentials = bool(at) and user != "" and user != ":"
            m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", where)
            if m is None or int(m[2] or 0) > 65535:
                return None
            host, port = _host(m[1]), "" if (m[2] or "").lstrip("0") == _SPECIAL[name] else str(int(m[2])) if m[2] else ""
            path = _path(path, [])
    except (ValueError, UnicodeError):
        return None
    query = "?" + quote(query, safe=_SAFE + "?`{}") if mark and query else ""
    fragment = "#" + quote(fragment, safe=_SAFE + "?{}") if fragment else ""
    bare = host[1:-1] if host.startswith("[") else host.removesuffix(".")
    try:
        address = ipaddress.ip_address(bare)
    except ValueError:
        address = None
    decoded = _decoded(path, 4, True)
    return {
        "href": f"{name}://{host}{':' + port if port else ''}{path}{query}{fragment}", "scheme": name, "host": host, "port": port, "path": path, "query": query, "fragment": fragment,
        "credentials": credentials, "decoded": decoded, "deep": _decoded(path, 8, False), "family": address.version if address else 0, "public": address is None or is_public(address),
        "marks": marks(host.strip("[]").removesuffix("."), decoded),
    }


@F.pandas_udf(URL_TYPE)
def _url(raw: pd.Series, base: pd.Series) -> pd.DataFrame:
    seen: dict = {}
    rows = []
    for key in zip(raw, base, strict=True):
        if key not in seen:
            seen[key] = parse_url(*key)
        rows.append(seen[key])
    return pd.DataFrame({k: pd.Series([None if r is None else r[k] for r in rows], dtype=object) for k in _FIELDS})


#: Not to be copied into every place that uses its result: each address is parsed once.
_url = _url.asNondeterministic()


def url(raw: Column, base: Column | None = None) -> Column:
    """The struct of a URL (href is null where it can't be parsed); all else below works on it."""
    return _url(raw, F.lit(None).cast("string") if base is None else base)


def host_of(u: Column) -> Column:
    """The host in lower case, without brackets and one final dot."""
    return F.regexp_replace(F.regexp_replace(u["host"], r"\A\[|\]\z", ""), r"\.\z", "")


def bare_host(u: Column) -> Column:
    return F.regexp_replace(host_of(u), r"\Awww\.", "")


def marked(u: Column, bits: int) -> Column:
    """Whether an address has one of the marks."""
    return F.coalesce(u["marks"].bitwiseAND(bits) != 0, F.lit(False))


def is_web(u: Column) -> Column:
    return F.coalesce(u["scheme"].isin("http", "https"), F.lit(False))


def is_safe(u: Column) -> Column:
    """A public web page that isn't for payment or private."""
    return F.coalesce(is_web(u) & ~u["credentials"] & u["public"] & u["decoded"].isNotNull() & ~marked(u, PAYMENT | PRIVATE | LOCAL), F.lit(False))


def safe_application(u: Column) -> Column:
    return F.when(is_safe(u), u["href"])


def is_aggregator(u: Column) -> Column:
    return marked(u, AGGREGATOR)


def query_pairs(u: Column) -> Column:
    return F.filter(F.split(F.substr(u["query"], F.lit(2)), "&"), lambda x: x != "")


def is_homepage(u: Column) -> Column:
    """A landing page without an event's id in its query."""
    path = F.coalesce(F.nullif(F.regexp_replace(u["decoded"], r"/+\z", ""), F.lit("")), F.lit("/"))
    landing = path.rlike(r"\A(?:/|/(?:home|main|index)(?:\.[a-z0-9]+)?|/(?:en|ko|kr))\z")
    named = F.exists(query_pairs(u), lambda x: F.lower(F.split_part(x, F.lit("="), F.lit(1))).isin(ID_KEYS) & (F.trim(F.try_url_decode(F.regexp_extract(x, "=(.*)", 1))) != ""))
    return F.when(u["decoded"].isNull(), True).otherwise(landing & ~F.coalesce(named, F.lit(False)))


def is_event_page(u: Column) -> Column:
    """Of an aggregator: whether the page is one event's."""
    routes = [f"(?:{'|'.join(map(re.escape, hosts))})\n{path}\n" + ("[^\n]*" if query is None else query) for hosts, path, query in EVENT_PAGES]
    parts = F.concat(bare_host(u), F.lit("\n"), u["decoded"], F.lit("\n"), u["query"])
    return marked(u, AGGREGATOR) & F.coalesce(parts.rlike(rf"\A(?:{'|'.join(routes)})\z"), F.lit(False))


def safe_event_application(u: Column) -> Column:
    return F.when(is_safe(u) & ~is_homepage(u) & (~is_aggregator(u) | is_event_page(u)), u["href"])


def is_registration(u: Column) -> Column:
    return marked(u, REGISTRATION)


def safe_official(u: Column) -> Column:
    return F.when(is_safe(u) & ~is_registration(u), u["href"])


def _without(query: Column, keys: list[str]) -> Column:
    """A query without some parameters; what is left keeps its order."""
    pairs = F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda x: (x != "") & ~F.split_part(x, F.lit("="), F.lit(1)).isin(keys))
    joined = F.array_join(pairs, "&")
    return F.when(F.coalesce(joined, F.lit("")) == "", "").otherwise(F.concat(F.lit("?"), joined))


def port_part(u: Column) -> Column:
    return F.when(u["port"] == "", "").otherwise(F.concat(F.lit(":"), u["port"]))


def canonical(u: Column) -> Column:
    """A web address without credentials, fragment, tracking parameters and final dots of the host; null if it is none."""
    host = F.regexp_replace(u["host"], r"\.+\z", "")
    return F.when(is_web(u) & ~u["credentials"], F.concat(u["scheme"], F.lit("://"), host, port_part(u), u["path"], _without(u["query"], TRACKING)))


def fetched(u: Column) -> Column:
    """The address by which pages are told apart: no fragment, host without final dots."""
    return F.concat(u["scheme"], F.lit("://"), F.regexp_replace(u["host"], r"\.+\z", ""), port_part(u), u["path"], u["query"])


def is_blocked_host(host: Column) -> Column:
    """Content networks and social sites. A social name counts anywhere in the host."""
    social = F.lit(False)
    for part in SOCIAL:
        social |= F.contains(host, F.lit(part))
    return host.startswith("cdn.") | F.contains(host, F.lit(".cdn.")) | host.startswith("static.") | host.startswith("assets.") | social


def is_within(host: Column, hosts: Column) -> Column:
    """Whether a host is one of the hosts or below one."""
    return F.exists(hosts, lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))


def is_allowed_link(u: Column, kind: Column, own_hosts: Column) -> Column:
    safe = F.when(kind == "application", safe_application(u)).otherwise(safe_official(u))
    host = F.regexp_replace(u["host"], r"\.+\z", "")
    return F.coalesce(safe.isNotNull() & ~is_blocked_host(host) & ~marked(u, FILE) & ~is_within(host, own_hosts), F.lit(False))


def destination(u: Column) -> Column:
    """struct(host, key) of where an event's identity URL leads; null for aggregators."""
    host = F.regexp_replace(F.regexp_replace(u["host"], r"\.\z", ""), r"\Awww\.", "")
    path = F.coalesce(F.nullif(F.regexp_replace(u["path"], r"/+\z", ""), F.lit("")), F.lit("/"))
    return F.when(~is_aggregator(u) & u["href"].isNotNull(), F.struct(host.alias("host"), F.concat(host, path, u["query"]).alias("key")))


def safe_logo(raw: Column, u: Column) -> Column:
    """An https image address without control characters, blocked names, or hosts that aren't public."""
    host = host_of(u)
    ok = (F.length(raw) <= 4096) & (raw == F.trim(raw)) & (raw != "") & ~raw.rlike(r"[\x00-\x1F\x7F]") & (u["scheme"] == "https") & ~u["credentials"]
    ok &= (host != "") & ~F.array_contains(F.split(host, r"\."), "") & u["public"] & u["decoded"].isNotNull() & ~marked(u, LOCAL | LOGO)
    return F.when(F.coalesce(ok, F.lit(False)), u["href"])


def safe_detail(raw: Column, u: Column, source: str) -> Column:
    """A source's own detail page; `u` is raw resolved against that source's base. Paths that decode to control
    characters, back-slashes, dot segments or sensitive names don't count."""
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), F.lit("\\"))
    clean = (raw == F.trim(raw)) & ~raw.rlike(r"[\x00-\x1F\x7F]") & ~F.contains(decoded, F.lit("\\")) & ~F.exists(F.split(F.regexp_extract(decoded, r"\A[^?#]*", 0), "/"), lambda s: s.isin(".", ".."))
    segments = F.split(F.lower(u["deep"]), "/")
    clean &= ~u["credentials"] & (u["fragment"] == "") & u["deep"].isNotNull() & ~u["deep"].rlike(r"[\x00-\x1F\x7F\\]") & ~F.arrays_overlap(segments, F.array(*map(F.lit, SENSITIVE))) & ~F.exists(segments, lambda s: s.endswith(".pdf"))
    route = F.lit(False)
    for base, pages in DETAIL_PAGES[source]:
        here = F.concat(u["scheme"], F.lit("://"), u["host"], port_part(u)) == base
        for path, query in pages:
            route |= here & u["deep"].rlike(rf"\A{path}\z") & u["query"].rlike(rf"\A{query}\z")
    return F.when(F.coalesce(clean & route, F.lit(False)), safe_application(u))


def resolve(u: Column, addresses: Column, official: Column) -> Column:
    """struct(kind, reason, url, host, address, family): whether a page may be fetched, and from which of its addresses
    (array of struct(address, family, public)); the first reason against it counts, and any address that isn't public."""
    host = host_of(u)
    safe = F.when(official, safe_official(u)).otherwise(safe_application(u))
    literal = u["family"] > 0
    reason = (
        F.when(u["href"].isNull(), "invalid-url")
        .when(~is_web(u), "unsupported-protocol")
        .when(u["credentials"], "credentials")
        .when(marked(u, LOCAL), "blocked-hostname")
        .when(literal & ~u["public"], "blocked-address")
        .when(~literal & (addresses.isNull() | (F.size(addresses) == 0)), "dns-failure")
        .when(~literal & F.exists(addresses, lambda a: ~a["public"]), "blocked-address")
        .when(safe.isNull(), "unsafe-public-url")
    )
    allowed = reason.isNull()
    first = F.get(addresses, F.lit(0))
    return F.struct(
        F.when(allowed, "allowed").otherwise("rejected").alias("kind"), reason.alias("reason"), F.when(allowed, safe).alias("url"), F.when(allowed, host).alias("host"),
        F.when(allowed, F.when(literal, host).otherwise(first["address"])).alias("address"), F.when(allowed, F.when(literal, u["family"]).otherwise(first["family"])).alias("family"),
    )


#: Reasons of the URL policy; other rejections are the fetch's.
POLICY_REASONS = ["invalid-url", "unsupported-protocol", "credentials", "blocked-hostname", "blocked-address", "unsafe-public-url", "dns-failure"]
FETCH_REASONS = ["too-many-redirects", "missing-redirect-location", "http-status", "unsupported-content-type", "body-too-large"]


def rejection_bucket(reason: Column) -> Column:
    return F.when(reason.isin(POLICY_REASONS), "policy").when(reason.isin(FETCH_REASONS), "fetch").otherwise(F.raise_error(F.concat(F.lit("unknown rejection: "), reason)))


def ipv4_value(c: Column) -> Column:
    """A dotted address as a number, or null."""
    parts = F.transform(F.split(c, r"\."), lambda x: F.when(x.rlike(r"\A\d{1,3}\z"), x.cast("bigint")))
    ok = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull() & (x <= 255))
    return F.when(F.coalesce(ok, F.lit(False)), F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s * 256 + x))


def is_public_ipv4(c: Column) -> Column:
    value, blocked = ipv4_value(c), F.lit(False)
    for n in _BLOCKED4:
        blocked |= value.between(int(n.network_address), int(n.broadcast_address))
    return F.coalesce(~blocked, F.lit(False))


@F.pandas_udf(T.BooleanType())
def is_public_address(c: pd.Series) -> pd.Series:
    """For addresses of either family; texts that are none aren't public."""

    def one(text: str | None) -> bool:
        try:
            return text is not None and is_public(ipaddress.ip_address(text))
        except ValueError:
            return False

    return c.map(one)
