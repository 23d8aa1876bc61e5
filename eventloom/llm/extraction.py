"""Main text of web pages: a host suffix array finds what its pages repeat.

A page is parsed once into blocks of text, each with a zone: the article, chrome (menus, headers, footers, sidebars,
notices, adverts, forms, comments) or open (none of both). The words of all blocks are concatenated, page by page (a
block's end ends a run), and the suffixes of a host's pages are bucketed by their first RUN words: a bucket with suffixes of
enough of the host's pages is a repeated run, and a longer repeat is a chain of such buckets, one suffix after the other.
Covered boilerplate goes: of open blocks, stretches of LONG words and whole repeated blocks; of a marked article, which may
well say what other pages say, stretches of LONG words that stand on half of the host's pages.

An article's suffixes are many, so of every LONG words only the suffix of least hash (the anchor) is counted first: a repeat
of LONG words has its anchors wherever it stands. All suffixes are counted only of the few blocks with an anchor that is
frequent enough.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import U64, mix, saved, seeds

#: Words of the shortest repeat that is looked for, and of the shortest that counts as boilerplate within a block.
RUN, LONG = 6, 20
#: A repeat stands on one of so many pages of its host at least (in articles: ARTICLE_ONE_OF), and on so many pages, or on
#: all of a smaller host's (articles of those are left alone).
ONE_OF, ARTICLE_ONE_OF, LEAST_PAGES = 10, 2, 5
#: Repeated runs up to which they are sent to every task.
FEW = 1_000_000
#: Pages whose blocks are held at once.
PAGES = 256

# Element names, and words of class, id and role, that tell what an element is.
CHROME = frozenset("nav footer aside form noscript template iframe button select dialog menu object audio video canvas svg head fieldset".split())
CHROME_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices
popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies respond share sharing social related
recommended newsletter subscribe subscription signup login search widget pagination pager toolbar contentinfo complementary""".split())
CHROME_STARTS = tuple("commentlist commentform advert sidebar cookie newsletter subscri breadcrumb sponsor footer navig navbar popup banner disqus".split())
#: What says so as a class name's last word, too: reader-comments, wp-block-ad.
LAST_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor promo banner cookie cookies consent gdpr notices alert legal disclaimer popup
modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reviews discussion discussions disqus replies newsletter widget
toolbar pagination pager""".split())
FIRST_WORDS = CHROME_WORDS | LAST_WORDS
#: Before such a word, what says that the element only has to do with it; after it, that it is without or only able to.
ABOUT, WITHOUT = frozenset("has no not non with without is hide show js category tag".split()), frozenset("free less open closed enabled disabled".split())
#: A reader's comment, and what else its class name may say: of articles these words count, whatever else they are.
COMMENT_WORDS, COMMENT_PARTS = frozenset("comment comments reply replies discussion disqus".split()), frozenset("div li item list thread body reader readers user single parent child content entry post text depth even odd byuser".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
MAIN_WORDS = frozenset("article content post entry story".split())
#: What says less than one in so many words of another candidate isn't the main text.
SHARE = 4
#: What a class name may say before the word that tells what the element is.
PLACES = MAIN_WORDS | frozenset("site page main global primary secondary top bottom left right blog".split())
BLOCKS = frozenset("""p div section article main header footer aside nav h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote
pre figure figcaption form fieldset details summary address hr body html head title dialog menu option select template noscript iframe""".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Elements that their next sibling, or a block in the case of p, closes.
SELF_CLOSING = frozenset("p li dt dd tr td th option thead tbody".split())

# Every alternative takes what it has begun to its end or the page's, so no place is read twice.
_VALUES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp)\b{_VALUES}(?:>.*?(?:</\1\s*>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_VALUES})(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")


def _names_chrome(name: str) -> bool:
    """Whether a class name as a whole says chrome: site-footer and related-posts do, has-sidebar and ad-free don't."""
    parts = _WORD.findall(name)
    while parts and parts[0] in PLACES:
        parts.pop(0)
    if not parts or parts[-1] in WITHOUT:
        return False
    return parts[0] in FIRST_WORDS or parts[0].startswith(CHROME_STARTS) or parts[-1] in LAST_WORDS and parts[0] not in ABOUT


def _names_comment(name: str) -> bool:
    """Whether a class name says a reader's comment and nothing else: comment-body and div-comment-12 do, comments-open doesn't."""
    parts = set(_WORD.findall(name))
    return not COMMENT_WORDS.isdisjoint(parts) and parts <= COMMENT_WORDS | COMMENT_PARTS


ARTICLE, OPEN, NONE = 0, 1, 2
HARD, SOFT, RESET = 1, 2, 3
#: Forms may well wrap a whole page.
FORMS = frozenset(("form", "fieldset"))


@functools.lru_cache(4096)
def _kind(name: str, attributes: str) -> tuple[int, bool, int]:
    """Whether an element is chrome anywhere (SOFT: unless it holds the page's only main element, RESET: unless it is that), whether outside articles, and its rank as the place of the main text (0: none)."""
    words, names, hidden, role = set(), [], False, ""
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                words.update(_WORD.findall(value))
                names += value.split()
            elif key == "role":
                role = value
                words.update(_WORD.findall(value))
                names.append(value)
            elif key == "style":
                hidden |= "display:none" in value.replace(" ", "")
            else:
                hidden |= key == "hidden" or value == "true"
    # the page itself and its main elements are what they are, whatever their classes say
    whole = name in ("html", "body", "main", "article") or role in ("main", "article") or any((w := _WORD.findall(n)) and MAIN_WORDS.issuperset(w) for n in names)
    comment = name not in ("html", "body", "main") and any(map(_names_comment, names))
    chrome = HARD if hidden or name in CHROME and name not in FORMS else SOFT if name in FORMS or comment or not whole and any(map(_names_chrome, names)) else 0
    # an article that is nothing but a teaser or an advert by its classes
    if not chrome and name == "article" and any(map(_names_chrome, names)) and not any((w := _WORD.findall(n)) and MAIN_WORDS.issuperset(w) for n in names):
        chrome = RESET
    head = name == "header" or not whole and bool(words & HEAD_WORDS)
    main = 3 if name == "article" or role == "article" else 2 if name == "main" or role == "main" else 1 if name in ("div", "section", "td") and words & MAIN_WORDS else 0
    return chrome, head, main


#: Where a block is: whether in a main element; the outermost article around it and the article next to that (0: none), by
#: number; whether in an element named as content.
NOWHERE = (False, 0, 0, False)


def parse(source: str) -> list[tuple[str, tuple[bool, int, int, bool], int]]:
    """(text, where it is, whether it is chrome: HARD, SOFT, or RESET in a main element within soft chrome) of each block, in order."""
    blocks: list[tuple[str, tuple[bool, int, int, bool], int]] = []
    held: list[str] = []
    stack: list[tuple[str, tuple[bool, int, int, bool], int]] = []  # name, place, chrome
    opened: dict[str, int] = {}  # how many of a name are on the stack
    place, chrome, articles = NOWHERE, 0, 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                blocks.append((text, place, chrome))
            held.clear()

    def pop_to(depth: int) -> None:
        nonlocal place, chrome
        for element in stack[depth:]:
            opened[element[0]] -= 1
        del stack[depth:]
        place, chrome = (stack[-1][1], stack[-1][2]) if stack else (NOWHERE, 0)

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1] and m[1].lower() in ("textarea", "title"):
                flush()
            continue
        name = name.lower()
        if name in VOID:
            if name == "hr":
                flush()
            else:
                held.append(" " if name == "br" else "")
            continue
        if name in BLOCKS:
            flush()
        elif name in ("td", "th"):
            held.append(" ")
        if m[2]:
            for depth in () if not opened.get(name) else range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name in BLOCKS or not any(s[0] in BLOCKS and s[0] not in SELF_CLOSING for s in stack[depth + 1 :]):
                        if stack[depth][2] != chrome:
                            flush()
                        pop_to(depth)
                    break
            continue
        if stack and (name in SELF_CLOSING and stack[-1][0] == name or name in BLOCKS and stack[-1][0] == "p"):
            pop_to(len(stack) - 1)
        own, head, main = _kind(name, m[4])
        new_chrome = HARD if HARD in (chrome, own) else SOFT if own == SOFT else RESET if own == RESET or chrome and main >= 2 else chrome
        new_place = place
        if main and new_chrome not in (HARD, SOFT):
            articles += main == 3
            inside, outer, inner, named = place
            new_place = (inside or main == 2, outer or (articles if main == 3 else 0), inner or (articles if main == 3 and outer else 0), named or main == 1)
        if head and new_place == NOWHERE and not new_chrome:
            new_chrome = SOFT
        if new_chrome != chrome:
            flush()
        if m[4].endswith("/") and name not in BLOCKS:
            continue
        if name in BLOCKS or new_place != place or new_chrome != chrome:
            stack.append((name, new_place, new_chrome))
            opened[name] = opened.get(name, 0) + 1
            place, chrome = new_place, new_chrome
    if at < len(source):
        held.append(source[at:])
    flush()
    return blocks


def _chosen(blocks: list[tuple[int, tuple[bool, int, int, bool]]]) -> list[bool]:
    """Which of the blocks (words, place) are the main text, by the words that each candidate holds.

    A main element goes before articles outside it, and these before elements named as content, unless the latter hold over
    SHARE times its words. In a main element its articles are the text if its own words are less than one in SHARE of
    theirs, and teasers if its own words are as many; else it is the text as a whole. An article in an article goes with
    it only if it is the longer one, as comments and related pages are not."""
    size = [0, 0, 0]  # in a main element; of the longest article outside; elsewhere in elements named as content
    inside, own, inner = 0, {}, {}
    for n, (main, article, second, named) in blocks:
        if main:
            size[0] += n
            inside += n * (article > 0)
        elif not article:
            size[2] += n * named
        if article:
            of, key = (inner, second) if second else (own, (main, article))
            of[key] = of.get(key, 0) + n
    size[1] = max([0, *(n for (main, _), n in own.items() if not main), *(inner[k] for n, (main, a, k, _) in blocks if k and not main)])
    if not any(size):
        return [False] * len(blocks)
    best = next(i for i in range(3) if size[i] and SHARE * size[i] >= max(size[i:]))
    rest = size[0] - inside
    out = []
    for _, (main, article, second, named) in blocks:
        if best == 0:
            ok = main and (rest < inside if article else not SHARE * rest < inside)
        else:
            ok = not main and (article > 0 or best == 2 and named) and (best == 1 or named)
        out.append(ok and not (second and inner[second] <= own.get((main, article), 0)))
    return out


def zones(source: str) -> list[tuple[str, int]]:
    """(text, zone) of each block: with an element of the main text, its blocks are the article; without, all but chrome
    are open. A main element within soft chrome counts only if there is none elsewhere."""
    found = parse(source)
    if all(place == NOWHERE for _, place, chrome in found if not chrome):
        found = [(text, place, 0 if chrome == RESET else chrome) for text, place, chrome in found]
    live = [(len(text.split()), place) for text, place, chrome in found if not chrome]
    chosen = _chosen(live)
    marked, each = any(chosen), iter(chosen)
    return [(text, NONE if chrome else ARTICLE if next(each) else NONE if marked else OPEN) for text, _, chrome in found]


_STEP = seeds(RUN, 29) | U64(1)


def runs(blocks: list[list[str]]) -> list[np.ndarray]:
    """Of each block of words, the hash of the RUN words from each on; a shorter block is one run."""
    words = [w.encode() for b in blocks for w in b]
    h = mix(np.array([zlib.crc32(w) << 32 | zlib.adler32(w) for w in words], U64)) if words else np.zeros(0, U64)
    out, at = [], 0
    for b in blocks:
        own = h[at : at + len(b)]
        at += len(b)
        n = max(len(b) - RUN + 1, 1)
        total = np.full(n, U64(min(len(b), RUN)))
        for j in range(min(len(b), RUN)):
            total += own[j : j + n] * _STEP[j]
        out.append(mix(total).view(np.int64))
    return out


def anchors(own: np.ndarray) -> np.ndarray:
    """Of a block's runs: the least of each LONG - RUN + 1 in a row, which a window of LONG words holds; none of a shorter block."""
    wide, width = LONG - RUN + 1, 1
    if len(own) < wide:
        return own[:0]
    least = own.copy()
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    step = wide - width
    return np.unique(np.minimum(least[:-step], least[step:]) if step else least)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _unique(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


_ROWS = "row long, host long, page long, article boolean, blocks array<string>, runs array<long>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their article's blocks, or their open ones; `runs` are the anchors of an article, or all runs of open blocks
    and chrome."""
    for whole in batches:
        for lo in range(0, whole.num_rows, PAGES):
            batch = whole.slice(lo, PAGES)
            hosts, pages, marked, texts, suffixes = [], [], [], [], []
            for x, host in zip(batch.column("html"), batch.column("host").to_pylist(), strict=True):
                found = zones(x.as_py() or "")
                article = any(z == ARTICLE for _, z in found)
                blocks = [t for t, z in found if z == (ARTICLE if article else OPEN)]
                if article:
                    own = [anchors(r) for r in runs([t.split() for t in blocks])]
                else:
                    own = runs([t.split() for t, _ in found])
                hosts.append(_hash(host))
                pages.append(_hash("\n".join(blocks)))
                marked.append(article)
                texts.append(blocks)
                suffixes.append(_unique(own))
            columns = [pa.array(hosts, pa.int64()), pa.array(pages, pa.int64()), pa.array(marked), pa.array(texts, pa.list_(pa.string())), pa.array(suffixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("page_id", "url", "row")), *columns], ["page_id", "url", "row", "host", "page", "article", "blocks", "runs"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of the blocks of articles that have one of the anchors `repeated`."""
    for batch in batches:
        out = []
        for blocks, hot in zip(batch.column("blocks").to_pylist(), batch.column("repeated").to_pylist(), strict=True):
            each = runs([b.split() for b in blocks])
            out.append(_unique([r for r in each if np.isin(anchors(r), hot).any()]))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "host", "page")), pa.array(out, pa.list_(pa.int64()))], ["row", "host", "page", "runs"])


def covered(words: list[str], own: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Which words of a block its repeated runs cover."""
    mark = np.zeros(len(words) + RUN + 1, np.int64)
    hit = np.flatnonzero(np.isin(own, repeated))
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + min(RUN, len(words)), -1)
    return np.cumsum(mark)[: len(words)] > 0


def unique_text(blocks: list[str], repeated: np.ndarray, article: bool = False) -> str:
    """Blocks without their boilerplate; what is left of a block is joined. Boilerplate are stretches of LONG words that
    repeated runs cover, and outside articles wholly covered blocks: of RUN words, or shorter ones between two that are
    covered too."""
    if not len(repeated):
        return "\n".join(blocks)
    each, kept = [b.split() for b in blocks], []
    marks = [covered(words, own, repeated) for words, own in zip(each, runs(each), strict=True)]
    full = [not article and bool(mark.all()) for mark in marks]
    for i, (words, mark) in enumerate(zip(each, marks, strict=True)):
        if full[i]:
            drop = np.full(len(words), len(words) >= RUN or len(full) > 1 and all(full[max(i - 1, 0) : i + 2]))
        else:
            drop = np.zeros(len(words), bool)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
            for lo, hi in zip(edges[::2], edges[1::2], strict=True):
                drop[lo:hi] = hi - lo >= LONG
        if left := [w for w, gone in zip(words, drop, strict=True) if not gone]:
            kept.append(" ".join(left))
    return "\n".join(kept)


def _unique_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in ("blocks", "repeated", "article"))
        texts = [unique_text(b, np.array(r or [], np.int64), article) for b, r, article in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _repeated(rows: DataFrame, sizes: DataFrame, enough: Column) -> DataFrame:
    """(row, repeated): of rows (row, host, page, runs), the runs that stand on enough pages of the host; rows without any
    are left out. Pages are counted by their text, partially before the shuffle."""
    each = rows.select("host", "page", F.explode("runs").alias("run")).groupBy("host", "run").agg(F.count_distinct("page").alias("c"))
    found = saved(each.where("c > 1").join(sizes, "host").where(F.col("c") >= enough).select("host", "run"))
    found = F.broadcast(found) if found.count() <= FEW else found
    return rows.select("row", "host", F.explode("runs").alias("run")).join(found, ["host", "run"], "left_semi").groupBy("row").agg(F.collect_set("run").alias("repeated"))


def _few(found: DataFrame) -> DataFrame:
    """A table of (row, repeated), to be sent to every task where it is small."""
    found = saved(found)
    runs_ = found.agg(F.sum(F.size("repeated"))).first()[0] or 0
    return F.broadcast(found) if runs_ <= FEW else found


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html).

    Null or empty html, and pages without main text, have the empty text. Rows stand for themselves, whatever their
    page_id; rows of equal text, whatever their urls, are one page of their host. A null url is a host of its
    own. An empty table gives no rows. A page of any length, however its quotes and elements are closed, is read in one pass.
    """
    kinds = [f"{k} {pages.schema[k].dataType.simpleString()}" for k in ("page_id", "url")]
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", F.monotonically_increasing_id().alias("row"), host.alias("host"), "html")
    rows = saved(rows.mapInArrow(_parsed, ", ".join([*kinds, _ROWS])), "zstd")
    # hosts of several pages of different text; others repeat nothing
    sizes = saved(rows.where("size(blocks) > 0").groupBy("host").agg(F.count_distinct("page").alias("n")).where("n > 1"))
    share = lambda one_of: F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("n") / one_of))
    articles = rows.where("article")
    hot = _few(_repeated(articles, sizes, share(ARTICLE_ONE_OF)))
    suffixes = saved(articles.select("row", "host", "page", "blocks").join(hot, "row").mapInArrow(_suffixes, "row long, host long, page long, runs array<long>"))
    inside = _repeated(suffixes, sizes, share(ARTICLE_ONE_OF))
    # of pages without an article all runs count, chrome's too; those of articles' pages don't stand in open blocks
    outside = _repeated(rows.where("not article"), sizes, F.greatest(F.lit(2), F.least("n", share(ONE_OF))))
    found = _few(inside.unionByName(outside))
    texts = rows.join(found, "row", "left").select("page_id", "url", "blocks", "repeated", "article").mapInArrow(_unique_texts, ", ".join([*kinds, "text string"]))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
