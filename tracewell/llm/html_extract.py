"""Main text of web pages: a suffix array over each host's token streams, with page structure as its guard.

Each page is cut into blocks once.  Structure tells of a block that it is certainly *article* (inside <article>, <main>
or what says it is the body of one), certainly *furniture* (navigation, headers, footers, sidebars, forms, adverts,
notices, comments and the like, by element, role, or class and id names that say nothing else), or *open*: any other
block of a page without an article, and blocks inside articles whose class or id only has a part like that (`ad-hoc`,
`related-work`) or says something else that may be furniture (`share`, `social`, `related`).  A form is furniture, unless it holds most of a page's text.  A class or id alone never makes html,
body or the outermost <article> or <main> furniture; an article inside an element that is furniture by class or id
alone counts if the page has no other.

A page's stream is its tokens but for those that are certainly article.  The streams of a host's pages are put one after
another, and a suffix array sorted by the first LONG tokens finds the substrings of at least LONG tokens and the pages
that they are on.  Tasks do so for the pages they have at hand; what they found is counted over the whole host by
the substrings' hashes, so results don't depend on how pages are dealt out, and no page's text is.  Substrings on PAGES
distinct pages are the host's boilerplate.  Of an open block that they cover by half or more only the unique runs stay.

Certain articles are not cut, whatever their host repeats: passages that documents share are still their text.  By the
suffix array alone they would go, and adverts and footers that no other page has would stay.

Texts: character references are decoded, white space inside a block is one space, blocks are joined by a line feed.
Hidden elements are text like any other.  Cases: null or empty html has the empty text.  Broken markup: an unended tag
at the end is dropped, an element that is never closed lasts to the end.  Equal pages of a host count as one; pages with
other articles and the same surroundings don't.  Pages whose url is null or broken are one host.  Rows of one page_id are
each a page; a page_id that is no number is null.  An empty table gives an empty result.  Extra columns are passed over.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import counted, cut, salted, slot_filter, slot_split
from tracewell.llm.neardup import _K2, _K3, _mix, _WordHashes

LONG, PAGES = 8, 3
#: Tokens that a task holds before it builds their suffix arrays.
HELD = 200_000
#: Elements that end a block, have no end, hold no markup, or are not the article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes template".split())
FURNITURE = frozenset("aside button canvas dialog footer head iframe input menu nav noembed noframes noscript object script select style svg template textarea title xmp".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pagination popup promo promotion promoted related respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Of these, what doesn't name a menu, header, footer, sidebar, notice, advert, form or comments: inside an article such a
#: word alone is no reason to drop anything.
UNSURE = frozenset("promoted related respond share sharing social widget".split())
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+>|</>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[a-zA-Z/][^>]*+\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[\s_\-:]+")
#: Beginnings and ends of names that tell of a state: `no-sidebar`, `comments-open`.
STATES, ENDS = frozenset("no has with without".split()), frozenset("open closed enabled disabled".split())
#: Parts of names that leave the meaning of the others as it is.
NEUTRAL = frozenset("area articles block body bottom box btn button buttons col container content fixed form group header icons inner item items layout left link links list main module outer page panel post posts right row section site slot text title top unit view widget wrap wrapper".split())
#: Inside blocks_of only: furniture by a class or id alone, an explicit article inside that, what forms hold, and
#: what is open inside an article.
ARTICLE, FURNISHED, OPEN, MARKED, TAKEN, FORMED, OPEN_WITHIN = range(7)


def _marks(names: str) -> tuple[bool, bool, bool, bool, bool]:
    """Of class and id names: whether a whole one is a word of furniture, whether one is such a word and neutral parts,
    whether the word of one of these isn't unsure, whether one has such a part beside others, and whether one speaks of a
    header."""
    whole = part = named = doubtful = header = False
    for name in names.lower().split():
        parts = [x for x in _PARTS.split(name) if x and not x.isdigit()]
        if not parts or len(parts) > 1 and (parts[0] in STATES or parts[-1] in ENDS):
            continue
        header = header or "header" in parts
        if not WORDS.isdisjoint(parts):
            sure = all(x in WORDS or x in NEUTRAL for x in parts)
            whole, part, doubtful = whole or name in WORDS, part or sure, doubtful or not sure
            named = named or sure and any(x in WORDS and x not in UNSURE for x in parts)
    return whole, part, named, doubtful, header


def _kind(name: str, attributes: str, inside: int) -> int:
    """Kind of what an element holds, given the kind around it."""
    if inside == FURNISHED or name in FURNITURE:
        return FURNISHED
    a = {}
    if attributes and "=" in attributes:
        a = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    role = a.get("role", "").lower()
    whole, part, named, doubtful, header = _marks(f"{a.get('class', '')} {a.get('id', '')}") if "class" in a or "id" in a else (False,) * 5
    if role in ROLES:
        return FURNISHED
    around, within = inside in (OPEN, MARKED, FORMED), inside in (ARTICLE, TAKEN)
    if name == "form":
        return FORMED if inside in (OPEN, FORMED) else FURNISHED
    if name in ("article", "main") or role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody":
        if whole and not around:  # as a comment within an article
            return FURNISHED if named else OPEN_WITHIN
        return ARTICLE if inside in (OPEN, FORMED, ARTICLE) else TAKEN if inside in (MARKED, TAKEN) else inside
    if part and name not in ("html", "body"):
        return MARKED if around else FURNISHED if named else OPEN_WITHIN if within else inside
    if doubtful and within:
        return OPEN_WITHIN
    if around and name == "header":
        return FURNISHED
    if inside in (OPEN, FORMED) and header and name not in ("html", "body"):
        return MARKED
    return inside


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order; kinds are ARTICLE, FURNISHED and OPEN."""
    page = page or ""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    where: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by name, so no tag walks it
    kind, at = OPEN, 0

    def end_block():
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((kind, text))
            parts.clear()

    def close(name: str, until: tuple[str, ...] = ()) -> None:
        nonlocal kind
        if not where[name]:
            return
        i = where[name][-1]
        if any(where[u] and where[u][-1] > i for u in until):
            return
        gone = stack[i:]
        if any(n in BLOCKS for n, _ in gone) or (stack[i - 1][1] if i else OPEN) != kind:
            end_block()
        del stack[i:]
        for n, _ in gone:
            where[n].pop()
        kind = stack[-1][1] if stack else OPEN

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCKS:
                end_block()
            close(name)
            if name == "br":
                parts.append(" ")
            continue
        attributes = m[3] or m[6] or ""
        if name in BLOCKS:
            end_block()
            close("p", ("button", "table", "td", "th", "article", "aside", "body", "html"))
            if name == "li":
                close("li", ("ul", "ol", "menu"))
            elif name in ("dd", "dt"):
                close("dd", ("dl",))
                close("dt", ("dl",))
            elif name in ("td", "th", "tr"):
                for n in ("td", "th") if name != "tr" else ("tr",):
                    close(n, ("table",))
            elif name == "body":
                close("head")
        elif name == "br":
            parts.append(" ")
        if name in VOID or (name == "path" or attributes.endswith("/") and name not in BLOCKS and name not in RAW):
            continue
        inner = _kind(name, attributes, kind)
        if inner != kind:
            end_block()
        where[name].append(len(stack))
        stack.append((name, inner))
        kind = inner
        if name in RAW:
            m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if m is None:
                break
            at = m.start()
    end_block()
    kinds = {k for k, _ in out}
    has = bool(kinds & {ARTICLE, TAKEN, OPEN_WITHIN})
    words = {kind: sum(t.count(" ") + 1 for k, t in out if k == kind) for kind in kinds & {OPEN, FORMED}}
    final = {
        ARTICLE: ARTICLE, FURNISHED: FURNISHED, MARKED: FURNISHED, OPEN_WITHIN: OPEN, OPEN: FURNISHED if has else OPEN, TAKEN: FURNISHED if ARTICLE in kinds else ARTICLE,
        FORMED: OPEN if not has and words.get(FORMED, 0) > words.get(OPEN, 0) else FURNISHED,
    }
    return [(final[k], t) for k, t in out]


def word_hashes(text: str, hashes: dict) -> list[int]:
    return [hashes[w.encode("utf-8", "surrogatepass")] for w in text.split(" ")]


def gram_hashes(words: np.ndarray, long: int = LONG) -> np.ndarray:
    """Hashes of the substrings of `long` words (given by their hashes), by place."""
    n = len(words) - long + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.full(n, long, np.uint64)
    for i in range(long):
        h = _mix(h * _K2 + words[i : n + i] * _K3)
    return h.view(np.int64)


def suffix_array(text: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text in the order of their next `long` symbols, and each place's rank in that order."""
    n = len(text)
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while k < long:
        step = min(k, long - k)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
        k += step
    return np.argsort(rank, kind="stable"), rank


def substrings(streams: list[np.ndarray], long: int = LONG, most: int = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """(hash, stream) for each substring of `long` tokens of a host's streams: streams that it is in, `most` at most."""
    use = [i for i, s in enumerate(streams) if len(s) >= long]
    if not use:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.concatenate([np.append(streams[i], np.uint64(0)) for i in use])
    owner = np.repeat(use, [len(streams[i]) + 1 for i in use])
    sign = np.concatenate([np.append(np.zeros(len(streams[i]), np.int64), i + 1) for i in use])  # each stream ends with a sign of its own
    left = np.concatenate([np.append(np.arange(len(streams[i]), 0, -1), 0) for i in use])
    numbers = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, rank = suffix_array(np.where(sign > 0, -sign, numbers), long)
    order = order[left[order] >= long]
    rank, owner = rank[order], owner[order]
    new = np.append(True, (np.diff(rank) != 0) | (np.diff(owner) != 0))  # a stream's places of a substring lie together
    order, rank, owner = order[new], rank[new], owner[new]
    first = np.flatnonzero(np.append(True, np.diff(rank) != 0))
    nth = np.arange(len(rank)) - np.repeat(first, np.diff(np.append(first, len(rank))))
    kept = nth < most
    return gram_hashes(text, long)[order[kept]], owner[kept]


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site) of pages with an open block, once a batch."""
    for batch in batches:
        found = {site for site, html in zip(batch.column("site").to_pylist(), batch.column("html"), strict=True) if any(k == OPEN for k, _ in blocks_of(html.as_py()))}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["site"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, gram, page, asks): substrings of the streams of a task's pages, and pages that they are on; all those of
    pages with an open block (asks), PAGES pages of others, as more count no further."""
    hashes, sites, held = _WordHashes(), {}, 0

    def rows():
        for site, pages in sites.items():
            streams, keys = [x[0] for x in pages.values()], np.fromiter(pages, np.int64, len(pages))
            gram, at = substrings(streams)
            asking = [i for i, x in enumerate(pages.values()) if x[1]]
            own = [np.unique(gram_hashes(streams[i])) for i in asking]
            grams, on = np.concatenate([gram, *own]), np.concatenate([keys[at], *(np.full(len(g), keys[i]) for g, i in zip(own, asking, strict=True))])
            asks = np.arange(len(grams)) >= len(gram)
            for start in range(0, len(grams), 10_000):
                part = slice(start, start + 10_000)
                n = len(grams[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, site)), pa.array(grams[part]), pa.array(on[part]), pa.array(asks[part])], names=["site", "gram", "page", "asks"])

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for site, page, html in zip(*(batch.slice(start, 256).column(c).to_pylist() for c in ("site", "page", "html")), strict=True):
                pages = sites.setdefault(site, {})
                if page in pages:
                    continue
                found = blocks_of(html)
                stream = np.array([h for k, t in found if k != ARTICLE for h in word_hashes(t, hashes)], np.uint64)
                pages[page] = (stream, any(k == OPEN for k, _ in found))
                held += len(stream) + 8
                if held > HELD:
                    yield from rows()
                    sites.clear()
                    held = 0
    yield from rows()


def unique_runs(words: list[str], hit: np.ndarray) -> str:
    """An open block without what its host repeats."""
    if not len(words) or hit.mean() < 0.5:
        return " ".join(words)
    return " ".join(w for w, h in zip(words, hit.tolist(), strict=True) if not h)


def text_of(page: str | None, often: np.ndarray, hashes: dict) -> str:
    """The main text of a page, given the hashes of its host's boilerplate (those that the page has)."""
    found = blocks_of(page)
    if not len(often):
        return "\n".join(t for k, t in found if k != FURNISHED)
    rest = [t.split(" ") for k, t in found if k != ARTICLE]
    stream = np.array([hashes[w.encode("utf-8", "surrogatepass")] for words in rest for w in words], np.uint64)
    starts = np.flatnonzero(np.isin(gram_hashes(stream), often))
    change = np.zeros(len(stream) + LONG + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + LONG, -1)
    hit, at, kept, words_of = np.cumsum(change)[: len(stream)] > 0, 0, [], iter(rest)
    for kind, block in found:
        if kind == ARTICLE:
            kept.append(block)
            continue
        words = next(words_of)
        if kind == OPEN and (left := unique_runs(words, hit[at : at + len(words)])):
            kept.append(left)
        at += len(words)
    return "\n".join(kept)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [text_of(html, np.array(grams or (), np.int64), hashes) for html, grams in zip(part.column("html").to_pylist(), part.column("grams").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def boilerplate(seen: DataFrame) -> DataFrame:
    """(site, gram): a host's substrings that are on PAGES distinct pages."""
    return seen.select("site", "gram", "page").distinct().groupBy("site", "gram").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= PAGES).select("site", "gram")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text), a row for each row of pages."""
    base = pages.select(F.col("page_id").try_cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    base = base.withColumns({"page": F.xxhash64("html"), "site": F.xxhash64(F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit("")))})
    none = F.lit(None).cast("array<long>").alias("grams")
    sites, (asked,) = counted(base.select("site", "html").mapInArrow(_asking, "site long").distinct())
    if not asked:
        ready = base.select("page_id", "url", "html", none)
    else:
        # pages of the hosts that have an open block give their substrings; of these, pages with one are dealt out, to
        # meet what they have of their host's boilerplate
        host = slot_filter(base.select("site", "page", "html"), F.col("site"), sites, F.col("site"))
        seen = cut(host.mapInArrow(_grams, "site long, gram long, page long, asks boolean"))
        asking = seen.where("asks").select("site", "gram", "page").distinct()
        often = cut(salted(asking, boilerplate(seen), ["site", "gram"], F.col("page")).groupBy("site", "page").agg(F.collect_list("gram").alias("grams")))
        some, others = slot_split(base, F.col("page"), often, F.col("page"))
        met = salted(some, often, ["site", "page"], F.coalesce("page_id", F.lit(0)), "left")
        ready = met.select("page_id", "url", "html", "grams").unionByName(others.select("page_id", "url", "html", none))
    return ready.mapInArrow(_texts, "page_id long, url string, text string")


def op6(spark, sf_dir: str) -> DataFrame:
    """Whole `pages`."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
