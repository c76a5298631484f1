"""Main text of web pages: page structure, and suffix arrays over each host's pages where structure says nothing.

A page with an ``article`` (or else ``main``) keeps the text of that, less the menus, headers, footers, sidebars, notices,
adverts, forms and reader comments in it.  A page without one is a stream of blocks.  The runs of ``RUN`` words or more that stand
in two pages of the host or more go, and unique runs stay.  The streams of a host of up to ``TASK_PAGES`` pages are
concatenated, and a suffix array over their words finds the runs; those of a larger host, which no task could hold, meet
by the hash of every window of ``RUN`` words, with the same result.  Pages of the first kind never leave their task.

What isn't the article's is known by its element, or by a class, id or role all of whose words say so (``NOT_TEXT``, with
``NEUTRAL`` ones; ``ALWAYS`` whatever is beside them): ``related-posts`` goes, ``related-work`` stays.  Attributes are parsed, so that no other attribute's name
or value counts.  Blocks are joined in page order by a newline, white space (as Unicode has it) in a block is one space, ``br`` is white
space.  Null or empty pages, and pages without words, have empty text.  Repeated rows stay rows; with suffix arrays, rows
of the same page id count as one page.  Pages without a host count as one host.  A page of any length is parsed once, in
one pass.  No columns but the id, the url and the html are read.  An empty table gives no rows.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pepspark.llm.common import map_arrow, ngram_hashes, staged, table

RUN = 8
TASK_PAGES = 256

#: Elements by what they mean for the text, and words in class, id or role of what isn't the article's.
RAW = "script style noscript template textarea title svg iframe object select option canvas audio video".split()
APART = {"nav", "aside", "form", "footer", "dialog", "menu", "head", "header"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = set(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace semantics".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are text: where their ids point to is no part apart from the article.
TEXT = HEADINGS | {"p", "li", "blockquote", "pre", "figure", "figcaption", "td", "th", "dd", "dt"}
NOT_TEXT = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social sidebar widget related recommended recommendations comment comments disqus replies "
    "reply respond nav navbar navigation menu breadcrumb breadcrumbs footer contentinfo complementary header masthead toolbar pagination pager search dialog skip".split()
)
#: Those that say so whatever words they stand beside.
ALWAYS = set("ads advert adverts advertisement advertising adsense cookie cookies gdpr newsletter sidebar disqus navbar breadcrumb breadcrumbs pagination".split())
#: Words that stand beside the others in the names of such parts and say nothing of their own.
NEUTRAL = set(
    "area article bar blog block body bottom box btn button buttons card container content desktop entry fixed form global google group icons inner item items js left link "
    "links list main mobile native outer page panel post posts right section site slot sticky stories story text thread top unit wrap wrapper".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rawattrs>[^>]*)>(?:.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^<>]*>?",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?|["'][^"']*["']?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
_OWN_HEADER = re.compile(r"(?:^|\s)(?:article|entry|post|story|content|page)[_-]*(?:header|heading)(?=$|\s)", re.I)

KEPT, HEADINGS_ONLY, GONE = 0, 1, 2


def attributes(text: str) -> dict[str, str]:
    """An element's attributes by lower-case name; the first of equal names, as browsers take it."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        if m[1]:
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def names_apart(value: str) -> bool:
    """Whether a class, id or role has a name made of words for what isn't the article's, with neutral ones at most beside."""
    for name in value.split():
        words = [w.lower() for w in _PARTS.split(name) if w and not w[0].isdigit()]
        if ALWAYS.intersection(words) or NOT_TEXT.intersection(words) and NOT_TEXT.union(NEUTRAL).issuperset(words):
            return True
    return False


def _standing(tag: str, attrs: str, inside: int, article: bool) -> int:
    """What the text of an element is to the article, given what its parent's is."""
    if inside == GONE or tag in APART and not (tag == "header" and article):
        return GONE
    if tag == "header":
        return HEADINGS_ONLY
    if not attrs or tag in ("html", "body"):
        return inside
    own = attributes(attrs)
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(own.get("style", "")):
        return GONE
    if _OWN_HEADER.search(own.get("class", "")):
        return HEADINGS_ONLY if article else inside
    for name in ("class", "id", "role"):
        # the id of a paragraph or heading is the target of a link, not what it is
        if name in own and not (tag in TEXT and name == "id") and not (tag in HEADINGS and name == "class") and names_apart(own[name]):
            return GONE
    return inside


def blocks(page: str) -> tuple[str, list[str]]:
    """("article" | "main" | "page", texts): the blocks of the page's articles, or of its main parts, or all of them."""
    found: dict[str, list[str]] = {"article": [], "main": [], "page": []}
    seen = {"page"}
    stack: list[list] = [["", KEPT, "page", 0]]  # tag, standing, region, where in ``parts`` a dropped inline element began
    parts: list[str] = []
    heading = False

    def close() -> None:
        top = stack[-1]
        if top[0] in INLINE:  # the block's text before the element, by the standing of what it is in
            del parts[top[3] :]
            top[3] = 0
            top = next(x for x in reversed(stack) if x[0] not in INLINE)
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text and (top[1] == KEPT or top[1] == HEADINGS_ONLY and heading):
            found[top[2]].append(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif m["end"]:
                if stack[-1][0] == tag:
                    del parts[stack.pop()[3] :]
            elif tag not in VOID and (stack[-1][0] == tag or m["attrs"] and _standing(tag, m["attrs"], KEPT, True) == GONE):
                stack.append([tag, GONE, stack[-1][2], len(parts)])
            continue
        close()
        if tag in HEADINGS:
            heading = not m["end"]
        if tag in VOID:
            continue
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack[-1][0] == "p" or stack[-1][0] == tag == "li" or stack[-1][0] in HEADINGS:
            stack.pop()
        _, standing, region, _ = stack[-1]
        standing = _standing(tag, m["attrs"] or "", standing, region != "page")
        if standing != GONE and (tag == "article" or tag == "main" and region == "page" or region == "page" and attributes(m["attrs"] or "").get("role", "").lower() == "main"):
            region = "article" if tag == "article" else "main"
            seen.add(region)
        stack.append([tag, standing, region, 0])
    parts.append(page[at:])
    close()
    for region in ("article", "main", "page"):
        if region in seen and (found[region] or region == "page"):
            return region, found[region]
    return "page", []


def repeated(pages: list[int], lengths: list[int], words: list[str], run: int) -> np.ndarray:
    """Which words of the concatenated streams are covered by runs of ``run`` words that two distinct pages have.

    A suffix array by prefix doubling, stopped at ``run`` words: neighbours that agree so far share a long substring.
    """
    size = len(words)
    page = np.repeat(np.array(pages), lengths)
    stream = np.repeat(np.arange(len(lengths)), lengths)
    _, rank = np.unique(np.array(words, dtype=object), return_inverse=True)
    length = 1
    while length < run:
        step = min(length, run - length)
        after = np.full(size, -1)
        same = np.flatnonzero(stream[: size - step] == stream[step:]) if size > step else np.empty(0, np.int64)
        after[same] = rank[same + step]
        after[after < 0] = -1 - np.flatnonzero(after < 0)  # ends of streams equal nothing
        order = np.lexsort((after, rank))
        new = np.r_[True, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])]
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(new)
        length += step
    order = np.lexsort((page, rank))
    first = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
    last = np.r_[first[1:], size] - 1
    shared = np.repeat(page[order][first] != page[order][last], last - first + 1)
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = order[shared]
    starts = starts[starts + run <= ends[starts]]
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1), np.add.at(edge, starts + run, -1)
    return np.cumsum(edge[:-1]) > 0


_BREAK = "\n"


def _words(blocks_of: list[str]) -> list[str]:
    return [w for b in blocks_of for w in (*b.split(), _BREAK)]


def _kept(words: list[str], gone: list[bool]) -> list[str]:
    kept = " ".join(w if w == _BREAK or not g else "" for w, g in zip(words, gone, strict=True))
    return [x for b in kept.split(_BREAK) if (x := " ".join(b.split()))]


def unique_runs(pages: list[int], texts: list[list[str]], run: int = RUN) -> list[list[str]]:
    """The blocks of a host's pages without the words of repeated runs; a block mark is a word of its own."""
    streams = [_words(blocks_of) for blocks_of in texts]
    words, lengths = [w for own in streams for w in own], list(map(len, streams))
    if not words:
        return [[] for _ in texts]
    gone, out, at = repeated(pages, lengths, words, run).tolist(), [], 0
    for own in streams:
        out.append(_kept(own, gone[at : at + len(own)]))
        at += len(own)
    return out


def window_hashes(words: list[str], run: int) -> np.ndarray:
    return ngram_hashes(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64), run).view(np.int64)


def unique_runs_by_hash(streams: DataFrame, run: int) -> DataFrame:
    """Rows with ``site, page, loose``, and ``text`` from what no other page of the site has: ``unique_runs`` over any
    number of pages."""

    def windows(batch):
        for site, page, loose in zip(*(batch.column(k) for k in range(3)), strict=True):
            found = np.unique(window_hashes(_words(loose.as_py()), run))
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([site.as_py()] * n, pa.int64()), pa.array([page.as_py()] * n, pa.int64()), pa.array(found)], names=["site", "page", "window"])

    def texts(batch):
        out, names = [], batch.schema.names
        for loose, shared in zip(batch.column(names.index("loose")), batch.column(names.index("shared")), strict=True):
            words = _words(loose.as_py())
            edge = np.zeros(len(words) + 1, np.int64)
            starts = np.flatnonzero(np.isin(window_hashes(words, run), np.array(shared.as_py() or [], np.int64)))
            edge[starts] += 1
            edge[starts + run] -= 1
            out.append("\n".join(_kept(words, (np.cumsum(edge[:-1]) > 0).tolist())))
        at = [i for i, name in enumerate(names) if name not in ("loose", "shared")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(out, pa.string())], names=[*(names[i] for i in at), "text"])

    met = map_arrow(streams.select("site", "page", "loose"), windows, "site long, page long, window long")
    twice = met.groupBy("site", "window").agg(F.min("page").alias("_low"), F.max("page").alias("_high")).where("_low < _high").select("site", "window")
    shared = met.join(twice, ["site", "window"]).groupBy("site", "page").agg(F.collect_set("window").alias("shared"))
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in streams.schema if f.name not in ("loose", "site", "page")]
    return map_arrow(streams.join(shared, ["site", "page"], "left"), texts, ", ".join(["site long, page long", *rest, "text string"]))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """``id_col, url_col, text`` for every row."""
    source = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("html"))
    kind = source.schema[0].dataType.simpleString()

    def rows(batch):
        text, loose, size, begin = [], [], 0, 0
        for row, page in enumerate(batch.column(2)):
            region, found = blocks(page.as_py() or "")
            text.append(None if region == "page" and found else "\n".join(found))
            loose.append(found if region == "page" and found else None)
            size += sum(map(len, found))
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin : row + 1], batch.column(1)[begin : row + 1], pa.array(text, pa.string()), pa.array(loose, pa.list_(pa.string()))], names=[id_col, url_col, "text", "loose"])
                text, loose, size, begin = [], [], 0, row + 1
        if text:
            yield pa.RecordBatch.from_arrays([batch.column(0)[begin:], batch.column(1)[begin:], pa.array(text, pa.string()), pa.array(loose, pa.list_(pa.string()))], names=[id_col, url_col, "text", "loose"])

    parsed = staged(map_arrow(source, rows, f"{id_col} {kind}, {url_col} string, text string, loose array<string>"), "parsed")
    streams = parsed.where("loose is not null").withColumn("_host", F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))
    sizes = streams.groupBy("_host").agg((F.count(F.lit(1)) > TASK_PAGES).alias("_large"))
    dealt = streams.join(sizes, "_host")

    def host(group: pa.Table) -> pa.Table:
        ids = group.column(id_col)
        numbers = {x: i for i, x in enumerate(dict.fromkeys(ids.to_pylist()))}
        found = unique_runs([numbers[x] for x in ids.to_pylist()], group.column("loose").to_pylist(), run)
        return pa.table([ids, group.column(url_col), pa.array(["\n".join(b) for b in found], pa.string())], names=[id_col, url_col, "text"])

    small = dealt.where("not _large").select(id_col, url_col, "loose", "_host").groupBy("_host").applyInArrow(host, f"{id_col} {kind}, {url_col} string, text string")
    large = dealt.where("_large").select(F.xxhash64("_host").alias("site"), F.xxhash64(id_col).alias("page"), id_col, url_col, "loose")
    large = unique_runs_by_hash(large, run).select(id_col, url_col, "text")
    return parsed.where("loose is null").select(id_col, url_col, "text").unionByName(small).unionByName(large)


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
