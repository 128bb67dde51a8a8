"""Main text of web pages by equivalence-class template deduction.

A token is an element in its role: the path of structural elements (with their
classes and ids) that leads to it; for text outside menus and the like also the
text itself. First pass: tokens that share their occurrence vector (how often they
occur on each page of the host) form an equivalence class. The vector is
compared by a fingerprint, the sum over pages of a hash of the page times the
count modulo 2**64, so that it adds up in partial aggregates and no host's
pages ever meet in one task. Classes of two tokens or more that occur on at least
half of the host's pages (three at least) are valid if their elements nest: every element's
parent is in a class that occurs wherever it does (the elements around a text
do anyway, as they are its role). They make the host's template; text that is
itself a token of a valid class belongs to it in that element, inside articles
as elsewhere, but for an article's first heading. A text counts once for all revisions of one article
(pages with the same first heading in their article): it must be on at least half of the host's
articles, and three, as well.

Second pass: a page is read against its host's template and the slots that the
template leaves are extracted. Slots under elements for menus, headers,
footers, sidebars, notices, adverts, forms or comments are no main text; inside
an article an element whose class or id is or contains such a word is one of these only
if it belongs to the template (names of adverts and reader comments, which differ from page to page, and element
names decide by themselves; where there is no template, all do). If a
page has articles (or a main element), their slots are it (all their text, if
the template leaves no slot in them: copies of one page); else those of the
template's element that holds the most text outside links of all the host's
pages (the deepest with at least half of it), else all slots that are not
mostly links. A page that the template doesn't fit, since fewer than half of the template's elements are on
it in their places, is read by itself.

Defined cases: null or empty html gives an empty text; a null url is a host of
its own; very long pages are read whole; repeated pages are extracted each; an
empty table gives an empty result; columns of any name are kept, and a result
that would clash with one of them gets a trailing underscore; broken markup is read to its end (elements
left open end with their parent, a tag cut off at the end is dropped).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_names, cut, free_name, slices

# Element names of HTML and words in classes and ids that say what a part of a page is.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "object", "canvas", "audio", "video", "select", "option", "button", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CHROME = {"nav", "menu", "footer", "aside", "form", "head", "dialog"}
CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "form", "gdpr", "header",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "pager", "popup", "promo", "promoted", "related", "replies", "reply", "respond", "search",
    "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
ALWAYS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored", "comment", "comments", "disqus", "replies", "reply", "respond"}  # adverts and reader comments, which differ from page to page
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HEADS = {"header", "masthead", "banner"}  # inside an article they hold its title
NOT_THERE = {"with", "without", "has", "no"}  # as in "with-sidebar"
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "menu"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HOST = re.compile(r"\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)")
MAIN_SHARE = 0.5
MIN_PAGES = 3
BROADCAST_BYTES = 32 << 20


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


class Part:
    """An open element: its role path, whether it lies in chrome, in an article, in a main element, and the path of the outermost part that its name alone makes chrome."""

    __slots__ = ("article", "chrome", "main", "named", "path", "tag")

    def __init__(self, tag: str, path: str, chrome: bool, article: bool, main: bool, named: str = ""):
        self.tag, self.path, self.chrome, self.article, self.main, self.named = tag, path, chrome, article, main, named


def opened(up: Part, tag: str, attributes: str) -> Part:
    names, role = [], ""
    for m in _ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            role = value.strip().lower()
        elif m[1].lower() != "hidden":
            names += value.lower().split()
    inside = up.article or up.main
    split = [set(re.split(r"[^a-z]+", n)) for n in names]
    words = {w for s in split if not s & NOT_THERE for w in s} - (HEADS if inside else set())
    chrome = up.chrome or tag in CHROME or (tag == "header" and not inside) or role in ROLES
    worded = tag not in ("html", "body", "article", "main") and bool(words & CHROME_WORDS)
    exact = worded and any(n in ALWAYS and n in words for n in names)
    chrome = chrome or (worded and not inside) or exact or (tag in ("article", "main") and bool(words & {"comment", "comments", "reply", "ad", "advert"}))
    label = tag + "".join("." + n for n in sorted(set(names)) if not any(c.isdigit() for c in n))
    path = f"{up.path}/{label}"
    return Part(tag, path, chrome, up.article or (tag == "article" and not chrome), up.main or ((tag == "main" or role == "main") and not chrome), up.named or (path if worded and inside else ""))


_TOP = Part("", "", False, False, False)


def read(page: str | None) -> Iterator[tuple[str, Part, str, bool]]:
    """("open", element, "", False) for structural elements; ("text", element, block, in a link) for blocks in page order."""
    stack = [_TOP]
    piece: list[str] = []
    linked = 0
    link_chars = 0
    page = page or ""
    at = 0

    def flush():
        nonlocal link_chars
        block = " ".join("".join(piece).split())
        piece.clear()
        share, link_chars = link_chars, 0
        if block:
            yield "text", stack[-1], block, share * 2 > len(block)

    def add(raw: str):
        nonlocal link_chars
        if raw:
            got = html.unescape(raw) if "&" in raw else raw
            piece.append(got)
            if linked:
                link_chars += len(got)

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            if tag not in ("textarea", "button", "select", "option", "iframe", "svg", "object"):
                continue
            piece.append(" ")
        elif tag == "br" or tag == "hr":
            piece.append("\n")
        elif tag in VOID:
            continue
        elif tag == "a":
            linked = 0 if closing else 1
        elif tag in BLOCK:
            yield from flush()
            linked = 0
            if closing:
                if any(p.tag == tag for p in stack):
                    while stack.pop().tag != tag:
                        pass
            else:
                if stack[-1].tag == "p":
                    stack.pop()
                shut = CLOSED_BY.get(tag)
                if shut:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in SCOPES:
                            break
                        if stack[k].tag in shut:
                            del stack[k:]
                            break
                if not (tag in ("html", "body") and any(p.tag == tag for p in stack)):
                    stack.append(opened(stack[-1], tag, m[3]))
                    yield "open", stack[-1], "", False
    yield from flush()


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _text_mark(path: str, block: str) -> int:
    """A text in its element's role; never 0."""
    return _hash(f"{path}\0{block}") | 1


def count_tokens(pages: list[tuple[str, int, str | None]]) -> dict[tuple[str, str, int, int], list[int]]:
    """(host, path, hash of the text or 0, article) -> fingerprint, pages, occurrences, characters outside links, characters; of a batch of pages.

    article tells pages apart that are not revisions of one article: the first heading of the article (or main element), or
    the page where there is none. It is 0 for elements.
    """
    out: dict[tuple[str, str, int, int], list[int]] = {}
    for host, mark, page in pages:
        elements: dict[str, list[int]] = {}
        texts: dict[tuple[str, int], int] = {}
        article = 0
        for kind, part, block, link in read(page):
            if kind == "open":
                elements.setdefault(part.path, [0, 0, 0])[0] += 1
            elif not part.chrome:
                x = elements.setdefault(part.path, [0, 0, 0])
                x[1] += 0 if link else len(block)
                x[2] += len(block)
                k = part.path, _text_mark(part.path, block)
                texts[k] = texts.get(k, 0) + 1
                if not article and part.tag in HEADINGS and (part.article or part.main):
                    article = _hash(block) | 1
        article = article or mark
        seen = {(host, p, 0, 0): v for p, v in elements.items() if p}
        seen.update({(host, p, t, article): [n, 0, 0] for (p, t), n in texts.items()})
        top = elements.get("", [0, 0, 0])
        seen[host, "", 0, article] = [top[0] + 1, *top[1:]]
        for k, (n, plain, chars) in seen.items():
            x = out.setdefault(k, [0, 0, 0, 0, 0])
            for i, v in enumerate((mark * n, 1, n, plain, chars)):
                x[i] += v
    return out


def _page_mark(name: str, page: str | None) -> int:
    return _hash(f"{name}\0{page or ''}") | 1


def templates(pages: DataFrame, key: str, url: str, body: str) -> DataFrame:
    """(host, paths, texts, main): the elements and texts of each host's template and the element of its main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, body, 16 << 20):
                rows = zip(batch.column(key).to_pylist(), batch.column(url).to_pylist(), batch.column(body).to_pylist(), strict=True)
                found = count_tokens([(host_of(u), _page_mark(f"{k}\0{u}", b), b) for k, u, b in rows])
                columns = list(zip(*[(h, p, _signed(t), _signed(a), _signed(v[0]), *v[1:]) for (h, p, t, a), v in found.items()], strict=True)) or [[]] * 9
                types = [pa.string(), pa.string(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "path", "text", "article", "mark", "pages", "n", "plain", "chars"])

    rows = pages.select(key, url, body).mapInArrow(run, "host string, path string, text long, article long, mark long, pages long, n long, plain long, chars long")
    # wrapping sums: 64-bit halves of the fingerprint add up exactly in decimals and are reduced again
    total = [F.expr("pmod(sum(cast(mark as decimal(20,0))), 18446744073709551616)").alias("mark"), *[F.sum(c).alias(c) for c in ("pages", "n", "plain", "chars")]]
    tokens = rows.groupBy("host", "path", "text", "article").agg(*total).groupBy("host", "path", "text").agg(*total, F.count("*").alias("articles"))
    # most texts occur once: they go before anything is asked of their host
    tokens = cut(tokens.filter((F.col("pages") >= MIN_PAGES) | (F.col("plain") > 0) | ((F.col("path") == "") & (F.col("text") == 0))))
    hosts = tokens.filter("path = '' and text = 0").select("host", F.col("pages").alias("all"), F.col("articles").alias("all_articles"))
    frequent = (F.col("pages") * 2 >= F.col("all")) & (F.col("pages") >= MIN_PAGES)
    # revisions of one article are one voice: a text that only they have in common is theirs
    frequent &= (F.col("text") == 0) | ((F.col("articles") * 2 >= F.col("all_articles")) & (F.col("articles") >= MIN_PAGES))
    tokens = tokens.join(hosts, "host").withColumn("frequent", frequent).filter("frequent or plain > 0")
    classes = tokens.filter("frequent").groupBy("host", "mark").agg(F.count("*").alias("size"))
    tokens = cut(tokens.join(classes, ["host", "mark"], "left").withColumn("valid", F.col("frequent") & (F.coalesce("size", F.lit(0)) >= 2)))
    up = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    parents = tokens.filter("valid and text = 0").select("host", F.col("path").alias("up"), F.col("pages").alias("up_pages"))
    nested = tokens.withColumn("up", up).join(parents, ["host", "up"], "left")
    nested = nested.withColumn("valid", F.col("valid") & ((F.col("text") != 0) | (F.col("path") == "") | F.coalesce(F.col("up_pages") >= F.col("pages"), F.lit(False))))
    steps = F.split("path", "/")
    up_to = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    held = nested.filter("plain > 0 and path <> ''").select("host", F.explode(up_to).alias("path"), "plain").groupBy("host", "path").agg(F.sum("plain").alias("held"))
    held = (
        held.join(nested.filter("valid and text = 0 and path <> ''").select("host", "path"), ["host", "path"], "left_semi")
        .join(nested.groupBy("host").agg(F.sum("plain").alias("total")), "host").filter(F.col("held") >= MAIN_SHARE * F.col("total"))
        .groupBy("host").agg(F.max_by("path", F.struct(F.size(steps), F.col("held"), "path")).alias("main"))
    )
    made = nested.filter("valid").groupBy("host").agg(
        F.collect_set(F.when(F.col("text") == 0, F.col("path"))).alias("paths"), F.collect_set(F.when(F.col("text") != 0, F.col("text"))).alias("texts")
    )
    return made.join(held, "host", "left")


def extract(page: str | None, paths: set[str] | None, texts: set[int], main: str | None) -> str:
    """The main text of a page; paths, texts and main are its host's template."""
    blocks = []
    opened_ = {""}
    article = main_element = False
    for kind, part, block, link in read(page):
        if kind == "open":
            opened_.add(part.path)
            article |= part.article
            main_element |= part.main
        elif not part.chrome:
            blocks.append((part, block, link))
    fits = bool(paths) and 2 * len(paths & opened_) >= len(paths)
    # inside articles a name makes no furniture by itself, but for adverts and comments: the element must be one of the template's (any will do where there is no template)
    blocks = [x for x in blocks if not x[0].named or (fits and x[0].named not in paths)]
    title = next((i for i, (p, _, _) in enumerate(blocks) if p.tag in HEADINGS and (p.article or p.main)), -1)  # no template takes an article's title
    slots = [x for i, x in enumerate(blocks) if i == title or _signed(_text_mark(x[0].path, x[1])) not in texts] if fits else blocks
    if article:
        return " ".join([b for p, b, _ in slots if p.article] or [b for p, b, _ in blocks if p.article])
    if main_element:
        return " ".join([b for p, b, _ in slots if p.main] or [b for p, b, _ in blocks if p.main])
    if fits and main and main in opened_:
        slots = [x for x in slots if x[0].path == main or x[0].path.startswith(main + "/")]
    else:
        slots = [x for x in slots if not x[2]]
    return " ".join(b for _, b, _ in slots)


@any_names("key", "url", "body")
def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """All rows and columns of pages with text and n_chars (code points)."""
    made = templates(pages, key, url, body)
    text, n_chars = free_name(pages.columns, "text"), free_name(pages.columns, "n_chars")
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)", 1)), F.lit(""))
    own = [free_name([*pages.columns, text, n_chars], n) for n in ("__host", "__paths", "__texts", "__main")]
    made = cut(made.select("host", "paths", "texts", "main").toDF(*own))
    length = F.aggregate(F.transform(own[1], F.length), F.lit(0), lambda a, x: a + x) + 24 * F.size(own[1]) + 16 * F.size(own[2]) + 64
    if (made.agg(F.sum(length)).first()[0] or 0) <= BROADCAST_BYTES:  # else the pages are shuffled to their hosts' templates
        made = F.broadcast(made)
    joined = pages.withColumn(own[0], host).join(made, own[0], "left")
    kept = list(pages.columns)
    names = [*kept, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, body):
                known: dict[str, tuple] = {}
                out = []
                hosts, ways = batch.column(own[0]).to_pylist(), batch.column(own[3]).to_pylist()
                for i, (b, h) in enumerate(zip(batch.column(body).to_pylist(), hosts, strict=True)):
                    if h not in known:
                        paths, texts = batch.column(own[1])[i].as_py(), batch.column(own[2])[i].as_py()
                        known[h] = (set(paths or ()), set(texts or ()), ways[i])
                    out.append(extract(b, *known[h]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], names=names)

    from pyspark.sql import types as T

    schema = T.StructType([*pages.schema.fields, T.StructField(text, T.StringType())])
    return joined.mapInArrow(run, schema).withColumn(n_chars, F.char_length(text).cast("long"))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")
