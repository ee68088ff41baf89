"""HTML extraction by consensus host paths.

Every page scores its containers and votes for the generalised tag-class path of the
best one; Spark sums the votes of each host, and each page is then extracted again with
the winning path of its host. A page that has nothing at that path uses its own best.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import written

#: Hosts whose winners are broadcast at most; beyond that the join is shuffled, and AQE splits a hot host.
BROADCAST_HOSTS = 200_000
#: Share of a page's text that its container must hold, and of linked text from which what surrounds it is a menu.
SHARE, LINKED = 0.7, 0.5

_ATTRS = r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)"""
_RAW = "script|style|noscript|template|iframe|svg|math|textarea|select|title|object|canvas|video|audio"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>]){_ATTRS}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-zA-Z][\w:-]*){_ATTRS}>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article blockquote body center div main section td".split())
_NEVER = frozenset("article body html main".split())
_DROP_TAGS = frozenset("aside button dialog footer form head header menu nav".split())
_DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id names that mark what is not the article: the name is one of them, or joins them with
#: words of _PARTS only. So related-posts and share-buttons go, related-work and share-price stay.
_DROP_WORDS = frozenset(
    """ad ads adsense advert advertisement advertising adverts adv alert banner banners breadcrumb breadcrumbs comment comments consent cookie cookies
    copyright discussion disqus footer form gdpr hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain pager
    pagination paywall popup promo promoted promotion recommended related replies reply respond responses search share sharing sidebar signup skip social
    sponsor sponsored subscribe subscription taboola tags toolbar trending widget widgets""".split()
)
_PARTS = frozenset(
    """aside area articles author bar block body bottom box btn button buttons center column container content desktop fixed foot global group head header icon icons inline inner item items js
    latest left link links list main media message mobile overlay page panel post posts primary reader readers recent right row secondary section site slot stories sticky strip sub text thread title top unit user users view wp wrap wrapper
    by dfp facebook fb google gpt x""".split()
)
_DROP_CLASSES = frozenset("header site-header page-header top-bar topbar".split())
_CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr td th", "table tbody thead tfoot"), "option": ("option", "select")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}


class Block(NamedTuple):
    container: int
    text: str
    linked: int


class Page(NamedTuple):
    """Blocks of text outside what is dropped, in page order; for each container its path, parent and tag."""

    blocks: list[Block]
    paths: list[str]
    parents: list[int]
    tags: list[str]


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(raw)} if raw and not raw.isspace() else {}


def _dropped(tag: str, attrs: dict[str, str]) -> bool:
    if tag in _DROP_TAGS:
        return True
    if not attrs or tag in _NEVER:
        return tag == "article" and "comment" in attrs.get("class", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _DROP_ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return any(_marks(x) for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".split())


@lru_cache(10_000)
def _parted(word: str) -> tuple[str, ...]:
    """A word that is made of the words of the two lists without anything between them, as these: commentlist, topnav. Any other as it is. Pieces have three letters
    at least, but for one of the names of advertising and what joins it to others."""
    if word in _DROP_WORDS or word in _PARTS:
        return (word,)
    for n in range(len(word) - 1, 1, -1):
        head, rest = word[:n], word[n:]
        if (len(head) > 2 or head in ("ad", "by")) and (head in _DROP_WORDS or head in _PARTS):
            tail = _parted(rest)
            if all(x in _DROP_WORDS or x in _PARTS for x in tail) and all(len(x) > 2 or x in ("ad", "by") for x in tail):
                return (head, *tail)
    return (word,)


def _marks(name: str) -> bool:
    """Whether a class or id name says that its element is not the article."""
    if name.lower() in _DROP_CLASSES:
        return True
    words = [y for x in map(str.lower, _WORDS.findall(name)) if not x.isdigit() for y in _parted(x)]
    return any(x in _DROP_WORDS for x in words) and all(x in _DROP_WORDS or x in _PARTS for x in words)


def _step(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted({_DIGITS.sub("0", c) for c in attrs.get("class", "").split()})
    return ".".join([tag, *classes])


def parse(html: str) -> Page:
    """One pass over the page; unclosed and crossed elements are closed as browsers do."""
    blocks: list[Block] = []
    paths, parents, tags = ["html"], [-1], ["html"]
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                blocks.append(Block(stack[-1][1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        if any(tag in _BLOCK for tag, _, _ in stack[depth:]):
            flush()
        links -= sum(tag == "a" for tag, _, _ in stack[depth:])
        del stack[depth:]

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at and not stack[-1][2]:
            text = html[at : m.start()]
            parts.append(text)
            if links:
                linked += len(text)
        at = m.end()
        tag = m[4] or m[7]
        if tag is None:
            continue
        tag = tag.lower()
        if m[3] or m[6]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if stack[depth][0] in _CONTAINER and tag not in _BLOCK:
                    break
            continue
        if tag == "html":
            continue
        if tag == "br":
            if not stack[-1][2]:
                parts.append(" ")
            continue
        if tag in _BLOCK:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] in _CONTAINER:
                    break
            if tag in _CLOSES:
                ends, stops = _CLOSES[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in ends:
                        pop_to(depth)
                        break
                    if stack[depth][0] in stops:
                        break
            flush()
        if tag in _VOID:
            continue
        _, container, dropped = stack[-1]
        attrs = _attributes(m[5] if m[4] else m[8])
        dropped = dropped or _dropped(tag, attrs)
        if tag in _CONTAINER and not dropped:
            paths.append(f"{paths[container]}>{_step(tag, attrs)}")
            parents.append(container)
            tags.append(tag)
            container = len(paths) - 1
        links += tag == "a"
        stack.append((tag, container, dropped))
    if at < len(html) and not stack[-1][2]:
        parts.append(html[at:])
    flush()
    return Page(blocks, paths, parents, tags)


def best_container(page: Page) -> tuple[int, int] | None:
    """The article, or else the main element, around the deepest container with most of the page's unlinked text; without
    these, that container, or the one around it as long as it has more text that is no menu. With its characters."""
    inside, linked = [0] * len(page.paths), [0] * len(page.paths)
    for b in page.blocks:
        c = b.container
        while c >= 0:
            inside[c] += len(b.text) - b.linked
            linked[c] += b.linked
            c = page.parents[c]
    if not inside[0]:
        return None
    best = max((c for c in range(len(inside)) if inside[c] >= SHARE * inside[0]), key=lambda c: (page.paths[c].count(">"), -c))
    c, article, main = best, None, None
    while c >= 0:
        article = c if page.tags[c] == "article" else article
        main = c if page.tags[c] == "main" else main
        c = page.parents[c]
    if article is None and main is None:
        c = page.parents[best]
        while c > 0 and page.tags[c] != "body":
            more, menu = inside[c] - inside[best], linked[c] - linked[best]
            if menu and menu >= LINKED * (more + menu):
                break
            if more:
                best = c
            c = page.parents[c]
    else:
        best = main if article is None else article
    return best, inside[best]


def text_at(page: Page, chosen: set[int]) -> str:
    """The blocks inside these containers, in page order, joined by one end of line."""
    within = [False] * len(page.paths)
    for c in range(len(within)):
        within[c] = c in chosen or page.parents[c] >= 0 and within[page.parents[c]]
    return "\n".join(b.text for b in page.blocks if within[b.container])


def extract(html: str, path: str | None) -> str:
    """The text at the path, or in the page's own best container where there is none. A page whose text is all links
    has only what its articles, or its main element, hold."""
    page = parse(html)
    text = text_at(page, {c for c, p in enumerate(page.paths) if p == path})
    if not text and (best := best_container(page)):
        text = text_at(page, {best[0]})
    for tag in ("article", "main"):
        text = text or text_at(page, {c for c, t in enumerate(page.tags) if t == tag})
    return text


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): for each host the path with most votes; of equals the smallest. A page's vote counts the characters in
    its container; pages without unlinked text don't vote. Votes are summed before and after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = parse(html.as_py() or "")
                if best := best_container(page):
                    sums[host, page.paths[best[0]]] += best[1]
            if len(sums) > 100_000:
                yield _votes(sums)
                sums.clear()
        yield _votes(sums)

    votes = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, votes long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def _votes(sums: Counter) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(sums.values()), pa.int64())], ["host", "path", "votes"])


def main_text(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url and the main text of each row of pages, with its code points.

    Null, empty and contentless html give an empty text; a null or odd url belongs to the
    host "". Repeated rows vote each and give repeated rows; a page is read whole however long; an empty table gives no rows. Other
    columns are not read.
    """
    winners = written(winning_paths(pages))
    n_hosts = winners.count()
    pages = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"), _host(F.col("url")).alias("host"))
    joined = pages.join(F.broadcast(winners) if n_hosts <= broadcast_hosts else winners, "host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py() or "", p.as_py()) for h, p in zip(batch.column("html"), batch.column("path"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
