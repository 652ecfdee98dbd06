"""Main text of web pages by a consensus of each host's pages.

A page is read into blocks of text, each with the containers it lies in. A container's path is the tags from the body down to it
with their classes, numbers in them generalised. Every page scores its containers (text they hold outside links, a level
further up for half as much, more for tags and classes that name an article), climbs from the best one while the
containers around it, up to an article or main part, add text that is mostly no links, and votes for the path it reaches. Votes are
added up by host in Spark, and the text is then taken from the host's winning path; a page without it, or with nothing in
it, uses the path it voted for itself. Reading a page takes time in proportion to its length, however broken or deeply nested it is: a tag
that is not closed before the next ``<`` outside quotes is text.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and readers' comments are left out wherever
they stand, by tag or by a whole class, id or role that names one (``sidebar``, ``sidebar-left``, ``user-comments``; not
``has-sidebar``, ``comments-open``, nor a heading's own address such as ``related-work``). An article, a main part and what
holds one are never left out by name. Character references are decoded; white space in a block becomes
one space; blocks are joined by a line feed. Null and empty pages, and pages without text, give an empty text. Pages
without a host in their address share one.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.llm.common import record, runs, written

VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64())])
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)")
_UNQUOTED = re.compile(r"""[^'"<>]*""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Element names and naming habits of web pages.
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "head", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CONTAINERS = {"body", "div", "article", "main", "section", "aside", "header", "footer", "nav", "form", "td", "center", "dialog"}
_BLOCKS = _CONTAINERS | {
    "html", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot",
    "tr", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "fieldset", "details", "summary", "hr",
}
_DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu"}
_DROPPED_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice",
    "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
# What a name of several words may hold besides a dropped word and still name such a zone.
_SIDES = {
    "area", "bar", "block", "bottom", "box", "center", "container", "content", "global", "inner", "item", "items", "left", "links", "list",
    "main", "outer", "page", "panel", "post", "primary", "right", "secondary", "section", "site", "slot", "sub", "thread", "top", "user",
    "unit", "wrap", "wrapper",
}
_KEPT = {"body", "main", "article"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ARTICLE_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text"}
# An element that a new one of the second kind ends without an end tag.
_ENDED_BY = {"p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


@dataclass
class Element:
    tag: str
    parent: Element | None  # of a container: the next one around it
    named: bool  # left out by its own name
    holder: Element | None = field(default=None, repr=False)  # the element around it, container or not
    weight: float = 1.0
    score: float = 0.0
    container: Element | None = field(default=None, repr=False)
    step: str = ""  # of a container: its part of the path
    known_path: object = None  # of a container: running hash of the path
    freed: bool = False  # holds an article, as does all around it
    first: int = 0  # number of the first block in it
    last: int = 0  # and of the first one behind it
    out: bool | None = None  # in a zone that is left out, once that has been asked

    @property
    def path(self) -> str:
        steps, box = [], self
        while box is not None:
            steps.append(box.step)
            box = box.parent
        return "/".join(filter(None, reversed(steps)))


@dataclass
class Block:
    text: str
    inside: Element
    value: int  # characters, less twice those in links
    at: int  # number in the page, blocks that are left out included


def _names_zone(name: str) -> bool:
    """Whether a whole class, id or role names a zone to leave out: dropped words alone or with words for a place or kind."""
    words = [w for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())]
    return any(w in _DROPPED_WORDS for w in words) and all(w in _DROPPED_WORDS or w in _SIDES for w in words)


def _words(attributes: str) -> tuple[list[str], set[str], bool]:
    """Classes with numbers generalised, the words of class, id and role, and whether one of these names a zone to leave out."""
    classes, words, zone = [], set(), False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() == "class":
            classes += [re.sub(r"\d+", "0", c.lower()) for c in value.split()]
        zone = zone or any(map(_names_zone, value.split()))
        words.update(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    return classes, words, zone


def _left_out(element: Element) -> bool:
    """Whether an element lies in a zone that is left out; remembered for all elements around it that are asked on the way."""
    way, at = [], element
    while at is not None and at.out is None and not (at.named or at.tag in _DROPPED):
        way.append(at)
        at = at.holder
    out = at is not None and (at.out is None or at.out)
    for x in way:
        x.out = out
    return out


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Place of the ``>`` that ends a tag of which the attributes begin at ``at``; -1 if there is none before the next ``<`` or the end.

    Places behind quoted values from which no end has been found go to ``dead``, so that none is gone through twice.
    """
    passed = []
    while True:
        at = _UNQUOTED.match(page, at).end()
        sign = page[at : at + 1]
        if sign == ">":
            return at
        close = page.find(sign, at + 1) if sign and sign != "<" else -1
        if close < 0 or close + 1 in dead:
            dead.update(passed)
            return -1
        at = close + 1
        passed.append(at)


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, slash, name and attributes of each tag; comments and declarations have no name. Answered by the place to go on from."""
    at, dead, last = 0, set(), page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        tag = _OPEN.match(page, start)
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            token = start, len(page) if end < 0 else end + 3, "", "", ""
        elif tag is not None:
            end = _tag_end(page, tag.end(), dead) if tag.end() <= last else -1
            if end < 0:
                continue
            token = start, end + 1, tag[1], tag[2].lower(), page[tag.end() : end]
        elif page[at : at + 1] in ("!", "?") and start < last:
            token = start, page.find(">", start) + 1, "", "", ""
        else:
            continue
        at = (yield token) or token[1]


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, in zones that are not left out, each with the container it lies in."""
    top = Element("html", None, False, known_path=hashlib.blake2b(digest_size=16))
    top.container = top
    open_tags: Counter[str] = Counter()
    stack, found, part, links, in_link, at = [top], [], [], 0, False, 0

    def end_block() -> None:
        nonlocal links
        text = " ".join(references.unescape("".join(part)).split())
        part.clear()
        if text:
            found.append((text, stack[-1], max(0, len(text) - 2 * links)))
        links = 0

    def end_elements(depth: int) -> None:
        for x in stack[depth:]:
            x.last = len(found)
            open_tags[x.tag] -= 1
        del stack[depth:]

    def add(text: str) -> None:
        nonlocal links
        if text:
            part.append(text)
            links += len(text) * in_link

    tokens = _tokens(page)
    token = next(tokens, None)
    while token is not None:
        start, end, closing, tag, attributes = token
        add(page[at:start])
        at = end
        if tag in _RAW and not closing and tag != "head" and not attributes.endswith("/"):
            at = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(page, at).end()
        try:
            token = tokens.send(at)
        except StopIteration:
            token = None
        if not tag:
            continue
        if tag in _RAW and not closing:
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            part.append(" ")
            continue
        if tag not in _BLOCKS and tag not in _DROPPED:
            continue
        end_block()
        if closing:
            if open_tags[tag]:
                end_elements(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        while len(stack) > 1 and tag in _ENDED_BY.get(stack[-1].tag, ()):
            end_elements(len(stack) - 1)
        if tag in _VOID or tag == "html":
            continue
        classes, words, zone = _words(attributes) if attributes else ([], set(), False)
        up = stack[-1]
        named = zone and tag not in _HEADINGS and tag not in _KEPT
        element = Element(tag, None, named, first=len(found))
        if tag in _KEPT and not zone:  # an article named a comment frees nothing around it
            for x in reversed(stack):
                if x.freed:
                    break
                x.named, x.freed = False, True
        element.container = up.container
        if tag in _CONTAINERS:
            element.step, element.known_path = ".".join([tag, *classes]), up.container.known_path.copy()
            element.known_path.update(("/" * (up.container is not top) + element.step).encode("utf-8", "surrogatepass"))
            element.parent, element.container = up.container, element
            element.weight = {"article": 3.0, "main": 2.0}.get(tag, 1.5 if words & _ARTICLE_WORDS else 1.0)
        element.holder = up
        open_tags[tag] += 1
        stack.append(element)
    add(page[at:])
    end_block()
    top.last = len(found)
    end_elements(1)
    blocks = []
    for number, (text, element, value) in enumerate(found):
        if not _left_out(element):
            blocks.append(Block(text, element.container, value, number))
            box = element.container
            box.score += value
            if box.parent is not None:
                box.parent.score += value / 2
    return blocks


def best_path(blocks: list[Block]) -> str:
    """Path of the container that scores highest; its first in the page where several are equal; "" without text."""
    boxes: dict[int, Element] = {}
    for block in blocks:
        box: Element | None = block.inside
        while box is not None and id(box) not in boxes:
            boxes[id(box)] = box
            box = box.parent
    return _whole(max(boxes.values(), key=lambda x: x.score * x.weight), blocks).path if boxes else ""


def _whole(box: Element, blocks: list[Block]) -> Element:
    """The container around ``box`` up to which each adds text that is mostly no links; never beyond an article or main part, nor the body.

    A container that adds nothing is passed through. The blocks of a container stand in a row.
    """
    places = [b.at for b in blocks]
    span = lambda x: (bisect_left(places, x.first), bisect_left(places, x.last))
    best, (low, high) = box, span(box)
    while best.tag not in _KEPT and box.tag not in _KEPT and box.parent is not None and box.parent.tag not in ("body", "html"):
        box = box.parent
        first, last = span(box)
        more = blocks[first:low] + blocks[high:last]
        if more:
            if 2 * sum(b.value for b in more) < sum(len(b.text) for b in more):
                break
            best, low, high = box, first, last
    return best


def text_in(blocks: list[Block], path: str) -> str:
    """Text of the blocks that lie in a container of this path."""
    wanted = hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    inside: dict[int, bool] = {}

    def lies_in(box: Element | None) -> bool:
        way = []
        while box is not None and id(box) not in inside and box.known_path.digest() != wanted:
            way.append(id(box))
            box = box.parent
        found = box is not None and inside.get(id(box), True)
        inside.update(dict.fromkeys(way, found))
        return found

    return "\n".join(b.text for b in blocks if lies_in(b.inside))


def main_text(blocks: list[Block], path: str | None) -> str:
    """Text in ``path``, or where there is none in the page's own best container."""
    return (text_in(blocks, path) if path is not None else "") or text_in(blocks, best_path(blocks))


def host_of(url_col: str):
    found = F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): how many pages of a host score the path highest."""

    def run(batches):
        for batch in batches:
            total: Counter[tuple[str, str]] = Counter()
            for hosts, texts in runs(iter([batch])):
                for host, text in zip(hosts, texts, strict=True):
                    blocks = blocks_of(text.decode())
                    if blocks:
                        total[host, best_path(blocks)] += 1
            yield record(VOTES, [h for h, _ in total], [p for _, p in total], list(total.values()))

    given = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    found = given.mapInArrow(run, "host string, path string, votes long")
    return found.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winners(voted: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes, of several the first in order."""
    return voted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extracted(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages``.

    Winning paths, a row for each host, are written first, so that the join that follows knows their size: Spark sends them to all
    tasks while they are few, and otherwise joins by host, splitting hosts with many pages.
    """

    def run(batches):
        for batch in batches:
            at = 0
            for ids, texts in runs(iter([batch])):
                paths = batch.column(3).slice(at, len(ids)).to_pylist()
                found = [main_text(blocks_of(t.decode()), p) for t, p in zip(texts, paths, strict=True)]
                yield record(TEXTS, ids, batch.column(2).slice(at, len(ids)), found, [len(x) for x in found])
                at += len(ids)

    best = written(winners(votes(pages, url_col, html_col)), "paths")
    given = pages.select(
        F.col(page_col).cast("long").alias("page_id"),
        F.col(html_col).cast("string").alias("html"),
        F.col(url_col).cast("string").alias("url"),
        host_of(url_col).alias("host"),
    )
    return given.join(best, "host", "left").select("page_id", "html", "url", "path").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
