"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier gives each block a score, and with it the cost of calling it
content and of calling it boilerplate: its capacities to the two terminals. Neighbours in the page, and blocks that follow
one another inside the same container, are tied by edges whose capacity is what it costs to label them differently. The
minimum cut is the cheapest labelling of the whole page; blocks on the content side are the text.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows

#: Elements of HTML by what they mean here.
RAW = frozenset("script style noscript template iframe svg math textarea title select object canvas audio video xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("nav aside footer header form menu button dialog fieldset search head".split())
ARTICLE = frozenset(("article", "main"))
#: Attributes that are looked at.
MEANING = frozenset("class id role style hidden aria-hidden".split())
#: Of RAW, those whose content is text up to the end tag; a page that lacks it ends with them. Others without an end are as if they weren't there.
TEXT_ONLY = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Inside these, an end tag of a paragraph or item outside doesn't count.
BARRIERS = ("article", "main", "body", "td", "th")
#: What opens closes a paragraph, and an item of its own kind.
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
#: Parts of class names, ids and roles that mark what isn't the article, or what is.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright dialog disqus disclaimer donate footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription syndication tags toc toolbar tooltip topbar widget widgets".split())
BODY = frozenset("article articlebody body content entry main post story text".split())

#: What starts an element, as HTML reads it: quotes count right after an equals sign only; a tag or comment without an end goes to the end of the page.
#: Possessive repeats, so that no place is read again. A quote that is never closed ends with the next ">".
_value = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]++)"""
_attribute = re.compile(rf"""(=?[^\s/>=]++)(?:\s*+=\s*+({_value}))?+|=""")
_token = re.compile(rf"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+{_value})?+|=)*+)(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)""", re.S)
_parts = re.compile(r"[a-z]+(?=[A-Z])|[A-Z]?[a-z]+|[A-Z]+|\d+")

#: The classifier's weights, and the capacities of the edges.
WEIGHTS = {"base": -0.5, "boilerplate": -9.0, "head of article": -2.0, "article": 4.0, "body": 1.5, "paragraph": 1.0, "heading": 1.0, "long": 1.0, "longer": 1.5, "links": -4.0, "sentence": 0.5}
NEXT, NEXT_ELSEWHERE, SIBLING = 1.0, 0.25, 0.5


class _Open:
    __slots__ = ("tag", "score", "article", "number")

    def __init__(self, tag: str, score: float, article: bool, number: int):
        self.tag, self.score, self.article, self.number = tag, score, article, number


def _opened(tag: str, attributes: str, parent: _Open | None, number: int) -> _Open:
    score, article = (parent.score, parent.article) if parent else (0.0, False)
    if tag in ARTICLE:
        return _Open(tag, score + WEIGHTS["article"] * (not article), True, number)
    bad, body = tag in BOILERPLATE, False
    if attributes and not attributes.isspace() and tag not in ("body", "html"):
        for name, value in _attribute.findall(attributes):
            name = name.lower()
            if name not in MEANING:
                continue
            value = value[1:-1] if value[:1] in ("'", '"') and value[:1] == value[-1:] and len(value) > 1 else value
            if name == "style":
                bad = bad or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif name == "hidden" or name == "aria-hidden":
                bad = bad or (name == "hidden" and value.lower() != "until-found") or value.lower() == "true"
            else:
                parts = {p.lower() for p in _parts.findall(value)}
                bad, body = bad or bool(parts & MARKS), body or bool(parts & BODY)
    if bad:
        score += WEIGHTS["head of article"] if tag == "header" and article else WEIGHTS["boilerplate"]
    elif body:
        score += WEIGHTS["body"]
    return _Open(tag, score, article, number)


class _Stack(list):
    """Open elements, and where each name is in it, so that an end tag without a start, or with one far down, costs no search."""

    def __init__(self):
        super().__init__([_Open("", 0.0, False, 0)])
        self.places: dict[str, list[int]] = {}

    def push(self, element: _Open) -> None:
        self.places.setdefault(element.tag, []).append(len(self))
        self.append(element)

    def cut(self, size: int) -> None:
        while len(self) > size:
            self.places[self.pop().tag].pop()

    def last(self, tag: str) -> int:
        """The place of the innermost element of a name, 0 if there is none."""
        found = self.places.get(tag)
        return found[-1] if found else 0


def page_blocks(html: str) -> list[tuple[str, float, int]]:
    """text, classifier score and container of each block of a page, in order. Takes time in proportion to the page."""
    stack = _Stack()
    blocks: list[tuple[str, float, int]] = []
    pieces: list[str] = []
    linked, in_link, number, at, size = 0, False, 0, 0, len(html)
    lowered, endless = "", set()

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            top = stack[-1]
            tag, words, share = top.tag, text.count(" ") + 1, min(1.0, linked / len(text))
            score = WEIGHTS["base"] + top.score + WEIGHTS["links"] * share
            if share < 0.5:
                score += WEIGHTS["long"] * (words >= 10) + WEIGHTS["longer"] * (words >= 25) + WEIGHTS["sentence"] * (text[-1] in ".!?…。")
            if tag in ("p", "pre", "blockquote"):
                score += WEIGHTS["paragraph"]
            elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                score += WEIGHTS["heading"]
            holder = stack[-2].number if tag in ("p", "li", "pre", "dd", "dt", "td") or tag[:1] == "h" and len(stack) > 1 else top.number
            blocks.append((text, score, holder))
        pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        text = unescape(text) if "&" in text else text
        pieces.append(text)
        if in_link:
            linked += len(text)

    while at < size:
        m = _token.search(html, at)
        if not m:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCKS:
                close()
                k = stack.last(tag)
                if k and (tag not in ("p", "li", "dd", "dt") or k > max(map(stack.last, BARRIERS))):
                    stack.cut(k)
                in_link = False
            continue
        if tag in RAW and tag not in endless:
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            lowered = lowered or html.lower()
            if len(lowered) != size:  # a few capitals have longer small forms
                lowered = "".join(c.lower() if c.isascii() else c for c in html)
            end = lowered.find(f"</{tag}", at)
            while 0 <= end and end + len(tag) + 2 < size and lowered[end + len(tag) + 2] not in " \t\n\f\r/>":
                end = lowered.find(f"</{tag}", end + 1)
            if end < 0:
                if tag in TEXT_ONLY:
                    break
                endless.add(tag)
                continue
            at = html.find(">", end) + 1 or size
            pieces.append(" ")
            continue
        if tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
        elif tag == "a":
            in_link = True
        elif tag in BLOCKS:
            close()
            in_link = False
            if tag in VOID:
                continue
            ends = SAME.get(tag, ()) + (("p",) if tag != "button" else ())
            while len(stack) > 1 and stack[-1].tag in ends:
                stack.cut(len(stack) - 1)
            number += 1
            stack.push(_opened(tag, m[3], stack[-1], number))
    close()
    return blocks


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; edges hold in both directions.

    Flow that passes a node straight from terminal to terminal goes first; the rest is sent along shortest paths of the
    residual graph, by levels, until none is left. Nodes that the source can't tell from the sink go to the sink's side.
    """
    n = len(source)
    left = [s - t for s, t in zip(source, sink, strict=True)]
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, c in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        room += (c, c)
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(k for k in range(n) if left[k] > tiny)
        for k in queue:
            level[k] = 0
        starts, reached = list(queue), False
        while queue:
            k = queue.popleft()
            if left[k] < -tiny:
                reached = True
            for e in near[k]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[k] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for start in starts:
            while left[start] > tiny:
                path, k = [], start
                while left[k] >= -tiny:
                    while turn[k] < len(near[k]):
                        e = near[k][turn[k]]
                        if room[e] > tiny and level[to[e]] == level[k] + 1:
                            break
                        turn[k] += 1
                    else:
                        if not path:
                            break
                        k = to[path.pop() ^ 1]
                        turn[k] += 1
                        continue
                    path.append(e)
                    k = to[e]
                if not path:
                    break
                flow = min(left[start], -left[k], min(room[e] for e in path))
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                left[start] -= flow
                left[k] += flow


def _soft(x: float) -> float:
    return log1p(exp(x)) if x < 30 else x


def main_text(html: str | None) -> str:
    """The main text of a page: white space in a block is one space, blocks are joined by line feeds."""
    blocks = page_blocks(html or "")
    if not blocks:
        return ""
    edges, last = [], {}
    for k, (_, _, holder) in enumerate(blocks):
        before = last.get(holder)
        if k:
            edges.append((k - 1, k, NEXT if before == k - 1 else NEXT_ELSEWHERE))
        if before is not None and before < k - 1:
            edges.append((before, k, SIBLING))
        last[holder] = k
    content = minimum_cut([_soft(s) for _, s, _ in blocks], [_soft(-s) for _, s, _ in blocks], edges)
    return "\n".join(b[0] for b, c in zip(blocks, content, strict=True) if c)


def with_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of pages (page_id, url, html).

    Whole pages are read, and nothing of the article is dropped or capped. Null and empty pages, and pages without
    content, give an empty text; rows are taken one by one, so repeated rows give equal texts.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def make(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        texts = [main_text(h) for h in columns["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([columns["page_id"], columns["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return arrow_rows(pages, [F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html")], make, f"page_id {kind}, url string, text string")
