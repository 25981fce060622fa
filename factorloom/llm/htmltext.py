"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes blocks of text (bounded by block-level tags) in a tree of containers. A linear classifier gives each block
the odds of being content from its words, links, punctuation, and the nearest hint above it: an element made for content
or boilerplate, or such a name on it. Its two costs are the capacities of the edges to the terminals. Blocks that follow
each other, on the page or in one container, are joined by smoothness edges that are the stronger the closer they are in
the tree; among paragraphs of one container they outweigh a weak or wrong classifier, so a paragraph of links inside an
article stays and a sentence in a menu goes. The minimum cut (maximum flow) splits content from boilerplate. Weights are
set by hand: there are no labelled pages to fit them on.

A hint counts for what is below it until a nearer one. Names on html, body, and on whatever stands above a content element
say nothing about that element; names such as header or widget say nothing inside one, and names on paragraphs little.

Defined results: a null or empty page, and one without content, has the empty text; broken markup is read as far as it
goes (an unfinished tag at the end is no text, an unclosed element ends with its parent); character references are
decoded; white space in a block becomes one space; ties of the cut go to boilerplate; very long and deep pages are read
whole, with memory in proportion; repeated pages are read alike; an empty table gives no rows; further columns, of
whatever name, are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]|['"])*?)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
#: Elements whose insides are never text of the page.
DROPPED = frozenset("script style noscript template svg iframe object canvas audio video select option textarea button head title datalist map".split())
_RAW = frozenset(("script", "style", "textarea", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot munder mover munderover mtable mtr mtd mstyle semantics annotation".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog header".split())
CONTENT_NAMES = frozenset("article content main post entry story body".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts breadcrumb breadcrumbs comment comments commentlist cookie cookies consent dialog disqus footer "
    "gdpr menu modal nav navbar navigation newsletter pagination pager popup promo promotion recommended related reply replies respond share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription hidden".split()
)
#: Names of boilerplate outside of content elements only.
OUTER_NAMES = frozenset("banner form header login masthead notice notices reader tags toolbar widget widgets alert".split())
#: A name with such a word before it tells of something else on the page.
_ABOUT = frozenset("has with without no not is".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption".split())
#: Weights of the classifier (log odds of content), of which `words` counts up to `most`.
WEIGHTS = {"bias": -2.0, "words": 0.9, "most": 4.5, "links": -4.0, "sentence": 1.0, "heading": 0.5, "content": 2.0, "named": 1.0, "boilerplate": -8.0, "weak": -1.5}
#: Smoothness of neighbours is NEAR / distance^2, and SAME_PARENT for those that follow each other in one container only.
NEAR, SAME_PARENT, LIMIT = 8.0, 1.0, 20.0


@dataclass(slots=True)
class Block:
    text: str
    holder: int  # number of its container
    odds: float


@dataclass(slots=True)
class _Element:
    tag: str
    number: int
    hint: str  # of the nearest element that has one
    inside: bool  # whether a content element is here or above
    boilerplate: bool  # whether its own tag is boilerplate


def _names(attributes: str, inside: bool) -> str:
    """What class, id, role and visibility say: content, boilerplate or nothing."""
    good = False
    for key, value in _ATTRIBUTE.findall(attributes):
        value, key = value.strip("\"'").lower(), key.lower()
        if key in ("class", "id", "role"):
            for token in value.split():
                words = re.split(r"[^a-z0-9]+", token)
                own = {w for k, w in enumerate(words) if not k or words[k - 1] not in _ABOUT}
                if own & BOILERPLATE_NAMES or not inside and own & OUTER_NAMES:
                    return "boilerplate"
                good = good or bool(own & CONTENT_NAMES)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "boilerplate"
    return "named" if good else ""


class Page:
    """The blocks of a page in page order, and the tree of their containers."""

    def __init__(self, page: str) -> None:
        self.parent, self.depth = [0], [0]
        self.blocks = _read(page, self)

    def distance(self, a: int, b: int) -> int:
        """Steps between two containers; over all neighbours in page order these are no more than the tags."""
        steps = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a, steps = self.parent[a], steps + 1
        return steps


def blocks(page: str) -> list[Block]:
    return Page(page).blocks


def _read(page: str, tree: Page) -> list[Block]:
    """The blocks of a page in page order, with their log odds; containers go into the tree."""
    out: list[Block] = []
    stack: list[_Element] = []
    parts: list[str] = []
    state = {"links": 0, "a": 0, "heading": False}
    w = WEIGHTS

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        linked, state["links"] = state["links"], 0
        parts.clear()
        if text:
            words = text.count(" ") + 1
            odds = w["bias"] + min(w["most"], w["words"] * math.log1p(words)) + w["links"] * min(1.0, linked / len(text)) + w["sentence"] * (text[-1] in ".!?…\"'”»") + w["heading"] * state["heading"]
            out.append(Block(text, stack[-1].number if stack else 0, odds + (w.get(stack[-1].hint, 0.0) if stack else 0.0)))

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            state["links"] += (m.start() - at) * bool(state["a"])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag, close = name.lower(), bool(m.group(1))
        if tag in DROPPED and not close:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in _RAW:
                at = n
            parts.append(" ")
            continue
        if tag == "a":
            state["a"] = 0 if close else 1
            continue
        if tag in ("br", "hr", "wbr", "img"):
            parts.append("" if tag == "wbr" else " ")
            if tag == "hr":
                flush()
            continue
        if tag in INLINE or tag in VOID:
            if close or tag in VOID or _names(m.group(3), bool(stack) and stack[-1].inside) != "boilerplate":
                continue
        flush()
        state["heading"] = not close and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        state["a"] = 0
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CONTENT_TAGS:  # such an element inside an unclosed menu or the like closes it
            while stack and stack[-1].boilerplate:
                stack.pop()
        if stack and stack[-1].tag == "p":
            stack.pop()
        above = stack[-1] if stack else _Element("", 0, "", False, False)
        inside = above.inside or tag in CONTENT_TAGS
        boilerplate = tag in BOILERPLATE_TAGS and not (tag == "header" and above.inside)
        named = "" if tag in ("html", "body") else _names(m.group(3), inside)
        if named == "boilerplate" and above.inside and tag in PARAGRAPHS:
            named = "weak"
        hint = "boilerplate" if boilerplate else "content" if tag in CONTENT_TAGS and named != "boilerplate" else named or above.hint
        tree.parent.append(above.number)
        tree.depth.append(tree.depth[above.number] + 1)
        stack.append(_Element(tag, len(tree.parent) - 1, hint, inside, boilerplate))
    if at < n:
        parts.append(page[at:])
    flush()
    return out


def _flow_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The side of the source in a minimum cut. gain > 0: capacity from the source, < 0: to the sink; undirected edges."""
    n = len(gain)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def link(a: int, b: int, x: float, y: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(x)
        head[b].append(len(to))
        to.append(a)
        cap.append(y)

    for i, g in enumerate(gain):
        if g > 0:
            link(source, i, g, 0.0)
        elif g < 0:
            link(i, sink, -g, 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    eps = 1e-9
    while True:  # Dinic: shortest augmenting paths, level by level
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                k = next(i for i, e in enumerate(path) if cap[e] <= eps)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if cap[e] > eps and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = to[e]


def label(page: Page) -> list[bool]:
    """Content or not, for each block."""
    found = page.blocks
    gain = [max(-LIMIT, min(LIMIT, b.odds)) for b in found]  # the two terminal costs differ by the log odds
    if all(g > 0 for g in gain) or all(g <= 0 for g in gain):
        return [g > 0 for g in gain]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR / max(2, page.distance(found[i - 1].holder, b.holder)) ** 2))
        above = page.parent[b.holder]
        if last.get(above, i - 1) != i - 1:
            edges.append((last[above], i, SAME_PARENT))
        last[above] = i
    return _flow_cut(gain, edges)


def extract(page: str | None) -> str:
    read = Page(page or "")
    return "\n".join(b.text for b, on in zip(read.blocks, label(read), strict=True) if on)


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(tidy(scan), f"page_id {kind}, url string, text string, n_chars long")
