"""Main text of web pages by minimum-cut labelling.

A page is parsed into text blocks (runs of text between block-level tags). A linear classifier over the tags and
class names around a block, its link share, length and punctuation gives the cost of calling it content or
boilerplate; these costs are the capacities to the two terminals. Blocks that follow each other and blocks of one
parent are joined by smoothness edges. The minimum cut, found by maximum flow, is the labelling of least
total cost; the content side is the main text.

Defined cases: null and empty pages have an empty text; unclosed, stray and deeply nested tags are accepted; an open head
ends at what may not stand in it, another unseen element without an end tag of its own at the first block element (script and
style hold the rest of the page, as in browsers); repeated pages give equal rows; other columns are carried along.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Element kinds of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video"}
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
          "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre",
          "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
# Weights of the classifier: positive speaks for content.
TAGS = {"article": 4.0, "main": 3.0, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "button": -8.0,
        "select": -8.0, "textarea": -8.0, "fieldset": -8.0}
ROLES = {"main": 3.0, "article": 4.0, "navigation": -8.0, "banner": -8.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0, "form": -8.0,
         "alert": -8.0, "dialog": -8.0}
GOOD = {"article", "body", "content", "entry", "main", "post", "prose", "story", "text"}
BAD = {"ad", "ads", "adv", "advert", "advertisement", "adverts", "author", "banner", "bottom", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
       "cookie", "cookies", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
       "notice", "pager", "pagination", "popup", "promo", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social",
       "sponsor", "sponsored", "subscribe", "teaser", "toolbar", "topbar", "widget"}


@dataclass
class Block:
    text: str
    score: float
    parent: int
    shared: int  # depth of the deepest element that holds this block and the one before
    depth: int


class _Reader(HTMLParser):
    """Collects blocks; each open element carries the evidence of its ancestors."""

    def __init__(self, endless: frozenset[tuple[int, int]] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.endless = endless  # places of the unseen elements that have no end tag
        self.places: list[tuple[int, tuple[int, int]]] = []  # depth and place of the open unseen elements
        self.left: set[tuple[int, int]] = set()  # places of those that ended with an element around them
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, float, float, bool, int]] = []  # tag, for, against, unseen, number
        self.open: dict[str, int] = {}
        self.links = self.count = self.linked = 0
        self.parts: list[str] = []
        self.lowest = 0
        self.heading = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
        if self.places:
            self.leave_unseen(tag)
        if tag in VOID:
            return
        _, good, bad, unseen, _ = self.stack[-1] if self.stack else ("", 0.0, 0.0, False, 0)
        given = dict(attrs)
        weight = TAGS.get(tag, 0.0) + ROLES.get((given.get("role") or "").lower(), 0.0)
        if tag == "header" and not self.open.get("article") and not self.open.get("main"):
            weight -= 8
        if "hidden" in given or (given.get("aria-hidden") or "") == "true" or "display:none" in (given.get("style") or "").replace(" ", ""):
            weight -= 8
        if tag not in ("html", "body"):
            names = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{given.get('class') or ''} {given.get('id') or ''}").lower()))
            weight += -8.0 if names & BAD else 2.0 if names & GOOD else 0.0
        self.count += 1
        self.stack.append((tag, good + max(weight, 0), bad + min(weight, 0), unseen or tag in UNSEEN, self.count))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"
        if tag in UNSEEN:
            self.places.append((len(self.stack) - 1, self.getpos()))

    def leave_unseen(self, tag: str) -> None:
        """End the innermost unseen elements that ``tag`` shows to be over."""
        while self.places:
            depth, place = self.places[-1]
            if self.stack[depth][0] == "head":
                over = tag not in IN_HEAD and (tag == "body" or not self.open.get("title"))
            else:
                over = tag in BLOCKS and place in self.endless
            if not over:
                return
            self.handle_endtag(self.stack[depth][0])

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if not self.open.get(tag):
            return
        while self.stack:
            name = self.stack.pop()[0]
            if self.places and self.places[-1][0] == len(self.stack):
                _, place = self.places.pop()
                if name != tag:
                    self.left.add(place)
            self.open[name] -= 1
            self.links -= name == "a"
            self.lowest = min(self.lowest, len(self.stack))
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.handle_endtag("head")
        if self.stack and self.stack[-1][3]:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        linked, self.linked = self.linked, 0
        self.parts = []
        if not text:
            return
        at = len(self.stack) - 1
        while at > 0 and self.stack[at][0] in INLINE:
            at -= 1
        tag, good, bad, _, number = self.stack[at] if self.stack else ("", 0.0, 0.0, False, 0)
        words = text.count(" ") + 1
        score = (-1.0 + min(good, 6.0) + max(bad, -16.0) - 4 * min(1.0, linked / len(text)) + min(words, 60) / 20
                 + 0.5 * (text[-1] in ".!?\"'”»…") + 0.5 * (tag in ("p", "h1", "h2", "h3", "blockquote", "pre")) - 0.5 * (tag in ("li", "option")))
        self.blocks.append(Block(text, score, number, min(self.lowest, at), at))
        self.lowest = at + 1


def read_blocks(html: str) -> list[Block]:
    reader = _read(html)
    endless = reader.left | {place for _, place in reader.places}
    return (_read(html, frozenset(endless)) if endless else reader).blocks


def _read(html: str, endless: frozenset[tuple[int, int]] = frozenset()) -> _Reader:
    reader = _Reader(endless)
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source side of a minimum cut (maximum flow by blocking flows)."""
    n = len(source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):  # what both terminals could take flows at once
        through = min(source[i], sink[i])
        if source[i] > through:
            link(s, i, source[i] - through, 0)
        elif sink[i] > through:
            link(i, t, sink[i] - through, 0)
    for a, b, weight in edges:
        link(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[u] < len(head[u]):
                e = head[u][nxt[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(head[u]):
                path.append(head[u][nxt[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                nxt[u] += 1
            else:
                break


def main_text(html: str | None, smooth: float = 0.5) -> str:
    """Content blocks of a page, joined by line feeds."""
    blocks = read_blocks(html or "")
    cost = [(math.log1p(math.exp(b.score)), math.log1p(math.exp(-b.score))) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:  # neighbours, the closer the deeper what holds both
            edges.append((i - 1, i, smooth * (1 + b.shared) / (1 + max(b.depth, blocks[i - 1].depth))))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, smooth))
        last[b.parent] = i
    inside = min_cut([c[0] for c in cost], [c[1] for c in cost], edges)
    return "\n".join(b.text for b, keep in zip(blocks, inside, strict=True) if keep)


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``_main_text``. Pages are independent, so no shuffle is needed."""
    pages = pages.drop("_main_text")
    names = pages.columns
    renamed = pages.toDF(*[f"c{i}" for i in range(len(names))])
    column = names.index(html)
    schema = ", ".join(f"`c{i}` {t}" for i, (_, t) in enumerate(pages.dtypes)) + ", main_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = pa.array([main_text(h) for h in part.column(column).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "main_text"])

    return renamed.mapInArrow(run, schema).toDF(*names, "_main_text")
