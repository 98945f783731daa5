"""Main text of web pages by a tree-structured graphical model over DOM nodes.

A page becomes a tree: block elements are inner nodes, and each stretch of text
between block borders is a leaf, a block of text.  Every node is content or not;
node potentials are weights of its features (tag, words of class, id and role,
amount of text, share of linked text, share of the page's text, how it ends),
and every edge has a 2 x 2 potential by the kind of child that ties it to its
parent.  Sum-product messages go up and down the tree once, for all pages of a
batch together and depth by depth, and give exact marginals; the blocks whose
marginal of being content is at least one half are the text.

The weights maximise the likelihood of labelled pages, pairs of html and main
text; the gradient is observed minus expected counts, from the same messages.
``labelled`` makes such pages where there are none: texts of a bounded sample of
pages (``SAMPLE`` pages of at most ``PAGE_CHARS``) set into layouts whose main
text is known, as articles of several markups, with menus, adverts, notices,
comments, side columns and forms around and inside them.

Parsing: comments, declarations and the content of ``SKIPPED`` elements are
dropped; end tags may be missing; a block element ends an open paragraph; elements
nested deeper than ``DEPTH`` count as children of the last one above; text keeps
the order of the page.

Cases: null and empty html, pages without text and pages all of whose text is
rejected give the empty text; null ids and urls are carried along; rows that repeat
an id are extracted each; html of any length is one unit of work, read in one
pass; an empty table gives an empty result; names of other columns play no part.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgrain.llm.common import lean

#: Pages whose texts are set into layouts, their longest html, and the labelled pages made of them.
SAMPLE, PAGE_CHARS, LAYOUTS = 200, 1 << 16, 600
DEPTH = 256
STEPS, RATE, RIDGE = 150, 0.1, 1e-3

# Fixed values of HTML: elements that begin and end blocks, elements whose content is no text, elements that an opening one ends.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("audio button canvas datalist iframe noembed noframes noscript object optgroup option script select style svg template textarea title video xmp".split())
VOID = frozenset("hr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
BARRIERS = frozenset("ul ol dl menu dir table".split())

_TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>)""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSING = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in SKIPPED}
_TAGS = {name: i for i, name in enumerate(sorted(BLOCKS))}
_LEAF, _ROOT = len(_TAGS), len(_TAGS) + 1


@dataclass
class Trees:
    """Nodes of several pages, parents before children; leaves carry a text."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    names: list[tuple[int, str]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    root: list[int] = field(default_factory=list)

    def _node(self, parent: int, kind: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        return len(self.parent) - 1

    def add(self, page: str | None) -> None:
        """Read one page."""
        top = self._node(-1, _ROOT)
        self.root.append(top)
        page = page or ""
        stack, open_ = [("", top)], Counter()
        pieces: list[str] = []
        inside, linked, at = False, 0, 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    self.leaf.append(self._node(stack[-1][1], _LEAF))
                    self.text.append(text)
                    self.linked.append(min(linked, len(text)))
                pieces.clear()
            linked = 0

        def close(until: int) -> None:
            while len(stack) > until:
                open_[stack.pop()[0]] -= 1

        while at < len(page):
            m = _TAG.search(page, at)
            if m is None:
                pieces.append(page[at:])
                break
            if m.start() > at:
                pieces.append(page[at : m.start()])
                if inside:
                    linked += m.start() - at
            at = m.end()
            if m[1]:
                at = page.find("-->", at)
                at = len(page) if at < 0 else at + 3
                continue
            if m[2]:
                at = page.find(">", at)
                at = len(page) if at < 0 else at + 1
                continue
            name = m[4].lower()
            if name in BLOCKS:
                if m[3] and open_[name] <= 0 and name != "p":
                    continue  # ends nothing
                flush()
                if m[3]:
                    inside = False
                    if open_[name] > 0:
                        k = len(stack) - 1
                        while stack[k][0] != name:
                            k -= 1
                        close(k)
                    continue
                if stack[-1][0] == "p":
                    close(len(stack) - 1)
                if name in ENDS:
                    k = len(stack) - 1
                    while k > 0 and len(stack) - k < 8 and stack[k][0] not in BARRIERS and stack[k][0] not in ENDS[name]:
                        k -= 1
                    while k > 0 and stack[k][0] in ENDS[name]:
                        close(k)
                        k -= 1
                if name in VOID:
                    continue
                under = stack[-1][1]
                node = under if self.depth[under] >= DEPTH else self._node(under, _TAGS[name])
                if m[5] and node != under:
                    for a, b, c in _NAMES.findall(m[5]):
                        self.names += [(node, part) for part in {x.lower() for x in _PART.findall(a or b or c)}]
                stack.append((name, node))
                open_[name] += 1
            elif name == "a":
                inside = not m[3]
            elif name == "br":
                pieces.append(" ")
            elif name in SKIPPED and not m[3] and not m[5].endswith("/"):
                end = _CLOSING[name].search(page, at)
                at = len(page) if end is None else end.start()
        flush()


def _steps(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, "right")


_LENGTHS, _SHARES = [1, 8, 16, 32, 64, 128, 256, 512, 1024, 4096], [0.01, 0.25, 0.5, 0.75, 0.99]
#: The first column of each group of features; words of class, id and role come last.
_GROUPS = np.cumsum([0, _ROOT + 1, _ROOT + 1, 2 * len(_LENGTHS) + 2, 2 * len(_SHARES) + 2, 2 * len(_SHARES) + 2, 2])
_EDGES = 3


class Graph:
    """Features, edges and levels of some trees as arrays."""

    def __init__(self, t: Trees, vocabulary: dict[str, int]):
        n = self.n = len(t.parent)
        self.parent, depth, kind = np.array(t.parent, np.int64), np.array(t.depth, np.int64), np.array(t.kind, np.int64)
        self.leaf = np.array(t.leaf, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1))) if n else []
        self.chars, linked = np.zeros(n), np.zeros(n)
        self.chars[self.leaf], linked[self.leaf] = [len(x) for x in t.text], t.linked
        for level in self.levels[:0:-1]:
            np.add.at(self.chars, self.parent[level], self.chars[level])
            np.add.at(linked, self.parent[level], linked[level])
        root = np.repeat(t.root, np.diff([*t.root, n]))
        is_leaf = (kind == _LEAF).astype(np.int64)
        within = np.where(self.parent >= 0, kind[self.parent], _ROOT)
        share = linked / np.maximum(self.chars, 1)
        ends = np.array([x[-1] in '.!?:"”»' for x in t.text], np.int64) if t.text else np.zeros(0, np.int64)
        columns = [
            _GROUPS[0] + kind,
            _GROUPS[1] + within,
            _GROUPS[2] + is_leaf * (len(_LENGTHS) + 1) + _steps(self.chars, _LENGTHS),
            _GROUPS[3] + is_leaf * (len(_SHARES) + 1) + _steps(share, _SHARES),
            _GROUPS[4] + is_leaf * (len(_SHARES) + 1) + _steps(self.chars / np.maximum(self.chars[root], 1), _SHARES),
        ]
        words = [(node, vocabulary[w]) for node, w in t.names if w in vocabulary]
        self.row = np.concatenate([*[np.arange(n)] * len(columns), self.leaf, np.array([x for x, _ in words], np.int64)])
        self.column = np.concatenate([*columns, _GROUPS[5] + ends, _GROUPS[6] + np.array([x for _, x in words], np.int64)])
        # an edge to a leaf, to an element with a name of its own, or to another element
        self.edge = np.where(is_leaf == 1, 0, 1)
        self.edge[np.array([x for x, _ in t.names], np.int64)] = 2

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log odds of each node, marginals of each edge to a parent): one pass up, one down."""
        own = np.zeros((self.n, 2))
        own[:, 1] = np.bincount(self.row, weights[self.column], self.n)
        message, pair = np.zeros((self.n, 2)), np.zeros((self.n, 2, 2))
        for level in self.levels[:0:-1]:
            both = edges[self.edge[level]] + own[level][:, None, :]
            message[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(own, self.parent[level], message[level])
        for level in self.levels[1:]:  # ``own`` of the level above is complete: from below and from above
            rest = own[self.parent[level]] - message[level]
            pair[level] = rest[:, :, None] + edges[self.edge[level]] + own[level][:, None, :]
            own[level] += np.logaddexp(rest[:, None, 0] + edges[self.edge[level]][:, 0, :], rest[:, None, 1] + edges[self.edge[level]][:, 1, :])
            own[level] -= own[level].max(axis=1, keepdims=True)
        pair -= pair.max(axis=(1, 2), keepdims=True)
        pair = np.exp(pair)
        return own[:, 1] - own[:, 0], pair / pair.sum(axis=(1, 2), keepdims=True)


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray

    def texts(self, pages: list[str | None]) -> list[str]:
        """The main text of each page."""
        t = Trees()
        for page in pages:
            t.add(page)
        odds, _ = Graph(t, self.vocabulary).marginals(self.weights, self.edges)
        out: list[list[str]] = [[] for _ in pages]
        of = np.searchsorted(np.array(t.root), np.array(t.leaf, np.int64), "right") - 1
        for page, node, text in zip(of.tolist(), t.leaf, t.text, strict=True):
            if odds[node] >= 0:
                out[page].append(text)
        return ["\n".join(x) for x in out]


def _labels(t: Trees, g: Graph, texts: list[str]) -> np.ndarray:
    """Leaves in the main text are content, and elements most of whose text is; those without text go with their parent."""
    y = np.zeros(g.n)
    bounds = np.searchsorted(t.leaf, [*t.root, g.n])
    for lo, hi, text in zip(bounds[:-1].tolist(), bounds[1:].tolist(), texts, strict=True):
        for m in SequenceMatcher(None, t.text[lo:hi], text.split("\n") if text else [], autojunk=False).get_matching_blocks():
            y[t.leaf[lo + m.a : lo + m.a + m.size]] = 1
    inner = np.zeros(g.n)
    inner[g.leaf] = g.chars[g.leaf] * y[g.leaf]
    for level in g.levels[:0:-1]:
        np.add.at(inner, g.parent[level], inner[level])
    y = np.where(g.chars > 0, inner * 2 > g.chars, 0).astype(np.int64)
    for level in g.levels[1:]:
        y[level] = np.where(g.chars[level] > 0, y[level], y[g.parent[level]])
    return y


def fit(labelled: list[tuple[str, str]]) -> Model:
    """Maximum likelihood, with a ridge, by gradient steps of adapted size."""
    t = Trees()
    for page, _ in labelled:
        t.add(page)
    seen = Counter(w for _, w in set(t.names))
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= 3))}
    g = Graph(t, vocabulary)
    y = _labels(t, g, [text for _, text in labelled])
    size, n = int(_GROUPS[6]) + len(vocabulary), max(1, g.n)
    x = np.zeros(size + 4 * _EDGES)
    child = np.flatnonzero(g.parent >= 0)
    observed = np.zeros((_EDGES, 2, 2))
    np.add.at(observed, (g.edge[child], y[g.parent[child]], y[child]), 1)
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        edges = x[size:].reshape(_EDGES, 2, 2)
        odds, pair = g.marginals(x[:size], edges)
        with np.errstate(over="ignore"):
            left = y - 1 / (1 + np.exp(-odds))
        expected = np.zeros((_EDGES, 2, 2))
        np.add.at(expected, g.edge[child], pair[child])
        slope = np.concatenate([np.bincount(g.column, left[g.row], size), (observed - expected).ravel()]) / n - RIDGE * x / math.sqrt(n)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        x = x + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(vocabulary, x[:size], x[size:].reshape(_EDGES, 2, 2))


# Fixed values of the layouts: words that pages use in class and id for each part.
MAIN = "article article-body body content entry entry-content main main-content post post-body post-content story story-body text page-content".split()
MENU = "menu navbar nav navigation main-nav top-nav breadcrumb breadcrumbs pagination pager toc links tabs".split()
HEAD = "header site-header masthead banner top topbar page-header logo branding".split()
FOOT = "footer site-footer bottom copyright legal colophon page-footer credits".split()
SIDE = "sidebar side aside widget related recommended popular trending more rail secondary archive tags".split()
ADVERT = "ad ads advert advertisement adsense sponsored promo promotion sponsor banner-ad".split()
NOTICE = "notice cookie cookie-notice consent gdpr alert message popup modal overlay warning subscribe newsletter paywall".split()
REMARKS = "comments comment comment-list discussion responses reply replies disqus respond feedback".split()
SHARE = "share social sharing share-buttons follow social-links".split()


class _Layout:
    """One labelled page: html in pieces, and the lines of its main text."""

    def __init__(self, rnd: random.Random, long: list[str], short: list[str]):
        self.rnd, self.long, self.short = rnd, long, short
        self.out: list[str] = []
        self.main: list[str] = []

    def named(self, tag: str, names: list[str]) -> str:
        how = self.rnd.choice(["class", "class", "id", "role"]) if tag == "div" else self.rnd.choice(["class", "id"])
        extra = f" {self.rnd.choice('box wrap inner col block clearfix'.split())}" if self.rnd.random() < 0.3 else ""
        return f'<{tag} {how}="{self.rnd.choice(names)}{extra}">'

    def line(self) -> str:
        return self.rnd.choice(self.short if self.rnd.random() < 0.3 else self.long)

    def block(self, tag: str, text: str, content: bool, open_: bool = False) -> None:
        """One block, at times with markup inside, a link, or no end tag."""
        shown = html.escape(text, quote=self.rnd.random() < 0.5)
        way = self.rnd.random()
        if way < 0.1:
            shown = f"<b>{shown}</b>"
        elif way < 0.15:
            shown = f"<b>{shown}<br>"
        elif way < 0.25 and " " in shown and "&" not in shown:
            a, b = shown.split(" ", 1)
            shown = f'<a href="/x">{a}</a> {b}'
        self.out.append(f"<{tag}>{shown}" + ("" if open_ else f"</{tag}>"))
        if content:
            self.main += [" ".join(text.split())]

    def items(self, tag: str, names: list[str] | None) -> None:
        """A list of links."""
        inner = "".join(f'<li><a href="/{i}">{html.escape(" ".join(self.line().split()[: self.rnd.randrange(1, 7)]))}</a></li>' for i in range(self.rnd.randrange(2, 9)))
        self.out.append((self.named(tag, names) if names else f"<{tag}>") + f"<ul>{inner}</ul></{tag}>")

    def part(self, tag: str, names: list[str] | None, most: int) -> None:
        """A part of some blocks that are no content."""
        self.out.append(self.named(tag, names) if names else f"<{tag}>")
        if self.rnd.random() < 0.5:
            self.out.append(html.escape(self.line()))
        else:
            for _ in range(self.rnd.randrange(1, most + 1)):
                self.block(self.rnd.choice(["p", "p", "div", "h3", "li"]), self.line(), False)
        self.out.append(f"</{tag}>")

    def clutter(self) -> None:
        """One thing that may stand anywhere."""
        way = self.rnd.randrange(8)
        if way == 0:
            self.part("div", ADVERT, 2)
        elif way == 1:
            self.part("div", NOTICE, 2)
        elif way == 2:
            self.part("aside", self.rnd.choice([None, SIDE, ADVERT]), 4)
        elif way == 3:
            self.items(self.rnd.choice(["div", "section"]), self.rnd.choice([SIDE, SHARE, MENU]))
        elif way == 4:
            self.out.append(f'<form action="/s"><label>{html.escape(self.rnd.choice(self.short))}</label><input name="q"><p>{html.escape(self.line())}</p><button>Go</button></form>')
        elif way == 5:
            self.out.append(f"<!-- {self.rnd.randrange(99)} --><script>var t='<p>x</p>';</script><style>p{{margin:0}}</style>")
        elif way == 6:
            self.part("section", self.rnd.choice([SIDE, NOTICE]), 3)
        else:
            self.part("div", SHARE, 1)

    def remarks(self) -> None:
        tag = self.rnd.choice(["div", "section", "ol", "ul"])
        self.out.append(self.named(tag, REMARKS))
        for _ in range(self.rnd.randrange(1, 7)):
            inner = self.rnd.choice(["li", "div", "article"])
            self.out.append(self.named(inner, REMARKS) if self.rnd.random() < 0.8 or inner == "article" else f"<{inner}>")
            self.block("p", self.line(), False)
            self.out.append(f"</{inner}>")
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        rnd = self.rnd
        tag = rnd.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        names = MAIN if tag in ("div", "td", "section") else rnd.choice([None, None, MAIN])
        self.out.append(("<table><tr>" if tag == "td" else "") + (self.named(tag, names) if names else f"<{tag}>"))
        if rnd.random() < 0.8:
            self.block(rnd.choice(["h1", "h1", "h2"]), rnd.choice(self.long)[:60] if rnd.random() < 0.7 else rnd.choice(self.short), True)
        inner = rnd.random() < 0.2
        if inner:
            self.out.append(self.named("div", MAIN))
        loose = rnd.random() < 0.15
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 12, 20])):
            way = rnd.random()
            if way < 0.8:
                self.block("p", self.line(), True, loose)
            elif way < 0.85:
                self.block(rnd.choice(["h2", "h3"]), rnd.choice(self.short), True)
            elif way < 0.9:
                tag2 = rnd.choice(["ul", "ol"])
                self.out.append(f"<{tag2}>")
                for _ in range(rnd.randrange(1, 5)):
                    self.block("li", self.line(), True, rnd.random() < 0.3)
                self.out.append(f"</{tag2}>")
            elif way < 0.94:
                self.out.append("<blockquote>")
                self.block("p", self.line(), True)
                self.out.append("</blockquote>")
            elif way < 0.97:
                self.block(rnd.choice(["pre", "div", "figcaption"]), self.line(), True)
            else:
                self.out.append("<table><tr>")
                for _ in range(2):
                    self.block("td", rnd.choice(self.short), True)
                self.out.append("</tr></table>")
            if rnd.random() < 0.06:
                self.clutter()
        if inner:
            self.out.append("</div>")
        if rnd.random() < 0.1:
            self.remarks()
        self.out.append(f"</{tag}>" + ("</tr></table>" if tag == "td" else ""))

    def page(self) -> tuple[str, str]:
        rnd = self.rnd
        if rnd.random() < 0.05:  # bare paragraphs, no frame
            for _ in range(rnd.randrange(1, 5)):
                self.block("p", self.line(), True)
            return "".join(self.out), "\n".join(self.main)
        self.out.append('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>t</title></head><body>')
        if rnd.random() < 0.4:
            self.part(*(("header", None) if rnd.random() < 0.5 else ("div", HEAD)), 2)
        if rnd.random() < 0.8:
            self.items(*(("nav", None) if rnd.random() < 0.7 else ("div", MENU)))
        wrap = rnd.random() < 0.3
        if wrap:
            self.out.append(self.named("div", ["wrapper", "container", "page", "site", "main", "layout"]))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            self.clutter()
        self.article()
        if rnd.random() < 0.3:
            self.remarks()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            self.clutter()
        if wrap:
            self.out.append("</div>")
        if rnd.random() < 0.8:
            self.part(*(("footer", None) if rnd.random() < 0.7 else ("div", FOOT)), 2)
        if rnd.random() < 0.9:
            self.out.append("</body></html>")
        return "".join(self.out), "\n".join(self.main)


def layouts(pages: list[str], n: int = LAYOUTS) -> list[tuple[str, str]]:
    """``n`` labelled pages with the blocks of text of some pages, always the same for the same pages."""
    t = Trees()
    for page in pages:
        t.add(page)
    long = sorted({x for x in t.text if len(x) >= 40}) or ["A paragraph of some length, as pages without one still need a text.", "Another one, of which layouts can be made."]
    short = sorted({x for x in t.text if len(x) < 40}) or ["Short line.", "Menu", "One more"]
    rnd = random.Random(11)
    return [_Layout(rnd, long, short).page() for _ in range(n)]


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Model:
    """The model of layouts with the texts of ``SAMPLE`` pages drawn by hash."""
    text = F.col(f"`{html_col}`")
    drawn = pages.filter(text.isNotNull() & (F.length(text) <= PAGE_CHARS)).select(text.alias("html"), F.xxhash64(F.col(f"`{id_col}`").cast("string"), text).alias("h"))
    last = drawn.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]  # rows with texts only of those drawn
    found = drawn.filter(F.col("h") <= last).groupBy("h").agg(F.min("html").alias("html")).collect() if last is not None else []
    return fit(layouts([r["html"] for r in sorted(found, key=lambda r: r["h"])]))


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text, n_chars) of every page."""
    source = pages.select(F.col(f"`{html_col}`").alias("_html"), F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[1:]) + ", text string, n_chars bigint"
    names = [f.name for f in source.schema[1:]] + ["text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = model.texts(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=names)

    return source.mapInArrow(lean(run), schema)
