"""Main text of web pages: a tree-structured graphical model over DOM nodes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortide.llm.scratch import by_value, received, send

by_value(__name__)

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template noscript head title iframe object svg math canvas audio video".split())
SIDE = frozenset("nav header footer aside menu dialog".split())
CONTROL = frozenset("form button select option optgroup textarea label fieldset legend input datalist output".split())
MAIN = frozenset("article main".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt caption td th".split())
LIST = frozenset("ul ol li dl table thead tbody tfoot tr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var br wbr img".split()
)
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
#: Start tags that end an open element of these kinds, up to the elements after the slash.
ENDS_OWN = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Parts of class, id and role names that pages give to what isn't their article, or to what is.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay cookie "
    "cookies consent gdpr notice notices alert warning newsletter subscribe subscription signup login register form search "
    "nav navbar navigation navi menu menus breadcrumb breadcrumbs crumb crumbs pagination pager toolbar header masthead "
    "topbar footer foot bottom copyright legal sidebar side aside widget widgets related recommended recommendations "
    "more also share sharing social follow comment comments commentlist reply replies respond disqus feedback rating tags "
    "tagcloud meta complementary contentinfo skip hidden toc outbrain taboola".split()
)
ARTICLE = frozenset("article main content body post entry story text prose page".split())

FEATURES = (
    "bias", "side", "control", "main", "text", "list", "inline", "other", "around", "article",
    "links: none", "links: some", "links: most", "words: 0", "words: 1-4", "words: 5-19", "words: 20+", "stops", "heading", "inside around", "footer",
)
_NAMING, _NO_NAMES = ("class", "id", "role", "aria-label", "itemprop"), frozenset()
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNFINISHED = re.compile("<[a-zA-Z/!?]")


@dataclass
class Element:
    tag: str
    parent: int
    names: frozenset[str]
    keep: str | None
    #: own text pieces: place in the page, text
    pieces: list[tuple[int, str]] = field(default_factory=list)


class Tree(HTMLParser):
    """Elements in page order, a parent before its children; open elements are closed as browsers do."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [Element("#page", -1, frozenset(), None)]
        self.open, self.at = [0], 0
        #: places in ``open`` of each tag's open elements
        self.places: dict[str, list[int]] = {"#page": [0]}
        #: block that each text piece lies in: a new one at each edge of a block element
        self.block, self.blocks = 0, []

    def _close_to(self, depth: int) -> None:
        if any(self.elements[e].tag not in INLINE for e in self.open[depth:]):
            self.block += 1
        for e in self.open[depth:]:
            self.places[self.elements[e].tag].pop()
        del self.open[depth:]

    def _last(self, kinds: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element of some kinds; 0, the page, without any."""
        return max([own[-1] for k in kinds if (own := self.places.get(k))], default=0)

    def _end_open(self, kinds: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        depth = self._last(kinds)
        if depth > self._last(until):
            self._close_to(depth)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._end_open({"p"}, {"button", "table", "td", "th", "caption", "#page"})
        if tag in ENDS_OWN:
            self._end_open(*ENDS_OWN[tag])
        if tag == "body":
            self._end_open({"head"}, frozenset())
        if tag == "br":
            self.handle_data(" ")
            return
        if tag not in INLINE:
            self.block += 1
        words, keep = _NO_NAMES, None
        if attrs:
            given = dict(attrs)
            keep = given.get("data-keep")
            names = " ".join([given.get(a) or "" for a in _NAMING if a in given])
            if names:
                words = frozenset([w.lower() for w in _NAME.findall(names)])
            if "hidden" in given:
                words |= {"hidden"}
        self.elements.append(Element(tag, self.open[-1], words, keep))
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(len(self.elements) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_data(" ")
            return
        if depth := self._last({tag}):
            self._close_to(depth)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i) and self.rawdata[i : i + 9].lower() != "<![cdata[":
            return self.parse_bogus_comment(i)  # as browsers do with any other marked section
        return super().parse_html_declaration(i)

    def handle_data(self, data: str) -> None:
        self.elements[self.open[-1]].pieces.append((self.at, data))
        self.blocks.append(self.block)
        self.at += 1


def parse(html: str) -> Tree:
    """The tree of a page; a broken page gives what can be read of it, to its end."""
    tree = Tree()
    tree.feed(html)
    if _UNFINISHED.match(tree.rawdata):  # a tag or comment that the page doesn't end
        tree.rawdata = ""
    tree.close()
    return tree


_AT = {name: j for j, name in enumerate(FEATURES)}
_KIND = {t: _AT[k] for k, tags in (("inline", INLINE), ("list", LIST), ("text", TEXT), ("main", MAIN), ("control", CONTROL), ("side", SIDE)) for t in tags}
_HEADING = frozenset(f"h{i}" for i in range(1, 7))
_OWN_WHOLE = MAIN | {"body", "html"}


def node_features(tree: Tree) -> tuple[list[list[int]], list[float], list[int], list[bool]]:
    """Of each element: its features that are 1, its stops (0 to 1), its parent, and whether it is inline."""
    e = tree.elements
    n = len(e)
    words, linked, stops = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        el = e[i]
        if el.tag in SILENT:
            words[i] = linked[i] = stops[i] = 0
            continue
        for _, own in el.pieces:
            words[i] += len(own.split())
            stops[i] += own.count(".") + own.count("!") + own.count("?") + own.count(";") + own.count(":")
        if el.tag == "a":
            linked[i] = words[i]
        if i:
            words[el.parent] += words[i]
            linked[el.parent] += linked[i]
            stops[el.parent] += stops[i]
    features, inside = [], [False] * n
    for i, el in enumerate(e):
        tag, names, w = el.tag, el.names, words[i]
        x = [0, _KIND.get(tag, _AT["other"])]
        around = article = False
        if names:
            around = tag not in _OWN_WHOLE and not names.isdisjoint(AROUND)
            article = not around and not names.isdisjoint(ARTICLE)
        if around:
            x.append(_AT["around"])
        if article:
            x.append(_AT["article"])
        if tag in _HEADING:
            x.append(_AT["heading"])
        elif tag == "footer":
            x.append(_AT["footer"])
        x.append(_AT["links: none" if not linked[i] else "links: some" if 2 * linked[i] < w else "links: most"])
        x.append(_AT["words: 0" if not w else "words: 1-4" if w < 5 else "words: 5-19" if w < 20 else "words: 20+"])
        if i and inside[el.parent]:
            x.append(_AT["inside around"])
            inside[i] = True
        elif around or tag in SIDE or tag in CONTROL:
            inside[i] = True
        features.append(x)
    return features, [min(s, 3) / 3 for s in stops], [el.parent for el in e], [el.tag in INLINE for el in e]


@dataclass
class TreeModel:
    """Unary weights for label 1 (content), and log potentials [edge kind, parent label, own label]."""

    unary: np.ndarray
    pair: np.ndarray

    def marginals(
        self, features: list[list[int]], stops: list[float], parent: list[int], inline: list[bool], edges_too: bool = False
    ) -> tuple[list[float], np.ndarray | None]:
        """P(content) of each node, and on request the joint probabilities of each edge: messages go up, then down."""
        n = len(parent)
        w, pair = self.unary.tolist(), self.pair.tolist()
        full_stop = w[_AT["stops"]]
        # own potential and the messages from below
        belief = [[0.0, sum([w[j] for j in x]) + full_stop * s] for x, s in zip(features, stops, strict=True)]
        edges = [pair[k] for k in inline]
        sent = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            (a, b), ((e00, e01), (e10, e11)) = belief[i], edges[i]
            m0, m1 = _add(e00 + a, e01 + b), _add(e10 + a, e11 + b)
            sent[i] = (m0, m1)
            top = belief[parent[i]]
            top[0] += m0
            top[1] += m1
        out = [0.0] * n
        joint = np.zeros((n, 2, 2)) if edges_too else None
        total = [[0.0, 0.0]] * n
        total[0] = belief[0]
        out[0] = _share(*belief[0])
        for i in range(1, n):
            p = parent[i]
            (a, b), ((e00, e01), (e10, e11)), (m0, m1) = belief[i], edges[i], sent[i]
            c0, c1 = total[p][0] - m0, total[p][1] - m1  # all that the parent knows but this child's message
            total[i] = [a + _add(c0 + e00, c1 + e10), b + _add(c0 + e01, c1 + e11)]
            out[i] = _share(*total[i])
            if joint is not None:
                j = np.array([[c0 + e00 + a, c0 + e01 + b], [c1 + e10 + a, c1 + e11 + b]])
                j = np.exp(j - j.max())
                joint[i] = j / j.sum()
        return out, joint


def _add(a: float, b: float) -> float:
    """log(e^a + e^b)"""
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def _share(a: float, b: float) -> float:
    return 1 / (1 + math.exp(max(-50.0, min(50.0, a - b))))


def fit_tree(pages: list[str], steps: int = 250, rate: float = 0.3, ridge: float = 0.002) -> TreeModel:
    """Maximum conditional likelihood of the labels; the gradient is what was seen less what the
    marginals expect.  Elements with ``data-keep`` 1 or 0 carry a label, and the rest their parent's."""
    data = []
    for html in pages:
        tree = parse(html)
        y = np.zeros(len(tree.elements), int)
        for i, e in enumerate(tree.elements):
            y[i] = int(e.keep) if e.keep in ("0", "1") else (y[e.parent] if i else 0)
        data.append((*node_features(tree), y))
    model = TreeModel(np.zeros(len(FEATURES)), np.zeros((2, 2, 2)))
    size = sum(len(d[-1]) for d in data)
    seen_u, seen_p = np.zeros_like(model.unary), np.zeros_like(model.pair)
    for _ in range(steps):
        gu, gp = -ridge * size * model.unary, -ridge * size * model.pair
        for features, stops, parent, inline, y in data:
            p, joint = model.marginals(features, stops, parent, inline, True)
            for x, stop, left in zip(features, stops, y - np.array(p), strict=True):
                gu[x] += left
                gu[_AT["stops"]] += stop * left
            for i in range(1, len(y)):
                gp[int(inline[i])] -= joint[i]
                gp[int(inline[i]), y[parent[i]], y[i]] += 1
        seen_u, seen_p = seen_u + gu**2, seen_p + gp**2
        model.unary = model.unary + rate * gu / (np.sqrt(seen_u) + 1e-8)
        model.pair = model.pair + rate * gp / (np.sqrt(seen_p) + 1e-8)
    return model


def extract(html: str, model: TreeModel) -> tuple[str, float]:
    """Main text of a page, and the mean marginal of the text kept (0 without any)."""
    tree = parse(html)
    p, _ = model.marginals(*node_features(tree))
    silent = [False] * len(p)
    for i, e in enumerate(tree.elements):
        silent[i] = e.tag in SILENT or (i > 0 and silent[e.parent])
    kept = sorted((at, text, p[i]) for i, e in enumerate(tree.elements) if p[i] >= 0.5 and not silent[i] for at, text in e.pieces)
    blocks: dict[int, list[str]] = {}
    for at, text, _ in kept:
        blocks.setdefault(tree.blocks[at], []).append(text)
    lines = [" ".join("".join(b).split()) for b in blocks.values()]
    sure = [q for _, text, q in kept if text.strip()]
    return "\n".join(x for x in lines if x), float(np.mean(sure)) if sure else 0.0


def extract_pages(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url, text, n_chars and confidence of every row.

    A null or empty page has an empty text, as has one without an article.  Texts aren't cut.  Rows are
    handled one by one, so copies, ties and an empty table need no rule; other columns are ignored.
    """
    shared = send(pages.sparkSession, model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = received(shared)
        for htmls in batches:
            yield pd.DataFrame([extract(h or "", model) for h in htmls], columns=["text", "confidence"])

    out = pages.select("page_id", "url", F.pandas_udf(run, "text string, confidence double")("html").alias("_x"))
    return out.select("page_id", "url", "_x.text", F.length("_x.text").cast("long").alias("n_chars"), "_x.confidence")
