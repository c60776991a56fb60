"""Operator 8: main text of web pages.

A page is cut into flat text blocks. Each is described by its word count and link density, those of the
blocks before and after it, and where it stands: in the page's marked article or trunk (the smallest
element with most of the words), apart from it, in page furniture. A decision tree, trained on the
blocks of the small labelled pages below, tells article text from the rest. Class names only feed two of
the features, and not where the named element wraps the page's text (``sidebar-right`` on a layout).
Kept blocks are joined in page order by an empty line.

Defined results: a null or empty page, or one without article text, has the empty text; character
references are decoded; white space inside a block becomes one space; text that is not in any element
counts as a block of the body; unclosed elements end where HTML lets them end; repeated rows give
repeated results; other columns are carried through (``text`` and ``n_chars`` are replaced); an empty
table gives an empty result. Pages are read one at a time: memory follows the longest page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow

# Element names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
OPAQUE_TAGS = frozenset("script style noscript template svg math iframe object head title select option button textarea canvas audio video map".split())
#: Elements whose content is not parsed.
RAW_TAGS = frozenset("script style textarea title iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog header fieldset address".split())
#: An opening tag of the key ends an open element of these names, if that is the innermost one.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Elements that lay out a page, as against those that structure its text.
LAYOUT_TAGS = frozenset("div section article main aside".split())
#: Elements that can hold the text of a page.
TRUNK_TAGS = LAYOUT_TAGS | {"", "body", "td", "form", "center"}
# Words of class names, identifiers and labels. They only feed the features ``place`` and ``named``.
ARTICLE_WORDS = frozenset("article articlebody entry post story content main maincontent body text".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb"
    " breadcrumbs sidebar aside rail footer masthead topbar toolbar comment comments commentlist disqus reply replies discussion respond cookie"
    " cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing"
    " social related recommended recommendations widget form search pagination pager legal copyright disclaimer hidden tags byline".split()
)
NO_ARTICLE = frozenset("ad ads advert comment comments reply replies promo sponsored related recommended teaser sidebar widget".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

#: Share of the words of the marked article, or of the page, that make an element its trunk.
TRUNK = 0.6
#: Share of a page's words from which an element with the name of page furniture is only the layout around them:
#: where the name is a part of a longer one, and where it stands alone.
WRAPS = (0.5, 0.75)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "apart", "named", "heading")
#: place: 0 outside the page's marked article, 1 outside the trunk of a page that marks none, 2 in the marked article, 3 in its
#: trunk. apart: the share of the trunk's words directly in it, for blocks that stand in a layout element of their own within it.
#: named: the block stands in page furniture (an element for it, or one named so that does not wrap the page's text).
#: heading: 6 for h1 to 1 for h6, 0 for other text.
#: Labelled pages: G and R with a number are so many words of the article and of the rest. Each is read at several sizes.
LABELLED_PAGES = [
    # Marked articles: paragraphs of any length, headings, quotes, list items; menus, adverts and footers beside them.
    "<nav><ul><li><a>R1</a><li><a>R1</a><li><a>R2</a><li><a>R1</a></ul></nav><div>R9</div><article><h1>G8</h1><p>G60<p>G3<p>G25<p><a>G6</a> G30<p>G2<p>G90<p>G40</article><footer>R12</footer>",
    "<nav><a>R1</a> <a>R2</a></nav><div>R14</div><article><h1>G12</h1><p>G15<p>G4</article><footer>R7</footer>",
    "<div>R6</div><article><h1>G4</h1><p>G2<p>G120</article><footer>R20</footer>",
    "<article><p>G1<p>G2</article>",
    "<article>G150</article>",
    "<header><h1>R3</h1><p>R8</header><main><h2>G7</h2><p>G55<blockquote>G20</blockquote><p>G35<ul><li>G5<li>G8<li>G4</ul><p>G33<h3>G2</h3><p>G48</main><aside><h4>R2</h4><p>R25<p>R30</aside><footer><p>R15<p><a>R2</a> <a>R3</a></footer>",
    "<main><h1>R3</h1><article><h2>G6</h2><p>G70<p><a>G9</a><p>G44<p>G52</article><div>R3</div><div><p>R40<p>R22</div></main>",
    "<article><header><h1>G9</h1></header><p>G40<p><a>G12</a><p>G38<p>G7<p>G61</article>",
    "<article><h1>G5</h1><p>G45<p><a>G3</a><p>G2<p>G70</article><p>R30",
    "<article><h1>G6</h1><p>G10 <a>G8</a><p>G4 <a>G5</a> G3<p>G12<p><a>G2</a> G2<p>G9<p>G20 <a>G15</a><p>G3</article>",
    "<article><p>G14 <a>G12</a><p><a>G10</a> G22<p>G30 <a>G30</a><p>G5 <a>G4</a><p>G2<p>G18</article><footer>R6</footer>",
    "<article><p>G9<p><a>G6</a><p>G12<p><a>G14</a><p>G25<p>G4</article>",
    "<main><p>G3<p>G22<p><a>G3</a><p>G18<p><a>G20</a> G4<p>G16</main><div><a>R3</a></div>",
    "<article><div><h1>G3</h1></div><div><p>G38<p>G24</div></article>",
    "<article><div><h1>G2</h1><h2>G8</h2></div><div><p>G9<p>G33<p>G60</div></article>",
    "<h1>R1</h1><article><h2>G6</h2><p>G60<p>G9<p>G33</article><h2>R2</h2><p>R30",
    "<div><h1>R4</h1><h2>R7</h2></div><article><p>G40<p>G70</article><div><h2>R3</h2><p>R12</div>",
    "<div>R9</div><div><a>R1</a></div><article><p>G100<p>G60</article><div><h2>R2</h2><p>R90</div><div><h3>R1</h3><p>R30</div>",
    "<main><h1>R2</h1><article><p>G12<p>G8</article><h2>R3</h2><article class=teaser><h2>R5</h2><p>R16</article></main>",
    # Lists of links in and below articles.
    "<article><h1>G6</h1><p>G80<p>G30<ul><li><a>R5</a><li><a>R7</a><li><a>R4</a></ul></article><footer>R5</footer>",
    "<article><p>G50<p>G66<h4>R2</h4><ul><li><a>R6</a><li><a>R6</a><li><a>R9</a><li><a>R8</a></ul></article>",
    "<main><ul><li><a>R1</a><li><a>R2</a><li><a>R1</a></ul><h1>G7</h1><p>G42<p>G58<p><a>R4</a><p><a>R5</a></main>",
    "<article><p><a>R2</a> <a>R3</a> R1<h1>G9</h1><p>G100<p>G5<p>G64<p><a>R3</a> <a>R2</a></article>",
    # Paragraphs that are one link, at the start and the end of the text.
    "<article><h1>G3</h1><p><a>G12</a><p>G40<p>G22</article><ul><li><a>R5</a><li><a>R6</a></ul>",
    "<article><h2>G6</h2><p><a>G20</a><p>G18<p>G52<p><a>G14</a></article>",
    "<main><h1>G2</h1><p><a>G9</a><p>G30<p><a>G11</a><p>G44</main><div><a>R2</a> <a>R3</a></div>",
    # Furniture inside articles.
    "<article><h1>G6</h1><p class=byline>R4<div class=social><a>R1</a></div><p>G40<p>G35<div class='author-box related'>R25</div></article>",
    "<article><div class=share><a>R2</a></div><h1>G5</h1><p>G60<div class=promo><a>R6</a></div><p>G33<p>G48<div class=tags><a>R1</a> <a>R1</a></div></article>",
    "<main><h1>G4</h1><p>G51<div class=ad-slot><a>R9</a></div><p>G20<div class=newsletter>R3 <a>R4</a></div><p>G39</main>",
    "<div class=content><h1>G7</h1><div class=share><a>R1</a> <a>R2</a></div><p>G44<p>G29<div class=ads><a>R12</a></div><p>G60</div><div class=related><a>R6</a></div>",
    "<article><h1>G6</h1><p>G44<div class=ad>R12</div><p>G52<aside>R20</aside><p>G31<div class=share><a>R1</a> <a>R1</a></div><form>R6</form></article>",
    "<article><h1>G8</h1><div class=entry><p>G64<p>G12<p>G33<p>G80</div><section id=comments><h3>R2</h3><p>R30<p>R55<p>R12</section></article>",
    "<div class='layout sidebar-left'><article><h1>G5</h1><p>G30<p>G2<p>G77</article><div class=sidebar><p>R40<p>R6</div></div>",
    "<article><div><h1>G7</h1></div><div><p>G38<p>G55<p>G9<p>G61</div></article><div>R25</div>",
    "<article><h1>G4</h1><p>G90<p>G46<p>G3<p>G70<div>R18</div></article>",
    "<article><p>G60<p>G72<div>R4</div><p>G55<div>R35</div></article>",
    "<article><section><h2>G3</h2><p>G40<p>G8</section><section><h2>G4</h2><p>G52<p>G33</section><section><h2>G2</h2><p>G64</section></article>",
    "<main><div><p>G30</div><div><p>G45<p>G2</div><div><p>G51</div><div class=newsletter><p>R20</div></main>",
    # Pages that mark nothing: the trunk, what stands beside it, headings above it.
    "<div><a>R2</a> <a>R1</a> <a>R1</a></div><div><h1>G6</h1><p>G70<p>G35<p>G4<p>G50</div><div>R20</div><div>R6</div>",
    "<div>R4</div><ul><li><a>R2</a><li><a>R1</a></ul><div><h2>G5</h2><p>G48<p>G2<p>G66<p><a>G8</a><p>G40</div><div><p>R30<p>R14</div><div>R9</div>",
    "<div><h1>G2</h1></div><div><p>G40<p>G12<p>G50</div><div><h2>R1</h2><p>R30<p>R9</div>",
    "<div><h1>G4</h1></div><div><p>G12<p>G20</div><div><h4>R3</h4><p>R8</div>",
    "<div><a>R1</a></div><div><p>G90<p>G60<p>G22</div><div>R30</div><div>R8</div>",
    "<table><tr><td><a>R2</a></td></tr><tr><td><p>G110<p>G30<p>G12</td><td><h3>R2</h3><p>R26</td></tr></table>",
    "<div>R14</div><div>R3 <a>R1</a></div><div><p>G70<p>G95</div><div><h2>R3</h2><p>R20</div>",
    "<div>R3 <a>R2</a></div><div><p>G20 <a>G9</a><p>G33<p><a>G4</a> G5<p>G41<p><a>G7</a><p>G15</div><div><h3>R2</h3><ul><li><a>R4</a><li><a>R5</a></ul></div>",
    "<table><tr><td><a>R2</a><p><a>R1</a><p><a>R3</a></td><td><h2>G5</h2><p>G70<p>G45<p>G8<p>G50</td><td>R15 <a>R3</a></td></tr></table><center>R8</center>",
    "<div><h1>G7</h1></div><div><p>G55<p>G62<p>G18</div><div><h3>R2</h3><p>R22</div>",
    "<div><a>R3</a></div><div><h1>G9</h1></div><div><p>G80<p>G41<p>G5<p>G37</div><div><a>R2</a> <a>R2</a></div>",
    "<p><a>R1</a> <a>R2</a> <a>R1</a><h1>G6</h1><p>G64<p>G38<p>G3<p>G90<hr><p><a>R2</a> R3",
    "<p>G60<p>G45<p>G72<div>R11</div><p>R4 <a>R2</a>",
    "<h1>G4</h1>G120<p>G50<div>R28</div>",
    "<form><div><a>R1</a> <a>R2</a></div><div><h1>G6</h1><p>G49<p>G77<p>G21</div><div>R10</div></form>",
    "<div class='page search-on'><div><a>R2</a></div><div><h1>G3</h1><p>G58<p>G6<p>G61</div></div><div class=footer>R12</div>",
    "<div class='post has-tags'><h1>G8</h1><p>G33<p>G2<p>G47</div><div class=comments><p>R60<p>R45<p>R30</div>",
    "<div class=cookies>R40</div><div id=content><h1>G6</h1><p>G52<p>G38<ul class=menu><li>R1<li>R2</ul></div><div class=footer>R9</div>",
    # Pages without an article.
    "<nav><a>R3</a></nav><footer>R8</footer>",
    "<ul><li><a>R2</a><li><a>R3</a><li><a>R1</a><li><a>R4</a></ul>",
]


@dataclass
class Node:
    """A leaf (``feature`` is None) or a test: rows with feature <= limit go to ``low``."""

    value: float
    feature: int | None = None
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def decide(self, row: tuple) -> bool:
        node = self
        while node.feature is not None:
            node = node.low if row[node.feature] <= node.limit else node.high
        return node.value > 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 16) -> Node:
    """CART with Gini impurity; ties go to the first feature and the lowest limit."""
    node = Node(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or len(y) < 2 or y.min() == y.max():
        return node
    best = (1e-9, None, 0.0)
    base = y.mean() * (1 - y.mean())
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            p, q = y[low].mean(), y[~low].mean()
            gain = base - low.mean() * p * (1 - p) - (1 - low.mean()) * q * (1 - q)
            if gain > best[0] + 1e-12:
                best = (gain, f, limit)
    if best[1] is None:
        return node
    low = x[:, best[1]] <= best[2]
    node.feature, node.limit = best[1], float(best[2])
    node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def train(table: list | None = None) -> Node:
    table = LABELLED if table is None else table
    return grow(np.array([r for r, _ in table], float), np.array([k for _, k in table], float))


@dataclass
class Block:
    text: str
    words: int
    links: float
    heading: int
    #: The element that the block ends in.
    element: int


@dataclass
class Element:
    tag: str
    parent: int
    #: Page furniture: 1 a part of its name says so, 2 its name or a form, 3 an element or attribute that is nothing else.
    chrome: int
    #: 3 an article element, 2 main, 1 named like one.
    level: int
    opaque: bool
    #: Of h1 to h6, inherited; 0 for none.
    heading: int
    #: Within an article or main element.
    marked: int


_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|aria-label|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _element(tag: str, attributes: str, parent: int, outer: Element) -> Element:
    chrome, level = 0, 0
    if tag in CHROME_TAGS and not (tag == "header" and outer.marked > 1):
        chrome = 2 if tag in ("form", "fieldset", "address") else 3
    own = tag in ("article", "main")
    if own:
        level = 3 if tag == "article" else 2
        # An article in an article is a comment or a teaser.
        chrome = max(chrome, 2 * (outer.marked == 3))
    # Names on a page's own article say what stands beside it.
    words = CHROME_WORDS if not own or outer.marked == 3 else NO_ARTICLE
    if attributes and tag not in ("html", "body"):
        for name, *value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(value)
            if name in ("class", "id", "aria-label"):
                for token in value.split():
                    parts = {p.lower() for p in _PART.findall(token)}
                    if parts & {"has", "with", "no", "without"}:
                        continue
                    if parts & words:
                        chrome = max(chrome, 2 if len(parts) == 1 else 1)
                    elif parts & ARTICLE_WORDS:
                        level = level or 1
            elif name == "role":
                chrome = 3 if value.lower() in CHROME_ROLES else chrome
                level = {"article": 3, "main": max(level, 2)}.get(value.lower(), level)
            elif (name == "style" and _HIDDEN.search(value)) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                chrome = 3
    heading = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else outer.heading
    return Element(tag, parent, chrome, level, outer.opaque or tag in OPAQUE_TAGS, heading, max(outer.marked, level if level > 1 else 0))


@dataclass
class _Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", 0, 0, 0, False, 0, 0)])
    stack: list[int] = field(default_factory=lambda: [0])
    parts: list[tuple[str, bool]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    link: bool = False

    @property
    def top(self) -> Element:
        return self.elements[self.stack[-1]]

    def text(self, raw: str) -> None:
        if not self.top.opaque and raw:
            self.parts.append((html.unescape(raw) if "&" in raw else raw, self.link))

    def flush(self) -> None:
        """End the block that is open."""
        if self.parts:
            text = " ".join("".join(p for p, _ in self.parts).split())
            if text:
                words = len(text.split())
                linked = sum(len(p.split()) for p, link in self.parts if link)
                self.blocks.append(Block(text, words, min(1.0, linked / words), self.top.heading, self.stack[-1]))
            self.parts.clear()
        self.link = False

    def open(self, tag: str, attributes: str) -> None:
        while len(self.stack) > 1 and (self.top.tag == "p" and tag in BLOCK_TAGS or self.top.tag in ENDS.get(tag, ())):
            self.stack.pop()
        self.elements.append(_element(tag, attributes, self.stack[-1], self.top))
        self.stack.append(len(self.elements) - 1)

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.elements[self.stack[k]].tag == tag:
                del self.stack[k:]
                return


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page, in order, and its elements, each after its parent."""
    p, at, n = _Page(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            p.text(page[at:])
            break
        if lt > at:
            p.text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt)
        if m is None:
            if page.startswith(("<!", "<?", "</"), lt) or page[lt + 1 : lt + 2].isalpha():
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                p.text("<")
                at = lt + 1
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        at = m.end()
        if tag in BLOCK_TAGS or tag in OPAQUE_TAGS:
            if tag in BLOCK_TAGS:
                p.flush()
            if closing:
                p.close(tag)
            elif tag in RAW_TAGS:
                end = _RAW_END[tag].search(page, at)
                at = n if end is None else end.end()
            elif tag not in VOID_TAGS and not (attributes.endswith("/") and tag in ("svg", "math")):
                if tag == "body":
                    p.close("head")
                p.open(tag, attributes)
        elif tag == "a":
            p.link = not closing
        elif tag == "br":
            p.text(" ")
    p.flush()
    return p.blocks, p.elements


def _rise(elements: list[Element], at: dict[int, float]) -> list[float]:
    """Sums over each element and all that it holds."""
    out = [0.0] * len(elements)
    for e, x in at.items():
        out[e] = x
    for e in range(len(elements) - 1, 0, -1):
        out[elements[e].parent] += out[e]
    return out


def _inside(elements: list[Element], flag: list[bool]) -> list[bool]:
    """Whether an element or one around it has the flag."""
    out = list(flag)
    for e in range(1, len(elements)):
        out[e] = out[e] or out[elements[e].parent]
    return out


def _around(elements: list[Element], e: int | None) -> set[int]:
    """The element and all around it."""
    out = set()
    while e is not None and e not in out:
        out.add(e)
        e = elements[e].parent
    return out


def _plain(found: list[Block]) -> dict[int, float]:
    """Words outside links by element."""
    at: dict[int, float] = {}
    for b in found:
        at[b.element] = at.get(b.element, 0) + b.words * (1 - b.links)
    return at


def _furniture(found: list[Block], elements: list[Element]) -> list[bool]:
    """Elements in page furniture. A name counts only where the element does not wrap the page's text."""
    words = _rise(elements, _plain(found))
    hard = _inside(elements, [x.chrome == 3 for x in elements])
    own = [e for e, x in enumerate(elements) if x.level and not hard[e] and not (x.level > 1 and x.chrome == 2)]
    level = max((elements[e].level for e in own), default=0)
    own = [e for e in own if elements[e].level == level]
    main = max(own, key=lambda e: words[e], default=None)
    if main is not None:
        # An element of the same kind that holds nearly all of it stands for it.
        main = max(e for e in own if words[e] >= 0.8 * words[main])
        wraps = _around(elements, main)
        wide = [False] * len(elements)
    else:
        title = min((b for b in found if b.heading and not hard[b.element]), key=lambda b: b.heading, default=None)
        wraps = _around(elements, title and title.element) if title else set()
        wide = [x.chrome < 3 and words[e] >= WRAPS[x.chrome > 1] * words[0] for e, x in enumerate(elements)]
    return _inside(elements, [x.chrome > 0 and e not in wraps and not wide[e] for e, x in enumerate(elements)])


def rows(found: list[Block], elements: list[Element]) -> list[tuple]:
    """The features of each block, as in ``FEATURES``."""
    named = _furniture(found, elements)
    level = [x.level for x in elements]
    for e in range(1, len(elements)):
        level[e] = max(level[e], level[elements[e].parent])
    text = [b for b in found if not named[b.element]]
    most = max((level[b.element] for b in text), default=0)
    core = [b for b in text if level[b.element] == most]
    words = _rise(elements, _plain(core))
    trunk = max((e for e, x in enumerate(elements) if x.tag in TRUNK_TAGS and words[e] >= TRUNK * words[0]), default=0)
    within = _inside(elements, [e == trunk for e in range(len(elements))])
    layout = [0] * len(elements)
    for e in range(1, len(elements)):
        layout[e] = e if elements[e].tag in LAYOUT_TAGS or e == trunk else layout[elements[e].parent]
    direct = sum(b.words * (1 - b.links) for b in core if layout[b.element] == trunk) / max(words[trunk], 1)
    out = []
    for k, b in enumerate(found):
        around = [v for i in (k - 1, k + 1) for v in ((found[i].words, found[i].links) if 0 <= i < len(found) else (0, 0.0))]
        e = b.element
        place = (3 if within[e] else 2 if most else 1) if level[e] == most else 0
        out.append((b.words, b.links, *around, place, direct if within[e] and layout[e] != trunk else 0.0, int(named[e]), 7 - b.heading if b.heading else 0))
    return out


def labelled_rows(pages: list[str], sizes: tuple[float, ...] = (0.5, 1, 1.6)) -> list[tuple[tuple, int]]:
    """(features, label) of the blocks of the labelled pages."""
    out = {}
    for page in pages:
        for size in sizes:
            fill = lambda m, size=size: " ".join([{"G": "good", "R": "rest"}[m[1]]] * max(1, round(int(m[2]) * size)))
            found, elements = blocks(re.sub(r"\b([GR])([0-9]+)\b", fill, page))
            for b, r in zip(found, rows(found, elements), strict=True):
                out.setdefault(r, int(b.text.startswith("good")))
    return list(out.items())


LABELLED = labelled_rows(LABELLED_PAGES)


def main_text(page: str | None, tree: Node) -> str:
    found, elements = blocks(page or "")
    return "\n\n".join(b.text for b, r in zip(found, rows(found, elements), strict=True) if tree.decide(r))


def extract(pages: DataFrame, page: str = "html", table: list | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points); drop the page column."""
    tree = train(table)
    keep = [c for c in pages.columns if c not in ("text", "n_chars", page)]
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(batch.num_columns - 1)]
            cols = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "text", "n_chars"])

    return arrow(pages.select(*keep, page), extracted, schema)
