"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is read once into a flat list of text blocks. Each block has its word count and link density, those of
its neighbours, and what the markup around it says: whether it is a heading, whether it is inside an article, and
whether the elements around it are, or are named like, something else. A tree grown on the labelled table below keeps
or drops each block. The table is a list of page sketches with labelled blocks; their features are computed from
the sketches by the same code that reads pages.

Names (class, id, role, itemprop) are taken apart: a name all of whose words are boilerplate words or general ones says
boilerplate, one that also holds others is a weak sign, on which the block's own features decide. Words behind
"has", "with" or "no" say nothing. A form is boilerplate if it has controls and little other text; a form around a
whole page or article is not. Labels and lists of choices are always dropped.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page
order by one line feed. Null and empty pages have an empty text. Comments, scripts, styles and markup never
reach a block; markup that is cut off at the end of a page is dropped. What an embedded element (drawings, buttons,
media) holds is dropped up to its own end tag; the tag of one that is never closed is ignored. Formulas are text.
Repeated rows get equal texts; null page_id and url stay null. Whole pages of any length are read. An empty table gives
no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import lean

# Element names by role.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("address article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
LEAVES = BLOCKS - CONTAINERS - frozenset("br head hr html title".split())
BOILERPLATE = frozenset("nav menu aside footer dialog header address".split())
ARTICLES = frozenset("article main".split())
RAW = frozenset("script style textarea title".split())  # to the end of the page if unclosed
EMBEDDED = frozenset("noscript template svg annotation annotation-xml iframe object canvas button audio video select datalist label legend".split())
NESTED = frozenset("template svg object".split())  # may hold elements of their own name
FOREIGN = "svg"  # where "/>" ends an element
BREAKS = frozenset("title iframe object button select".split())  # embedded elements that end a block
CONTROLS = frozenset("input select textarea button".split())
# Words in names.
BOILERPLATE_WORDS = frozenset(
    "ad ads adbox adv advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion "
    "disqus dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promotion recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser teasers toc toolbar topbar widget widgets".split()
)
ARTICLE_WORDS = frozenset("article content entry main post story".split())
TITLE_WORDS = frozenset("header masthead".split())  # of an article they hold its title
GENERAL_WORDS = ARTICLE_WORDS | frozenset(
    "a above aside area bar below block body bottom box btn button buttons center col column container desktop first fixed float form global grid group head heading holder horizontal icon icons id inline inner item items js large last "
    "layout left link links list mobile module more nest of on outer page panel posts primary region right row secondary section sections site slot small sticky stories text the title to top unit vertical view wrap wrapper".split()
)
SILENCING_WORDS = frozenset("has with without no not is".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"']+/\Z")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = frozenset(("class", "id", "role", "itemprop"))
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "boilerplate", "heading")

# The labelled table, a page sketch a line. "+n" stands for n words of main text, "-n" for n other words.
LABELLED = """
<nav><ul><li><a>-1</a><li><a>-1</a><li><a>-2</a></ul></nav><article><h1>+9</h1><p>+45<p>+60<p>+12<p>+3</article><footer>-9 <a>-2</a></footer>
<header><a>-2</a> -4</header><nav><a>-1</a> <a>-1</a> <a>-1</a></nav><div class="ad">-6</div><article><header><h1>+7</h1></header><p>+1<p>+300<p>+30 <a>+9</a><p>+2<ul><li>+5<li>+3</ul></article><footer>-40</footer>
<div class="cookie-notice"><p>-30</div><article><h2>+4</h2><p>+25<blockquote>+18</blockquote><div class="ad">-12</div><p>+40<aside><p>-35</aside><p>+6</article><div id="sidebar"><p>-50<p>-20</div><footer>-8</footer>
<article><h1>+6</h1><p>+80<h2>+1</h2><ul><li><a>+8</a><li><a>+5</a><li><a>+11</a><li><a>+4</a></ul></article><footer><a>-2</a> -3</footer>
<article><p>+20<p>+30 <a>+20</a><p>+8 <a>+6</a><p>+5 <a>+1</a> +5<ul><li><a>-1</a><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul></article><p>-7
<article><h1>+4</h1><section><p>+60<p>+9</section><section class="comments"><p>-45<p>-9<p>-70</section></article><section id="comments"><h3>-2</h3><p>-60<p>-5</section>
<main><h1>+5</h1><p>+50<div class="share-buttons"><a>-1</a> <a>-1</a></div><p>+35<div class="related-posts"><h3>-2</h3><p><a>-7</a><p><a>-9</a></div></main><aside><h4>-2</h4><p>-33</aside><p>-12<p>-55
<article><p>+4</article><p>-30<div><p>-5<p><a>-3</a></div>
<div class="story"><h1>+5</h1><p>+40<p>+3</div><div><p>+70<p>+35</div><div class="footer"><p>-40</div>
<div class="menu"><a>-1</a> <a>-1</a></div><div id="content"><h1>+8</h1><p>+30<p>+2<p>+18 <a>+3</a></div><div class="sidebar"><h3>-2</h3><p>-25<ul><li><a>-4</a><li><a>-5</a></ul></div><div id="footer">-11 <a>-1</a></div>
<ul><li><a>-1</a><li><a>-1</a></ul><h1>+5</h1><p>+35<p>+60<p>+7<p>+45<div class="footer">-25</div>
<ul><li><a>-1</a><li><a>-2</a><li><a>-1</a><li><a>-3</a></ul><h1>+7</h1><p>+22<h2>+3</h2><p>+28 <a>+6</a><p>+14<p>+50<p>-3 <a>-6</a>
<p>+3
<p>+1
<p>+9
<h1>+6</h1><p>+11
<h1>+2</h1><p>+4<p>+5
<p>+8<p>+6<p>+5<p>+12
<a>-1</a> <a>-2</a> <a>-1</a><p>+16<p>+20 <a>+5</a><p>+18<p>+3<a>-2</a> <a>-2</a>
<h3>-2</h3><ul><li><a>-4</a><li><a>-6</a><li><a>-9</a><li><a>-14</a></ul><h3>-2</h3><ul><li><a>-5</a><li><a>-12</a></ul>
<p><a>-12</a><p><a>-14</a> -2<p><a>-30</a> -3<p><a>-30</a>
<h1>+4</h1><p>+90<table><tr><td>+3<td>+2<tr><td>+4<td>+1</table><p>+25<p>-2 <a>-3</a><ul><li><a>-1</a><li><a>-2</a></ul>
<div>+400</div><p><a>-1</a><p><a>-1</a>
<div class="cookie-recipes"><h2>+3</h2><p>+45<p>+30<p>+6</div><div class="cookie-banner"><p>-20</div>
<section class="social-history"><p>+55<p>+18</section><div class="social-follow-us"><a>-1</a> <a>-3</a> <a>-2</a></div><div class="subscribe-today"><p>-6</div>
<article><section class="search-for-truth"><p>+40<p>+5<p>+22</section><div class="share-this-now"><a>-2</a> <a>-1</a></div></article>
<form><input><input><p>-8<p>-25</form><h1>+6</h1><p>+40<p>+20<form><input><button>x</button>-3</form>
<form><article><h1>+5</h1><p>+60<p>+9</article></form><footer>-20</footer>
<form><h1>+5</h1><p>+60<p>+40<p>+9<input></form><div class="footer">-9</div>
<header><h1>-3</h1><p>-12</header><h2>+5</h2><p>+44<p>+16<footer><p>-30</footer>
<div><a>-1</a> <a>-1</a> <a>-2</a> <a>-1</a> <a>-2</a></div><h1>+5</h1><p>+40<p>+12<p>+4
<div><a>-2</a> <a>-3</a> <a>-2</a> <a>-1</a> <a>-2</a> <a>-3</a></div><p>+30<p>+9<p>+25<div><a>-3</a> <a>-4</a> <a>-5</a></div>
<p><a>-9</a><p>+18<p>+50<p>+6<p><a>-8</a><p><a>-11</a>
<a>-6</a> <a>-5</a> <a>-9</a><h2>+6</h2><p>+70<p>+2<p>+33<h2>-2</h2><p><a>-7</a><p><a>-6</a><p><a>-9</a>
<article><h1>+6</h1><p><a>+12</a><p>+3<p>+50<h2>+2</h2><p><a>+10</a><p>+4<h3>+3</h3><ul><li><a>+6</a><li><a>+9</a></ul><p>+5</article>
<article><p>+2<p><a>+7</a><p>+1<p><a>+4</a><p>+6</article><p>-3<p><a>-2</a>
<div class="story"><h2>+2</h2><p><a>+5</a><p>+4<p>+55</div><p>-2 <a>-4</a><p><a>-3</a>
<div class="content"><p>+30<h2>+1</h2><ol><li><a>+8</a><li>+3 <a>+6</a><li><a>+14</a></ol></div><div><a>-2</a> <a>-2</a> <a>-1</a></div>
<h1>+3</h1><p>+25<h2>+4</h2><p>+31<h3>-3</h3><ul><li><a>-5</a><li><a>-4</a><li><a>-6</a></ul><p>-2
"""


@dataclass
class Node:
    """A leaf holds ``keep``; an inner node sends values up to ``at`` of ``feature`` to ``low``."""

    keep: bool
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Node:
    """A binary tree by Gini impurity; ties go to the earlier feature and the lower threshold."""
    node = Node(bool(2 * y.sum() > len(y)))
    if depth == 0 or y.min() == y.max():
        return node
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= at
            impurity = sum(m.sum() * (p := y[m].mean()) * (1 - p) for m in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, at)
    if best is None:
        return node
    _, node.feature, node.at = best
    low = x[:, node.feature] <= node.at
    node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def labelled_blocks(table: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the sketches."""
    x, y = [], []
    for line in table.strip().splitlines():
        page = re.sub(r"([+-])(\d+)", lambda m: " ".join([{"+": "kept", "-": "gone"}[m[1]]] * int(m[2])), line)
        found = blocks(page)
        x += features(found)
        y += [b.text.startswith("kept") for b in found]
    return np.array(x, float), np.array(y, float)


def train(labelled: str = LABELLED) -> Node:
    return grow(*labelled_blocks(labelled))


def decide(node: Node, values: tuple) -> bool:
    while node.low is not None:
        node = node.low if values[node.feature] <= node.at else node.high
    return node.keep


@dataclass
class Form:
    """What is known of a form when the page has been read."""

    words: int = 0
    controls: int = 0
    article: bool = False

    @property
    def boilerplate(self) -> bool:
        return self.controls > 0 and not self.article and self.words <= 40 * self.controls


@dataclass
class Around:
    """What the open elements say: boilerplate 0, 0.5 or 1; article 0, 0.5 (by name) or 1 (by element)."""

    element: str = ""
    boilerplate: float = 0
    article: float = 0
    form: Form | None = None


@dataclass
class Block:
    text: str
    words: int
    links: float
    heading: bool = False
    around: Around = field(default_factory=Around)

    @property
    def boilerplate(self) -> float:
        return 1 if self.around.form and self.around.form.boilerplate else self.around.boilerplate


def attributes(attrs: str) -> dict[str, str]:
    """Names in lower case and values, in order; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), a or b or c)
    return out


def _says(name: str) -> tuple[float, bool]:
    """What one name says: boilerplate (0, 0.5, 1) and article."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[0] in SILENCING_WORDS:
        return 0, False
    known = BOILERPLATE_WORDS.intersection(words)
    if not known:
        return 0, bool(ARTICLE_WORDS.intersection(words)) and GENERAL_WORDS.issuperset(words)
    if known <= TITLE_WORDS and ARTICLE_WORDS.intersection(words):
        return 0, False
    return (1 if (BOILERPLATE_WORDS | GENERAL_WORDS).issuperset(words) else 0.5), False


def _inside(above: Around, element: str, attrs: str) -> Around:
    """What holds inside an element."""
    boilerplate, article = 0.0, False
    values = attributes(attrs) if attrs and element not in ("html", "body") else {}
    if values:
        if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(values.get("style", "")):
            return Around(element, 1, 0, above.form)
        said = [_says(x) for k in _NAMES if k in values for x in values[k].split()]
        boilerplate, article = max((b for b, _ in said), default=0.0), any(a for _, a in said)
        if above.article and boilerplate == 1 and all(TITLE_WORDS.issuperset(w.lower() for w in _WORDS.findall(x)) for k in _NAMES if k in values for x in values[k].split() if _says(x)[0]):
            boilerplate = 0  # the header of an article
        if article and boilerplate:
            boilerplate, article = 0, False
    if element in BOILERPLATE and not (element == "header" and above.article):
        boilerplate = 1
    if element in ARTICLES and boilerplate < 1:
        inside = 1.0
    else:
        inside = max(above.article, 0.5 * article)
    return Around(element, max(boilerplate, above.boilerplate), inside, above.form)


def _markup(page: str) -> tuple[list[tuple[int, int, str, bool, str]], dict[int, int]]:
    """All markup in order (start, end, name, whether an end tag, attributes), a raw element as one; and by the
    number of an embedded element's start tag the number of its end tag, if it has one."""
    found: list[tuple[int, int, str, bool, str]] = []
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {name: [] for name in EMBEDDED}
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        name, end, attrs = (m["name"] or "").lower(), m["end"] == "/", m["attrs"] or ""
        if name in EMBEDDED or name in RAW:
            foreign = name == FOREIGN or waiting[FOREIGN]
            empty = foreign and attrs.endswith("/") and not _UNQUOTED_SLASH.search(attrs)
            if name in RAW:
                if not end and not empty:
                    stop = _RAW_END[name].search(page, at)
                    at = stop.end() if stop else len(page)
            elif end:
                if waiting[name]:
                    ends[waiting[name].pop()] = len(found)
            elif not empty:
                if name not in NESTED:
                    waiting[name].clear()
                waiting[name].append(len(found))
        found.append((m.start(), at, name, end, attrs))
    return found, ends


class _Reader:
    """Gathers text into blocks while the markup goes by."""

    def __init__(self):
        self.out: list[Block] = []
        self.stack = [Around()]
        self.texts: list[str] = []
        self.link = self.heading = False
        self.linked = 0
        self.leaf: Around | None = None

    def text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.texts.append(text)
            if self.link:
                self.linked += len(text.strip())

    def close(self) -> None:
        words = "".join(self.texts).split()
        self.texts.clear()
        if words:
            text, around = " ".join(words), self.leaf or self.stack[-1]
            self.out.append(Block(text, len(words), min(1.0, self.linked / len(text)), self.heading, around))
            if around.form:
                around.form.words += len(words)
        self.linked = 0

    def tag(self, name: str, end: bool, attrs: str) -> None:
        form = self.stack[-1].form
        if form and not end and name in CONTROLS and attributes(attrs).get("type", "").lower() != "hidden":
            form.controls += 1
        if name in EMBEDDED or name in RAW and not end:
            if name in BREAKS:
                self.close()
        elif name == "a":
            self.link = not end
        elif name in BLOCKS:
            self.close()
            self.leaf = None
            if name in CONTAINERS:
                self.link = False
                self._container(name, end, attrs)
            elif name in LEAVES and attrs and not end:
                self.leaf = _inside(self.stack[-1], name, attrs)
            self.heading = not end and len(name) == 2 and name[0] == "h" and name[1].isdigit()
            if form and name == "h1":
                form.article = True

    def _container(self, name: str, end: bool, attrs: str) -> None:
        if end:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].element == name:
                    del self.stack[i:]
                    break
            return
        around = _inside(self.stack[-1], name, attrs)
        if name == "form":
            around.form = Form()
        elif around.form and name in ARTICLES:
            around.form.article = True
        self.stack.append(around)


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page in order."""
    reader = _Reader()
    markup, ends = _markup(page)
    at = k = 0
    while k < len(markup):
        start, stop, name, end, attrs = markup[k]
        reader.text(page[at:start])
        if k in ends:
            k = ends[k]
            stop = markup[k][1]
        at, k = stop, k + 1
        if name:
            reader.tag(name, end, attrs)
    reader.text(page[at:])
    reader.close()
    return reader.out


def features(found: list[Block]) -> list[tuple]:
    """The features of each block. article: 1 inside, -1 outside on a page with an element that says so, else 0."""
    there = any(b.around.article == 1 and b.boilerplate < 1 for b in found)
    edge = Block("", 0, 0.0)
    out = []
    for before, b, after in zip([edge, *found], found, [*found[1:], edge], strict=False):
        article = 1 if b.around.article else -1 if there else 0
        out.append((b.words, b.links, before.words, before.links, after.words, after.links, article, b.boilerplate, int(b.heading)))
    return out


def extract(tree: Node, page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, values in zip(found, features(found), strict=True) if decide(tree, values))


def _extract(tree: Node) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(tree, page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, labelled: str = LABELLED) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(lean(_extract(train(labelled))), "page_id long, url string, text string, n_chars long")
