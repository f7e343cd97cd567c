"""Operator 13, HTML extraction: tag-path ratios.

A page becomes blocks of text, each with the path of elements from the root to
it. Per path, text without links and punctuation are summed and divided by the
path's blocks; these ratios are smoothed over neighbouring blocks in page order
and fused with the share of text that is no link; paths whose fused score
reaches ``LIMIT`` of the scores' deviation are content. The main text is the
element that holds nearly all content, text in ``article`` or ``main`` counting
more; what in it is made of links on paths that are no content goes.

Elements whose tag, role, state or name says that they are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or comments are no
candidates. If their names alone leave a page without text, names are not used.

A page is looked at by itself, in one pass and in memory linear to its length,
so there is no shuffle, and lost tasks are simply done again.

Defined results: null and empty html give an empty text, as does a page that
has nothing but what is left out; text without any markup is one block; open
elements end as browsers end them, and unclosed comments or scripts reach to
the end; repeated rows stay; an empty table gives no rows; clashing columns are
replaced. White space is Unicode's, no-break spaces included, and so is <br>.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarn.llm import common

#: Weights of a block's neighbours at distances 0, 1 and 2.
KERNEL = (4, 2, 1)
#: Deviations of the fused scores that content reaches.
LIMIT = 0.5
#: How much more text in an article counts, the share of the content that the chosen element holds, and the share that the only article needs.
ARTICLE = 4
HOLDS = 0.9
ALONE = 0.2

#: Kinds of elements and names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("nav footer aside form script style noscript template svg button select textarea iframe object canvas audio video dialog menu head title noembed noframes datalist map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("html body div section article main center table tbody tr td".split())
#: A start tag ends open elements of the named kinds, looked for up to one of the barriers.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "option": ("option",)}
BARRIERS = frozenset("html body table ul ol dl article section div main td th caption button".split())
NO_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
OTHERS = re.compile(
    r"(ads?|adv|adbox|adslot|adunit|nav|navs|tags?|share|sharing|social|search|rail|related|login|signin|signup|popup|modal|overlay|pager|aside|skip|respond|gdpr|notices?|toc"
    r"|(advert|adsense|adsby|sponsor|promo|banner|cookie|consent|sidebar|sidenav|widget|navbar|navigation|menu|breadcrumb|header|masthead|topbar|footer|comment|disqus|repl(y|ies)|recommend|newsletter|subscri|paginat|toolbar|copyright|outbrain|taboola)[a-z]*)"
)
OWN = frozenset("article content contents post entry main story body text page section title".split())
MAYBE = frozenset("has with without no not is show hide enable enabled disable free".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>"
    r"|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MARKS = ".,;:!?…、。，；：！？"


class Element(NamedTuple):
    parent: int
    tag: str
    path: int
    out: bool  # left out
    article: bool
    link: bool


class Block(NamedTuple):
    text: str
    element: int
    chars: int
    links: int


def named_other(attributes: dict[str, str]) -> bool:
    """Whether a class or id says that an element is no content."""
    names = [NAME.findall(x) for key in ("class", "id") for x in attributes.get(key, "").split()]
    names = [[w.lower() for w in x] for x in names if x]
    if any(len(x) == 1 and x[0] in OWN for x in names):
        return False
    for x in names:
        ends = {x[0], x[-1]}
        other = [w for w in ends if OTHERS.fullmatch(w)]
        titled = other == ["header"] and ends & OWN  # post-header
        if other and not titled and not MAYBE & set(x):
            return True
    return False


def left_out(tag: str, attributes: dict[str, str], article: bool, by_name: bool) -> bool:
    if tag in LEFT_OUT or tag == "header" and not article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style", "")))
    return hidden or attributes.get("role", "").lower() in ROLES or by_name and tag != "main" and named_other(attributes)


class Page:
    """Blocks and elements of a page, read tag by tag."""

    def __init__(self, html: str, by_name: bool):
        self.elements = [Element(0, "html", 0, False, False, False)]
        self.paths: dict[tuple[int, str], int] = {}
        self.stack = [0]
        self.open: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.title = ""
        self.run: list[str] = []
        self.links = 0
        self.read(html, by_name)

    def end_block(self) -> None:
        if not self.run:
            return
        text = " ".join("".join(self.run).split())
        if text:
            at = self.stack[-1]
            while self.elements[at].tag in INLINE:
                at = self.elements[at].parent
            chars = len(text) - text.count(" ")
            self.blocks.append(Block(text, at, chars, min(self.links, chars)))
        self.run, self.links = [], 0

    def pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.elements[self.stack.pop()].tag] -= 1

    def close(self, tags: tuple[str, ...], barriers: frozenset[str]) -> bool:
        """End the innermost element of ``tags`` within the barriers, if there is one."""
        if not any(self.open.get(t) for t in tags):
            return False
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.elements[self.stack[depth]].tag
            if tag in tags:
                self.pop(depth)
                return True
            if tag in barriers:
                return False
        return False

    def start(self, tag: str, attributes: dict[str, str], by_name: bool) -> None:
        if tag in NO_PARAGRAPH:
            self.close(("p",), BARRIERS)
        while tag in ENDS and self.close(ENDS[tag], BARRIERS - frozenset(ENDS[tag])):
            pass
        up = self.elements[self.stack[-1]]
        article = up.article or tag in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody"
        out = up.out or left_out(tag, attributes, up.article, by_name)
        if tag in INLINE:
            path = up.path
        else:
            label = f"{tag}.{attributes['class']}" if tag in HOLDERS and attributes.get("class") else tag
            path = self.paths.setdefault((up.path, label), len(self.paths) + 1)
        self.elements.append(Element(self.stack[-1], tag, path, out, article, up.link or tag == "a"))
        self.stack.append(len(self.elements) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1

    def text(self, raw: str) -> None:
        top = self.elements[self.stack[-1]]
        if top.out:
            return
        if self.open.get("header") and not any(self.open.get(h) for h in HEADINGS):
            return  # of an article's header, headings only
        text = references.unescape(raw) if "&" in raw else raw
        self.run.append(text)
        if top.link:
            self.links += sum(map(len, text.split()))

    def read(self, html: str, by_name: bool) -> None:
        at, end = 0, len(html)
        while at < end:
            found = TOKEN.search(html, at)
            if not found:
                self.text(html[at:])
                break
            if found.start() > at:
                self.text(html[at : found.start()])
            at = found.end()
            closing, tag, rest = found.groups()
            if not tag:
                continue
            tag = tag.lower()
            if tag not in INLINE and tag != "br":
                self.end_block()
            if closing:
                if tag in INLINE:
                    self.close((tag,), NO_PARAGRAPH | BARRIERS)
                elif self.open.get(tag):
                    self.close((tag,), frozenset())
                continue
            if tag == "br":
                self.text(" ")
            elif tag in RAW:
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                if tag == "title" and not self.title:
                    self.title = " ".join(references.unescape(html[at : stop.start() if stop else end]).split())
                at = stop.start() if stop else end
            elif tag not in VOID:
                attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if rest.strip("/ \n") else {}
                self.start(tag, attributes, by_name)
        self.end_block()


def scores(page: Page) -> tuple[list[float], float]:
    """The fused score of each block's path, and the least of content."""
    paths = [page.elements[b.element].path for b in page.blocks]
    sums: dict[int, list[float]] = {}
    for path, b in zip(paths, page.blocks):
        s = sums.setdefault(path, [0, 0, 0, 0, 0.0])
        for k, x in enumerate((1, b.chars, b.links, sum(map(b.text.count, MARKS)))):
            s[k] += x

    def smooth(values: list[float]) -> list[float]:
        out, n = [], len(values)
        for i in range(n):
            near = range(max(i - 2, 0), min(i + 3, n))
            weights = [KERNEL[abs(i - j)] for j in near]
            out.append(sum(w * values[j] for w, j in zip(weights, near)) / sum(weights))
        most = max(out, default=0) or 1
        return [x / most for x in out]

    texts = smooth([(sums[p][1] - sums[p][2]) / sums[p][0] for p in paths])
    marks = smooth([sums[p][3] / sums[p][0] for p in paths])
    for p, t, m in zip(paths, texts, marks):
        sums[p][4] += (t * m) ** 0.5 * (1 - sums[p][2] / max(sums[p][1], 1))
    fused = [sums[p][4] / sums[p][0] for p in paths]
    mean = sum(fused) / len(fused)
    return fused, LIMIT * (sum((x - mean) ** 2 for x in fused) / len(fused)) ** 0.5


def holder(page: Page, weights: list[float]) -> int:
    """The element of the main text: from the root down, as long as one element below holds nearly all of it."""
    elements = page.elements
    held, kids, headed = [0.0] * len(elements), {}, {}
    for b, w in zip(page.blocks, weights):
        held[b.element] += w
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
        if elements[i].tag in HOLDERS and not elements[i].out:
            kids.setdefault(elements[i].parent, []).append(i)
    for b in page.blocks:
        up = elements[b.element]
        if up.tag in HEADINGS and (up.article or elements[up.parent].tag not in ("html", "body") or b.text in page.title or page.title and page.title in b.text):
            headed.setdefault(up.parent, b.element)
    at = 0
    while elements[at].tag not in ("article",):
        below = [i for i in kids.get(at, []) if held[i] > 0]
        articles = [i for i in below if elements[i].tag in ("article", "main")]
        if len(articles) == 1 and held[articles[0]] >= ALONE * held[at]:
            at = articles[0]
            continue
        best = max(below, key=lambda i: (held[i], -i), default=None)
        # A heading before an element belongs to it.
        if best is None or held[best] < HOLDS * held[at] or headed.get(at, best) < best:
            break
        at = best
    return at


def chosen(page: Page) -> list[str]:
    if not page.blocks:
        return []
    fused, least = scores(page)
    content = [f >= least and f > 0 for f in fused]
    weights = [b.chars * f * (ARTICLE if page.elements[b.element].article else 1) if c else 0.0 for b, f, c in zip(page.blocks, fused, content)]
    if not any(weights):
        weights = [float(b.chars - b.links) for b in page.blocks]
    top = holder(page, weights)
    within = [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        within[i] = i == top or i > 0 and within[e.parent]
    return [
        b.text for b, c in zip(page.blocks, content)
        if within[b.element] and (c or 2 * b.links <= b.chars or page.elements[b.element].tag in HEADINGS)
    ]


def main_text(html: str | None) -> str:
    """The page's main text, a line for each block."""
    if not html:
        return ""
    return "\n".join(chosen(Page(html, True)) or chosen(Page(html, False)))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the columns text and n_chars in place of ``html``."""
    new = (("text", T.StringType()), ("n_chars", T.LongType()))
    schema = common.with_fields(T.StructType([f for f in pages.schema.fields if f.name != html]), *new)
    keep = schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.decode("utf-8", "replace")) for x in common.utf8(b.column(html))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)


def op13_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.read(spark, sf_dir, "pages").select("page_id", "url", "html"))
