"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf path of block elements. Each path has a
ratio of text length to nodes and one of punctuation to nodes; their product is smoothed over
neighbouring nodes in page order and weighed by what else is known of the path: the share of
its text outside links, and its marks (below). Scores are fused over the container that the
paths lie in, their parent path. The container that is best for its length is the anchor;
paths of containers that score half of it or more are content, and so are those of
containers nested in content, unless they are marked otherwise or mostly links.

Marks are weights, not verdicts: `article`, `main` and such roles multiply a score by
`FAVOUR`; elements, roles and a few class names that stand for navigation, notices, forms,
adverts or comments by `DISFAVOUR`. What is never shown (scripts, styles, hidden elements)
is no text node.

Text: character references decoded; white space inside a block becomes one space; blocks are
trimmed, empty ones left out, the rest joined by one newline. A line break ends a block.
A null, empty or text-free page has the empty text; a null page_id stays null. Unclosed elements
end where their parents do, and a page cut short ends there. Elements may be nested to any
depth: paths are numbered, so time and memory grow with the page's length. Repeated rows stay;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, column, table, tidied

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")
_TOKEN = re.compile(r"[a-z0-9]+")

# Element names of HTML by what they do to text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split()
)
_HIDDEN = frozenset("head script style template noscript svg math canvas object iframe audio video map title noembed noframes datalist".split())
_CHROME = frozenset("nav aside footer form button select textarea input dialog menu fieldset optgroup option label".split())
_CONTENT = frozenset("article main".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
_CHROME_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead
    comment comments cookie cookies consent notice newsletter subscribe popup""".split()
)
_ENDS_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav
    ol p pre section table ul""".split()
)
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


#: What marks multiply a score by; the share of the anchor's score that content has; the least share of text outside links of nested content.
FAVOUR, DISFAVOUR = 64.0, 0.02
LEAST = 0.5
UNLINKED = 0.5


class Element(NamedTuple):
    name: str
    path: int
    weight: float
    link: bool
    shown: bool


class Node(NamedTuple):
    """A block of text."""

    path: int
    text: str
    linked: int


class Page:
    """A page's blocks of text in order, and its paths: the parent and the weight of each."""

    def __init__(self, html: str):
        self.nodes: list[Node] = []
        self.parents, self.weights = [0], [1.0]
        self._numbers: dict[tuple[int, str, float], int] = {}
        self._stack = [Element("", 0, 1.0, False, True)]
        self._open: Counter[str] = Counter()
        self._held: list[str] = []
        self._linked = 0
        self._read(html)

    def _path(self, parent: int, name: str, weight: float) -> int:
        """The number of a path; elements of one name that are marked differently have different paths."""
        key = (parent, name, weight)
        if key not in self._numbers:
            self._numbers[key] = len(self.parents)
            self.parents.append(parent)
            self.weights.append(weight)
        return self._numbers[key]

    def _hold(self, text: str) -> None:
        if text and self._stack[-1].shown:
            self._held.append(text)
            if self._stack[-1].link:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._held:
            text = " ".join(unescape("".join(self._held)).split())
            if text:
                self.nodes.append(Node(self._stack[-1].path, text, min(self._linked, len(text))))
            self._held.clear()
        self._linked = 0

    def _push(self, element: Element) -> None:
        self._stack.append(element)
        self._open[element.name] += 1

    def _pop_to(self, names: Collection[str], stop: Collection[str]) -> None:
        """Close the innermost element of these names, unless one to stop at comes first."""
        if not any(self._open[x] for x in names):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].name in names:
                for e in self._stack[i:]:
                    self._open[e.name] -= 1
                del self._stack[i:]
                return
            if self._stack[i].name in stop:
                return

    def _close(self, name: str) -> None:
        if name == "p" and not self._open["p"]:
            self._flush()
        elif name not in _INLINE:
            self._flush()
            self._pop_to({name}, ())
        else:
            self._pop_to({name}, _ENDS_P)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _MARKUP.search(html, at)
            if m is None:
                self._hold(html[at:])
                break
            self._hold(html[at : m.start()])
            at = m.end()
            if m["cdata"]:
                self._hold(m["cdata"].replace("&", "&amp;"))
            name = m["name"] or m["name2"]
            if not name:
                continue
            name = name.lower()
            if m["close"] or m["close2"]:
                self._close(name)
                continue
            if name == "br" or name not in _INLINE:
                self._flush()
            if name in _VOID:
                continue
            if name in _ENDS_P:
                self._pop_to({"p"}, {"table", "td", "th", "button", "object"})
            if name in _IMPLIED:
                self._pop_to(*_IMPLIED[name])
            top = self._stack[-1]
            weight, shown = _marks(name, m["attributes"] or m["attributes2"] or "", top)
            if name in _RAW:
                # Their content is no markup, and none of them holds the text of an article.
                close = _raw_end(name).search(html, at)
                end = html.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else n
            elif name in _INLINE:
                if weight != top.weight or shown != top.shown:
                    self._flush()
                path = top.path if weight == top.weight else self._path(top.path, name, weight)
                self._push(Element(name, path, weight, top.link or name == "a", shown))
            else:
                self._push(Element(name, self._path(top.path, name, weight), weight, top.link, shown))
        self._flush()


@functools.cache
def _raw_end(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def _marks(name: str, attributes: str, top: Element) -> tuple[float, bool]:
    """An element's weight, and whether it is shown. Marks add to the parent's, each kind once."""
    shown = top.shown and name not in _HIDDEN
    favoured, other = top.weight == FAVOUR, top.weight < 1
    content = name in _CONTENT
    # A header inside the article is the article's own.
    chrome = name in _CHROME or (name == "header" and not favoured)
    if attributes and not attributes.isspace():
        values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        role = values.get("role", "").lower()
        content |= role in ("main", "article")
        chrome |= role in _CHROME_ROLES
        if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
            shown = False
        if name not in ("html", "body", "article", "main"):
            chrome |= not _CHROME_NAMES.isdisjoint(_TOKEN.findall(f"{values.get('class', '')} {values.get('id', '')}".lower()))
    if other or chrome:
        return DISFAVOUR, shown
    return (FAVOUR if favoured or content else 1.0), shown


def path_ratios(nodes: list[Node]) -> dict[int, float]:
    """Of each path: text length a node, times one more than its punctuation a node."""
    text, punctuation, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in nodes:
        text[x.path] += len(x.text)
        punctuation[x.path] += len(_PUNCTUATION.findall(x.text))
        count[x.path] += 1
    return {p: text[p] / count[p] * (1 + punctuation[p] / count[p]) for p in text}


KERNEL = np.array([0.054, 0.242, 0.408, 0.242, 0.054])


def select(page: Page) -> list[str]:
    """Texts of the content nodes."""
    nodes = page.nodes
    if not nodes:
        return []
    ratios = path_ratios(nodes)
    smooth = np.convolve(np.pad([ratios[x.path] for x in nodes], 2, mode="edge"), KERNEL, mode="valid")
    length, linked, fused = defaultdict(int), defaultdict(int), defaultdict(float)
    for x in nodes:
        linked[x.path] += x.linked
        length[x.path] += len(x.text)
    unlinked = {p: 1 - linked[p] / length[p] for p in length}
    # A container is a parent path under one weight: marked paths don't speak for their neighbours.
    container = {p: (page.parents[p], page.weights[p]) for p in ratios}
    size, loose = defaultdict(int), defaultdict(float)
    for x, score in zip(nodes, smooth, strict=True):
        c, n = container[x.path], len(x.text)
        fused[c] += score * n * page.weights[x.path] * (0.1 + 0.9 * unlinked[x.path])
        loose[c] += n * unlinked[x.path]
        size[c] += n
    score = {c: fused[c] / size[c] for c in fused}
    anchor = max(score, key=lambda c: (score[c] * size[c] ** 0.5, -c[0], c[1]))
    chosen = {c for c, v in score.items() if v >= LEAST * score[anchor]}
    # Content reaches down the paths; a parent's number is less than its children's.
    within: list[float | None] = [None] * len(page.parents)
    for p in range(len(page.parents)):
        weight = page.weights[p]
        above = within[page.parents[p]] if p else None
        within[p] = weight if (p, weight) in chosen else above if above is not None and weight >= above else None
    for c in score:
        if within[c[0]] is not None and c[1] >= within[c[0]] and loose[c] >= UNLINKED * size[c]:
            chosen.add(c)
    return [x.text for x in nodes if container[x.path] in chosen]


def main_text(html: str | None) -> str:
    return "\n".join(select(Page(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [main_text(x) for x in column(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
