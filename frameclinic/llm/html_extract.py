"""Main text of web pages: flat text blocks, judged by a decision tree on the words and links of a block and its neighbours."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from frameclinic.llm.common import tidy

# Elements whose content is no text, elements without content, elements that do not end a block.
SILENT = "script style noscript template title textarea select option svg math iframe object canvas audio video button head"
VOID = "area base br col embed hr img input link meta param source track wbr"
INLINE = (
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var big acronym wbr img"
)
# Elements and words of class, id and role that name a part of the page.
BOILER_TAGS = "nav footer aside form menu dialog fieldset"
BOILER_WORDS = (
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs toolbar sidebar aside side related recommended trending popular widget share sharing social tags cookie cookies "
    "consent notice gdpr newsletter subscribe signup popup modal overlay alert disclaimer comment comments reply replies respond discussion "
    "disqus footer copyright legal colophon pagination pager login search form skip complementary contentinfo dialog"
)
#: Side parts in which an article element is a teaser or a reply, never the page's own article.
CLOSED_TAGS = "nav footer aside menu dialog"
HEADER_WORDS = "header masthead topbar"
MAIN_TAGS = "article main"
MAIN_WORDS = "article content post entry main story body text"

_SILENT, _VOID, _INLINE = set(SILENT.split()), set(VOID.split()), set(INLINE.split())
_BOILER_TAGS, _BOILER, _HEADER = set(BOILER_TAGS.split()), set(BOILER_WORDS.split()), set(HEADER_WORDS.split())
_CLOSED = set(CLOSED_TAGS.split())
_MAIN_TAGS, _MAIN = set(MAIN_TAGS.split()), set(MAIN_WORDS.split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+>",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# A small labelled table. Columns: words, share of linked words, the same for the block before and the block after,
# place (1: in the page's main part, -1: outside it, 0: the page names none), whether a named side part holds it, and
# the label (1: main text). Blocks and neighbours are typical ones: single words, captions, menu entries, paragraphs.
_BLOCKS = [(1, 0.0), (2, 1.0), (5, 0.0), (5, 0.2), (8, 0.6), (12, 0.0), (18, 0.1), (25, 0.3), (30, 0.8), (60, 0.0), (150, 0.05)]
_NEIGHBOURS = [(0, 0.0), (2, 1.0), (6, 0.0), (30, 0.0), (45, 0.2), (80, 0.0)]


def _label(block, before, after, place: int, side: int) -> int:
    """Side parts and what stands outside a named main part is not main text, what stands in it is; else prose counts:
    long blocks with few links, and short ones beside prose."""
    if side or place < 0:
        return 0
    if place > 0:
        return 1
    prose = any(n >= 25 and links < 0.3 for n, links in (before, after))
    return int(block[1] < 0.35 and (block[0] >= 15 or prose))


TRAINING = [
    (*block, *before, *after, place, side, _label(block, before, after, place, side))
    for block in _BLOCKS
    for before in _NEIGHBOURS
    for after in _NEIGHBOURS
    for place, side in ((1, 0), (1, 1), (0, 0), (0, 1), (-1, 0), (-1, 1))
]


@dataclass
class Tree:
    """A decision tree on yes/no splits of numbers, grown until its leaves are pure."""

    feature: list[int] = field(default_factory=list)
    limit: list[float] = field(default_factory=list)
    below: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)

    def grow(self, x: np.ndarray, y: np.ndarray) -> int:
        """Adds the node for the rows, by the split of least weighted Gini impurity; returns its number."""
        node = len(self.label)
        for part in (self.feature, self.below, self.above):
            part.append(-1)
        self.limit.append(0.0)
        self.label.append(int(2 * y.sum() >= len(y)))
        best = None
        for f in range(x.shape[1]) if 0 < y.sum() < len(y) else ():
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= cut
                impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, cut
        if best is not None:
            _, self.feature[node], self.limit[node] = best
            low = x[:, self.feature[node]] <= self.limit[node]
            self.below[node] = self.grow(x[low], y[low])
            self.above[node] = self.grow(x[~low], y[~low])
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, limit, below, above = map(np.array, (self.feature, self.limit, self.below, self.above))
        node = np.zeros(len(x), np.int64)
        while (inner := feature[node] >= 0).any():
            at = np.flatnonzero(inner)
            n = node[at]
            node[at] = np.where(x[at, feature[n]] <= limit[n], below[n], above[n])
        return np.array(self.label)[node]


def train() -> Tree:
    rows = np.array(TRAINING, np.float64)
    tree = Tree()
    tree.grow(rows[:, :-1], rows[:, -1])
    return tree


def _part(tag: str, rest: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element opens a side part, and whether it opens the main part."""
    words = {w for m in _NAMES.finditer(rest) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())} if rest else set()
    side = tag in _BOILER_TAGS or bool(words & _BOILER) or (not in_main and (tag == "header" or bool(words & _HEADER)))
    if tag in ("html", "body"):
        return False, False
    return side, tag in _MAIN_TAGS or (not side and bool(words & _MAIN))


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """The page's text blocks in order: text, words, linked words, in a main part, in a side part.

    A block ends at every tag that is not inline; comments, scripts, styles and other silent elements are left out;
    an unclosed one reaches to the end. Text is unescaped and its white space made single spaces. The page's first
    article or main element is no side part for the names of what wraps it (a page-wide form, a layout with a side bar).
    """
    out: list[tuple[str, int, int, int, int]] = []
    stack: list[tuple[str, int, bool]] = []  # element, change of side, main
    text: list[str] = []
    linked: list[str] = []
    in_link = 0
    side = main = 0
    met = False

    def close() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                n = min(len(words), len(html.unescape(" ".join(linked)).split())) if linked else 0
                out.append((" ".join(words), len(words), n, int(main > 0), int(side > 0)))
            text.clear()
            linked.clear()

    def add(part: str) -> None:
        if part:
            text.append(part)
            if in_link:
                linked.append(part)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            add(" ")
        elif tag in _SILENT and tag != "head":
            if not m["close"] and not (m["rest"] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            if tag not in ("button", "svg", "math"):
                close()
        elif tag == "a":
            in_link = 0 if m["close"] else 1
        elif tag in _INLINE:
            continue
        else:
            close()
            if m["close"]:
                in_link = 0
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        side -= sum(x[1] for x in stack[k:])
                        main -= sum(x[2] for x in stack[k:])
                        del stack[k:]
                        break
            elif tag not in _VOID and not (m["rest"] or "").endswith("/"):
                if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                    side -= stack[-1][1]
                    main -= stack[-1][2]
                    stack.pop()
                s, k = _part(tag, m["rest"], main > 0)
                if tag in _MAIN_TAGS and not s:
                    if side and not met and not any(x[0] in _CLOSED for x in stack):
                        s = -side
                    met = met or side + s == 0
                stack.append((tag, s, k))
                side += s
                main += k
    close()
    return out


def main_text(found: list[tuple[str, int, int, int, int]], tree: Tree) -> str:
    """The blocks that the tree takes for main text, joined by single spaces."""
    if not found:
        return ""
    words = np.array([b[1] for b in found], np.float64)
    links = np.array([b[2] for b in found]) / words
    inside = np.array([b[3] for b in found])
    place = np.where(inside, 1, -1) if (inside & ~np.array([b[4] for b in found], bool)).any() else np.zeros(len(found))
    around = [np.concatenate([[0], v[:-1]]) for v in (words, links)] + [np.concatenate([v[1:], [0]]) for v in (words, links)]
    good = tree.predict(np.stack([words, links, *around, place, [b[4] for b in found]], axis=1))
    return " ".join(b[0] for b, g in zip(found, good) if g)


def _extracted(keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = train()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(blocks(h or ""), tree) for h in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[*keep, "text", "n_chars"],
                )

    return run


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and the main text of every row of ``pages`` (html), with its code points as n_chars.

    A null or empty page, and one without main text, gives an empty text. Broken markup never fails: stray and
    unclosed tags end blocks as they come. Repeated rows are judged alike; pages are not moved between tasks.
    """
    rows = pages.select(*keep, pages["html"].alias("__html"))
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return rows.mapInArrow(tidy(_extracted(keep)), T.StructType([*rows.select(*keep).schema.fields, *new]))
