"""Main text of web pages: flat blocks, their words and link densities and those of their neighbours, and a decision tree.

A page is read once, tag by tag, into flat blocks of text: the text between two tags that begin or end a block. Each block knows
its words, how many of them are in links, whether one of the elements around it says that it is no part of the main text
(navigation, asides, forms, names as ``ad`` or ``comments``), and whether one says that it is (``article``, ``main``). A block and
the two beside it make one row of features, and a tree trained on the small table of ``blocks_labelled`` decides. Where the tree
decides, and not a fixed rule, pages without telling elements are split by words and links alone.

Everything is work within a page: there is no shuffle, and time and memory grow with the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.blocks_labelled import LABELLED
from reviewlake.llm.common import batches_by_size, table

# Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead title tr ul".split()
)
# Blocks whose end tag is often left out: what they say holds up to the next beginning or end of a block.
LOOSE = frozenset("p li dd dt tr td th thead tbody tfoot option optgroup colgroup caption h1 h2 h3 h4 h5 h6 hr col".split())
# Elements whose content is no markup, and no text to read.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Elements with markup inside, of which nothing is read as main text.
UNREAD = frozenset("select button svg math object noscript template datalist audio video canvas map".split())
ASIDE = frozenset("nav aside footer form menu dialog fieldset search".split())
MAIN = frozenset("article main".split())
# Parts of class, id and role values.
NAMES = frozenset(
    "ad ads adv advert advertisement advertising adbox adsense sponsor sponsored promo promotion promoted banner popup modal overlay"
    " nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside"
    " complementary contentinfo rail widget widgets related recommended recommendations share sharing social follow comment comments"
    " disqus respond reply replies cookie cookies consent gdpr notice notices notification alert alertdialog newsletter subscribe"
    " subscription signup login search form tags skip toolbar copyright legal disclaimer".split()
)
_MAIN_NAMES = frozenset("article articlebody main".split())
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_END = re.compile(r">|=\s*([\"'])")
_SAYS = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDES = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_CLOSES = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in RAW}
ASIDE_FLAG, MAIN_FLAG = 1, 2


class Block(NamedTuple):
    """A flat block: its text, words, words in links, what the elements around it say, and whether it is a heading."""

    text: str
    words: int
    linked: int
    says: int
    heading: bool


def _aside_name(word: str, around: int) -> bool:
    """Whether one word of a class, id or role names no part of the main text; ``with-sidebar`` names what it lies beside."""
    parts = [p.lower() for p in _PARTS.findall(word)]
    if not parts or parts[0] in ("has", "with", "without", "no", "non") or (around & MAIN_FLAG and parts[-1] == "header"):
        return False
    return not NAMES.isdisjoint(parts)


def says(name: str, attributes: str, around: int) -> int:
    """What an element says of the text inside, given what those around it say: ``ASIDE_FLAG``, ``MAIN_FLAG``, both or none."""
    out = around
    if name in ASIDE or name in UNREAD or (name == "header" and not around & MAIN_FLAG):
        out |= ASIDE_FLAG
    if name in MAIN:
        out |= MAIN_FLAG
    if attributes and not attributes.isspace():
        for key, a, b, c in _SAYS.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDES.search(value)):
                out |= ASIDE_FLAG
            elif key in ("class", "id", "role"):
                if value.lower() in _MAIN_NAMES:
                    out |= MAIN_FLAG
                elif name not in ("body", "html", "main") and any(_aside_name(word, around) for word in value.split()):
                    out |= ASIDE_FLAG
            elif key == "itemprop" and value.lower() == "articlebody":
                out |= MAIN_FLAG
    return out


class _Page:
    """The blocks of a page, in order, as the tags come."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.words = self.linked = 0
        self.open: list[tuple[str, int, int]] = []  # name, what was said before, depth at which a link was open
        self.depth: dict[str, int] = {}
        self.said = self.leaf = 0
        self.heading = False
        self.link = -1  # how many elements were open when a link began, or -1

    def read(self, chunk: str) -> None:
        text = html.unescape(chunk) if "&" in chunk else chunk
        self.text.append(text)
        n = len(text.split())
        self.words += n
        if self.link >= 0:
            self.linked += n

    def cut(self) -> None:
        """The end of a block."""
        if self.text:
            parts = "".join(self.text).split()
            if parts:
                n = len(parts)
                # a word that tags divide counts once in the block; its parts in links are at most all
                self.blocks.append(Block(" ".join(parts), n, min(n, self.linked), self.said | self.leaf, self.heading))
            self.text, self.words, self.linked = [], 0, 0

    def begin(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text.append(" ")
        elif name == "a":
            self.link = len(self.open)
        elif name in BLOCK:
            self.cut()
            self.heading, self.leaf = name[0] == "h" and name[1:].isdigit(), 0
            if name in LOOSE:
                self.leaf = says(name, attributes, self.said)
            else:
                self._push(name, says(name, attributes, self.said))
        elif name in UNREAD:
            self.cut()
            self._push(name, says(name, attributes, self.said) | ASIDE_FLAG)

    def _push(self, name: str, said: int) -> None:
        self.open.append((name, self.said, self.link))
        self.depth[name] = self.depth.get(name, 0) + 1
        self.said = said

    def end(self, name: str) -> None:
        if name == "a":
            self.link = -1
        elif name in BLOCK or name in UNREAD:
            self.cut()
            self.heading, self.leaf = False, 0
            while self.depth.get(name, 0) and name not in LOOSE:
                last, self.said, _ = self.open.pop()
                self.depth[last] -= 1
                if self.link > len(self.open):
                    self.link = -1
                if last == name:
                    break


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page, in order; those without a word are left out.

    A tag ends at the first ``>`` outside of quoted values, or at the first of all if a quote stays open; comments, declarations and raw
    elements that stay open reach to the end, as a browser has it. A ``<`` that begins no tag is text.
    """
    out = _Page()
    at, done, size = 0, 0, len(page)
    open_quotes: set[str] = set()
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        follows = page[at + 1 : at + 2]
        if follows in ("!", "?") or (follows == "/" and not page[at + 2 : at + 3].isalpha()):
            if done < at:
                out.read(page[done:at])
            comment = page.startswith("<!--", at)
            if comment and page.startswith((">", "->"), at + 4):
                end = page.find(">", at) + 1
            else:
                end = page.find("-->" if comment else ">", at + 4 if comment else at + 1)
                end = size if end < 0 else end + (3 if comment else 1)
            at = done = end
            continue
        tag = _TAG.match(page, at)
        if tag is None:
            at += 1
            continue
        if done < at:
            out.read(page[done:at])
        end = tag.end()
        while True:
            mark = _END.search(page, end)
            if mark is None:
                end = size
                break
            if mark[1] is None:
                end = mark.end()
                break
            closing = -1 if mark[1] in open_quotes else page.find(mark[1], mark.end())
            if closing < 0:
                open_quotes.add(mark[1])  # from here on none is closed
                end = page.find(">", tag.end()) + 1 or size
                break
            end = closing + 1
        name = tag[1].lower()
        if page[at + 1] == "/":
            out.end(name)
        elif name in RAW:
            out.text.append(" ")
            closes = _CLOSES[name].search(page, end)
            end = closes.start() if closes else size
        else:
            out.begin(name, page[tag.end() : end - 1])
        at = done = end
    if done < size:
        out.read(page[done:])
    out.cut()
    return out.blocks


def features(words: np.ndarray, linked: np.ndarray, said: np.ndarray, heading: np.ndarray) -> np.ndarray:
    """Rows of words and link density of a block, of the one before and of the one after, and of what is said of it."""
    density = linked / np.maximum(words, 1)

    def beside(x: np.ndarray) -> list[np.ndarray]:
        wide = np.concatenate([[0], x, [0]]).astype(float)
        return [wide[1:-1], wide[:-2], wide[2:]]

    return np.stack([*beside(words), *beside(density), (said & ASIDE_FLAG) > 0, (said & MAIN_FLAG) > 0, heading], axis=1).astype(float)


class Tree(NamedTuple):
    """A binary decision tree: feature (-1 in leaves), threshold, the node for at most and for more, and the leaf's part of content."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    def content(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while (inner := self.feature[node] >= 0).any():
            rows = np.flatnonzero(inner)
            n = node[rows]
            node[rows] = np.where(x[rows, self.feature[n]] <= self.threshold[n], self.low[n], self.high[n])
        return self.share[node] >= 0.5


def train(x: np.ndarray, y: np.ndarray, least: int = 2, deepest: int = 7) -> Tree:
    """A tree that splits by the least Gini impurity, ties to the first feature and the lowest threshold."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        own, n, ones = len(nodes), len(rows), y[rows].sum()
        nodes.append([-1, 0.0, -1, -1, ones / n])
        best = (2.0 * ones * (n - ones) / n - 1e-9, -1, 0.0)
        if 0 < ones < n and depth < deepest:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, left = x[order, f], np.arange(1, n)
                a = np.cumsum(y[order])[:-1]
                right, b = n - left, ones - a
                gini = 2 * a * (left - a) / left + 2 * b * (right - b) / right
                gini[(v[1:] == v[:-1]) | (left < least) | (right < least)] = np.inf
                i = int(gini.argmin()) if len(gini) else -1
                if i >= 0 and gini[i] < best[0]:
                    best = (float(gini[i]), f, float(v[i] + v[i + 1]) / 2)
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[own][:2] = best[1:]
            nodes[own][2] = grow(rows[low], depth + 1)
            nodes[own][3] = grow(rows[~low], depth + 1)
        return own

    grow(np.arange(len(y)), 0)
    columns = list(zip(*nodes, strict=True))
    return Tree(np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]), np.array(columns[4]))


@lru_cache(maxsize=1)
def trained() -> Tree:
    """The tree of the labelled table."""
    pages: dict[str, list] = {}
    for line in LABELLED.split("\n"):
        if line:
            page, *rest = line.split()
            pages.setdefault(page, []).append(rest)
    xs, ys = [], []
    for rows in pages.values():
        said, heading = [], []
        for _, path, _, _ in rows:
            flags = 0
            for element in path.split("/"):
                name, _, classes = element.partition(".")
                flags = says(name, f'class="{classes}"' if classes else "", flags)
            said.append(flags)
            heading.append(name[0] == "h" and name[1:].isdigit())
        xs.append(features(*(np.array(c) for c in ([int(r[2]) for r in rows], [int(r[3]) for r in rows], said, heading))))
        ys.append([int(r[0]) for r in rows])
    return train(np.concatenate(xs), np.concatenate(ys))


def main_text(page: str, tree: Tree | None = None) -> str:
    """The main text of one page: the blocks that the tree takes for content, joined by line ends."""
    found = blocks(page)
    if not found:
        return ""
    x = features(*(np.array(c) for c in ([b.words for b in found], [b.linked for b in found], [b.says for b in found], [b.heading for b in found])))
    content = (tree or trained()).content(x)
    return "\n".join(b.text for b, keep in zip(found, content.tolist(), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``; other columns are not read).

    Null or empty html gives an empty text, as does a page of which nothing is main text; null ids and urls stay null, and repeated
    rows stay rows of their own. White space inside a block is one space; blocks are joined by one line end.
    """
    tree = trained()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_size(batches, 2):
            texts = [main_text(page, tree) if page else "" for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

