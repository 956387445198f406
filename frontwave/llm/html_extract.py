"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Scripts, styles, comments, head matter and form
controls never give text; a control that is not closed anywhere ends at the next tag, another with the block around it at the latest. A link goes on over the blocks inside it and
ends with the element around it. A block's features are its number of words and link density, those of the block before and
after it, and three hints: inside an article or main element, inside something that calls itself page chrome (menus, banners,
footers, sidebars, notices, adverts, forms, reader comments, told by element names and by class, id or role names that are
made of such words and general ones only), and in a heading. A decision tree (Gini splits) keeps or drops each block. It is
trained on the labelled blocks of :mod:`html_labels`, each page as it is and, where everything beside its main text is short or
linked, once more with all elements and names that tell its parts made plain, so that words and link densities decide wherever
hints are missing.

Text: character references are decoded as HTML 5 does, white space inside a block is one space, blocks are joined in page
order by one newline. ``<br>`` is white space inside its block.

Defined results: a null or empty page, or one without a kept block, gives an empty text and 0 characters; malformed and
cut-off markup is read as far as it goes (unclosed elements end with the page); repeated rows each give a row; an empty
table gives an empty table. Whole pages are read; nothing is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded
from .html_labels import PAGES

# HTML element names by their role in this reading.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text, up to their closing tag, whatever is in between.
RAW = frozenset("script style title textarea".split())
SILENT = frozenset("noscript template select option button svg math canvas audio video object iframe head".split())
CHROME = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
CHROME_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion footer form login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget complementary contentinfo dialog alert hidden".split())
#: Words that may stand beside one of these in the name of a part of a page.
GENERAL = frozenset("area bar big block body bottom box button center col column container content cover desktop entry extra first global group header home horizontal image img inline inner item items large last latest left line link links list main mobile news nav outer page pages panel placeholder post posts primary right row secondary section site slot small stories story tab tag tags text title top unit vertical wide wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening <p> or <li> closes an open one.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[^\s]+")

FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "in_article", "in_chrome", "heading")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    main: bool
    chrome: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def is_chrome(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element opens page chrome. A header is chrome only outside an article."""
    if name in CHROME or name == "header" and not in_main:
        return True
    if not attributes:
        return False
    whole = name in ("body", "html") or name in MAIN
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role") and not whole:
            for given in value.split():
                words = {w for w in re.split(r"[^a-z]+", given) if w}
                if words <= CHROME_WORDS | GENERAL and (words & CHROME_WORDS or "header" in words and not in_main):
                    return True
    return False


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order; blocks without words are left out."""
    out: list[Block] = []
    pieces: list[tuple[str, bool]] = []  # text, whether inside a link
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, opens main, opens chrome
    main = chrome = heading = silent = 0
    link = -1  # how many elements were open when the open link began
    unclosed: set[str] = set()  # silent elements that are not closed from here on

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = sum(len(WORDS.findall(p)) for p, in_link in pieces if in_link)
                words = text.count(" ") + 1
                out.append(Block(text, words, min(linked, words), main > 0, chrome > 0, heading > 0))
            pieces.clear()

    def say(text: str) -> None:
        if not silent:
            pieces.append((text, link >= 0))

    def close(depth: int) -> None:
        nonlocal main, chrome, heading, silent, link
        while len(stack) > depth:
            name, opens_main, opens_chrome = stack.pop()
            main -= opens_main
            chrome -= opens_chrome
            heading -= name in HEADINGS
            silent -= name in SILENT
        link = link if link <= len(stack) else -1

    def innermost(name: str) -> int | None:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        m = TOKEN.match(html, lt)
        if m is None:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            if html.startswith("<![CDATA[", lt):
                say(html[lt + 9 : at].removesuffix("]]>"))
            continue
        name, closing, empty = m[2].lower(), bool(m[1]), m[3].rstrip().endswith("/")
        if name in RAW:
            if not closing and not empty:
                stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if name == "body":
            silent = 0  # a head that was not closed ends here
        if name == "a":
            link = -1 if closing else len(stack)
        elif name in ("br", "wbr"):
            say(" " if name == "br" else "")
        elif name in BLOCK or name == "head":
            flush()
        if name in VOID or name == "a":
            continue
        if closing:
            depth = innermost(name)
            if depth is not None and (name in BLOCK or all(s[0] not in BLOCK for s in stack[depth:])):
                close(depth)
        elif not empty:
            if name in SILENT and name not in unclosed and not re.compile(f"</{name}", re.I).search(html, at):
                unclosed.add(name)
            if name in unclosed:
                at = end if (at := html.find("<", at)) < 0 else at
                continue
            if name in SELF_CLOSING and (depth := innermost(name)) is not None and all(s[0] not in BLOCK or s[0] in SELF_CLOSING for s in stack[depth:]):
                close(depth)
            opens_main, opens_chrome = name in MAIN or 'role="main"' in m[3], is_chrome(name, m[3], main > 0)
            if opens_chrome and name not in BLOCK:
                flush()
            stack.append((name, opens_main, opens_chrome))
            main += opens_main
            chrome += opens_chrome
            heading += name in HEADINGS
            silent += name in SILENT
    flush()
    return out


def features(page: list[Block]) -> np.ndarray:
    """One row per block, columns as FEATURES."""
    x = np.zeros((len(page), len(FEATURES)))
    for i, b in enumerate(page):
        x[i, 0], x[i, 1], x[i, 6:] = b.words, b.density, (b.main, b.chrome, b.heading)
        if i:
            x[i, 2], x[i, 3] = page[i - 1].words, page[i - 1].density
        if i + 1 < len(page):
            x[i, 4], x[i, 5] = page[i + 1].words, page[i + 1].density
    return x


# ---- the tree


@dataclass
class Node:
    """A leaf (``column`` -1) with its share of kept blocks, or a split: ``value <= cut`` goes left."""

    keep: float
    column: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def train(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Node:
    """Greedy Gini splits; ties go to the earlier feature and lower cut, so the tree is the same on every run."""
    node = Node(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return node
    best = (len(y) * 2 * node.keep * (1 - node.keep) - 1e-9, -1, 0.0)
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, c] <= cut
            n = int(left.sum())
            if least <= n <= len(y) - least:
                p, q = y[left].mean(), y[~left].mean()
                gini = n * 2 * p * (1 - p) + (len(y) - n) * 2 * q * (1 - q)
                if gini < best[0] - 1e-9:
                    best = (gini, c, float(cut))
    if best[1] >= 0:
        left = x[:, best[1]] <= best[2]
        node.column, node.cut = best[1], best[2]
        node.left, node.right = train(x[left], y[left], depth - 1, least), train(x[~left], y[~left], depth - 1, least)
    return node


def kept(tree: Node, row: np.ndarray) -> bool:
    while tree.column >= 0:
        tree = tree.left if row[tree.column] <= tree.cut else tree.right
    return tree.keep >= 0.5


def plain(html: str) -> str:
    """The page with the elements and names that tell its parts made plain; its blocks stay the same."""
    named = re.sub(r"(</?)(?:article|aside|footer|form|header|main|menu|nav|section)\b", r"\1div", html)
    return re.sub(r"""\s(?:class|id|role)="[^"]*\"""", "", named)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the training pages, each as it is and, where that can be told from its words and links, made plain; a page's labels are one digit per block."""
    xs, ys = [], []
    for html, labels in PAGES:
        for page in (blocks(html), blocks(plain(html))):
            if len(page) != len(labels):
                raise ValueError(f"{len(page)} blocks, {len(labels)} labels: {[b.text for b in page]}")
            if not any(b.chrome or b.main for b in page) and any(y == "0" and b.words > 8 and b.density < 0.5 for b, y in zip(page, labels, strict=True)):
                continue
            xs.append(features(page))
            ys.append([int(c) for c in labels])
    return np.vstack(xs), np.concatenate(ys)


def told(tree: Node, indent: str = "") -> str:
    """The tree in words."""
    if tree.column < 0:
        return f"{indent}{'keep' if tree.keep >= 0.5 else 'drop'} ({tree.keep:.2f})\n"
    return f"{indent}{FEATURES[tree.column]} <= {tree.cut:g}\n{told(tree.left, indent + '  ')}{indent}else\n{told(tree.right, indent + '  ')}"


def main_text(html: str | None, tree: Node) -> str:
    if not html:
        return ""
    page = blocks(html)
    return "\n".join(b.text for b, row in zip(page, features(page), strict=True) if kept(tree, row))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page."""
    tree = train(*labelled())
    schema = T.StructType([pages.schema[key], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            texts = [main_text(x, tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.fieldNames())

    return pages.select(key, url, html).mapInArrow(over, schema)
