"""HTML extraction: flat text blocks, their words and link density with the neighbours', and a
decision tree.

A page is cut at block-level tags into flat blocks of text.  A block has its word count, its link
density (share of its words inside links), the same of the blocks before and after, and whether
it is inside an article or main part, inside a heading, or inside a part that its tag or class names
as furniture (navigation, header, footer, sidebar, notice, advert, form, comments).  A decision
tree, grown here on the small labelled table below, tells content from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article",
            "furniture", "heading")

#: Labelled blocks: the features above in order (link densities in percent), then 1 for content.
LABELLED = np.array([
    # paragraphs and headings of articles
    (45, 0, 8, 0, 60, 0, 1, 0, 0, 1), (60, 3, 45, 0, 38, 0, 1, 0, 0, 1), (38, 0, 60, 3, 2, 0, 1, 0, 0, 1),
    (2, 0, 38, 0, 55, 0, 1, 0, 0, 1), (1, 0, 2, 0, 1, 0, 1, 0, 0, 1), (8, 0, 4, 0, 45, 0, 1, 0, 1, 1),
    (1, 0, 0, 0, 1, 0, 1, 0, 1, 1), (12, 25, 30, 0, 40, 0, 1, 0, 0, 1), (5, 100, 40, 0, 33, 0, 1, 0, 0, 1),
    (90, 0, 75, 2, 6, 0, 1, 0, 0, 1), (3, 0, 6, 100, 28, 0, 1, 0, 1, 1), (17, 0, 3, 0, 9, 0, 1, 0, 0, 1),
    (4, 0, 60, 0, 12, 40, 1, 0, 0, 1), (150, 1, 4, 0, 110, 0, 1, 0, 0, 1),
    # articles on pages without an article tag
    (52, 0, 7, 0, 64, 0, 0, 0, 0, 1), (64, 2, 52, 0, 40, 0, 0, 0, 0, 1), (40, 0, 64, 2, 3, 0, 0, 0, 0, 1),
    (20, 0, 40, 0, 35, 5, 0, 0, 0, 1), (33, 9, 12, 0, 21, 0, 0, 0, 0, 1), (120, 0, 9, 0, 80, 0, 0, 0, 0, 1),
    (7, 0, 0, 0, 52, 0, 0, 0, 1, 1), (6, 0, 14, 0, 48, 0, 0, 0, 1, 1), (3, 0, 40, 0, 30, 0, 0, 0, 0, 1),
    (8, 0, 25, 0, 31, 0, 0, 0, 0, 1), (5, 0, 64, 0, 44, 0, 0, 0, 0, 1),
    (30, 0, 30, 0, 0, 0, 0, 0, 0, 1), (18, 0, 45, 0, 0, 0, 0, 0, 0, 1), (41, 0, 28, 0, 2, 100, 0, 0, 0, 1),
    (15, 0, 33, 0, 4, 0, 0, 0, 0, 1), (27, 3, 51, 0, 3, 100, 0, 0, 0, 1), (13, 0, 26, 0, 0, 0, 0, 0, 0, 1),
    # furniture by tag or class, also within articles
    (1, 100, 0, 0, 1, 100, 0, 1, 0, 0), (2, 100, 1, 100, 1, 100, 0, 1, 0, 0), (9, 0, 2, 100, 8, 0, 0, 1, 0, 0),
    (14, 0, 55, 0, 0, 0, 0, 1, 0, 0), (35, 0, 9, 0, 20, 0, 0, 1, 0, 0), (28, 0, 60, 0, 12, 0, 1, 1, 0, 0),
    (6, 0, 28, 0, 40, 0, 1, 1, 1, 0), (70, 0, 3, 0, 22, 0, 0, 1, 0, 0), (44, 5, 10, 0, 44, 0, 1, 1, 0, 0),
    (3, 0, 70, 0, 3, 100, 0, 1, 1, 0), (18, 0, 150, 0, 5, 0, 0, 1, 0, 0), (55, 0, 44, 0, 61, 0, 0, 1, 0, 0),
    (60, 0, 40, 0, 10, 0, 0, 1, 0, 0), (30, 0, 80, 0, 3, 0, 0, 1, 0, 0), (95, 0, 33, 0, 18, 0, 0, 1, 0, 0),
    (42, 0, 21, 0, 0, 0, 0, 1, 0, 0), (25, 0, 12, 0, 30, 0, 1, 1, 0, 0), (51, 0, 48, 0, 9, 0, 1, 1, 0, 0),
    (33, 10, 52, 0, 47, 0, 0, 1, 0, 0), (16, 0, 27, 0, 39, 0, 0, 1, 0, 0), (81, 0, 66, 0, 72, 0, 0, 1, 0, 0),
    (7, 0, 31, 0, 58, 0, 1, 1, 1, 0), (11, 30, 90, 0, 64, 0, 0, 1, 0, 0), (22, 0, 37, 0, 120, 0, 0, 1, 0, 0),
    # furniture without a name
    (1, 100, 0, 0, 1, 100, 0, 0, 0, 0), (2, 100, 1, 100, 2, 100, 0, 0, 0, 0), (3, 100, 2, 100, 6, 0, 0, 0, 0, 0),
    (4, 75, 3, 100, 2, 100, 0, 0, 0, 0), (10, 60, 5, 80, 4, 100, 0, 0, 0, 0), (5, 0, 2, 100, 2, 100, 0, 0, 0, 0),
    (4, 0, 1, 100, 0, 0, 0, 0, 0, 0), (6, 50, 30, 0, 3, 100, 0, 0, 0, 0), (25, 80, 6, 100, 7, 70, 0, 0, 0, 0),
    (2, 0, 3, 0, 2, 0, 0, 0, 0, 0), (3, 0, 5, 0, 0, 0, 0, 0, 0, 0), (7, 0, 4, 0, 0, 0, 0, 0, 0, 0),
    (1, 0, 0, 0, 2, 100, 0, 0, 1, 0),
], dtype=float)

#: Tags that end a block of text.
BLOCK_TAGS = frozenset((
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol "
    "optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul").split())
#: Tags whose content is never shown as text, and is read up to their own end tag.
RAW_TAGS = frozenset("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button select label fieldset head".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role attributes that name furniture.
FURNITURE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|"
    r"nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|footer|masthead|sidebar|side|aside|widget|related|"
    r"share|sharing|social|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|comment|comments|reply|replies|respond|disqus|pagination|pager|toolbar|copyright|legal|"
    r"complementary|contentinfo|search|tags|byline)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:![^>]*|\?[^>]*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
                    re.S)
_NAMING = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("feature", "cut", "low", "high", "value")


def grow(rows: np.ndarray, depth: int = 6) -> Node:
    """A classification tree by Gini impurity; ties go to the first feature and the lowest cut."""
    node = Node()
    y = rows[:, -1]
    node.value, node.feature = bool(y.mean() >= 0.5), -1
    if depth == 0 or y.min() == y.max():
        return node
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = rows[:, f] < cut
            cost = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, cut)
    if best is None:
        return node
    _, node.feature, node.cut = best
    left = rows[:, node.feature] < node.cut
    node.low, node.high = grow(rows[left], depth - 1), grow(rows[~left], depth - 1)
    return node


def classify(node: Node, row: tuple[float, ...]) -> bool:
    while node.feature >= 0:
        node = node.low if row[node.feature] < node.cut else node.high
    return node.value


@lru_cache(maxsize=1)
def trained() -> Node:
    return grow(LABELLED)


class _Block:
    __slots__ = ("text", "words", "linked", "article", "furniture", "heading")


def blocks_of(page: str) -> list[_Block]:
    """The page's flat blocks in order; empty ones are left out."""
    out: list[_Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open tags: name, whether furniture, whether article
    furniture = article = links = heading = 0
    text: list[str] = []
    linked: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        # References are decoded over the whole block, as in-line tags may stand beside them.
        if not text:
            return
        joined = _SPACES.sub(" ", html.unescape("".join(text))).strip(" ")
        if joined:
            b = _Block()
            b.text, b.words = joined, joined.count(" ") + 1
            b.linked = len("".join(linked).split()) if linked else 0
            b.article, b.furniture, b.heading = article > 0, furniture > 0, heading > 0
            out.append(b)
        text.clear()
        linked.clear()

    def close(k: int) -> None:
        nonlocal furniture, article, links, heading
        while len(stack) > k:
            name, is_furniture, is_article = stack.pop()
            furniture -= is_furniture
            article -= is_article
            links -= name == "a"
            heading -= name in HEADING_TAGS

    def add(piece: str) -> None:
        text.append(piece)
        if links:
            linked.append(piece + " ")

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end() if m.end() > m.start() else m.end() + 1
        name = m[2]
        if name is None:  # a comment or declaration
            continue
        name = name.lower()
        if name in BLOCK_TAGS:
            flush()
        elif name == "br":
            text.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        attributes = m[3]
        if name in VOID_TAGS:
            continue
        if name in RAW_TAGS:
            if attributes.rstrip().endswith("/"):
                continue
            stop = re.compile(rf"</{re.escape(name)}\s*(?:>|$)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in ("p", "li", "option", "td", "th", "tr", "dd", "dt") and stack and stack[-1][0] == name:
            close(len(stack) - 1)  # their end tags may be left out
        named = "".join(f" {a or b or c} " for a, b, c in _NAMING.findall(attributes)) if attributes else ""
        is_furniture = (name in FURNITURE_TAGS and not (name == "header" and article > 0)
                        or bool(named and FURNITURE_NAMES.search(named))
                        or bool(attributes and _HIDDEN.search(attributes)))
        if name in ("html", "body"):
            is_furniture = False
        is_article = name in ("article", "main")
        stack.append((name, is_furniture, is_article))
        furniture += is_furniture
        article += is_article
        links += name == "a"
        heading += name in HEADING_TAGS
    flush()
    return out


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line; empty if there are none."""
    if not page:
        return ""
    blocks, tree = blocks_of(page), trained()
    words = [0, *(b.words for b in blocks), 0]
    links = [0.0, *(100 * min(b.linked, b.words) / b.words for b in blocks), 0.0]
    # With an article or main part, what stands outside of it is not the article's.
    inside = any(b.article and not b.furniture for b in blocks)
    keep = []
    for i, b in enumerate(blocks, 1):
        row = (words[i], links[i], words[i - 1], links[i - 1], words[i + 1], links[i + 1], b.article, b.furniture, b.heading)
        if (b.article or not inside) and classify(tree, row):
            keep.append(b.text)
    return "\n".join(keep)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(v.as_py()) for v in part.column("html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``, without a shuffle.

    A null or empty html gives an empty text; null ids and urls and repeated rows are returned as they
    come; a page without content blocks gives an empty text; an empty table gives no rows; other
    columns are not read.  A cut page counts as closed at its end."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return base.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")
