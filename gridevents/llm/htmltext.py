"""Main text of web pages: boosted trees over nodes, and a decoding that respects the tree.

Every block element is a row of features: its tag and attribute words and those of its
ancestors, its depth, its place among its siblings, the density of text, links and
tags in its subtree.  Gradient-boosted trees, trained here, give each block a score.

The labels come from pages that name their parts: a block inside ``article`` or ``main``
and outside parts named as furniture is content, a block inside such a part is not.
Rows are also shown with all names blanked, so that the trees learn what text looks like
where nothing is named (furniture made of prose is left out there: without a name it
cannot be told from text), and content rows as if furniture held them, so that they
learn that named furniture may hold prose (reader comments, notices).

A page is decoded as a whole: a set of open nodes is sought in which every open node has
an open parent, with the largest sum of scores weighted by text.  Bottom up, a subtree
is open when its best sum is positive; so no text is kept below a rejected node, and none
is lost because a wrapper alone looked odd.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from gridevents.llm.dom import INLINE, Node, parse
from gridevents.llm.words import slices
from gridevents.session import written

#: Pages whose nodes the trees are trained on (the bound of the sample), trees and their depth.
SAMPLE_PAGES, TREES, DEPTH = 300, 12, 4
#: Parts of the table by hash, in which pages are labelled for the sample.
SHARES = 1 << 20

#: Words of tags and attributes that name furniture, and those that name content.
FURNITURE = frozenset("""nav navigation navbar menu menubar header masthead banner footer foot bottom copyright legal sidebar side aside rail
    ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted cookie cookies consent notice notices gdpr alert
    comment comments reply replies disqus respond discussion form search login signup subscribe subscription newsletter share sharing social
    related recommended recommendations popular trending breadcrumb breadcrumbs crumbs pager pagination widget popup modal overlay toolbar
    tooltip skip contentinfo complementary tags toc dialog button topbar toplinks outbrain taboola tag meta byline""".split())
CONTENT = frozenset("article main content post story entry text articlebody body blog page prose".split())
FURNITURE_TAGS = frozenset("nav footer aside form header menu dialog button select fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt".split())

FEATURES = ("furniture_tag", "content_tag", "furniture_words", "content_words", "furniture_above", "content_above",
            "prose_tag", "list_tag", "table_tag", "wrapper_tag", "depth", "own_chars", "chars", "link_share", "tags_per_char",
            "children", "prose_share", "stops_per_char", "sibling_place", "siblings", "sibling_share", "page_share", "page_place")
#: The first features are names.
NAMES = 6

_SPACE = re.compile(r"[ \t\n\x0b\x0c\r  -     　 \x85]+")
_STOPS = str.maketrans("", "", ".,;:!?")


class Block:
    """A block element as it is decoded."""
    __slots__ = ("node", "parent", "own", "chars", "links", "tags", "children", "prose", "stops", "before", "features", "label")


def text_of(piece: str) -> str:
    """White space as one space, ends trimmed; character references are decoded first."""
    return _SPACE.sub(" ", html.unescape(piece)).strip(" ")


def blocks(root: Node) -> tuple[list[Block], list[tuple[int, str]]]:
    """The block elements in page order, and the text runs between block borders as (block, text)."""
    found: list[Block] = []
    runs: list[tuple[int, str]] = []
    buffer: list[str] = []
    links = [0]

    def flush(owner: int) -> None:
        if buffer:
            text = text_of("".join(buffer))
            buffer.clear()
            if text:
                runs.append((owner, text))
                block = found[owner]
                block.own += len(text)
                block.stops += len(text) - len(text.translate(_STOPS))

    # an explicit stack, as pages may nest deeply: (element, its parts still to come, its block, inside a link)
    def begin(node: Node, parent: int) -> int:
        block = Block()
        block.node, block.parent, block.own, block.links, block.tags, block.children = node, parent, 0, 0, 0, 0
        block.chars = block.prose = block.stops = block.before = 0
        found.append(block)
        return len(found) - 1

    stack = [(root, iter(root.parts), begin(root, -1), False)]
    while stack:
        node, parts, owner, link = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            if node.tag not in INLINE:
                flush(owner)
        elif isinstance(part, str):
            buffer.append(part)
            if link:
                found[owner].links += len(part.strip())
        elif part.hidden:
            continue
        elif part.tag in INLINE:
            found[owner].tags += 1
            if part.tag not in ("a",) and FURNITURE.intersection(part.tokens):
                flush(owner)  # named furniture is a block even where the element is inline
                stack.append((part, iter(part.parts), begin(part, owner), link))
                part.tag = "div"
            else:
                stack.append((part, iter(part.parts), owner, link or part.tag == "a"))
        else:
            flush(owner)
            found[owner].children += 1
            stack.append((part, iter(part.parts), begin(part, owner), link))
    return found, runs


def describe(found: list[Block]) -> np.ndarray:
    """Features of every block, one row each."""
    for block in reversed(found):  # children stand after their parents
        block.chars += block.own
        if block.node.tag in PROSE_TAGS:
            block.prose += block.own
        if block.parent >= 0:
            up = found[block.parent]
            up.chars, up.links, up.tags = up.chars + block.chars, up.links + block.links, up.tags + block.tags + 1
            up.prose, up.stops = up.prose + block.prose, up.stops + block.stops
    whole = max(found[0].chars, 1)
    above: list[tuple[int, int]] = []
    seen, place = 0, [0] * len(found)
    out = np.zeros((len(found), len(FEATURES)))
    for i, b in enumerate(found):
        tag, tokens = b.node.tag, b.node.tokens
        up = found[b.parent] if b.parent >= 0 else b
        furniture, content = above[b.parent] if b.parent >= 0 else (0, 0)
        bad, good = len(FURNITURE.intersection(tokens)), len(CONTENT.intersection(tokens))
        if tag in ("html", "body"):
            bad = 0  # words about the layout of the page
        own_bad, own_good = tag in FURNITURE_TAGS, tag in CONTENT_TAGS
        if own_bad and tag == "header" and content:
            own_bad = False  # the header of an article
        above.append((furniture + bad + own_bad, content + good + own_good))
        out[i] = (own_bad, own_good, bad, good, furniture, content,
                  tag in PROSE_TAGS, tag in ("ul", "ol", "li", "dl"), tag in ("table", "tr", "td", "th", "tbody"),
                  tag in ("div", "section", "span", "body", "html", "center"), b.node.depth, math.log1p(b.own), math.log1p(b.chars),
                  min(1.0, b.links / (b.chars + 1)), b.tags / (b.chars + 1), b.children, b.prose / (b.chars + 1),
                  b.stops / (b.chars + 1), place[b.parent] if b.parent >= 0 else 0, up.children, b.chars / (up.chars + 1), b.chars / whole, seen / whole)
        if b.parent >= 0:
            place[b.parent] += 1
        seen += b.own
    return out


def labels(features: np.ndarray) -> np.ndarray:
    """1 content, 0 furniture, -1 unknown, from the names of a block and its ancestors."""
    column = {name: features[:, i] for i, name in enumerate(FEATURES)}
    bad = (column["furniture_tag"] + column["furniture_words"] + column["furniture_above"]) > 0
    good = (column["content_tag"] + column["content_above"]) > 0
    return np.where(bad, 0, np.where(good, 1, -1))


class Trees:
    """The boosted trees as arrays, scored for many rows at once."""

    def __init__(self, trees: list[tuple[float, list]], prior: float = 0.0):
        self.trees = [(w, *(np.array(c) for c in zip(*nodes))) for w, nodes in trees]
        self.prior = prior

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.prior)
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                here = at[inner]
                less = rows[inner, feature[here]] <= threshold[here]
                at[inner] = np.where(less, left[here], right[here])
            total += weight * value[at]
        return total


def _nodes(tree) -> list[tuple[int, float, int, int, float]]:
    """(feature or -1, threshold, left, right, value) of every node of a fitted tree."""
    out: list = []

    def add(node) -> int:
        place = len(out)
        out.append(None)
        if node.subtreeDepth() == 0:
            out[place] = (-1, 0.0, 0, 0, float(node.prediction()))
        else:
            left, right = add(node.leftChild()), add(node.rightChild())
            out[place] = (int(node.split().featureIndex()), float(node.split().threshold()), left, right, 0.0)
        return place

    add(tree._call_java("rootNode"))
    return out


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees from at most ``sample_pages`` pages that name parts of both kinds, by the hash of their page_id.

    Pages are labelled in growing shares of the table (by hash), until enough are found or all
    are read.  Where no page at all names both kinds there is nothing to learn; all blocks then
    get the same positive score, and only markup, scripts and the like are left out.
    """
    usable = pages.where("page_id IS NOT NULL AND html IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, text in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist()):
                rows = describe(blocks(parse(text))[0])
                label = labels(rows)
                if not ((label == 0).any() and (label == 1).any()):
                    continue
                known = label >= 0
                rows, label = rows[known], label[known]
                plain = (label == 1) | (rows[:, FEATURES.index("prose_share")] < 0.5)
                blank = rows[plain].copy()
                blank[:, :NAMES] = 0
                moved = rows[label == 1].copy()
                moved[:, FEATURES.index("furniture_above")] = 1
                both = np.concatenate([rows, blank, moved])
                label = np.concatenate([label, label[plain], np.zeros(len(moved))])
                yield pa.record_batch([pa.array(np.full(len(both), page, np.int64)), pa.array(np.arange(len(both))),
                                       pa.array(label.astype(np.float64)),
                                       pa.array(list(both), pa.list_(pa.float64()))], ["page", "row", "label", "features"])

    place = F.pmod(F.xxhash64("page_id"), F.lit(SHARES))
    total, share, rows, ids = usable.count(), 0, None, []
    while share < SHARES and len(ids) < sample_pages:
        before, share = share, min(SHARES, max(16 * share, -(-2 * sample_pages * SHARES // max(total, 1))))
        more = written(usable.where(place.between(before, share - 1)).dropDuplicates(["page_id"])
                       .mapInArrow(run, "page long, row long, label double, features array<double>"), "nodes")
        rows = more if rows is None else rows.unionByName(more)
        # the bound of the sample: only these ids come to the driver
        ids = [r[0] for r in rows.select("page").distinct().orderBy(F.pmod(F.xxhash64("page"), F.lit(SHARES)), "page").limit(sample_pages).collect()]
    if not ids:
        return Trees([], prior=1.0)
    rows = rows.where(F.col("page").isin(ids))
    data = rows.repartition(4, "page").sortWithinPartitions("page", "row").select("label", array_to_vector("features").alias("features"))
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32, cacheNodeIds=False).fit(data)
    return Trees([(w, _nodes(t)) for w, t in zip(fitted.treeWeights, fitted.trees)])


def open_blocks(found: list[Block], margin: np.ndarray) -> np.ndarray:
    """Which blocks are open: the best set in which every open block has an open parent."""
    value = [float(m) * (0.25 + math.log1p(b.own)) for m, b in zip(margin, found)]
    for i in range(len(found) - 1, 0, -1):
        if value[i] > 0:
            value[found[i].parent] += value[i]
    out = np.zeros(len(found), bool)
    for i, b in enumerate(found):
        out[i] = value[i] > 0 and (b.parent < 0 or out[b.parent])
    return out


def main_text(pages: DataFrame, trees: Trees) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html).

    The blocks of the main text in page order, one a line: character references decoded, white
    space in a block one space, ends trimmed.  A null or empty html, and a page without such
    text, gives an empty text; null ids and urls stay; repeated rows give repeated rows; pages
    are read whole, in memory that follows the longest single page.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 19):
                read = [blocks(parse(page or "")) for page in part["html"].to_pylist()]
                rows = [describe(found) for found, _ in read]
                margin = trees.margin(np.concatenate(rows))
                out, at = [], 0
                for found, runs in read:
                    keep = open_blocks(found, margin[at:at + len(found)])
                    at += len(found)
                    out.append("\n".join(text for owner, text in runs if keep[owner]))
                yield pa.record_batch([part["page_id"], part["url"], pa.array(out, pa.string())], ["page_id", "url", "text"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string")


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """``main_text`` by trees trained on a sample of the same pages."""
    return main_text(pages, train(pages, sample_pages))
