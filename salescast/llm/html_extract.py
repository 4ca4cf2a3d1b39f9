"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

Each block element is a node with the text and tag counts of its subtree, link and
punctuation shares, text density, the words of its attributes, its depth, and how it
compares with its siblings and its parent. Spark ML's gradient-boosted trees learn which
nodes belong to the main text. No page is labelled by hand: nodes that HTML itself calls
article or main are examples, unless they lie in what it calls navigation, header, footer,
aside, form or notice, or what their attributes call so; pages that say neither are not
learned from. The trees are fitted on the nodes of about ``SAMPLE_PAGES`` pages chosen
by hash, a documented bound, and applied to every page, since few pages name their parts.

Decoding gives each node one of three states: outside (a container above the main
text), inside, or dropped. Outside may hold any state, inside only inside or dropped,
dropped only dropped. The best such assignment under the trees' probabilities is found
from the leaves up, so a choice never contradicts one above or below it.

A null, empty or text-free html has no blocks, and the text is empty. Without a page to
learn from, nodes count as the examples' rule says. Repeated rows each get a row. A page
is parsed as a whole, by a task at a time. Columns other than page_id, url and html are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.llm.html_dom import Node, parse
from salescast.llm.scratch import stored

SAMPLE_PAGES = 1_000
TREES = 20
DEPTH = 4
BATCH_PAGES = 64

# Words that pages use for their parts, in attributes.
MAIN_WORDS = ("article", "articlebody", "main", "content", "post", "entry", "story", "text", "body", "page")
OTHER_WORDS = (
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer",
    "sidebar", "aside", "widget", "ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "cookie",
    "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "search",
    "comment", "comments", "reply", "replies", "respond", "disqus", "related", "recommended", "share", "social",
    "copyright", "contentinfo", "complementary", "toolbar", "pagination", "pager", "tags",
)
MAIN_TAGS = ("article", "main")
OTHER_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "head")
SHOWN_TAGS = ("p", "div", "section", "li", "ul", "td", "table", "blockquote", "pre", "body")
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_WORD = re.compile(r"[a-z0-9]+")
_MAIN, _OTHER = frozenset(MAIN_WORDS), frozenset(OTHER_WORDS)

FEATURE_NAMES = [
    "chars", "words", "tags", "density", "link_share", "stops", "commas", "own_chars", "own_share", "depth",
    "children", "place", "siblings", "sibling_chars", "sibling_same", "parent_share", "page_share", "position",
    "main_words", "other_words", "above_main", "above_other", "is_main", "is_other", "is_heading",
    *[f"is_{tag}" for tag in SHOWN_TAGS],
]


def _word_hits(names: str) -> tuple[int, int]:
    if not names:
        return 0, 0
    words = set(_WORD.findall(names))
    return len(words & _MAIN), len(words & _OTHER)


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row per node: subtree counts, attribute words, depth and sibling statistics."""
    count = len(nodes)
    chars, words, tags, links = ([0] * count for _ in range(4))
    stops, commas, own = ([0] * count for _ in range(3))
    start = [0] * count
    seen = 0
    hits = [_word_hits(node.names) for node in nodes]
    above = [(0, 0)] * count
    for i, node in enumerate(nodes):
        start[i] = seen
        for _, text in node.runs:
            own[i] += len(text)
            words[i] += text.count(" ") + 1
            stops[i] += text.count(".") + text.count("!") + text.count("?")
            commas[i] += text.count(",")
        seen += own[i]
        chars[i], tags[i], links[i] = own[i], 1 + node.inline_tags, min(node.link_chars, own[i])
        if node.parent >= 0:
            p = node.parent
            main, other = above[p]
            above[i] = (main + hits[p][0] + (nodes[p].tag in MAIN_TAGS), other + hits[p][1] + (nodes[p].tag in OTHER_TAGS))
    for i in range(count - 1, 0, -1):
        p = nodes[i].parent
        for column in (chars, words, tags, links, stops, commas):
            column[p] += column[i]
    page = max(chars[0], 1)
    like = Counter((node.parent, node.tag) for node in nodes)
    rows = np.zeros((count, len(FEATURE_NAMES)))
    for i, node in enumerate(nodes):
        mother = nodes[node.parent] if node.parent >= 0 else node
        siblings = len(mother.children) if node.parent >= 0 else 1
        parent_chars = chars[node.parent] if node.parent >= 0 else chars[i]
        same = like[node.parent, node.tag]
        size = max(chars[i], 1)
        rows[i, :25] = (
            math.log1p(chars[i]), math.log1p(words[i]), math.log1p(tags[i]), chars[i] / tags[i], links[i] / size,
            100 * stops[i] / size, 100 * commas[i] / size, math.log1p(own[i]), own[i] / size, node.depth,
            len(node.children), node.place, siblings, math.log1p((parent_chars - chars[i]) / max(siblings - 1, 1)),
            same / siblings, chars[i] / max(parent_chars, 1), chars[i] / page, start[i] / page,
            hits[i][0], hits[i][1], above[i][0], above[i][1], node.tag in MAIN_TAGS, node.tag in OTHER_TAGS,
            node.tag in _HEADINGS,
        )
        if node.tag in SHOWN_TAGS:
            rows[i, 25 + SHOWN_TAGS.index(node.tag)] = 1
    return rows


def example_labels(nodes: list[Node]) -> list[int] | None:
    """1 for nodes that HTML says belong to the main text, 0 for others; None if the page names no main part."""
    state = [0] * len(nodes)
    named = False
    for i, node in enumerate(nodes):
        above = state[node.parent] if node.parent >= 0 else 0
        hit = _word_hits(node.names)
        if above == -1 or node.tag in OTHER_TAGS or (hit[1] and node.tag not in MAIN_TAGS):
            state[i] = -1
        elif above == 1 or node.tag in MAIN_TAGS or "main" in node.names.split():
            state[i] = 1
            named = True
    return [int(s == 1) for s in state] if named else None


@dataclass
class Tree:
    """A regression tree as arrays; a leaf's ``feature`` is -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)
        every = np.arange(len(rows))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.value[at]
            low = rows[every, np.maximum(feature, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)


@dataclass
class NodeModel:
    trees: list[Tree]
    weights: list[float]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        margin = sum((w * tree(rows) for w, tree in zip(self.weights, self.trees)), np.zeros(len(rows)))
        return 1 / (1 + np.exp(-2 * margin))


def _tree_of(root) -> Tree:
    """Arrays of a fitted tree, from its nodes on the driver (at most 2 ** (DEPTH + 1) of them)."""
    columns: list[list] = [[], [], [], [], []]

    def walk(node) -> int:
        place = len(columns[0])
        for column, value in zip(columns, (-1, 0.0, 0, 0, node.prediction())):
            column.append(value)
        if node.getClass().getSimpleName() == "InternalNode":
            columns[0][place] = node.split().featureIndex()
            columns[1][place] = node.split().threshold()
            columns[2][place] = walk(node.leftChild())
            columns[3][place] = walk(node.rightChild())
        return place

    walk(root)
    return Tree(*[np.array(c) for c in columns])


def training_nodes(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Features and label of every node of the sampled pages that name their main part."""
    total = pages.count()
    share = F.pmod(F.xxhash64("url", "page_id"), F.lit(1_000_000))
    sampled = pages.where(share < int(1_000_000 * min(1.0, sample_pages / total))) if total > sample_pages else pages

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0):
                nodes = parse(page.as_py() or "")
                labels = example_labels(nodes)
                if labels is not None:
                    features = pa.array(node_features(nodes).tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), features], names=["label", "features"])

    return sampled.select("html").mapInArrow(gather, "label double, features array<double>")


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> NodeModel | None:
    """Fitted trees, or None if the sample doesn't show both kinds of node."""
    rows = stored(training_nodes(pages, sample_pages).coalesce(4), "html-nodes")
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    vectors = rows.select("label", array_to_vector("features").alias("features"))
    trainer = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=5, seed=7, maxBins=64)
    fitted = trainer.fit(vectors)
    return NodeModel([_tree_of(t._call_java("rootNode")) for t in fitted.trees], list(fitted.treeWeights))


OUTSIDE, INSIDE, DROPPED = 0, 1, 2


def decode(nodes: list[Node], probability: np.ndarray) -> list[int]:
    """The most probable states in which no node contradicts one above it.

    A node weighs more the more text of its own it has.
    """
    count = len(nodes)
    weight = [1 + math.log1p(sum(len(text) for _, text in node.runs)) for node in nodes]
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log1p(-p).tolist()
    inside, dropped, outside = [0.0] * count, [0.0] * count, [0.0] * count
    for i in range(count - 1, -1, -1):
        below = nodes[i].children
        inside[i] = weight[i] * yes[i] + sum(max(inside[c], dropped[c]) for c in below)
        dropped[i] = weight[i] * no[i] + sum(dropped[c] for c in below)
        outside[i] = weight[i] * no[i] + sum(max(inside[c], dropped[c], outside[c]) for c in below)
    state = [DROPPED] * count
    for i, node in enumerate(nodes):
        above = state[node.parent] if node.parent >= 0 else OUTSIDE
        if above == DROPPED:
            continue
        best = INSIDE if inside[i] > dropped[i] else DROPPED
        if above == OUTSIDE and outside[i] >= max(inside[i], dropped[i]):
            best = OUTSIDE
        state[i] = best
    return state


def blocks_of(nodes: list[Node], state: list[int]) -> list[str]:
    """The text runs of the inside nodes, in page order."""
    found: list[str] = []
    todo: list[tuple[int, int, int]] = [(0, 0, 0)]  # node, next child, next run
    while todo:
        i, child, run = todo.pop()
        node = nodes[i]
        while run < len(node.runs) and node.runs[run][0] <= child:
            if state[i] == INSIDE:
                found.append(node.runs[run][1])
            run += 1
        if child < len(node.children):
            todo.append((i, child + 1, run))
            if state[node.children[child]] != DROPPED:
                todo.append((node.children[child], 0, 0))
    return found


def main_text(page: str, model: NodeModel | None) -> str:
    return main_texts([page], model)[0]


def main_texts(pages: list[str | None], model: NodeModel | None) -> list[str]:
    parsed = [parse(page or "") for page in pages]
    features = [node_features(nodes) for nodes in parsed]
    if model is None:
        probability = [np.array(example_labels(nodes) or [0.0] * len(nodes), dtype=float) for nodes in parsed]
    else:
        ends = np.cumsum([len(f) for f in features])[:-1]
        probability = np.split(model.probability(np.concatenate(features)), ends)
    return ["\n".join(blocks_of(nodes, decode(nodes, p))) for nodes, p in zip(parsed, probability)]


def extract(pages: DataFrame, model: NodeModel | None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(first, BATCH_PAGES)
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                lengths = pa.array([len(text) for text in texts], pa.int64())
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), lengths]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(scan, "page_id long, url string, text string, n_chars long")


def extract_main_text(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
