"""Main text of web pages by gradient-boosted trees over DOM nodes (operator 1).

Every element is a row of features: text and tag density of its subtree, share of links, words in its attributes,
depth, and how it compares with its siblings. Spark's gradient-boosted trees learn from a bounded sample of the pages
themselves, on which elements that authors named (article and main; navigation, footers, adverts, comments, ...) give
weak labels. Each row is also learnt without the features that name it, so that unnamed elements of other pages are
judged by their form, and with the form of another row, so that a name outweighs any form. Decoding is hierarchical: an element can be kept only with its parent, and of all such choices
the one of the greatest likelihood is taken, so an element and its ancestors never contradict each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import spread, staged
from tablewright.llm.dom import NAMED, Page

#: Pages that the model learns from, at most about; trees and their depth.
PAGES, TREES, DEPTH = 300, 12, 4


class Trees:
    """A boosted ensemble as arrays, for whole columns of nodes at a time."""

    def __init__(self, model=None):
        self.trees = []
        for tree, weight in zip(model.trees, model.treeWeights) if model else ():
            feature, bound, left, right, value = [], [], [], [], []

            def walk(node) -> int:
                i = len(feature)
                inner = node.subtreeDepth() > 0
                feature.append(node.split().featureIndex() if inner else 0)
                bound.append(node.split().threshold() if inner else np.inf)
                value.append(node.prediction())
                left.append(i)
                right.append(i)
                if inner:
                    left[i], right[i] = walk(node.leftChild()), walk(node.rightChild())
                return i

            walk(tree._java_obj.rootNode())
            self.trees.append((weight, tree.depth, *map(np.array, (feature, bound, left, right, value))))

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds that a node is main text. Without training pages, named parts decide."""
        if not self.trees:
            return np.where(x[:, NAMED[4]] > 0, -3.0, np.where(x[:, NAMED[3]] > 0, 3.0, 0.5))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for weight, depth, feature, bound, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = np.where(x[rows, feature[at]] <= bound[at], left[at], right[at])
            total += weight * value[at]
        return 2 * total  # the ensemble fits half the log odds


def decode(parent: list[int], odds: np.ndarray, judged: list[bool] | None = None) -> np.ndarray:
    """The likeliest choice in which every kept node's parent is kept; nodes that are not judged go with their parent.

    The root stands for the page and is kept.
    """
    n = len(parent)
    free = [True] * n if judged is None else judged
    yes, no = (np.where(free, -np.logaddexp(0, s * odds), 0.0) for s in (-1, 1))
    keep, drop = yes.tolist(), no.tolist()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        # Children come after their parent, so these are final.
        keep[p] += max(keep[i], drop[i]) if free[i] else keep[i]
        drop[p] += drop[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[parent[i]] and (not free[i] or keep[i] > drop[i])
    return kept


def fit(pages: DataFrame, most: int = PAGES, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Learn from about `most` pages, chosen by hash of their text."""
    share = max(1, pages.count() // most)
    sample = pages.filter(F.col("html").isNotNull() & (F.pmod(F.xxhash64("html"), F.lit(share)) == 0)).select("html")

    def task(batches):
        for b in batches:
            rows, labels, rng = [], [], np.random.default_rng(7)
            for source in b.column(0).to_pylist():
                x, y = Page(source).features()
                x, y = x[y >= 0], y[y >= 0]
                plain, moved = x.copy(), x[rng.permutation(len(x))]
                plain[:, NAMED] = 0
                moved[:, NAMED] = x[:, NAMED]
                rows += [*x.tolist(), *plain.tolist(), *moved.tolist()]
                labels += y.tolist() * 3
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["x", "label"])

    nodes = staged(sample.mapInArrow(task, "x array<double>, label double"), "nodes")
    if nodes.select("label").distinct().count() < 2:
        return Trees()
    data = nodes.select(array_to_vector("x").alias("features"), "label").coalesce(4)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=64, seed=1).fit(data)
    return Trees(model)


def extract(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages, and pages without main text, have an empty text. Repeated rows and null ids are rows like
    others; pages of any length are read whole; other columns are not read; an empty table gives no rows. The model
    is learnt from the pages if none is given.
    """
    model = fit(pages) if model is None else model
    kind = pages.schema["page_id"].dataType.simpleString()

    def task(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                read = [Page(s) for s in part.column("html").to_pylist()]
                x = [p.features()[0] for p in read]
                odds = np.split(model.odds(np.concatenate(x)), np.cumsum([len(r) for r in x])[:-1])
                texts = [p.text(decode(p.parent, o, p.judged())) for p, o in zip(read, odds)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return spread(pages.select("page_id", "url", "html")).mapInArrow(task, f"page_id {kind}, url string, text string, n_chars bigint")
