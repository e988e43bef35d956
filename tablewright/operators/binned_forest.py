"""Random forests of few features, grown from sums per cell of binned features instead of from rows.

As in MLlib a feature has at most BINS bins, every row counts in each tree as often as a Poisson draw of mean 1 says, a
node tries a random subset of the features and splits by variance or Gini impurity. Rows in the same bins are never parted,
so trees need only sums per cell: the number of cells is bounded by the bins, not by the rows. Rows are read twice, for
the bins and for the sums; each tree is then grown in a task of its own.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col
from ..functions.stage import staged

BINS = 32
#: Cells and classes up to which a forest is grown here: three features with all their bins.
MAX_CELLS, MAX_CLASSES = BINS**3, 32
ACCURACY = 10_000


def cuts(train: DataFrame, features: list[str]) -> list[list[float]]:
    """Per feature the thresholds between its bins: between all values if they are few, else about equal shares of rows."""
    shares = [i / BINS for i in range(1, BINS)]
    got = train.agg(*[F.struct(F.percentile_approx(col(f), shares, ACCURACY).alias("q"), F.max(col(f)).alias("most"),
                               F.approx_count_distinct(col(f)).alias("kinds")).alias(f"f{i}") for i, f in enumerate(features)]).first()
    out = []
    for i, f in enumerate(features):
        g = got[f"f{i}"]
        # The estimate of few kinds is off by less than half; whether they are few is then counted.
        values = sorted(r[0] for r in train.select(col(f)).distinct().limit(BINS + 1).collect()) if g["kinds"] <= 2 * BINS else []
        if 0 < len(values) <= BINS:
            out.append([(a + b) / 2 for a, b in zip(values, values[1:])])
        else:
            out.append(sorted({x for x in g["q"] or [] if x < g["most"]}))
    return out


def fits(thresholds: list[list[float]], classes: int = 1) -> bool:
    return math.prod(len(t) + 1 for t in thresholds) <= MAX_CELLS and classes <= MAX_CLASSES


def cell(features: list[str], thresholds: list[list[float]]) -> Column:
    """The number of a row's cell; the last feature's bin counts fastest."""
    out = F.lit(0)
    for f, t in zip(features, thresholds):
        steps = [F.when(col(f) > x, 1).otherwise(0) for x in t]
        out = out * (len(t) + 1) + (reduce(Column.__add__, steps) if steps else F.lit(0))
    return out.cast("int")


def _variance(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = s[0]
    m = np.maximum(n, 1)
    return n, s[2] / m - (s[1] / m) ** 2


def _gini(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = s.sum(axis=0)
    return n, 1 - ((s / np.maximum(n, 1)) ** 2).sum(axis=0)


def _grow(sizes: list[int], sums: np.ndarray, impurity, depth: int, subset: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """(sums of its leaf for every cell, importance per feature) of one tree; `sums` has a row per statistic, a column per cell."""
    bins = np.stack(np.unravel_index(np.arange(sums.shape[1]), sizes))
    at = np.zeros(sums.shape[1], dtype=np.int64)
    leaf, importance = np.zeros_like(sums), np.zeros(len(sizes))
    for level in range(depth + 1):
        open_ = np.flatnonzero(at >= 0)
        if not len(open_):
            break
        a, s = at[open_], sums[:, open_]
        k = int(a.max()) + 1
        total = np.stack([np.bincount(a, x, k) for x in s])
        leaf[:, open_] = total[:, a]
        if level == depth:
            break
        n, own = impurity(total)
        tried = rng.random((k, len(sizes))).argsort(axis=1).argsort(axis=1) < subset
        gain, feature, place = np.zeros(k), np.full(k, -1), np.zeros(k, dtype=np.int64)
        for f, size in enumerate(sizes):
            if size < 2:
                continue
            left = np.stack([np.bincount(a * size + bins[f, open_], x, k * size).reshape(k, size) for x in s]).cumsum(axis=2)[:, :, :-1]
            (nl, il), (nr, ir) = impurity(left), impurity(total[:, :, None] - left)
            g = own[:, None] - (nl * il + nr * ir) / np.maximum(n, 1)[:, None]
            g[(nl < 1) | (nr < 1) | ~tried[:, f, None]] = -1
            best = g.argmax(axis=1)
            g = g[np.arange(k), best]
            better = g > gain
            gain[better], feature[better], place[better] = g[better], f, best[better]
        split = feature >= 0
        np.add.at(importance, feature[split], (gain * n)[split])
        number = np.cumsum(split) - 1
        right = bins[feature[a], open_] > place[a]
        at[open_] = np.where(split[a], 2 * number[a] + right, -1)
    return leaf, importance


def _sums(train: DataFrame, at: Column, label: str, shift: float, cells: int, trees: int, seed: int) -> DataFrame:
    """(tree, cell, s0, s1, s2): weight, weighted sum and sum of squares of the label less `shift`."""
    def draw(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums = np.zeros((trees, 3, cells))
        for pdf in batches:
            here, of = np.unique(pdf["cell"].to_numpy(), return_inverse=True)
            y = pdf["y"].to_numpy() - shift
            for t in range(trees if len(pdf) else 0):
                w = rng.poisson(1.0, len(y)).astype(float)
                wy = w * y
                for i, x in enumerate((w, wy, wy * y)):
                    sums[t, i, here] += np.bincount(of, x, len(here))
        for t in range(trees):
            used = np.flatnonzero(sums[t, 0])
            if len(used):
                yield pd.DataFrame({"tree": np.full(len(used), t, np.int32), "cell": used.astype(np.int32),
                                    **{f"s{i}": sums[t, i, used] for i in range(3)}})

    rows = train.select(at.alias("cell"), col(label).cast("double").alias("y"))
    drawn = rows.mapInPandas(draw, "tree int, cell int, s0 double, s1 double, s2 double")
    return drawn.groupBy("tree", "cell").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(3)])


def _ready(grown: DataFrame, features: list[str]) -> tuple[DataFrame, list[float]]:
    """The trees' cells, and the importance of the features: the mean of the trees' shares."""
    grown = staged(grown)
    row = grown.filter("cell < 0").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"f{i}") for i in range(len(features))]).first()
    total = sum(x or 0.0 for x in row)
    return grown.filter("cell >= 0"), [(x or 0.0) / total if total else 0.0 for x in row]


def _rows(tree: int, values: np.ndarray, importance: np.ndarray) -> pd.DataFrame:
    """A row per cell with its values (a row of `values`), and the importance under cell -1."""
    share = importance / importance.sum() if importance.sum() > 0 else importance
    return pd.DataFrame({"tree": np.full(len(values) + 1, tree, np.int32), "cell": np.arange(-1, len(values), dtype=np.int32),
                         "v": [share, *values]})


GROWN = "tree int, cell int, v array<double>"


def regression(train: DataFrame, test: DataFrame, features: list[str], label: str, thresholds: list[list[float]],
               depth: int, trees: int, seed: int) -> tuple[DataFrame, list[float]]:
    """`test` with `prediction`, the mean of the trees' leaf means, and the importance per feature."""
    sizes = [len(t) + 1 for t in thresholds]
    shift = train.agg(F.avg(col(label))).first()[0] or 0.0
    subset = math.ceil(len(features) / 3) if trees > 1 else len(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        sums = np.zeros((3, math.prod(sizes)))
        sums[:, pdf["cell"].to_numpy()] = pdf[["s0", "s1", "s2"]].to_numpy().T
        leaf, importance = _grow(sizes, sums, _variance, depth, subset, np.random.default_rng([seed, t]))
        return _rows(t, (shift + leaf[1] / np.maximum(leaf[0], 1))[:, None], importance)

    at = cell(features, thresholds)
    sums = _sums(train, at, label, shift, math.prod(sizes), trees, seed)
    grown, importance = _ready(sums.repartition(trees, "tree").groupBy("tree").applyInPandas(grow, GROWN), features)
    values = grown.groupBy(F.col("cell").alias("_cell")).agg(F.avg(F.get("v", F.lit(0))).alias("prediction"))
    return test.withColumn("_cell", at).join(F.broadcast(values), "_cell").drop("_cell"), importance  # at most MAX_CELLS rows


def classification(train: DataFrame, test: DataFrame, features: list[str], label: str, classes: int, thresholds: list[list[float]],
                   depth: int, trees: int, seed: int) -> tuple[DataFrame, list[float]]:
    """`test` with `prediction`, the class of most votes (a tree votes by its leaf's shares), and the importance per feature."""
    sizes = [len(t) + 1 for t in thresholds]
    subset = math.ceil(math.sqrt(len(features))) if trees > 1 else len(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["cell", "label"])
        rng = np.random.default_rng([seed, t])
        sums = np.zeros((classes, math.prod(sizes)))
        # n draws of mean 1 add up to one draw of mean n.
        sums[pdf["label"].to_numpy(), pdf["cell"].to_numpy()] = rng.poisson(pdf["n"].to_numpy())
        leaf, importance = _grow(sizes, sums, _gini, depth, subset, rng)
        return _rows(t, (leaf / np.maximum(leaf.sum(axis=0), 1)).T, importance)

    at = cell(features, thresholds)
    counts = staged(train.groupBy(at.alias("cell"), col(label).cast("int").alias("label")).agg(F.count("*").alias("n")))
    each = train.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree")).crossJoin(F.broadcast(counts))
    grown, importance = _ready(each.repartition(trees, "tree").groupBy("tree").applyInPandas(grow, GROWN), features)
    votes = grown.groupBy(F.col("cell").alias("_cell")).agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(classes)]).alias("v"))
    values = votes.select("_cell", (F.array_position("v", F.array_max("v")) - 1).cast("double").alias("prediction"))
    return test.withColumn("_cell", at).join(F.broadcast(values), "_cell").drop("_cell"), importance  # at most MAX_CELLS rows
