"""Isolation forest: each tree grown in a task from its own sample of the whole table, scored in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_number, col
from ..functions.quantiles import exact_quantiles
from ..functions.stage import spread, staged

TREES = 100
SAMPLE = 256
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int"
SCORE = "_isolation_score"


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[list] = []
    work = [(x, 0, None, None)]
    while work:
        rows, depth, parent, side = work.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][side] = me
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append([-1, 0.0, -1, -1, len(rows)])
            continue
        f = int(rng.choice(usable))
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        nodes.append([f, float(cut), -1, -1, len(rows)])
        low = rows[:, f] <= cut
        work += [(rows[~low], depth + 1, me, 3), (rows[low], depth + 1, me, 2)]
    return nodes


def _mix(x: np.ndarray) -> np.ndarray:
    """64 mixed bits of each 64-bit number (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def samples(df: DataFrame, numbers: list[Column], seed: int = 42, trees: int = TREES) -> DataFrame:
    """(tree, hash, x): for each tree the SAMPLE rows of least hash of (seed, tree, row) in each task, in one pass.

    Each task sends at most SAMPLE rows a tree; the SAMPLE least of all tasks are a draw from the whole table.
    """
    k = len(numbers)

    def draw(batches):
        salts = _mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        hashes, rows = [np.zeros(0, np.uint64)] * trees, [np.zeros((0, k))] * trees
        for pdf in batches:
            x = pdf.iloc[:, 1:].to_numpy(dtype=float)
            number = _mix(pdf["_row"].to_numpy().astype("uint64") + np.uint64(0x9E3779B97F4A7C15))
            for t in range(trees):
                h = _mix(number ^ salts[t])
                full = len(hashes[t]) == SAMPLE
                new = np.flatnonzero(h < hashes[t].max()) if full else np.arange(len(h))
                if len(new):
                    h, v = np.concatenate([hashes[t], h[new]]), np.concatenate([rows[t], x[new]])
                    least = np.argpartition(h, SAMPLE - 1)[:SAMPLE] if len(h) > SAMPLE else np.arange(len(h))
                    hashes[t], rows[t] = h[least], v[least]
        for t in range(trees if len(hashes[0]) else 0):
            yield pd.DataFrame({"tree": np.full(len(hashes[t]), t, np.int32), "hash": hashes[t].view(np.int64), "x": list(rows[t])})

    d = df.select(F.monotonically_increasing_id().alias("_row"), *[n.alias(f"x{i}") for i, n in enumerate(numbers)])
    return d.mapInPandas(draw, "tree int, hash long, x array<double>")


def _least(pdf: pd.DataFrame) -> np.ndarray:
    """The rows of one tree: the SAMPLE least hashes, as unsigned numbers, of all tasks."""
    order = np.argsort(pdf["hash"].to_numpy().view(np.uint64), kind="stable")[:SAMPLE]
    return np.array([pdf["x"].iloc[i] for i in order], dtype=float)


def isolation_scores(df: DataFrame, columns: list[str], seed: int = 42, trees: int = TREES) -> DataFrame:
    """Add SCORE in (0, 1): the higher, the easier a row is to isolate.

    Each tree has SAMPLE rows of its own, drawn from the whole table, or all rows of a smaller one.
    """
    spark = df.sparkSession
    fields = {f.name: f for f in df.schema}
    numbers = [as_number(fields[c]) for c in columns]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t, rows = int(pdf["tree"].iloc[0]), _least(pdf)
        nodes = _grow(rows, np.random.default_rng([seed, t]), max(1, math.ceil(math.log2(max(len(rows), 2)))))
        return pd.DataFrame([(t, i, *n) for i, n in enumerate(nodes)],
                            columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

    table = samples(df, numbers, seed, trees).groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    if not len(table):
        return df.withColumn(SCORE, F.lit(0.0))
    forest = [g.sort_values("node").reset_index(drop=True) for _, g in table.groupby("tree")]
    size = int(forest[0]["size"].iloc[0])  # of a root; all trees have as many rows
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    model = spark.sparkContext.broadcast([
        (g["feature"].to_numpy(), g["threshold"].to_numpy(), g["left"].to_numpy(), g["right"].to_numpy(),
         _average_path(g["size"].to_numpy())) for g in forest
    ])
    scale = float(_average_path(np.array([size]))[0]) or 1.0

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        depth = np.zeros(len(x))
        for feature, threshold, left, right, rest in model.value:
            node = np.zeros(len(x), dtype=int)
            steps = np.zeros(len(x))
            for _ in range(limit + 1):
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[node]
                node = np.where(inner, np.where(low, left[node], right[node]), node)
                steps += inner
            depth += steps + rest[node]
        return pd.Series(np.exp2(-depth / len(model.value) / scale))

    return df.withColumn(SCORE, score(*numbers))


def drop_isolated(df: DataFrame, columns: list[str], contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """CL-23: drop the `contamination` share of rows that are easiest to isolate."""
    scored = staged(isolation_scores(spread(df), columns, seed))
    cut = exact_quantiles(scored, {"s": F.col(SCORE)}, [1 - contamination])["s"][0]
    kept = scored if cut is None else scored.filter(F.col(SCORE) <= F.lit(cut))
    return kept.select(*map(col, df.columns))
