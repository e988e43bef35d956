"""Two-variable linear programs, one per problem key, solved from a table of constraints.

A problem maximises px x + py y under a x + b y <= r with x, y >= 0. Its best
feasible corner lies on constraints that bound the feasible region. Constraints
that bound nothing are dropped first inside slices of a problem (each slice a
bounded group), so that a problem with very many constraints is spread over
tasks, and only the binding ones of every slice meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.stage import staged

SLICE_ROWS = 100_000


def _binding(a: np.ndarray, b: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows that can touch the region { a x + b y <= r } from inside, by merging half-planes.

    Works on directions sorted by angle; for parallel rows the tightest stays, then
    a row whose corner with its neighbours lies outside is removed until none is.
    """
    norm = np.hypot(a, b)
    real = np.flatnonzero(norm > 0)
    if not len(real):
        return np.flatnonzero(r < 0)[:1]
    angle = np.arctan2(b[real], a[real])
    order = real[np.lexsort((r[real] / norm[real], angle))]
    keep: list[int] = []
    seen = None
    for i in order:  # tightest of each direction
        key = (a[i] / norm[i], b[i] / norm[i])
        if seen is None or abs(key[0] - seen[0]) > 1e-12 or abs(key[1] - seen[1]) > 1e-12:
            keep.append(i)
            seen = key
    impossible = np.flatnonzero((norm == 0) & (r < 0))[:1]

    def redundant(p, q, s) -> bool:
        """q adds nothing between its angular neighbours p and s (all turning less than half a circle)."""
        if a[p] * b[s] - b[p] * a[s] <= 0:
            return False
        det = a[p] * b[s] - a[s] * b[p]
        x, y = (r[p] * b[s] - r[s] * b[p]) / det, (a[p] * r[s] - a[s] * r[p]) / det
        return a[q] * x + b[q] * y < r[q] - 1e-9 * max(1.0, abs(r[q]))

    changed = True
    while changed and len(keep) > 2:
        changed = False
        stack: list[int] = []
        n = len(keep)
        for j, q in enumerate(keep):
            p = stack[-1] if stack else keep[-1]
            s = keep[j + 1] if j + 1 < n else (stack[0] if stack else q)
            if redundant(p, q, s):
                changed = True
            else:
                stack.append(q)
        keep = stack
    return np.concatenate([np.array(keep, dtype=int), impossible])


def _best_corner(a, b, r, px, py):
    """The best feasible corner of a small set of rows; ties go to the smaller point."""
    pts = [(0.0, 0.0)]
    ax, bx = a != 0, b != 0
    pts += [(v, 0.0) for v in r[ax] / a[ax] if v >= 0]
    pts += [(0.0, v) for v in r[bx] / b[bx] if v >= 0]
    corners = [np.array(pts).reshape(-1, 2)]
    if len(a) > 1:  # the rows are sorted by angle: corners lie on neighbours
        a2, b2, r2 = (np.roll(v, -1) for v in (a, b, r))
        det = a * b2 - a2 * b
        ok = det != 0
        x = (r * b2 - r2 * b)[ok] / det[ok]
        y = (a * r2 - a2 * r)[ok] / det[ok]
        inside = (x >= 0) & (y >= 0)
        corners.append(np.column_stack([x[inside], y[inside]]))
    best = None
    points = np.vstack(corners)
    for start in range(0, len(points), 1024):
        c = points[start:start + 1024]
        slack = r[None, :] - (c[:, :1] * a[None, :] + c[:, 1:] * b[None, :])
        c = c[(slack >= -1e-9 * np.maximum(1.0, np.abs(r))[None, :]).all(axis=1)]
        for x, y in c:
            v = px * x + py * y
            if best is None or v > best[0] + 1e-12 * max(1.0, abs(v)) or (
                    abs(v - best[0]) <= 1e-12 * max(1.0, abs(v)) and (x, y) < best[1:]):
                best = (v, x, y)
    return best


def solve_programs(constraints: DataFrame, objectives: DataFrame, key: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """TM-9: (key, x, y, value) per problem; null when no corner is feasible.

    `constraints` has (key, a, b, r), `objectives` (key, px, py).
    """
    key_type = constraints.schema[key].dataType.simpleString()
    rows = f"key {key_type}, a double, b double, r double"
    c = constraints.select(F.col(key).alias("key"), *[F.col(x).cast("double").alias(x) for x in "abr"]).filter(
        "key is not null and a is not null and b is not null and r is not null")
    # Of rows with the same left side only the tightest counts.
    c = staged(c.groupBy("key", "a", "b").agg(F.min("r").alias("r")))
    # At most rows / slice_rows problems are large, so this table stays small.
    large = c.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > slice_rows).select(
        F.col("key").alias("_k"), F.ceil(F.col("n") / slice_rows).alias("slices"))

    def reduce_slice(ids: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i = _binding(*(pdf[x].to_numpy() for x in "abr"))
        return pd.DataFrame({"key": ids[0], **{x: pdf[x].to_numpy()[i] for x in "abr"}})

    binding = c.select("key", *"abr")
    if not large.isEmpty():
        marked = c.join(F.broadcast(large), F.col("key") == F.col("_k"), "left")
        binding = marked.filter("_k is null").select("key", *"abr").unionByName(
            marked.filter("_k is not null").withColumn("slice", F.pmod(F.xxhash64("a", "b"), F.col("slices")))
            .groupBy("key", "slice").applyInPandas(reduce_slice, rows))
    goal = objectives.select(F.col(key).alias("key"), F.col("px").cast("double"), F.col("py").cast("double"))

    def solve(ids: tuple, rows_of: pd.DataFrame, goals: pd.DataFrame) -> pd.DataFrame:
        if not len(goals):
            return pd.DataFrame({"key": [], "x": [], "y": [], "value": []})
        a, b, r = (rows_of[x].to_numpy(dtype=float) for x in "abr")
        i = _binding(a, b, r)
        best = _best_corner(a[i], b[i], r[i], float(goals["px"].iloc[0]), float(goals["py"].iloc[0]))
        v, x, y = best if best else (None, None, None)
        return pd.DataFrame({"key": [ids[0]], "x": [x], "y": [y], "value": [v]})

    out = binding.groupBy("key").cogroup(goal.groupBy("key")).applyInPandas(
        solve, f"key {key_type}, x double, y double, value double")
    return out.withColumnRenamed("key", key)
