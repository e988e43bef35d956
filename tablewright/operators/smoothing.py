"""Exponential smoothing with trend, forecasts and their intervals, over long series as well as many.

Level and trend follow l = a y + (1 - a)(l' + t') and t = b (l - l') + (1 - b) t'. That is an affine map of the state
before, with one matrix for all points, so maps of consecutive points can be composed: a block of points is
known by its length and one vector. Rows are dealt by range of (keys, x); a border between two ranges cuts at most one
series, so at most as many series as ranges need the state handed on, and that table is small.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import as_number, col, nan_to_null
from ..functions.ranges import RANGE, with_range

LEVEL_WEIGHT, TREND_WEIGHT, COVERAGE = 0.3, 0.1, 0.95


def _matrix(a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    return np.array([[1 - a, 1 - a], [-a * b, 1 - a * b]]), np.array([a, a * b])


def _scan(heads: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """State after every point: `own` summed with powers of the matrix from the head of the segment on, by doubling."""
    n = len(own)
    at = np.arange(n)
    place = at - np.maximum.accumulate(np.where(heads, at, 0))
    state, power, step = own.copy(), matrix, 1
    while step <= place.max(initial=0):
        later = np.flatnonzero(place >= step)
        state[later] += state[later - step] @ power.T  # the right side is taken before any row changes
        power, step = power @ power, step * 2
    return state


def smooth(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), level: float = LEVEL_WEIGHT, trend: float = TREND_WEIGHT,
           ranges: int | None = None) -> DataFrame:
    """(keys, x, y, level, trend, fitted, residual) per point in x order; `x` must be unique per key.

    The first point of a series is its level, with trend 0, and has no fitted value. Rows without x or y are left out.
    `ranges`: number of ranges; by default the shuffle decides.
    """
    df = nan_to_null(df)
    fields = {f.name: f for f in df.schema}
    names = [f"_k{i}" for i in range(len(keys))]
    d = df.select(*[col(k).alias(n) for k, n in zip(keys, names)], as_number(fields[x]).alias("_x"), as_number(fields[y]).alias("_y"))
    d = with_range(d.filter("_x is not null and _y is not null"), [*names, "_x"], ranges)
    matrix, weight = _matrix(level, trend)
    kinds = [T.StructField(n, fields[k].dataType) for k, n in zip(keys, names)]

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        """Length and vector of the maps of one block; where the series begins, the vector is its state."""
        pdf = pdf.sort_values("_x")
        own = np.outer(pdf["_y"].to_numpy(), weight)
        if pdf["first"].iloc[0]:
            own[0] = pdf["_y"].iloc[0], 0.0
        end = _scan(np.arange(len(own)) == 0, own, matrix)[-1]
        out = pdf.iloc[:1][[*names, RANGE]].copy()
        return out.assign(n=len(own), v=end[0], w=end[1])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """State before every block but the first of a series."""
        pdf = pdf.sort_values(RANGE, ignore_index=True)
        state, before = np.zeros(2), []
        for n, v, w in zip(pdf["n"], pdf["v"], pdf["w"]):
            before.append(state)
            state = np.linalg.matrix_power(matrix, int(n)) @ state + (v, w)
        return pdf[[*names, RANGE]].assign(l0=[s[0] for s in before], t0=[s[1] for s in before]).iloc[1:]

    def points(pdf: pd.DataFrame) -> pd.DataFrame:
        """All points of a range, whatever the number of its series."""
        code = pdf.groupby(names, sort=False, dropna=False).ngroup().to_numpy() if names else np.zeros(len(pdf), int)
        order = np.lexsort((pdf["_x"].to_numpy(), code))
        pdf, code = pdf.iloc[order].reset_index(drop=True), code[order]
        heads = np.append(True, code[1:] != code[:-1])
        value, held = pdf["_y"].to_numpy(float), pdf["l0"].notna().to_numpy()
        before = pdf[["l0", "t0"]].to_numpy(float)
        own = np.outer(value, weight)
        own[heads & ~held] = np.column_stack([value, np.zeros(len(value))])[heads & ~held]
        carried = heads & held
        own[carried] += before[carried] @ matrix.T
        state = _scan(heads, own, matrix)
        last = np.vstack([[np.nan, np.nan], state[:-1]])
        last[heads] = np.where(held[heads, None], before[heads], np.nan)
        fitted = last.sum(axis=1)
        return pdf[[*names, "_x", "_y"]].assign(level=state[:, 0], trend=state[:, 1], fitted=fitted, residual=value - fitted)

    block_type = T.StructType([*kinds, T.StructField(RANGE, T.IntegerType()), T.StructField("n", T.LongType()),
                               T.StructField("v", T.DoubleType()), T.StructField("w", T.DoubleType())])
    start_type = T.StructType([*kinds, T.StructField(RANGE, T.IntegerType()), T.StructField("l0", T.DoubleType()), T.StructField("t0", T.DoubleType())])
    point_type = T.StructType([*kinds, *[T.StructField(n, T.DoubleType()) for n in ("_x", "_y", "level", "trend", "fitted", "residual")]])
    same = lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    held = d.groupBy(*names).agg(F.min(RANGE).alias("_lo"), F.max(RANGE).alias("_hi")).filter("_lo < _hi")  # at most a series a border
    on = [F.lit(True), *same("d", "h")]
    cut = d.alias("d").join(F.broadcast(held.alias("h")), _all(on)).select("d.*", (F.col(RANGE) == F.col("_lo")).alias("first"))
    starts = cut.groupBy(RANGE, *names).applyInPandas(block, block_type)
    starts = starts.groupBy(*names).applyInPandas(chain, start_type)  # a row a range and cut series
    on = [F.col(f"d.{RANGE}") == F.col(f"s.{RANGE}"), *same("d", "s")]
    ready = d.alias("d").join(F.broadcast(starts.alias("s")), _all(on), "left").select("d.*", "s.l0", "s.t0")
    out = ready.groupBy(RANGE).applyInPandas(points, point_type)
    null = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("_x").alias(x), F.col("_y").alias(y),
                      "level", "trend", null("fitted"), null("residual"))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def forecast(points: DataFrame, x: str, periods: int = 5, keys: Sequence[str] = (), level: float = LEVEL_WEIGHT,
             trend: float = TREND_WEIGHT, coverage: float = COVERAGE) -> DataFrame:
    """(keys, step, x, y, lo, hi) for `periods` steps past the last point of `smooth`, with intervals of the given coverage.

    The variance of step h is that of the one-step residuals times 1 + sum over j < h of (a + a b j)^2. Series without
    a residual have no interval.
    """
    z = NormalDist().inv_cdf((1 + coverage) / 2)
    d = points.groupBy(*map(col, keys)).agg(
        F.max(col(x)).alias("_last"), F.max_by(F.struct("level", "trend"), col(x)).alias("_s"), F.avg(F.col("residual") * F.col("residual")).alias("_v"))
    h = F.col("step")
    # the sum over j = 1 .. h - 1, written out
    growth = (h - 1) * level ** 2 + 2 * level ** 2 * trend * h * (h - 1) / 2 + (level * trend) ** 2 * (h - 1) * h * (2 * h - 1) / 6
    half = z * F.sqrt(F.col("_v") * (1 + growth))
    y = F.col("_s.level") + h * F.col("_s.trend")
    return d.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).select(
        *map(col, keys), "step", (F.col("_last") + h).alias("x"), y.alias("y"), (y - half).alias("lo"), (y + half).alias("hi"))


def coverage(points: DataFrame, keys: Sequence[str] = (), share: float = COVERAGE) -> DataFrame:
    """(keys, points, inside): the share of one-step forecasts whose interval held the value that came."""
    z = NormalDist().inv_cdf((1 + share) / 2)
    group = list(map(col, keys))
    spread = points.groupBy(*[g.alias(f"_c{i}") for i, g in enumerate(group)]).agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("_s"))
    on = _all([F.lit(True), *[g.eqNullSafe(F.col(f"_c{i}")) for i, g in enumerate(group)]])
    return points.filter("residual is not null").join(spread, on).groupBy(*group).agg(
        F.count("*").alias("points"), F.avg((F.abs("residual") <= z * F.col("_s")).cast("double")).alias("inside"))
