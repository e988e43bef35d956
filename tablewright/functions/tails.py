"""Tail probabilities as columns, for tables of tests that never meet on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Terms of the series below BORDER standard deviations, steps of the continued fraction above it.
TERMS, BORDER = 80, 3.0


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of the standard normal law."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) * math.sqrt(2 / math.pi)
    # sum of x^(2k+1) / (1 * 3 * ... * (2k+1)), built term by term
    start = F.struct(x.cast("double").alias("term"), x.cast("double").alias("sum"))
    grow = lambda s, k: F.struct((s["term"] * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * x * x / (2 * k + 1)).alias("sum"))
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    low = 1 - density * F.aggregate(steps, start, grow, lambda s: s["sum"])
    # x + 1/(x + 2/(x + 3/...)) from its end
    deep = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1)), x.cast("double"), lambda f, k: x + k / f)
    return F.when(z.isNull() | F.isnan(z), None).when(x < BORDER, low).when(x > 38, 0.0).otherwise(density / deep)


def kolmogorov(x: Column) -> Column:
    """P(K >= x) of the limit law of Kolmogorov; below 0.2 it is 1 to double precision."""
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
                        lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * x * x))
    return F.when(x.isNull(), None).when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms)))
