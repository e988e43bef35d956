"""How outcomes and rankings of scenarios react to their assumptions; everything is computed, nothing is drawn at random.

A scenario is a row with factors, and the outcome is a column expression of them that is affine in each factor alone
(as the expected value of TM-10 is). Factors are a short list, so all levels are expanded inside a row's own task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col

Outcome = Callable[[dict[str, Column]], Column]
#: Lowest and highest multiple of each factor.
Bounds = dict[str, tuple[float, float]]


def expected_value(f: dict[str, Column]) -> Column:
    """The outcome of TM-10 from cost, benefit and probability."""
    return (f["benefit"] - f["cost"]) * f["probability"]


def _at(outcome: Outcome, factors: Sequence[str], changed: dict[str, float | Column]) -> Column:
    return outcome({n: col(n) * (F.lit(changed[n]) if n in changed else F.lit(1.0)) for n in factors})


def one_at_a_time(df: DataFrame, bounds: Bounds, outcome: Outcome = expected_value) -> DataFrame:
    """A row per scenario and factor: the columns of `df`, factor, base, low, high (outcomes at the bounds), swing and
    elasticity (relative change of the outcome per relative change of the factor)."""
    names = list(bounds)
    base = _at(outcome, names, {})
    rows = [F.struct(F.lit(n).alias("factor"), base.alias("base"), _at(outcome, names, {n: lo}).alias("low"),
                     _at(outcome, names, {n: hi}).alias("high"), F.lit(float(hi - lo)).alias("_span")) for n, (lo, hi) in bounds.items()]
    d = df.select(*map(col, df.columns), F.inline(F.array(*rows)))
    change = F.col("high") - F.col("low")
    return d.withColumn("swing", F.abs(change)).withColumn(
        "elasticity", F.try_divide(change, F.col("base") * F.col("_span"))).drop("_span")


def pairwise(df: DataFrame, bounds: Bounds, outcome: Outcome = expected_value) -> DataFrame:
    """A row per scenario and pair of factors: factor_a, factor_b, the outcomes at the four corners (low_low, low_high,
    high_low, high_high), worst, best, and interaction: what both changes do beyond the sum of each alone."""
    names, rows = list(bounds), []
    base = _at(outcome, names, {})
    for a, b in combinations(names, 2):
        (la, ha), (lb, hb) = bounds[a], bounds[b]
        corners = {"low_low": (la, lb), "low_high": (la, hb), "high_low": (ha, lb), "high_high": (ha, hb)}
        values = {n: _at(outcome, names, {a: x, b: y}) for n, (x, y) in corners.items()}
        both = values["high_high"] - _at(outcome, names, {a: ha}) - _at(outcome, names, {b: hb}) + base
        rows.append(F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), *[v.alias(n) for n, v in values.items()],
                             F.least(*values.values()).alias("worst"), F.greatest(*values.values()).alias("best"), both.alias("interaction")))
    return df.select(*map(col, df.columns), F.inline(F.array(*rows)))


def switching_points(df: DataFrame, key: str, bounds: Bounds, groups: Sequence[str] = (), outcome: Outcome = expected_value) -> DataFrame:
    """At which multiple of a factor a scenario takes, or the leader loses, the first place of its group.

    A row per scenario and factor: groups, key, factor, base, rival (the leader; for the leader the runner-up), rival_base,
    switch (the exact multiple at which both are equal; null where the factor does not move the outcome) and reachable
    (the multiple lies within the bounds). Ties go to the smaller key. Only the two best rows of a group leave a map task,
    and a group without a rival has no rows.
    """
    names, group = list(bounds), list(map(col, groups))
    base = _at(outcome, names, {})
    d = df.select(*map(col, df.columns), base.alias("_base")).filter("_base is not null")
    top = d.select(*group, col(key).alias("_key"), "_base").withColumn("_r", F.row_number().over(
        Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("_base"), F.asc("_key")))).filter("_r <= 2")
    place = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    leaders = top.groupBy(*[g.alias(f"_g{i}") for i, g in enumerate(group)]).agg(
        place(1, "_key").alias("_first"), place(1, "_base").alias("_fb"), place(2, "_key").alias("_second"), place(2, "_base").alias("_sb"))
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & g.eqNullSafe(F.col(f"_g{i}"))
    d = d.join(F.broadcast(leaders) if not group else leaders, on)  # one row without groups
    leads = col(key) == F.col("_first")
    rival, rival_base = F.when(leads, F.col("_second")).otherwise(F.col("_first")), F.when(leads, F.col("_sb")).otherwise(F.col("_fb"))
    rows = []
    for n, (lo, hi) in bounds.items():
        rest = _at(outcome, names, {n: 0.0})  # affine in the factor: outcome(m) = rest + m * (base - rest)
        switch = F.try_divide(rival_base - rest, F.col("_base") - rest)
        rows.append(F.struct(F.lit(n).alias("factor"), F.col("_base").alias("base"), rival.alias("rival"), rival_base.alias("rival_base"),
                             switch.alias("switch"), F.coalesce(switch.between(lo, hi), F.lit(False)).alias("reachable")))
    return d.filter("_second is not null").select(*group, col(key), F.inline(F.array(*rows)))
