"""Running values over a table in order, without a limit on its size.

Rows are dealt to tasks by range of (keys, order) and written once, so that a row's range is fixed. Windows run inside a
range; what crosses a border is one row per range and key.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import col
from .stage import staged

RANGE = "_range"


class Running(NamedTuple):
    """A running sum or minimum of `value`, from the first row of the key on, or from the last one back."""

    value: Column
    kind: str = "sum"
    back: bool = False


def with_range(df: DataFrame, by: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The table written by ranges of `by`, with the number of the range; equal rows share one."""
    parts = [col(c) for c in by]
    dealt = df.repartitionByRange(ranges, *parts) if ranges else df.repartitionByRange(*parts)
    return staged(dealt.withColumn(RANGE, F.spark_partition_id()))


def running(df: DataFrame, keys: Sequence[str], order: str, measures: dict[str, Running], ranges: int | None = None) -> DataFrame:
    """Add the running values per key, the row's own included. Every (keys, order) may occur once; null order is first.

    `ranges`: number of ranges; by default the shuffle decides. A key that fills the table is spread over all of them.
    """
    d = with_range(df, [*keys, order], ranges)
    group = [col(k) for k in keys]
    fn = {"sum": F.sum, "min": F.min}
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": lambda a, b: F.least(a, b)}  # least skips nulls
    totals = d.groupBy(RANGE, *group).agg(*[fn[m.kind](m.value).alias(f"_t{i}") for i, m in enumerate(measures.values())])
    # One row per range and key: a key's rows here number at most the ranges.
    lines = [Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc(RANGE) if m.back else F.asc(RANGE)).rowsBetween(
        Window.unboundedPreceding, -1) for m in measures.values()]
    borders = totals.select(F.col(RANGE).alias("_r"), *[g.alias(f"_k{i}") for i, g in enumerate(group)],
                            *[fn[m.kind](f"_t{i}").over(w).alias(f"_b{i}") for i, (m, w) in enumerate(zip(measures.values(), lines))])
    on = F.col(RANGE) == F.col("_r")
    for i, g in enumerate(group):
        on = on & g.eqNullSafe(F.col(f"_k{i}"))
    inside = [Window.partitionBy(RANGE, *group).orderBy(col(order).desc() if m.back else col(order).asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow) for m in measures.values()]
    local = d.select("*", *[fn[m.kind](m.value).over(w).alias(f"_l{i}") for i, (m, w) in enumerate(zip(measures.values(), inside))])
    return local.join(borders, on, "left").select(
        *map(col, df.columns), *[join[m.kind](F.col(f"_b{i}"), F.col(f"_l{i}")).alias(n) for i, (n, m) in enumerate(measures.items())])
