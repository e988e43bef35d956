"""Mergeable column profiles: exact counts and moments, quantile and distinct sketches.

One row per column and part of the data. Parts (files, days, batches) are profiled once and merged when a profile is
read, so a baseline grows by its new parts only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .columns import as_number, col, nan_to_null, numeric_columns

#: Size of the quantile sketch (rank error about 0.4 % at this size) and bits of the distinct sketch (about 1 %).
K, BITS = 800, 14
RANK_ERROR, DISTINCT_ERROR = 0.01, 0.04


def sketch(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, dtype, rows, n, lo, hi, mean, m2, quantiles, distinct) of one part, from one aggregate over one scan.

    mean, m2 (sum of squares around it), lo, hi and the quantile sketch are null for columns that are not numeric.
    """
    df = nan_to_null(df)
    columns = df.columns if columns is None else columns
    numeric, fields = set(numeric_columns(df)), {f.name: f for f in df.schema}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        text = col(c).cast("string")
        aggs += [F.count(col(c)).alias(f"n{i}"), F.hll_sketch_agg(text, F.lit(BITS)).alias(f"d{i}")]
        if c in numeric:
            x = as_number(fields[c])
            aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"m{i}"),
                     (F.var_pop(x) * F.count(x)).alias(f"v{i}"), F.kll_sketch_agg_double(x, F.lit(K)).alias(f"q{i}")]
    one = df.agg(*aggs)
    null = lambda t: F.lit(None).cast(t)
    rows = [F.struct(
        F.lit(c).alias("column"), F.lit(fields[c].dataType.simpleString()).alias("dtype"), F.col("rows"), F.col(f"n{i}").alias("n"),
        *[(F.col(f"{k}{i}") if c in numeric else null(t)).alias(name) for k, name, t in (
            ("lo", "lo", "double"), ("hi", "hi", "double"), ("m", "mean", "double"), ("v", "m2", "double"), ("q", "quantiles", "binary"))],
        F.col(f"d{i}").alias("distinct")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def merge(*parts: DataFrame) -> DataFrame:
    """The sketch of all parts together. A part may hold the rows of many parts already."""
    every = reduce(DataFrame.unionByName, parts)
    full = F.col("n") > 0
    means = every.groupBy("column").agg((F.sum(F.when(full, F.col("n") * F.col("mean"))) / F.sum("n")).alias("_mean")).withColumnRenamed("column", "_c")
    d = every.join(means, F.col("column") == F.col("_c"))  # one row a column
    off = F.col("mean") - F.col("_mean")
    return d.groupBy("column", "dtype").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("_mean").alias("mean"),
        F.sum(F.when(full, F.col("m2") + F.col("n") * off * off)).alias("m2"),
        F.kll_merge_agg_double(F.when(full, F.col("quantiles"))).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def profile(sketches: DataFrame, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, dtype, rows, n, nulls, lo, hi, mean, std, distinct, q25, q50, ...) of merged sketches."""
    some = F.col("lo").isNotNull()  # numeric, with at least one value
    return sketches.select(
        "column", "dtype", "rows", "n", (F.col("rows") - F.col("n")).alias("nulls"), "lo", "hi", "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"), F.hll_sketch_estimate("distinct").alias("distinct"),
        *[F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(p))).alias(f"q{round(p * 100)}") for p in probabilities])


class SketchStore:
    """Sketches of the parts of a growing table, one folder a part; a part that comes again replaces itself."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, part: str, df: DataFrame, columns: list[str] | None = None) -> None:
        sketch(df, columns).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/part={part}")

    def read(self) -> DataFrame:
        """All parts merged."""
        return merge(self.spark.read.parquet(self.root).drop("part"))
