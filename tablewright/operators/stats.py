"""Descriptive summaries, correlations and hypothesis tests."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.chunks import prefix_sums
from ..functions.columns import as_number, col, long_rows, nan_to_null, numeric_columns, pin, text_columns
from ..functions.joins import lookup
from ..functions.quantiles import exact_quantiles
from ..functions.special import chi2_upper, f_upper, t_two_sided
from ..functions.stage import staged
from ..functions.values import modes, value_counts
from .quality import duplicate_facts, pair_correlations

# Fixed values.
STRONG, MODERATE, ALPHA = 0.7, 0.5, 0.05


def dataset_info(df: DataFrame) -> dict[str, DataFrame]:
    """ST-1: `info` (one row) and `columns` (column, dtype, missing)."""
    df = nan_to_null(df)
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(col(n).isNull()).alias(f"m{i}")
                                                    for i, n in enumerate(df.columns)])
    columns = row.select(long_rows([
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"m{i}").alias("missing"))
        for i, f in enumerate(df.schema)]))
    total = reduce(Column.__add__, [F.col(f"m{i}") for i in range(len(df.columns))])
    dup = duplicate_facts(df).first()
    info = row.select(
        F.col("rows").alias("total_rows"), F.lit(len(df.columns)).alias("total_columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"), F.lit(len(text_columns(df))).alias("categorical_columns"),
        total.alias("missing_values_total"), F.lit(dup["rows"] - dup["distinct_rows"]).cast("long").alias("duplicate_rows"))
    return {"info": info, "columns": columns}


def numeric_summary(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """ST-2 and ST-3: one row per numeric column with values."""
    df = nan_to_null(df)
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column string")
    fields = {f.name: f for f in df.schema}
    quart = exact_quantiles(df, {c: as_number(fields[c]) for c in columns}, [0.25, 0.5, 0.75], approx=approx)
    mode = modes(df, columns, [])
    aggs, entries = [], []
    stats = [("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("variance", F.var_samp), ("min", F.min),
             ("max", F.max)]
    for i, c in enumerate(columns):
        q1, mid, q3 = quart[c]
        if q1 is None:
            continue
        x = as_number(fields[c])
        iqr = q3 - q1
        aggs += [f(x).alias(f"{n}{i}") for n, f in stats]
        # A constant column has no shape: its skewness and kurtosis are undefined.
        varies = F.min(x) < F.max(x)
        aggs += [F.when(varies, F.skewness(x)).alias(f"sk{i}"), F.when(varies, F.kurtosis(x)).alias(f"ku{i}"),
                 F.count_if((x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr)).alias(f"out{i}")]
        entries.append(F.struct(
            F.lit(c).alias("column"), *[F.col(f"{n}{i}").alias(n) for n, _ in stats],
            F.lit(mode.get(c)).cast("double").alias("mode"), F.lit(q1).alias("q25"), F.lit(mid).alias("median"),
            F.lit(q3).alias("q75"), F.lit(iqr).alias("iqr"), F.col(f"sk{i}").alias("skewness"),
            F.col(f"ku{i}").alias("kurtosis"), F.col(f"out{i}").alias("outliers_count")))
    if not entries:
        return df.sparkSession.createDataFrame([], "column string")
    return df.agg(*aggs).select(long_rows(entries))


def iqr_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """ST-3 alone: (column, lower, upper, outliers_count)."""
    df = nan_to_null(df)
    columns = numeric_columns(df) if columns is None else columns
    fields = {f.name: f for f in df.schema}
    quart = exact_quantiles(df, {c: as_number(fields[c]) for c in columns}, [0.25, 0.75])
    aggs, entries = [], []
    for i, c in enumerate(columns):
        if quart[c][0] is None:
            continue
        q1, q3 = quart[c]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        x = as_number(fields[c])
        aggs.append(F.count_if((x < lo) | (x > hi)).alias(f"o{i}"))
        entries.append(F.struct(F.lit(c).alias("column"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"),
                                F.col(f"o{i}").alias("outliers_count")))
    return df.agg(*aggs).select(long_rows(entries))


def categorical_summary(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """ST-4: one row per text column; ties go to the smallest value at the top and the largest at the bottom."""
    df = nan_to_null(df)
    columns = text_columns(df) if columns is None else columns
    counts = value_counts(df, columns)
    first = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value")))
    last = F.max_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value")))
    one = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique_values"),
                                       first.alias("f"), last.alias("l"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy("column").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("r", "value", "n"))),
                                       lambda s: F.struct(s["value"], s["n"]))).alias("distribution"))
    return one.join(top, "column").select(
        "column", "count", "unique_values", F.col("f.value").alias("most_frequent"),
        F.col("f.n").alias("most_frequent_count"), F.col("l.value").alias("least_frequent"),
        F.col("l.n").alias("least_frequent_count"), "distribution")


# ---------------------------------------------------------------- correlation

def pearson_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """ST-5: (a, b, r, n) for every pair, pairwise complete."""
    return pair_correlations(df, columns)


def average_ranks(counts: DataFrame, value: str, n: str) -> DataFrame:
    """Average rank of every distinct value from its count, by range chunks and prefix sums."""
    d = prefix_sums(counts, value, n)
    return d.withColumn("rank", F.col("_below") + (F.col(n) + 1) / 2).drop("_below")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """ST-6 for one pair: (a, b, r, n) with average ranks over the rows where both are present.

    Works on the counts of distinct (x, y), so copies are combined before any rank is looked up.
    """
    df = nan_to_null(df)
    fields = {f.name: f for f in df.schema}
    joint = staged(
        df.select(as_number(fields[a]).alias("x"), as_number(fields[b]).alias("y"))
        .filter("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n")))
    size = joint.agg(F.sum("n").alias("rows"), F.count("*").alias("pairs")).first()
    spark = df.sparkSession
    if not size["rows"]:
        return spark.createDataFrame([(a, b, None, 0)], "a string, b string, r double, n long")
    ranked = joint
    for c in ("x", "y"):
        counts = joint.groupBy(c).agg(F.sum("n").alias("m"), F.count("*").alias("w"))
        ranks = average_ranks(counts, c, "m").select(F.col(c).alias("_value"), F.col("w").alias("_w"),
                                                     F.col("rank").alias(f"r{c}"))
        ranked = lookup(ranked, ranks, F.col(c), "_value", "_w", size["pairs"])
    mid = (size["rows"] + 1) / 2  # the mean rank is known beforehand
    dx, dy, n = F.col("rx") - mid, F.col("ry") - mid, F.col("n")
    return ranked.agg(
        F.lit(a).alias("a"), F.lit(b).alias("b"),
        F.try_divide(F.sum(dx * dy * n), F.sqrt(F.sum(dx * dx * n)) * F.sqrt(F.sum(dy * dy * n))).alias("r"),
        F.sum("n").alias("n"))


def spearman_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = numeric_columns(df) if columns is None else columns
    parts = [spearman(df, a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if not parts:
        return df.sparkSession.createDataFrame([], "a string, b string, r double, n long")
    return reduce(DataFrame.unionAll, parts)


def strong_correlations(pairs: DataFrame, threshold: float = MODERATE) -> DataFrame:
    """ST-7: (feature1, feature2, correlation, strength), strongest first."""
    return pairs.filter(F.abs("r") >= threshold).select(
        F.col("a").alias("feature1"), F.col("b").alias("feature2"), F.col("r").alias("correlation"),
        F.when(F.abs("r") >= STRONG, "strong").otherwise("moderate").alias("strength"),
    ).orderBy(F.desc(F.abs("correlation")), "feature1", "feature2")


def correlation_insights(pairs: DataFrame) -> DataFrame:
    """ST-8: one row (feature1, feature2, max_abs_r, strong_count)."""
    r = F.coalesce(F.abs("r"), F.lit(0.0))
    d = pairs.agg(F.max_by(F.struct("a", "b"), r).alias("p"), F.max(r).alias("m"),
                  F.count_if(r >= STRONG).alias("strong_count"))
    some = F.col("m") > 0
    return d.select(F.when(some, F.col("p.a")).alias("feature1"), F.when(some, F.col("p.b")).alias("feature2"),
                    F.col("m").alias("max_abs_r"), "strong_count")


# ---------------------------------------------------------------- hypothesis tests

TEST = ("test_type string, statistic double, p_value double, degrees_of_freedom double, "
        "degrees_of_freedom_2 double, is_significant boolean, n long")


def _result(spark, name, stat, p, d1, d2, n) -> DataFrame:
    ok = p is not None and p == p
    return spark.createDataFrame(
        [(name, stat, p if ok else None, d1, d2, bool(p < ALPHA) if ok else None, n)], TEST)


def pearson_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """ST-9."""
    r = pair_correlations(df, [a, b]).first()
    n = r["n"]
    p = None
    if r["r"] is not None and n > 2:
        rest = 1 - min(1.0, abs(r["r"])) ** 2
        p = 0.0 if rest == 0 else t_two_sided(r["r"] * math.sqrt((n - 2) / rest), n - 2)
    return _result(df.sparkSession, "Pearson Correlation Test", r["r"], p, float(n - 2), None, n)


def group_moments(df: DataFrame, target: str, feature: str) -> DataFrame:
    """(key, n, mean, var) per group, the target shifted by its overall mean for accuracy.

    The shift is constant, so test statistics do not change. Copies of one key are
    combined on the map side.
    """
    df = nan_to_null(df)
    x = as_number(df.schema[target])
    centre = df.filter(col(feature).isNotNull()).agg(F.avg(x).alias("m")).first()["m"] or 0.0
    return df.filter(col(feature).isNotNull()).groupBy(col(feature).alias("key")).agg(
        F.count(x).alias("n"), (F.avg(x) - F.lit(centre)).alias("mean"), F.var_samp(x).alias("var"),
    ).withColumn("shift", F.lit(centre))


def t_statistic(groups: DataFrame) -> DataFrame:
    """ST-10 without p: pooled t of two groups in key order, one row (t, dof, n)."""
    a, b = F.min_by(F.struct("n", "mean", "var"), "key"), F.max_by(F.struct("n", "mean", "var"), "key")
    d = groups.agg(a.alias("a"), b.alias("b"))
    dof = F.col("a.n") + F.col("b.n") - 2
    ss = lambda g: F.coalesce((F.col(f"{g}.n") - 1) * F.col(f"{g}.var"), F.lit(0.0))
    pooled = F.try_divide(ss("a") + ss("b"), dof)
    scale = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("a.n")) + F.try_divide(F.lit(1.0), F.col("b.n"))))
    return d.select(F.try_divide(F.col("a.mean") - F.col("b.mean"), scale).alias("t"), dof.alias("dof"),
                    (F.col("a.n") + F.col("b.n")).alias("n"))


def anova_statistic(groups: DataFrame) -> DataFrame:
    """ST-11 without p: one row (f, dof_between, dof_within, n)."""
    g = groups.filter("n > 0")
    n, m = F.col("n"), F.col("mean")
    d = g.agg(F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(n * m).alias("s"), F.sum(n * m * m).alias("q"),
              F.sum((n - 1) * F.coalesce("var", F.lit(0.0))).alias("within"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return d.select(F.try_divide(F.try_divide(between, d1), F.try_divide(F.col("within"), d2)).alias("f"),
                    d1.alias("dof_between"), d2.alias("dof_within"), "n")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """ST-12: (a, b, n) over rows where both are present."""
    return df.filter(col(a).isNotNull() & col(b).isNotNull()).groupBy(
        col(a).cast("string").alias("a"), col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))


def chi2_statistic(table: DataFrame) -> DataFrame:
    """ST-12 without p: one row (chi2, dof, n); with Yates' correction when dof is 1.

    Uses sum(o^2 / (r c)), so empty cells need not exist as rows.
    """
    table = staged(table)
    rows = table.groupBy("a").agg(F.sum("n").alias("r"))
    cols = table.groupBy("b").agg(F.sum("n").alias("c"))
    size = rows.agg(F.count("*").alias("k"), F.sum("r").alias("n")).first()
    width = cols.count()
    total, dof = size["n"] or 0, (size["k"] - 1) * (width - 1)
    spark = table.sparkSession
    if dof <= 0:
        return spark.createDataFrame([(0.0, 0, total)], "chi2 double, dof long, n long")
    if dof == 1:
        cell = {(r["a"], r["b"]): r["n"] for r in table.collect()}  # four cells
        left = {r["a"]: r["r"] for r in rows.collect()}
        top = {r["b"]: r["c"] for r in cols.collect()}
        chi = 0.0
        for i, r in left.items():
            for j, c in top.items():
                e = r * c / total
                gap = abs(cell.get((i, j), 0) - e)
                chi += (gap - min(0.5, gap)) ** 2 / e
        return spark.createDataFrame([(chi, 1, total)], "chi2 double, dof long, n long")
    d = table.join(rows, "a").join(cols, "b")
    share = F.sum(F.col("n") * F.col("n") / (F.col("r").cast("double") * F.col("c")))
    return d.agg(((share - 1) * F.lit(total)).alias("chi2"), F.lit(dof).cast("long").alias("dof"),
                 F.lit(total).cast("long").alias("n"))


def hypothesis_test(df: DataFrame, target: str, feature: str) -> DataFrame:
    """ST-9 to ST-12 by column types; a text target with a numeric feature has no test and gives no row."""
    if target not in df.columns or feature not in df.columns:
        raise ValueError(f"columns {target!r} and {feature!r} must exist")
    spark = df.sparkSession
    numeric = set(numeric_columns(df, booleans=True))
    if target in numeric and feature in numeric:
        return pearson_test(df, target, feature)
    if target in numeric:
        groups = group_moments(df, target, feature)
        groups = staged(groups.filter("n > 0"))  # a group without target values is no group to compare
        if groups.count() == 2:
            r = t_statistic(groups).first()
            p = t_two_sided(r["t"], r["dof"]) if r["t"] is not None and r["dof"] > 0 else None
            return _result(spark, "Two-sample T-test", r["t"], p, float(r["dof"]), None, r["n"])
        r = anova_statistic(groups).first()
        ok = r["f"] is not None and r["dof_between"] > 0 and r["dof_within"] > 0
        p = f_upper(r["f"], r["dof_between"], r["dof_within"]) if ok else None
        return _result(spark, "One-way ANOVA", r["f"], p, float(r["dof_between"] or 0), float(r["dof_within"] or 0),
                       r["n"])
    if feature in numeric:
        return spark.createDataFrame([], TEST)
    r = chi2_statistic(contingency(df, target, feature)).first()
    p = chi2_upper(r["chi2"], r["dof"]) if r["dof"] > 0 else 1.0
    return _result(spark, "Chi-square Test of Independence", r["chi2"], p, float(r["dof"]), None, r["n"])
