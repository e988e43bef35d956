"""Drift of whole distributions: two-sample distance, binned stability index and correlations of numeric columns.

What a baseline needs is kept as small tables (`measure`) in a `BaselineStore`: value counts, bins with the edges the
baseline chose, and co-moments of column pairs. Co-moments of parts are merged, so a baseline can grow by new files only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_number, col, long_rows, nan_to_null, numeric_columns
from ..functions.quantiles import exact_quantiles
from ..functions.ranges import Running, running
from ..functions.tails import kolmogorov, normal_two_sided
from ..functions.values import number_counts
from .drift import PSI_FLOOR, psi, psi_drift
from .quality import pair_sums

BINS = 10
LEVEL = 0.05
#: Correlations are kept this far from 1 in absolute value before they are transformed.
EDGE = 1e-12


def _columns(df: DataFrame, columns: list[str] | None) -> list[str]:
    return numeric_columns(df) if columns is None else columns


# ---------------------------------------------------------------- two-sample distance

def value_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n) of the numeric columns, nulls and NaN left out."""
    df = nan_to_null(df)
    return number_counts(df, _columns(df, columns))


def ks(current: DataFrame, base: DataFrame, ranges: int | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance of two value tables: (column, n_base, n_current, distance, at, p_value).

    Both tables are merged by value and run through one chained prefix sum by ranges, so neither a column nor a value
    needs a task of its own. `at` is the smallest value at which the distribution functions are farthest apart; p_value
    follows the limit law. Columns that one side lacks have no row.
    """
    zero = F.lit(0).cast("long")
    both = base.select("column", "value", F.col("n").alias("b"), zero.alias("c")).unionByName(
        current.select("column", "value", zero.alias("b"), F.col("n").alias("c"))).groupBy("column", "value").agg(
        F.sum("b").alias("b"), F.sum("c").alias("c"))
    steps = running(both, ["column"], "value", {"fb": Running(F.col("b")), "fc": Running(F.col("c"))}, ranges)
    # The ends of the running sums are the totals.
    totals = steps.groupBy("column").agg(F.max("fb").alias("n_base"), F.max("fc").alias("n_current")).filter("n_base > 0 and n_current > 0")
    gap = F.abs(F.col("fb") / F.col("n_base") - F.col("fc") / F.col("n_current"))
    far = steps.join(F.broadcast(totals), "column").groupBy("column", "n_base", "n_current").agg(  # one row a column
        F.max(gap).alias("distance"), F.min_by("value", F.struct(-gap, F.col("value"))).alias("at"))
    size = F.sqrt(F.col("n_base").cast("double") * F.col("n_current") / (F.col("n_base") + F.col("n_current")))
    return far.withColumn("p_value", kolmogorov(size * F.col("distance")))


# ---------------------------------------------------------------- binned stability index

def bins(df: DataFrame, columns: list[str] | None = None, count: int = BINS) -> DataFrame:
    """(column, bin, lo, hi, share): bins of about equal share, open at both ends; a bin holds lo < value <= hi.

    Equal quantiles give one edge, so a column of few values has fewer bins. A column without values has none.
    """
    df = nan_to_null(df)
    columns = _columns(df, columns)
    fields = {f.name: f for f in df.schema}
    cuts = exact_quantiles(df, {c: as_number(fields[c]) for c in columns}, [i / count for i in range(1, count)])
    rows = []
    for c in columns:  # `count` rows a column
        edges = sorted({e for e in cuts[c] if e is not None})
        if edges:
            rows += [(c, i, lo, hi) for i, (lo, hi) in enumerate(zip([None, *edges], [*edges, None]))]
    table = df.sparkSession.createDataFrame(rows, "column string, bin int, lo double, hi double")
    return table.join(bin_shares(df, table).select("column", "bin", "share"), ["column", "bin"])


def bin_shares(df: DataFrame, table: DataFrame) -> DataFrame:
    """(column, bin, share) of the non-null values in the bins of another table; columns that are absent are left out."""
    df = nan_to_null(df)
    fields = {f.name: f for f in df.schema}
    edges: dict[str, list[float]] = {}
    for r in table.orderBy("column", "bin").collect():  # a few rows a column
        edges.setdefault(r["column"], []).extend([] if r["hi"] is None else [r["hi"]])
    held = {c: e for c, e in edges.items() if c in fields}
    place = lambda c, cuts: reduce(lambda a, e: a + (as_number(fields[c]) > F.lit(e)).cast("int"), cuts, F.lit(0))
    entries = [F.struct(F.lit(c).alias("column"), F.when(as_number(fields[c]).isNotNull(), place(c, cuts)).alias("bin")) for c, cuts in held.items()]
    if not entries:
        return table.select("column", "bin", F.lit(0.0).alias("share")).limit(0)
    counts = df.select(long_rows(entries)).filter("bin is not null").groupBy("column", "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return table.select("column", "bin").join(totals, "column").join(counts, ["column", "bin"], "left").select(
        "column", "bin", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def binned_psi(current: DataFrame, base: DataFrame) -> DataFrame:
    """(column, psi) of a table against baseline bins; shares of zero count as the floor of DR-7."""
    now = bin_shares(current, base).select("column", "bin", F.col("share").alias("current_share"))
    return psi(base.select("column", "bin", F.col("share").alias("base_share")).join(now, ["column", "bin"]))


def binned_psi_drift(scores: DataFrame) -> DataFrame:
    return psi_drift(scores).withColumn("check", F.lit("numeric_psi"))


# ---------------------------------------------------------------- correlations

MOMENTS = ["n", "mean_a", "mean_b", "s_aa", "s_bb", "s_ab"]


def co_moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, n, mean_a, mean_b, s_aa, s_bb, s_ab) of every column pair over the rows where both are present."""
    df = nan_to_null(df)
    columns = _columns(df, columns)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, mean_a double, mean_b double, s_aa double, s_bb double, s_ab double")
    sums, _, centre = pair_sums(df, columns)
    names, middle = F.array(*map(F.lit, columns)), F.array(*[F.lit(float(c)) for c in centre])
    n, mean = F.col("n"), lambda c: F.try_divide(F.col(c), F.col("n"))
    return sums.filter("n > 0").select(
        F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), n.cast("long").alias("n"),
        (F.get(middle, F.col("i")) + mean("sx")).alias("mean_a"), (F.get(middle, F.col("j")) + mean("sy")).alias("mean_b"),
        (F.col("qx") - n * mean("sx") * mean("sx")).alias("s_aa"), (F.col("qy") - n * mean("sy") * mean("sy")).alias("s_bb"),
        (F.col("p") - n * mean("sx") * mean("sy")).alias("s_ab"))


def merge_moments(*parts: DataFrame) -> DataFrame:
    """Co-moments of the union of tables from those of each table."""
    every = reduce(DataFrame.unionByName, parts)
    weighted = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    means = every.groupBy("a", "b").agg(weighted("mean_a").alias("ma"), weighted("mean_b").alias("mb"))
    d = every.join(means, ["a", "b"])
    da, db = F.col("mean_a") - F.col("ma"), F.col("mean_b") - F.col("mb")
    moved = lambda s, x, y: F.sum(F.col(s) + F.col("n") * x * y).alias(s)
    return d.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("ma").alias("mean_a"), F.first("mb").alias("mean_b"),
                                   moved("s_aa", da, da), moved("s_bb", db, db), moved("s_ab", da, db))


def _r() -> Column:
    r = F.try_divide(F.col("s_ab"), F.sqrt(F.col("s_aa")) * F.sqrt(F.col("s_bb")))
    return F.when((F.col("s_aa") > 0) & (F.col("s_bb") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlation_drift(current: DataFrame, base: DataFrame) -> DataFrame:
    """Fisher's comparison of two tables of co-moments: (a, b, r_base, r_current, n_base, n_current, z, p_value).

    z and p_value are null where a correlation is undefined or a side has fewer than four rows.
    """
    side = lambda d, s: d.select("a", "b", _r().alias(f"r_{s}"), F.col("n").alias(f"n_{s}"))
    d = side(base, "base").join(side(current, "current"), ["a", "b"])
    inner = lambda c: F.greatest(F.lit(EDGE - 1), F.least(F.lit(1 - EDGE), F.col(c)))
    turned = lambda c: F.log((1 + inner(c)) / (1 - inner(c))) / 2
    error = F.sqrt(F.lit(1.0) / (F.col("n_base") - 3) + F.lit(1.0) / (F.col("n_current") - 3))
    fit = F.col("r_base").isNotNull() & F.col("r_current").isNotNull() & (F.col("n_base") > 3) & (F.col("n_current") > 3)
    z = F.when(fit, (turned("r_current") - turned("r_base")) / error)
    return d.withColumn("z", z).withColumn("p_value", normal_two_sided(F.col("z")))


# ---------------------------------------------------------------- baseline state and findings

def measure(df: DataFrame, columns: list[str] | None = None, count: int = BINS) -> dict[str, DataFrame]:
    """The tables a baseline keeps: `values`, `bins` and `moments`."""
    return {"values": value_table(df, columns), "bins": bins(df, columns, count), "moments": co_moments(df, columns)}


def distribution_findings(df: DataFrame, base: dict[str, DataFrame], level: float = LEVEL) -> DataFrame:
    """Findings (check, column, severity, actual_value, detail) of all three comparisons; adjusted for their number.

    Distances and correlations count when their p-value stays below `level` with all tests of the kind controlled by
    `significance.adjust`; the stability index has the bands of DR-7.
    """
    from .significance import adjust

    columns = [r["column"] for r in base["bins"].select("column").distinct().collect() if r["column"] in df.columns]
    distance = ks(value_table(df, columns), base["values"])
    moved = correlation_drift(co_moments(df, columns), base["moments"]).filter("p_value is not null")
    finding = lambda d, check, name, value, text: adjust(d.withColumn("kind", F.lit(check)), "p_value", ["kind"]).filter(
        F.col("adjusted") < level).select(F.lit(check).alias("check"), name.alias("column"), F.lit("medium").alias("severity"),
                                          F.col(value).alias("actual_value"), text.alias("detail"))
    pair = F.concat_ws("~", "a", "b")
    return finding(distance, "distribution", col("column"), "distance", F.format_string("largest gap %.3f at %s", "distance", F.col("at").cast("string"))).unionByName(
        finding(moved, "correlation", pair, "z", F.format_string("r %.3f, was %.3f", "r_current", "r_base"))).unionByName(
        binned_psi_drift(binned_psi(df, base["bins"])))
