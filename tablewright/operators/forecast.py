"""Series summaries, histograms, simple regression, moving averages and forecasts over (x, y) columns.

Every function takes optional `keys`: one series per key, or one for the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.chunks import CHUNK_ROWS, with_previous
from ..functions.columns import as_number, col, nan_to_null
from ..functions.quantiles import exact_quantiles
from ..functions.values import modes


def series_summary(df: DataFrame, y: str) -> DataFrame:
    """TM-1: one row (mean, median, mode, std_dev) with the population std; zeros when empty."""
    df = nan_to_null(df)
    x = as_number(df.schema[y])
    mid = exact_quantiles(df, {y: x}, [0.5])[y][0]
    mode = modes(df, [y], []).get(y)
    zero = F.lit(0.0)
    return df.agg(
        F.coalesce(F.avg(x), zero).alias("mean"), F.lit(mid if mid is not None else 0.0).alias("median"),
        F.lit(mode if mode is not None else 0.0).alias("mode"), F.coalesce(F.stddev_pop(x), zero).alias("std_dev"))


def histogram(df: DataFrame, y: str, bins: int = 10) -> DataFrame:
    """TM-2: (bin, bin_start, bin_end, count) of equal width, the last bin closed; all in bin 0 when the range is zero."""
    df = nan_to_null(df)
    x = as_number(df.schema[y])
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    spark = df.sparkSession
    if r["lo"] is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, count long")
    width = (r["hi"] - r["lo"]) / bins
    at = F.least(F.floor((x - F.lit(r["lo"])) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
    counts = df.filter(x.isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return edges.join(F.broadcast(counts), "bin", "left").select(  # at most `bins` rows
        "bin", (F.lit(r["lo"]) + F.col("bin") * F.lit(width)).alias("bin_start"),
        (F.lit(r["lo"]) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"))


def _group(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*map(col, keys))


def correlation(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """TM-3: r, 0 with fewer than two points or a constant side."""
    fields = {f.name: f for f in df.schema}
    a, b = as_number(fields[x]), as_number(fields[y])
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return _group(df, keys).agg(F.coalesce(F.when(~flat, r), F.lit(0.0)).alias("r"))


def simple_regression(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """TM-4: (slope, intercept, r2, last_x, n); slope 0 for constant x, r2 0 for constant y, zeros below two points."""
    fields = {f.name: f for f in df.schema}
    a, b = as_number(fields[x]), as_number(fields[y])
    d = df.filter(a.isNotNull() & b.isNotNull())
    m = _group(d, keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.covar_pop(a, b).alias("sxy"),
        F.when(F.min(a) < F.max(a), F.var_pop(a)).alias("sxx"), F.when(F.min(b) < F.max(b), F.var_pop(b)).alias("syy"),
        F.max(a).alias("last_x"))
    slope = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0)))
    m = m.withColumn("slope", slope)
    residual = F.col("syy") - 2 * F.col("slope") * F.col("sxy") + F.col("slope") * F.col("slope") * F.coalesce(
        "sxx", F.lit(0.0))
    return m.select(
        *map(col, keys), "slope",
        F.when(F.col("n") < 2, 0.0).otherwise(F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"),
        F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(1 - F.try_divide(residual, F.col("syy")), F.lit(0.0)))
        .alias("r2"), "last_x", "n")


def regression_forecast(df: DataFrame, x: str, y: str, periods: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """TM-7: (step, x, y) for `periods` steps past the last x."""
    fit = simple_regression(df, x, y, keys)
    return fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).select(
        *map(col, keys), "step", (F.col("last_x") + F.col("step")).alias("x"),
        (F.col("intercept") + F.col("slope") * (F.col("last_x") + F.col("step"))).alias("y"))


def moving_average(df: DataFrame, x: str, y: str, window: int = 3, keys: Sequence[str] = (),
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """TM-6: `moving_avg` over the last `window` rows in x order, full windows only. `x` must be unique per key."""
    d = with_previous(df, as_number(df.schema[y]), x, window - 1, keys, "_prev", chunk_rows)
    total = F.aggregate("_prev", F.lit(0.0), lambda s, v: s + v) + as_number(df.schema[y])
    return d.filter(F.size("_prev") == window - 1).withColumn("moving_avg", total / window).drop("_prev")


def moving_average_forecast(df: DataFrame, x: str, y: str, window: int = 3, periods: int = 5,
                            keys: Sequence[str] = ()) -> DataFrame:
    """TM-5: (step, x, y); each forecast enters the next window. Series shorter than the window give nothing.

    Only the last `window` rows per series leave the map tasks (a group limit before the shuffle).
    """
    fields = {f.name: f for f in df.schema}
    order = as_number(fields[x])
    w = Window.partitionBy(*map(col, keys)).orderBy(F.desc("_x")) if keys else None
    d = df.select(*map(col, keys), order.alias("_x"), as_number(fields[y]).alias("_y"))
    if w is not None:
        last = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= window)
    else:
        last = d.orderBy(F.desc("_x")).limit(window)
    tail = F.transform(F.array_sort(F.collect_list(F.struct("_x", "_y"))), lambda s: s["_y"])
    g = _group(last, keys).agg(tail.alias("_t"), F.max("_x").alias("_last")).filter(F.size("_t") == window)
    mean = lambda a: F.aggregate(F.slice(a, -window, window), F.lit(0.0), lambda s, v: s + v) / window
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(periods)), F.col("_t"),
                        lambda acc, _: F.concat(acc, F.array(mean(acc))))
    return g.select(*map(col, keys), "_last", F.posexplode(F.slice(steps, window + 1, periods)).alias("_i", "y")).select(
        *map(col, keys), (F.col("_i") + 1).alias("step"), (F.col("_last") + F.col("_i") + 1).alias("x"), "y")


def forecast_accuracy(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """TM-8: (mape, rmse); zero actuals add nothing to the error but count; zeros when empty."""
    fields = {f.name: f for f in df.schema}
    a, p = as_number(fields[actual]), as_number(fields[predicted])
    e = a - p
    return _group(df.filter(a.isNotNull() & p.isNotNull()), keys).agg(
        F.coalesce(F.avg(F.coalesce(F.abs(F.try_divide(e, a)), F.lit(0.0))) * 100, F.lit(0.0)).alias("mape"),
        F.coalesce(F.sqrt(F.avg(e * e)), F.lit(0.0)).alias("rmse"))


def score_scenarios(df: DataFrame, cost: str = "cost", benefit: str = "benefit", probability: str = "probability") -> DataFrame:
    """TM-10: add roi, expected_value and recommendation; best expected value first."""
    gain = col(benefit) - col(cost)
    roi = F.try_divide(gain, col(cost)) * 100
    chance = F.when(col(probability) != 0, col(probability))
    label = (F.when(roi >= 50, "Highly Recommended").when(roi >= 20, "Recommended")
             .when(roi >= 0, "Consider").otherwise("Avoid"))
    return df.select(*map(col, df.columns), roi.alias("roi"), (gain * F.coalesce(chance, F.lit(1.0))).alias("expected_value"),
                     label.alias("recommendation")).orderBy(F.desc("expected_value"))
