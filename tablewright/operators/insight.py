"""Column classes, summaries, trends, segments, anomalies and rule-based recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import severity as sev
from ..functions.chunks import POS, with_dense_position, with_position
from ..functions.columns import (
    as_number, col, date_columns, finite, is_date, long_rows, nan_to_null, numeric_columns, percent, pin,
    text_columns,
)
from ..functions.dates import looks_like_date, parse_date
from ..functions.jobs import together
from ..functions.quantiles import exact_quantiles
from ..functions.stage import staged
from ..functions.values import top_values, value_counts
from .quality import distinct_facts, moment_facts

# Limits of the report's listings, and thresholds.
DATE_SHARE, CATEGORY_SHARE = 0.8, 0.5
DAILY_SPAN, WEEKLY_SPAN = 90, 730
SEGMENTS, ANOMALY_ROWS, TOP_VALUES = 20, 20, 10
SEGMENT_COLUMNS, SEGMENT_METRICS = 3, 5
ANOMALY_SIGMA, ANOMALY_MIN_ROWS = 2.0, 10
TREND_SHARE = 0.7


def classify_columns(df: DataFrame) -> DataFrame:
    """IN-1: (position, column, class) with class numeric, datetime, categorical or other.

    Text is judged on its distinct values with their counts, so a value is parsed once however often it occurs.
    """
    text = text_columns(df)
    entries = []
    for i, f in enumerate(df.schema):
        kind = ("numeric" if isinstance(f.dataType, T.NumericType) else "datetime" if is_date(f.dataType)
                else None if f.name in text else "other")
        entries.append((i, f.name, kind))
    base = df.sparkSession.createDataFrame(entries, "position int, column string, class string")
    if not text:
        return base
    rows = df.count()
    found = value_counts(df, text).groupBy("column").agg(
        F.sum(F.when(looks_like_date(F.col("value")), F.col("n")).otherwise(0)).alias("dates"), F.count("*").alias("distinct"))
    dated = F.col("dates") >= DATE_SHARE * rows
    few = F.coalesce("distinct", F.lit(0)) < CATEGORY_SHARE * rows
    kind = F.when(dated & F.lit(rows > 0), "datetime").when(few, "categorical").otherwise("other")
    return base.join(pin(found), "column", "left").select("position", "column", F.coalesce("class", kind).alias("class"))


def classes(df: DataFrame) -> dict[str, list[str]]:
    """IN-1 as lists in schema order; one small collect."""
    out: dict[str, list[str]] = {"numeric": [], "datetime": [], "categorical": [], "other": []}
    for r in sorted(classify_columns(df).collect(), key=lambda r: r["position"]):
        out[r["class"]].append(r["column"])
    return out


def growth(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """IN-3: (column, growth_rate) from the first to the last non-null value in row order."""
    d = nan_to_null(df)
    fields = {f.name: f for f in d.schema}
    d = with_position(d, order, "_p")
    aggs, entries = [], []
    for i, c in enumerate(columns):
        x = as_number(fields[c])
        at = F.when(x.isNotNull(), F.col("_p"))
        aggs += [F.min_by(x, at).alias(f"a{i}"), F.max_by(x, at).alias(f"z{i}"), F.count(x).alias(f"n{i}")]
        rate = F.try_divide(F.col(f"z{i}") - F.col(f"a{i}"), F.abs(f"a{i}"))
        entries.append(F.struct(F.lit(c).alias("column"),
                                finite(F.when(F.col(f"n{i}") >= 2, rate)).alias("growth_rate")))
    return d.agg(*aggs).select(long_rows(entries))


def column_summary(df: DataFrame, kinds: dict[str, list[str]], order: str | None = None,
                   approx: bool = False) -> DataFrame:
    """IN-2 with IN-3: one row per column."""
    d = nan_to_null(df)
    facts = moment_facts(d).join(distinct_facts(d, approx=approx), "column")
    numeric = kinds["numeric"]
    label = F.create_map(*[F.lit(x) for k, names in kinds.items() for n in names for x in (n, k)])
    facts = facts.withColumn("class", F.element_at(label, F.col("column")))
    is_num = F.col("class") == "numeric"
    fields = {f.name: f for f in d.schema}
    quart = exact_quantiles(d, {n: as_number(fields[n]) for n in numeric}, [0.25, 0.5, 0.75], approx=approx)
    spark = df.sparkSession
    q = spark.createDataFrame([(n, *v) for n, v in quart.items()] or [],
                              "column string, q25_val double, median_val double, q75_val double")
    sums = d.agg(*[F.sum(as_number(fields[n])).alias(f"s{i}") for i, n in enumerate(numeric)]).select(long_rows(
        [F.struct(F.lit(n).alias("column"), F.col(f"s{i}").alias("sum_val")) for i, n in enumerate(numeric)])) \
        if numeric else spark.createDataFrame([], "column string, sum_val double")
    g = growth(d, numeric, order) if numeric else spark.createDataFrame([], "column string, growth_rate double")
    out = facts.join(q, "column", "left").join(sums, "column", "left").join(g, "column", "left")
    stat = lambda c: F.when(is_num, finite(F.col(c)))
    return out.select(
        "position", F.col("column").alias("column_name"), F.col("class").alias("dtype"),
        (F.col("rows") - F.col("nulls")).alias("count"), F.col("nulls").alias("null_count"),
        percent(F.col("nulls"), F.col("rows")).alias("null_pct"), F.col("distinct").alias("unique_count"),
        finite(F.col("sum_val")).alias("sum_val"), stat("mean").alias("mean_val"), stat("min").alias("min_val"),
        stat("max").alias("max_val"), stat("std").alias("std_val"), "median_val", "q25_val", "q75_val", "growth_rate",
    )


def top_category_values(df: DataFrame, columns: list[str], k: int = TOP_VALUES) -> DataFrame:
    """IN-4: (column, value, n, total, rank, pct) of the most frequent values."""
    return top_values(value_counts(df, columns), k)


# ---------------------------------------------------------------- trends

def _as_time(df: DataFrame, date: str) -> Column:
    dtype = df.schema[date].dataType
    return col(date).cast("timestamp_ntz") if is_date(dtype) else parse_date(col(date)).cast("timestamp_ntz")


def period(t: Column, frequency: str) -> Column:
    """Start of day or month, or the Sunday that ends the week."""
    if frequency == "week":
        return (F.date_trunc("week", t) + F.expr("interval 6 days")).cast("timestamp_ntz")
    return F.date_trunc(frequency, t).cast("timestamp_ntz")


def pick_frequency(df: DataFrame, date: str) -> str | None:
    t = _as_time(df, date)
    span = df.agg((F.unix_micros(F.max(t).cast("timestamp")) - F.unix_micros(F.min(t).cast("timestamp"))).alias("us"))
    us = span.first()["us"]
    if us is None:
        return None
    days = us // 86_400_000_000
    return "day" if days <= DAILY_SPAN else "week" if days <= WEEKLY_SPAN else "month"


def trend_values(df: DataFrame, date: str, metrics: list[str], frequency: str | None = None) -> DataFrame:
    """IN-5: (metric, period, value), the mean per period; periods without values are left out.

    The result has one row per metric and calendar period, so the windows below stay small.
    """
    d = nan_to_null(df)
    frequency = frequency or pick_frequency(d, date)
    if frequency is None:
        return df.sparkSession.createDataFrame([], "metric string, period timestamp_ntz, value double")
    fields = {f.name: f for f in d.schema}
    t = _as_time(d, date)
    means = d.filter(t.isNotNull()).groupBy(period(t, frequency).alias("period")).agg(
        *[F.avg(as_number(fields[m])).alias(f"v{i}") for i, m in enumerate(metrics)])
    entries = [F.struct(F.lit(m).alias("metric"), F.col("period"), F.col(f"v{i}").alias("value"))
               for i, m in enumerate(metrics)]
    return means.select(long_rows(entries)).filter("value is not null")


def trend_points(values: DataFrame) -> DataFrame:
    """IN-6: add ordinal, change_pct and the number of periods; series of one period are dropped."""
    w = Window.partitionBy("metric").orderBy("period")
    prev = F.lag("value").over(w)
    return (
        values.withColumn("ordinal", F.row_number().over(w))
        .withColumn("change_pct", F.try_divide(F.col("value") - prev, F.abs(prev)) * 100)
        .withColumn("periods", F.count("*").over(Window.partitionBy("metric")))
        .filter("periods >= 2")
    )


def trends(points: DataFrame) -> DataFrame:
    """IN-7: (metric, direction, overall_change_pct, periods) over all points."""
    change = F.col("change_pct")
    up = F.avg(F.when(change.isNotNull(), (change > 0).cast("double")))
    down = F.avg(F.when(change.isNotNull(), (change < 0).cast("double")))
    first, last = F.min_by("value", "period"), F.max_by("value", "period")
    stats = points.groupBy("metric").agg(
        up.alias("up"), down.alias("down"), F.stddev_pop(change).alias("spread"), F.avg(F.abs(change)).alias("size"),
        F.count(change).alias("n"), (F.try_divide(last - first, F.abs(first)) * 100).alias("overall_change_pct"),
        F.count("*").alias("periods"))
    direction = (
        F.when(F.col("n") == 0, "stable").when(F.col("up") >= TREND_SHARE, "increasing")
        .when(F.col("down") >= TREND_SHARE, "decreasing")
        .when((F.col("n") > 1) & (F.col("size") > 0) & (F.col("spread") > F.col("size")), "volatile")
        .otherwise("stable"))
    return stats.select("metric", direction.alias("direction"), finite(F.col("overall_change_pct"))
                        .alias("overall_change_pct"), "periods")


# ---------------------------------------------------------------- segments

def segment_stats(df: DataFrame, categories: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sum and count of every segment of each (category, metric); all categories in one pass."""
    d = nan_to_null(df)
    fields = {f.name: f for f in d.schema}
    keyed = d.select(
        long_rows([F.struct(F.lit(c).alias("segment_column"), col(c).cast("string").alias("segment"))
                   for c in categories]),
        *[as_number(fields[m]).alias(f"x{i}") for i, m in enumerate(metrics)],
    ).filter("segment is not null")
    grouped = keyed.groupBy("segment_column", "segment").agg(*[
        f(F.col(f"x{i}")).alias(f"{n}{i}") for i in range(len(metrics))
        for f, n in ((F.avg, "m"), (F.sum, "s"), (F.count, "n"))])
    entries = [F.struct(F.col("segment_column"), F.lit(m).alias("metric_column"), F.col("segment"),
                        F.coalesce(finite(F.col(f"m{i}")), F.lit(0.0)).alias("mean"),
                        F.coalesce(finite(F.col(f"s{i}")), F.lit(0.0)).alias("sum"),
                        F.col(f"n{i}").alias("count")) for i, m in enumerate(metrics)]
    return grouped.select(long_rows(entries))


def largest_segments(stats: DataFrame, k: int = SEGMENTS) -> DataFrame:
    """The k largest segments of each (category, metric); the rank filter is a group limit before its shuffle."""
    w = Window.partitionBy("segment_column", "metric_column").orderBy(F.desc("count"), F.asc("segment"))
    return stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def segments(df: DataFrame, categories: list[str], metrics: list[str], k: int = SEGMENTS) -> DataFrame:
    """IN-8: mean, sum and count per segment, the k largest segments of each (category, metric)."""
    return largest_segments(segment_stats(df, categories, metrics), k)


def pick_segments(df: DataFrame, kinds: dict[str, list[str]], columns: int = SEGMENT_COLUMNS,
                  metrics: int = SEGMENT_METRICS) -> tuple[list[str], list[str]]:
    """The categories with the fewest values and the metrics with the widest spread."""
    cats, nums = kinds["categorical"], kinds["numeric"]
    if not cats or not nums:
        return [], []
    d = nan_to_null(df)
    n = {r["column"]: r["distinct"] for r in distinct_facts(d, cats).collect()}
    s = {r["column"]: r["std"] for r in moment_facts(d.select(*map(col, nums))).collect()}
    spread = lambda c: s[c] if s[c] is not None and s[c] == s[c] else 0.0
    return (sorted(cats, key=lambda c: n[c])[:columns],
            sorted(nums, key=spread, reverse=True)[:metrics])


def segment_leaders(stats: DataFrame) -> DataFrame:
    """Per (category, metric): the segment with the best mean, the largest one, and their shares of the total.

    Ties go to the larger segment, then to the smaller name.
    """
    best = F.min_by(F.struct("segment", "mean", "sum"), F.struct(-F.col("mean"), -F.col("count"), F.col("segment")))
    largest = F.min_by(F.struct("segment", "sum"), F.struct(-F.col("count"), F.col("segment")))
    out = stats.groupBy("segment_column", "metric_column").agg(
        best.alias("b"), largest.alias("l"), F.sum("sum").alias("total"))
    return out.select(
        "segment_column", "metric_column", F.col("b.segment").alias("top_segment"), F.col("b.mean").alias("top_mean"),
        (F.try_divide(F.col("b.sum"), F.abs("total")) * 100).alias("top_pct"),
        F.col("l.segment").alias("largest_segment"),
        F.when(F.col("total") > 0, F.col("l.sum") / F.col("total")).alias("largest_share"), "total")


# ---------------------------------------------------------------- anomalies

def anomalies(df: DataFrame, metrics: list[str], order: str | None = None, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    """IN-9: one row per column with values beyond sigma: count, share, direction, first 20 positions and values."""
    d = nan_to_null(df)
    d = with_position(d, order) if order else with_dense_position(d)
    fields = {f.name: f for f in d.schema}
    empty = ("column string, count long, pct double, direction string, positions array<bigint>, "
             "values array<double>, mean double, std double, threshold_sigma double")
    facts = {r["column"]: r for r in moment_facts(df.select(*map(col, metrics))).collect()} if metrics else {}
    entries, known = [], []
    for m in metrics:
        r = facts[m]
        if r["numbers"] < ANOMALY_MIN_ROWS or not r["std"] or r["std"] != r["std"]:
            continue
        x = as_number(fields[m])
        far = F.abs(x - F.lit(r["mean"])) > F.lit(sigma * r["std"])
        entries.append(F.struct(F.lit(m).alias("column"), F.when(far, x).alias("x")))
        known.append((m, r["mean"], r["std"], r["numbers"]))
    spark = df.sparkSession
    if not entries:
        return spark.createDataFrame([], empty)
    stats = spark.createDataFrame(known, "column string, mean double, std double, numbers long")
    far = d.select(F.col(POS).cast("long").alias(POS), long_rows(entries)).filter("x is not null")
    far = far.join(F.broadcast(stats), "column")  # one row per column
    totals = far.groupBy("column").agg(
        F.count("*").alias("count"), F.max(F.col("x") > F.col("mean")).alias("above"),
        F.max(F.col("x") < F.col("mean")).alias("below"))
    w = Window.partitionBy("column").orderBy(POS)
    head = far.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= ANOMALY_ROWS).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("r", POS, "x"))).alias("h"))
    return totals.join(head, "column").join(stats, "column").select(
        "column", "count", percent(F.col("count"), F.col("numbers")).alias("pct"),
        F.when(F.col("above") & F.col("below"), "both").when(F.col("above"), "above").otherwise("below")
        .alias("direction"),
        F.transform("h", lambda s: s[POS]).alias("positions"), F.transform("h", lambda s: s["x"]).alias("values"),
        "mean", "std", F.lit(sigma).alias("threshold_sigma"))


# ---------------------------------------------------------------- recommendations and payload

def recommendations(summary: DataFrame, defects: DataFrame, trend: DataFrame, anomaly: DataFrame,
                    leaders: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """IN-10: (ordinal, category, priority, message, related_columns), rules in report order."""
    none = F.array().cast("array<string>")
    one = lambda *c: F.array(*[F.col(x) for x in c])
    rule = lambda d, step, cat, pri, msg, rel: d.select(
        F.lit(step).alias("step"), F.lit(cat).alias("category"), F.lit(pri).alias("priority"),
        msg.alias("message"), rel.alias("related_columns"))
    decline = (F.col("direction") == "decreasing") & (F.coalesce(F.col("overall_change_pct"), F.lit(0.0)) < -20)
    concentrated = F.col("largest_share") > 0.5
    parts = [
        rule(summary.filter("has_critical_issues"), 0, "data_quality", "high",
             F.lit("Critical data quality issues: fix them before relying on the insights"), none),
        rule(defects.filter(F.col("severity") == sev.HIGH), 1, "data_quality", "medium",
             F.concat(F.lit("High-severity issue in "), F.array_join("columns", ", "), F.lit(": "), F.col("details")),
             F.col("columns")),
        rule(trend.filter(decline), 2, "trend", "high",
             F.format_string("Significant decline in %s: %.1f%% over the period", "metric", "overall_change_pct"),
             one("metric")),
        rule(trend.filter(F.col("direction") == "volatile"), 2, "trend", "medium",
             F.format_string("High volatility in %s", "metric"), one("metric")),
        rule(anomaly.filter("pct > 5"), 3, "anomaly", "high",
             F.format_string("%.1f%% of the values in %s are outliers", "pct", "column"), one("column")),
        rule(anomaly.filter("pct <= 5"), 3, "anomaly", "low",
             F.format_string("Minor outliers in %s (%d values)", "column", "count"), one("column")),
        rule(leaders.filter(concentrated), 4, "segment", "medium",
             F.format_string("Concentration risk: '%s' holds more than %d%% of %s", F.col("largest_segment"),
                             F.floor(F.col("largest_share") * 100), F.col("metric_column")),
             one("segment_column", "metric_column")),
    ]
    spark = summary.sparkSession
    fixed = []
    if not kinds["datetime"]:
        fixed.append((5, "general", "low", "No temporal data: add date columns for trend analysis", []))
    if not kinds["categorical"]:
        fixed.append((6, "general", "low", "No categorical columns: add dimensions for segment comparison", []))
    parts.append(spark.createDataFrame(
        fixed, "step int, category string, priority string, message string, related_columns array<string>"))
    rows = reduce(DataFrame.unionByName, parts)
    # One row per finding; findings are bounded by the schema, not by the data.
    w = Window.partitionBy(F.lit(0)).orderBy("step", "message")
    return rows.select((F.row_number().over(w) - 1).alias("ordinal"), "category", "priority", "message",
                       "related_columns")


def insights(df: DataFrame, report: dict[str, DataFrame], order: str | None = None, approx: bool = False,
             segment_columns: int = SEGMENT_COLUMNS, segment_metrics: int = SEGMENT_METRICS,
             listed: int = SEGMENTS) -> dict[str, DataFrame]:
    """IN-11: all insight tables and one metadata row.

    `listed` bounds the listing of segments only; leaders and shares come from all segments.
    """
    kinds = classes(df)
    spark = df.sparkSession
    none = spark.createDataFrame([], "metric string, period timestamp_ntz, value double")

    def trending():
        has = kinds["datetime"] and kinds["numeric"]
        return pin(trend_points(trend_values(df, kinds["datetime"][0], kinds["numeric"]) if has else none))

    def segmented():
        cats, nums = pick_segments(df, kinds, segment_columns, segment_metrics)
        # Segments grow with the data, so they are written once for the listing and the leaders.
        stats = staged(segment_stats(df, cats, nums)) if cats else spark.createDataFrame(
            [], "segment_column string, metric_column string, segment string, mean double, sum double, count long")
        return pin(largest_segments(stats, listed)), pin(segment_leaders(stats))

    # All of these have a bounded number of rows, or one per calendar period.
    points, (segs, leaders), odd, summary, rows = together(
        spark, trending, segmented, lambda: pin(anomalies(df, kinds["numeric"], order)),
        lambda: pin(column_summary(df, kinds, order, approx)), df.count)
    trend = trends(points)
    rec = recommendations(report["summary"], report["defects"], trend, odd, leaders, kinds)
    meta = spark.createDataFrame([(rows, len(df.columns), *(len(kinds[k]) for k in kinds))],
                                 "rows long, columns int, numeric int, datetime int, categorical int, other int")
    return {
        "summary": summary,
        "top_values": top_category_values(df, kinds["categorical"]) if kinds["categorical"] else spark.createDataFrame(
            [], "column string, value string, n long, total long, rank int, pct double"),
        "trend_points": points, "trends": trend, "segments": segs,
        "segment_leaders": leaders, "anomalies": odd, "recommendations": rec, "metadata": meta,
    }
