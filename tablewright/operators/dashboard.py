"""Application-table reads and dashboard series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col

# Allowed values per application column.
ALLOWED = {
    ("profiles", "role"): ["user", "admin"],
    ("datasets", "status"): ["uploaded", "processing", "cleaned", "analyzed", "error"],
    ("activity_logs", "status"): ["success", "error", "pending"],
    ("ml_models", "model_type"): ["regression", "classification", "clustering"],
    ("analytics_results", "analysis_type"): ["descriptive", "diagnostic", "predictive", "prescriptive"],
}
RANGES = {"7d": 7, "30d": 30, "90d": 90, "1y": 365}


def latest(df: DataFrame, key: str, time: str, k: int, tie: str | None = None) -> DataFrame:
    """The k newest rows per key. The filter on the rank is a group limit before the shuffle."""
    w = Window.partitionBy(col(key)).orderBy(col(time).desc(), *([col(tie).desc()] if tie else []))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def user_summary(datasets: DataFrame, analyses: DataFrame, queries: DataFrame, key: str = "user_id",
                 time: str = "created_at", tie: str | None = None, recent: int = 5) -> dict[str, DataFrame]:
    """DB-1: `stats` with the counts of every user, and the `recent` newest rows of each kind."""
    n = lambda d, name: d.groupBy(col(key).alias("user_id")).agg(F.count("*").alias(name))
    stats = n(datasets, "total_datasets").join(n(analyses, "total_analyses"), "user_id", "full_outer").join(
        n(queries, "total_queries"), "user_id", "full_outer").na.fill(0)
    newest = lambda d: latest(d, key, time, recent, tie)
    return {"stats": stats, "recent_datasets": newest(datasets), "recent_analyses": newest(analyses),
            "recent_queries": newest(queries)}


def system_summary(users: DataFrame, datasets: DataFrame, analyses: DataFrame, logs: DataFrame,
                   time: str = "created_at", tie: str | None = None, k: int = 50) -> dict[str, DataFrame]:
    """DB-2: total counts, the newest log rows and the activity per user among them."""
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias(name)).withColumn("_j", F.lit(1))
    totals = one(users, "total_users").join(one(datasets, "total_datasets"), "_j").join(
        one(analyses, "total_analyses"), "_j").drop("_j")
    recent = logs.orderBy(col(time).desc(), *([col(tie).desc()] if tie else [])).limit(k)
    return {"totals": totals, "recent": recent, "activity": recent.groupBy("user_id").agg(F.count("*").alias("n"))}


def activity_ranking(logs: DataFrame, users: DataFrame, key: str, user_key: str, name: Column,
                     label: str = "user_name") -> DataFrame:
    """DB-3: activity count per user with names, busiest first. Counting first leaves one row per user to join."""
    counts = logs.groupBy(col(key).alias("_u")).agg(F.count("*").alias("n"))
    people = users.select(col(user_key).alias("_k"), name.alias("_name"))
    return counts.join(people, F.col("_u") == F.col("_k"), "left").select(
        F.col("_u").alias(key), F.coalesce("_name", F.lit("Unknown User")).alias(label), "n").orderBy(
        F.desc("n"), key)


def tenant_scope(df: DataFrame, user, profiles: DataFrame, key: str = "user_id", user_key: str = "user_id") -> DataFrame:
    """DB-4: rows of the user, or all rows when the user is an admin."""
    admin = profiles.filter((col(user_key) == F.lit(user)) & (F.col("role") == "admin")).select(
        F.lit(True).alias("_admin")).limit(1)
    own = col(key) == F.lit(user)
    # The admin test is a scalar: it runs once and the scan keeps its own-rows filter otherwise.
    return df if not admin.isEmpty() else df.filter(own)


def check_values(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """DB-5: (column, value, n) of values outside the allowed list; null passes, as in a CHECK."""
    rules = {c: v for (t, c), v in ALLOWED.items() if t == table and (columns is None or c in columns)}
    return check_allowed(df, rules)


def check_allowed(df: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    entries = [F.when(col(c).isNotNull() & ~col(c).cast("string").isin(v),
                      F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"))) for c, v in rules.items()]
    if not entries:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    return df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.column", "e.value").agg(
        F.count("*").alias("n"))


def latest_result(results: DataFrame, users: DataFrame | None = None, key: str = "user_id",
                  time: str = "created_at", payload: str = "results",
                  default: str = '{"summary": "No analysis available"}') -> DataFrame:
    """DB-6: newest stored result per user; users without one get the default."""
    last = results.groupBy(col(key).alias(key)).agg(F.max_by(col(payload), col(time)).alias(payload))
    if users is None:
        return last
    return users.select(col(key)).distinct().join(last, key, "left").select(
        key, F.coalesce(payload, F.lit(default)).alias(payload))


# ---------------------------------------------------------------- series

def monthly_target(df: DataFrame, time: str, amount: str, growth: float = 0.02) -> DataFrame:
    """DB-7: (month, sales, target); the target grows by a fixed rate from the first month's sales.

    The windows run over one row per month.
    """
    m = df.filter(col(time).isNotNull()).groupBy(F.date_trunc("month", col(time)).cast("timestamp_ntz").alias("month")).agg(
        F.sum(col(amount)).alias("sales"))
    w = Window.partitionBy(F.lit(0)).orderBy("month")
    first = F.first("sales").over(w)
    steps = F.months_between("month", F.first("month").over(w)).cast("int")
    return m.select("month", "sales", (first * F.pow(F.lit(1.0 + growth), steps)).alias("target"))


def market_share(df: DataFrame, name: str, amount: str, top: int = 5) -> DataFrame:
    """DB-8: (name, value, percentage) of the largest names, the rest as Others.

    Names beyond the top never meet in one window: the top comes from a limit, the rest is total minus top.
    """
    sums = df.groupBy(col(name).cast("string").alias("name")).agg(F.sum(col(amount)).alias("value"))
    total = sums.agg(F.sum("value").alias("total"), F.count("*").alias("names"))
    head = sums.orderBy(F.desc("value"), F.asc("name")).limit(top)
    rest = total.withColumn("_j", F.lit(1)).join(
        head.agg(F.sum("value").alias("top")).withColumn("_j", F.lit(1)), "_j").filter(F.col("names") > top).select(
        F.lit("Others").alias("name"), (F.col("total") - F.col("top")).alias("value"))
    return pie_share(head.unionAll(rest), "value").withColumnRenamed("share_raw", "percentage").withColumn(
        "percentage", F.round("percentage", 1)).select("name", "value", "percentage")


def pie_share(df: DataFrame, value: str) -> DataFrame:
    """DB-12: add the share of the chart total in percent (`share_raw`) and its whole-number label.

    For a chart: a handful of rows, one per slice.
    """
    share = F.try_divide(col(value), F.sum(col(value)).over(Window.partitionBy(F.lit(0)))) * 100
    return df.withColumn("share_raw", share).withColumn("share_label", F.floor(F.col("share_raw") + 0.5).cast("long"))


def weekly_users(df: DataFrame, time: str, user: str) -> DataFrame:
    """DB-9: (week, active_users, new_users).

    One distinct (user, week) table serves both; a user's first week is a plain aggregate.
    """
    seen = df.select(F.date_trunc("week", col(time)).cast("timestamp_ntz").alias("week"), col(user).alias("u")).filter(
        "week is not null and u is not null").distinct()
    active = seen.groupBy("week").agg(F.count("*").alias("active_users"))
    new = seen.groupBy("u").agg(F.min("week").alias("week")).groupBy("week").agg(F.count("*").alias("new_users"))
    return active.join(new, "week", "left").select("week", "active_users", F.coalesce("new_users", F.lit(0)).alias("new_users"))


def quarterly_growth(df: DataFrame, time: str, amount: str) -> DataFrame:
    """DB-10: (quarter, revenue, growth) with growth in percent of the first quarter."""
    q = df.filter(col(time).isNotNull()).groupBy(
        F.date_trunc("quarter", col(time)).cast("timestamp_ntz").alias("quarter")).agg(F.sum(col(amount)).alias("revenue"))
    first = F.first("revenue").over(Window.partitionBy(F.lit(0)).orderBy("quarter"))
    return q.select("quarter", "revenue", (F.try_divide(F.col("revenue") - first, first) * 100).alias("growth"))


def dashboard_filter(df: DataFrame, time: str, span: str = "all", equals: dict[str, object] | None = None) -> DataFrame:
    """DB-11: keep the last days of data (7d, 30d, 90d, 1y, all) and equal values of given columns.

    The newest time is read first, so the range is a plain literal the scan can push down.
    """
    out = df
    for c, v in (equals or {}).items():
        if v is not None and v != "all":
            out = out.filter(col(c) == F.lit(v))
    if span == "all":
        return out
    newest = df.agg(F.max(col(time)).alias("t")).first()["t"]
    if newest is None:
        return out
    return out.filter(col(time) >= F.lit(newest) - F.expr(f"interval {RANGES[span]} days"))
