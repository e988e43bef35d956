"""Queries over the insight operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import insight as i, quality as q
from .common import big, dirty, joined, r, rounded, table, unions, view

QUERIES, SQL = {}, {}
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# IN-1
QUERIES["in_classes"] = lambda s, d: i.classify_columns(dirty(s, d, "orders"))
SQL["in_classes"] = f"""WITH v AS {view("orders")} SELECT position, "column", class FROM (VALUES (0, 'o_orderkey', 'numeric'),
    (1, 'o_custkey', 'numeric'), (3, 'o_totalprice', 'numeric'), (4, 'o_orderdate', 'datetime')) t(position, "column", class)
    UNION ALL SELECT 2, 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) < 0.5 * count(*) THEN 'categorical'
      ELSE 'other' END FROM v
    UNION ALL SELECT 5, 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) < 0.5 * count(*) THEN 'categorical'
      ELSE 'other' END FROM v"""


def _dated(s, d) -> DataFrame:
    o = table(s, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "soon").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due"), F.when(F.col("o_orderkey") % 2 == 0, "soon").otherwise(
        F.date_format("o_orderdate", "M/d/yyyy")).alias("seen"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"))


QUERIES["in_classes_text_dates"] = lambda s, d: i.classify_columns(_dated(s, d))
SQL["in_classes_text_dates"] = """SELECT 0 AS position, 'o_orderkey' AS "column", 'numeric' AS class
    UNION ALL SELECT 1, 'due', CASE WHEN avg(CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE 1.0 END) >= 0.8 THEN 'datetime'
      ELSE 'categorical' END FROM orders
    UNION ALL SELECT 2, 'seen', CASE WHEN avg(CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 1.0 END) >= 0.8 THEN 'datetime'
      ELSE CASE WHEN count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'soon' ELSE CAST(o_orderdate AS VARCHAR) END)
        < 0.5 * count(*) THEN 'categorical' ELSE 'other' END END FROM orders
    UNION ALL SELECT 3, 'title', CASE WHEN count(DISTINCT o_orderkey) < 0.5 * count(*) THEN 'categorical' ELSE 'other' END
      FROM orders"""


# IN-2 and IN-3
def _summary(s, d) -> DataFrame:
    df = dirty(s, d, "events")
    out = i.column_summary(df, {"numeric": ["event_id", "user_id", "value"], "datetime": ["ts"],
                                "categorical": ["event_type", "props"], "other": []}, order="event_id")
    return rounded(out.withColumn("sum_val", F.round("sum_val", 2)))


QUERIES["in_summary"] = _summary


def _summary_sql(pos, c, kind) -> str:
    num = kind == "numeric"
    stats = [f"avg({c})", f"min({c})", f"max({c})", f"stddev_samp({c})", f"median({c})", f"quantile_cont({c}, 0.25)",
             f"quantile_cont({c}, 0.75)",
             f"CASE WHEN count({c}) >= 2 AND arg_min({c}, event_id) <> 0 THEN (arg_max({c}, event_id) - arg_min({c}, event_id)) "
             f"/ abs(arg_min({c}, event_id)) END"]
    names = ["mean_val", "min_val", "max_val", "std_val", "median_val", "q25_val", "q75_val", "growth_rate"]
    return (f"SELECT {pos} AS position, '{c}' AS column_name, '{kind}' AS dtype, count({c}) AS count, "
            f"count(*) - count({c}) AS null_count, {r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_pct, "
            f"count(DISTINCT {c}) AS unique_count, "
            + ", ".join((r(x) if num else "NULL::DOUBLE") + f" AS {n}" for x, n in zip(stats, names))
            + (f", {r(f'sum({c})', 2)}" if num else ", NULL::DOUBLE") + f" AS sum_val FROM {view('events')} v")


SQL["in_summary"] = unions([_summary_sql(p, c, k) for p, c, k in (
    (0, "event_id", "numeric"), (1, "ts", "datetime"), (2, "user_id", "numeric"), (3, "event_type", "categorical"),
    (4, "value", "numeric"), (5, "props", "categorical"))])

QUERIES["in_growth"] = lambda s, d: rounded(i.growth(dirty(s, d, "events"), ["user_id", "value"], "event_id"))
SQL["in_growth"] = unions([f"""SELECT '{c}' AS "column", {r(f'''CASE WHEN arg_min({c}, event_id) <> 0 THEN
    (arg_max({c}, event_id) - arg_min({c}, event_id)) / abs(arg_min({c}, event_id)) END''')} AS growth_rate
    FROM {view("events")} v""" for c in ("user_id", "value")])

# IN-4
QUERIES["in_top_values"] = lambda s, d: rounded(i.top_category_values(table(s, d, "events"), ["event_type", "props"]))
SQL["in_top_values"] = unions([f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
    {big("sum(count(*)) OVER ()")} AS total, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank,
    {r("count(*) * 100.0 / sum(count(*)) OVER ()")} AS pct FROM events WHERE {c} IS NOT NULL GROUP BY {c}) t
    WHERE rank <= 10""" for c in ("event_type", "props")])


# IN-5, IN-6, IN-7
def _points_sql(source, date, trunc, metrics) -> str:
    return unions([f"""SELECT metric, period, value, ordinal, change_pct, periods FROM (SELECT '{m}' AS metric, period,
      value, CAST(row_number() OVER (ORDER BY period) AS INTEGER) AS ordinal,
      CASE WHEN lag(value) OVER (ORDER BY period) <> 0 THEN (value - lag(value) OVER (ORDER BY period))
        / abs(lag(value) OVER (ORDER BY period)) * 100 END AS change_pct, count(*) OVER () AS periods
      FROM (SELECT {trunc} AS period, avg({m}) AS value FROM {source} GROUP BY 1) g WHERE value IS NOT NULL) p
      WHERE periods >= 2""" for m in metrics])


def _points(df, date, metrics) -> DataFrame:
    return i.trend_points(i.trend_values(df, date, metrics))


_ROUND = f"""SELECT metric, period, ordinal, periods, {r("value")} AS value, {r("change_pct")} AS change_pct FROM """
_DAILY = _points_sql(view("events") + " v", "ts", "date_trunc('day', ts)", ["user_id", "value"])
QUERIES["in_trend_daily"] = lambda s, d: rounded(_points(dirty(s, d, "events"), "ts", ["user_id", "value"]))
SQL["in_trend_daily"] = f"{_ROUND} ({_DAILY}) t"
_MONTHLY = _points_sql("orders", "o_orderdate", "date_trunc('month', o_orderdate)", ["o_totalprice", "o_custkey"])
QUERIES["in_trend_month"] = lambda s, d: rounded(_points(table(s, d, "orders"), "o_orderdate", ["o_totalprice", "o_custkey"]))
SQL["in_trend_month"] = f"{_ROUND} ({_MONTHLY}) t"
QUERIES["in_trend_week"] = lambda s, d: rounded(i.trend_points(i.trend_values(
    table(s, d, "orders"), "o_orderdate", ["o_totalprice"], "week")), 5)
SQL["in_trend_week"] = f"""SELECT metric, period, ordinal, periods, {r("value", 5)} AS value, {r("change_pct", 5)} AS change_pct FROM ({_points_sql("orders", "o_orderdate",
    "date_trunc('week', o_orderdate) + INTERVAL 6 DAY", ["o_totalprice"])}) t"""
QUERIES["in_direction"] = lambda s, d: rounded(i.trends(_points(table(s, d, "orders"), "o_orderdate",
                                                                ["o_totalprice", "o_custkey"])))
SQL["in_direction"] = f"""WITH p AS ({_MONTHLY}), c AS (SELECT *, change_pct AS ch FROM p)
    SELECT metric, CASE WHEN count(ch) = 0 THEN 'stable'
      WHEN sum(CASE WHEN ch > 0 THEN 1.0 ELSE 0 END) / count(ch) >= 0.7 THEN 'increasing'
      WHEN sum(CASE WHEN ch < 0 THEN 1.0 ELSE 0 END) / count(ch) >= 0.7 THEN 'decreasing'
      WHEN count(ch) > 1 AND avg(abs(ch)) > 0 AND stddev_pop(ch) > avg(abs(ch)) THEN 'volatile' ELSE 'stable' END AS direction,
      {r("(arg_max(value, period) - arg_min(value, period)) / abs(arg_min(value, period)) * 100")} AS overall_change_pct,
      count(*) AS periods FROM c GROUP BY metric"""


# IN-8
def _segments(s, d) -> DataFrame:
    return i.segments(dirty(s, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_price", "l_discount"])


_SEG = unions([f"""SELECT 'l_returnflag' AS segment_column, '{m}' AS metric_column, l_returnflag AS segment, avg({m}) AS mean,
    sum({m}) AS sum, count({m}) AS count, CAST(row_number() OVER (ORDER BY count({m}) DESC, l_returnflag) AS INTEGER) AS rank
    FROM {view("lineitem")} v GROUP BY l_returnflag""" for m in ("l_quantity", "l_price", "l_discount")])
QUERIES["in_segments"] = lambda s, d: rounded(_segments(s, d), 2)
SQL["in_segments"] = f"""SELECT segment_column, metric_column, segment, {r("mean", 2)} AS mean, {r("sum", 2)} AS sum, count, rank
    FROM ({_SEG}) t WHERE rank <= 20"""
QUERIES["in_segment_top20"] = lambda s, d: rounded(i.segments(
    table(s, d, "events"), ["user_id", "event_type"], ["value"]), 2)
SQL["in_segment_top20"] = unions([f"""SELECT * FROM (SELECT '{c}' AS segment_column, 'value' AS metric_column,
    CAST({c} AS VARCHAR) AS segment, {r("avg(value)", 2)} AS mean, {r("sum(value)", 2)} AS sum, count(value) AS count,
    CAST(row_number() OVER (ORDER BY count(value) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank
    FROM events GROUP BY {c}) t WHERE rank <= 20""" for c in ("user_id", "event_type")])
QUERIES["in_segment_leaders"] = lambda s, d: rounded(i.segment_leaders(_segments(s, d)), 2)
SQL["in_segment_leaders"] = f"""SELECT segment_column, metric_column, arg_max(segment, mean) AS top_segment,
    {r("max(mean)", 2)} AS top_mean, {r("arg_max(sum, mean) / abs(sum(sum)) * 100", 2)} AS top_pct,
    arg_min(segment, rank) AS largest_segment, {r("CASE WHEN sum(sum) > 0 THEN arg_min(sum, rank) / sum(sum) END", 2)}
    AS largest_share, {r("sum(sum)", 2)} AS total FROM ({_SEG}) t WHERE rank <= 20 GROUP BY 1, 2"""


# IN-9
def _spiked(s, d) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", F.when(F.col("event_id") % 50 == 0, F.col("value") * 40).otherwise(F.col("value")).alias("value"),
                    F.when(F.col("event_id") % 400 == 0, -F.lit(500.0)).when(F.col("event_id") % 300 == 0, 900.0)
                    .otherwise(F.col("user_id") / 1.0).alias("level"))


def _anomalies(df, metrics) -> DataFrame:
    a = i.anomalies(df, metrics, order="event_id")
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return rounded(a.withColumn("positions", text(F.col("positions"))).withColumn("first_value", F.get("values", F.lit(0))).drop(
        "values"))


QUERIES["in_anomalies"] = lambda s, d: _anomalies(_spiked(s, d), ["value", "level"])
SQL["in_anomalies"] = unions([f"""SELECT * FROM (WITH v AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN value * 40 ELSE value
      END AS value, CASE WHEN event_id % 400 = 0 THEN -500.0::DOUBLE WHEN event_id % 300 = 0 THEN 900.0::DOUBLE
      ELSE user_id / 1.0::DOUBLE END AS level FROM events),
    m AS (SELECT avg({c}) AS a, stddev_samp({c}) AS sd, count({c}) AS n FROM v),
    f AS (SELECT event_id, {c} AS x, row_number() OVER (ORDER BY event_id) AS k FROM v, m WHERE abs({c} - a) > 2 * sd)
    SELECT '{c}' AS "column", count(*) AS count, {r("count(*) * 100.0 / any_value(n)")} AS pct,
      CASE WHEN bool_or(x > a) AND bool_or(x < a) THEN 'both' WHEN bool_or(x > a) THEN 'above' ELSE 'below' END AS direction,
      string_agg(CASE WHEN k <= 20 THEN event_id::VARCHAR END, ',' ORDER BY event_id) AS positions,
      {r("any_value(a)")} AS mean, {r("any_value(sd)")} AS std, 2.0::DOUBLE AS threshold_sigma,
      {r("arg_min(x, event_id)")} AS first_value FROM f, m HAVING count(*) > 0) t""" for c in ("value", "level")])


def _positions(s, d) -> DataFrame:
    """Dense positions in reading order need no order column."""
    a = i.anomalies(_spiked(s, d).select("level", "event_id"), ["level"])
    return a.select("column", "count", F.size("positions").alias("listed"), F.element_at("positions", 1).alias("first_position"))


QUERIES["in_anomaly_positions"] = _positions
SQL["in_anomaly_positions"] = """SELECT 'level' AS "column", count(*) AS count, CAST(least(count(*), 20) AS INTEGER) AS listed,
    min(event_id) AS first_position FROM events WHERE event_id % 400 = 0 OR event_id % 300 = 0"""


# IN-10 and IN-11 over the whole orders table
def _payload(s, d) -> dict:
    df = table(s, d, "orders")
    return i.insights(df, q.assess(df), order="o_orderkey")


QUERIES["in_recommendations"] = lambda s, d: joined(
    _payload(s, d)["recommendations"].select("ordinal", "category", "priority", "related_columns"), "related_columns")
_METRICS = ["o_orderkey", "o_custkey", "o_totalprice"]
_DIRECTIONS = SQL["in_direction"].replace(_MONTHLY, _points_sql(
    "orders", "o_orderdate", "date_trunc('month', o_orderdate)", _METRICS))
_FAR = unions([f"""SELECT '{c}' AS "column", sum(CASE WHEN abs({c} - a) > 2 * sd THEN 1 ELSE 0 END) AS far, count({c}) AS n
    FROM orders, (SELECT avg({c}) AS a, stddev_samp({c}) AS sd FROM orders) m""" for c in _METRICS])
_LARGEST = unions([f"""SELECT '{k}' AS segment_column, '{c}' AS metric_column, arg_max(s, n) / sum(s) AS share FROM
    (SELECT {k}, count(*) AS n, sum({c}) AS s FROM orders GROUP BY {k}) g""" for k in ("o_orderstatus", "o_orderpriority")
    for c in _METRICS])
SQL["in_recommendations"] = f"""SELECT CAST(row_number() OVER (ORDER BY step, related_columns) - 1 AS INTEGER) AS ordinal, category, priority,
      related_columns FROM (
    SELECT 2 AS step, 'trend' AS category, CASE WHEN direction = 'volatile' THEN 'medium' ELSE 'high' END AS priority,
      metric AS related_columns FROM ({_DIRECTIONS}) t WHERE direction = 'volatile' OR (direction = 'decreasing' AND overall_change_pct < -20)
    UNION ALL SELECT 3, 'anomaly', CASE WHEN far * 100.0 / n > 5 THEN 'high' ELSE 'low' END, "column" FROM ({_FAR}) f WHERE far > 0
    UNION ALL SELECT 4, 'segment', 'medium', segment_column || ',' || metric_column FROM ({_LARGEST}) l WHERE share > 0.5) x"""
QUERIES["in_payload"] = lambda s, d: _payload(s, d)["metadata"]
SQL["in_payload"] = """SELECT count(*) AS rows, 6 AS columns, 3 AS numeric, 1 AS datetime, 2 AS categorical, 0 AS other FROM orders"""
