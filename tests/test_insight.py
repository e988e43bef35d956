import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablewright.operators import insight as i, quality as q

START = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def full(spark):
    data = [(START + dt.timedelta(days=k), "NSEW"[k % 4], "AB"[k % 2], 1000.0 + k, float(k % 13)) for k in range(200)]
    return spark.createDataFrame(data, "date timestamp, region string, category string, revenue double, quantity double").repartition(3)


def test_full_sales(full):
    out = i.insights(full, q.assess(full))
    assert out["summary"].count() == 5
    assert {r["metric"] for r in out["trends"].collect()} == {"revenue", "quantity"}
    periods = [r["period"] for r in out["trend_points"].filter("metric = 'revenue'").orderBy("ordinal").collect()]
    assert all(p.weekday() == 6 for p in periods)  # a span of 199 days is cut into weeks that end on Sunday
    assert out["segment_leaders"].select("segment_column", "metric_column").distinct().count() == 4
    assert {r["direction"] for r in out["trends"].filter("metric = 'revenue'").collect()} == {"increasing"}


def test_numeric_only_asks_for_dimensions(spark):
    df = spark.createDataFrame([(float(k % 17), float(k % 5)) for k in range(100)], "col_a double, col_b double")
    out = i.insights(df, q.assess(df))
    assert out["trends"].count() == 0 and out["segments"].count() == 0
    assert out["recommendations"].filter("category = 'general'").count() == 2


def test_outlier_positions(spark):
    df = spark.createDataFrame([(100.0, "x")] * 98 + [(500.0, "y"), (600.0, "z")], "metric double, label string")
    a = i.anomalies(df, ["metric"]).first()
    assert (a["count"], a["pct"], a["direction"], a["positions"], a["values"]) == (2, 2.0, "above", [98, 99], [500.0, 600.0])
    assert a["mean"] == 109 and a["std"] == pytest.approx(63.71496, abs=1e-4)


def test_anomalies_need_ten_rows_and_a_spread(spark):
    assert i.anomalies(spark.createDataFrame([(float(v),) for v in [1] * 8 + [99]], "x double"), ["x"]).count() == 0
    assert i.anomalies(spark.createDataFrame([(5.0,)] * 30, "x double"), ["x"]).count() == 0


def test_only_twenty_positions_are_listed(spark):
    df = spark.createDataFrame([(k, 1000.0 if k % 25 == 0 else 1.0 + k % 3) for k in range(1000)], "k long, x double").repartition(4)
    a = i.anomalies(df, ["x"], order="k").first()
    assert a["count"] == 40 and a["positions"] == [25 * k for k in range(20)]


@pytest.mark.parametrize("values, expect", [([0, 10, 20, 30, 40, 50], None), ([-100, -50, 0, 50], 1.5), ([42], None), ([None, 2, 3, None], 0.5)])
def test_growth(spark, values, expect):
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], "k long, val double")
    assert i.growth(df, ["val"], "k").first()["growth_rate"] == expect


@pytest.mark.parametrize("days, frequency", [(90, "day"), (91, "week"), (730, "week"), (731, "month")])
def test_frequency_by_span(spark, days, frequency):
    df = spark.createDataFrame([(START,), (START + dt.timedelta(days=days, hours=5),)], "t timestamp")
    assert i.pick_frequency(df, "t") == frequency


@pytest.mark.parametrize("values, direction", [
    ([1, 2, 3, 4, 5, 6], "increasing"), ([6, 5, 4, 3, 2, 1], "decreasing"), ([10, 11, 10, 50, 49, 50, 48], "volatile"),
    ([5, 5, 5, 5], "stable"), ([0, 0, 0], "stable")])
def test_direction(spark, values, direction):
    df = spark.createDataFrame([(START + dt.timedelta(days=k), float(v)) for k, v in enumerate(values)], "t timestamp, v double")
    assert i.trends(i.trend_points(i.trend_values(df, "t", ["v"]))).first()["direction"] == direction


def test_text_dates_need_eighty_percent(spark):
    data = [("2024-01-01", "2024-01-01", "a")] * 7 + [("2024-01-02", "x", "b"), ("2024-01-02", "y", "c"), (None, "z", "d")]
    df = spark.createDataFrame(data, "good string, bad string, label string")
    assert i.classes(df)["datetime"] == ["good"] and i.classes(df)["categorical"] == ["bad", "label"]


def test_booleans_are_other(spark):
    assert i.classes(spark.createDataFrame([(True, 1)], "b boolean, n int"))["other"] == ["b"]


def test_concentration_uses_the_largest_segment(spark):
    df = spark.createDataFrame([("big", 10.0)] * 60 + [("small", 1.0)] * 40, "k string, v double")
    leader = i.segment_leaders(i.segments(df, ["k"], ["v"])).first()
    assert leader["largest_segment"] == "big" and leader["largest_share"] == pytest.approx(600 / 640)


def test_direction_looks_at_all_points(spark):
    values = list(range(1, 121)) + list(range(120, -280, -1))  # rises for 120 days, then falls for 400
    df = spark.createDataFrame([(START + dt.timedelta(days=k), float(v)) for k, v in enumerate(values)], "t timestamp, v double")
    points = i.trend_points(i.trend_values(df, "t", ["v"], "day"))
    assert points.count() == 520 and i.trends(points).first()["direction"] == "decreasing"


def test_leaders_and_shares_count_unlisted_segments(spark):
    df = spark.createDataFrame([(f"s{k % 30:02}", 1.0) for k in range(60)] + [("rare", 99.0)], "k string, v double")
    leader = i.segment_leaders(i.segment_stats(df, ["k"], ["v"])).first()
    assert leader["top_segment"] == "rare" and leader["total"] == 159 and leader["largest_share"] == pytest.approx(2 / 159)
