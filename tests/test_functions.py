import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.functions import chunks, joins, quantiles, special
from tablewright.functions.columns import text_as_number
from tablewright.functions.dates import parse_date

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("values", [
    list(np.random.default_rng(1).normal(size=3000)),
    [5.0] * 1000 + [1.0, 2.0, 9.0],
    [0.0] * 10 + [1e300, -1e300, 1e-300, 3.0],
    [float(i // 700) for i in range(2100)] + [None] * 50,
    [1.0, float("inf"), float("-inf"), 2.0, 3.0],
])
def test_narrowed_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    got = quantiles.exact_quantiles(df, {"x": F.col("x")}, PROBS, in_memory=3)["x"]
    known = np.array([v for v in values if v is not None])
    finite = np.isfinite(known).all()
    for g, e in zip(got, np.quantile(known, PROBS) if finite else [None] * len(PROBS)):
        if finite:
            assert g == pytest.approx(e, rel=1e-12, abs=1e-300)
    if not finite:
        assert got[0] == -math.inf and got[-1] == math.inf and got[3] == 2.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_both_quantile_ways_agree(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    a = quantiles.exact_quantiles(df, {"x": F.col("x")}, PROBS)["x"]
    b = quantiles.exact_quantiles(df, {"x": F.col("x")}, PROBS, in_memory=1)["x"]
    assert a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_empty_column_has_no_quantile(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": [None]}
    assert quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.5], in_memory=0) == {"x": [None]}


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    # One key holds most of the rows.
    data = [(i, "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), None if rng.random() < 0.4 else float(i))
            for i in range(600)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "pos long, k string, v double").repartition(5)


@pytest.mark.parametrize("chunk_rows", [10_000, 37, 5])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_forward_fill_does_not_depend_on_chunks(series, chunk_rows, keys):
    data, df = series
    got = {r["pos"]: r["v"] for r in chunks.forward_fill(df, ["v"], "pos", keys, chunk_rows).collect()}
    last, expect = {}, {}
    for pos, k, v in sorted(data):
        g = k if keys else 0
        if v is not None:
            last[g] = v
        expect[pos] = last.get(g)
    assert got == expect


@pytest.mark.parametrize("chunk_rows", [10_000, 37, 1])
def test_previous_values_cross_chunks(series, chunk_rows):
    data, df = series
    df = df.na.fill(0.0)
    got = {r["pos"]: list(r["_prev"]) for r in chunks.with_previous(df, F.col("v"), "pos", 3, ("k",), chunk_rows=chunk_rows).collect()}
    past = {}
    for pos, k, v in sorted(data):
        assert got[pos] == past.get(k, [])[-3:]
        past.setdefault(k, []).append(v or 0.0)


def test_prefix_sums(spark):
    df = spark.createDataFrame([(float(i), i % 4 + 1) for i in range(200)], "v double, n long").repartition(4)
    got = {r["v"]: r["_below"] for r in chunks.prefix_sums(df, "v", "n", ranges=9).collect()}
    total = 0
    for i in range(200):
        assert got[float(i)] == total
        total += i % 4 + 1


def test_dense_positions(spark):
    df = spark.range(0, 1000, 1, 7).filter("id % 3 <> 0")
    got = sorted(r["_pos"] for r in chunks.with_dense_position(df).collect())
    assert got == list(range(df.count()))


def test_lookup_serves_hot_cold_and_null_keys(spark):
    data = [("hot",)] * 500 + [(f"c{i}",) for i in range(30)] + [(None,)] * 100 + [("none",)]
    df = spark.createDataFrame(data, "k string")
    table = spark.createDataFrame([("hot", 1, 500)] + [(f"c{i}", i + 2, 1) for i in range(30)], "key string, v long, w long")
    for share in (0.0, 0.001, 0.5):
        joins.HOT_SHARE, old = share, joins.HOT_SHARE
        out = joins.lookup(df, table, F.col("k"), "key", "w", len(data))
        joins.HOT_SHARE = old
        assert out.count() == len(data)
        assert out.filter("v = 1").count() == 500 and out.filter("v is null").count() == 101


@pytest.mark.parametrize("got, expect", [
    (special.t_two_sided(2.228, 10), 0.05), (special.t_two_sided(1.96, 1e6), 0.05), (special.t_two_sided(0.0, 5), 1.0),
    (special.f_upper(4.96, 1, 10), 0.05), (special.f_upper(3.10, 3, 20), 0.05), (special.chi2_upper(3.841, 1), 0.05),
    (special.chi2_upper(18.307, 10), 0.05), (special.chi2_upper(2.0, 2), math.exp(-1)),
])
def test_tail_probabilities_match_tables(got, expect):
    assert got == pytest.approx(expect, abs=2e-4)


def test_number_texts(spark):
    df = spark.createDataFrame([(t,) for t in ("12d", " 7 ", "1e3", "-.5", "x", "", "0x1", "5f", None)], "t string")
    assert [r[0] for r in df.select(text_as_number(F.col("t"))).collect()] == [None, 7.0, 1000.0, -0.5, None, None, None, None, None]


def test_date_texts(spark):
    texts = ["2024-01-05", "2024-01-05T10:00:00Z", "1/5/2024", "5-Jan-2024", "Jan 5, 2024", "2020", "abc", "12.5", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] is not None for r in df.select(parse_date(F.col("t"))).collect()]
    assert got == [True, True, True, True, True, True, False, False, False]


def test_sketch_quantiles_are_close(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    got = quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.25, 0.5], approx=True)["x"]
    assert got == pytest.approx([250, 500], abs=2)
