"""Running values by ranges, whole-distribution drift, adjusted p-values, smoothing, sensitivity and sketches."""

import math
import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablewright.functions import sketches as sk
from tablewright.functions.ranges import Running, running
from tablewright.functions.tails import kolmogorov, normal_two_sided
from tablewright.operators import distribution as di, drift as dr, sensitivity as se, significance as si, smoothing as sm
from tablewright.sources.sinks import BaselineStore


@pytest.mark.parametrize("ranges", [1, 7])
def test_running_values(spark, ranges):
    rng = random.Random(1)
    data = [("a" if i % 3 else None, i, rng.randrange(-50, 50)) for i in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(data, "k string, x long, v long")
    got = rows(running(df, ["k"], "x", {"s": Running(F.col("v")), "m": Running(F.col("v"), "min", back=True)}, ranges).select("k", "x", "s", "m"))
    for k, x, s, m in got:
        assert s == sum(d[2] for d in data if d[0] == k and d[1] <= x) and m == min(d[2] for d in data if d[0] == k and d[1] >= x)
    assert len(got) == 200
    assert running(df.limit(0), ["k"], "x", {"s": Running(F.col("v"))}, ranges).count() == 0


def test_tails(spark):
    z = [0.0, 0.5, -1.96, 2.9999, 3.0, 5.0, -12.0, 37.0, 50.0, None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(z)], "i int, z double").orderBy("i").select(normal_two_sided(F.col("z"))).collect()]
    for v, p in zip(z, got):
        assert p is None if v is None else p == pytest.approx(math.erfc(abs(v) / math.sqrt(2)), rel=1e-12, abs=1e-300)
    k = [r[0] for r in spark.createDataFrame([(0, 0.1), (1, 0.5), (2, 1.36), (3, 3.0)], "i int, x double").orderBy("i").select(kolmogorov(F.col("x"))).collect()]
    assert k == pytest.approx([1.0, 0.963945243664875, 0.0494858967, 3.045996e-8], rel=1e-5)


def gap(a, b):
    v = np.unique(np.concatenate([a, b]))
    d = np.abs(np.searchsorted(np.sort(a), v, "right") / len(a) - np.searchsorted(np.sort(b), v, "right") / len(b))
    return d.max(), v[d.argmax()]


@pytest.mark.parametrize("ranges", [1, 9])
def test_distance_of_two_samples(spark, ranges):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 500).round(2), np.concatenate([rng.normal(0.4, 1, 300).round(2), np.full(300, 0.5)])  # a hot value
    frame = lambda x: spark.createDataFrame([(float(v), None if i % 5 else float("nan")) for i, v in enumerate(x)], "x double, y double")
    got = di.ks(di.value_table(frame(b)), di.value_table(frame(a)), ranges).collect()
    (r,) = got  # y has no values
    d, at = gap(a, b)
    assert (r["column"], r["n_base"], r["n_current"], r["at"]) == ("x", 500, 600, at) and r["distance"] == pytest.approx(d)
    assert r["p_value"] < 1e-6
    same = di.ks(di.value_table(frame(a)), di.value_table(frame(a)), ranges).first()
    assert same["distance"] == 0 and same["p_value"] == 1


def test_bins_belong_to_the_baseline(spark, folder):
    base = spark.createDataFrame([(float(i), 7.0, None) for i in range(1000)], "x double, c double, e double")
    store = BaselineStore(spark, folder)
    store.save("t", dr.profile(base), extra=di.measure(base))
    bins = store.extra("t", "bins")
    assert [r["hi"] for r in bins.filter("column = 'x'").orderBy("bin").collect()] == pytest.approx([99.9 * k for k in range(1, 10)] + [None])
    assert rows(bins.filter("column = 'c'").select("bin", "lo", "hi", "share"), "bin") == [(0, None, 7.0, 1.0), (1, 7.0, None, 0.0)]
    now = base.select((F.col("x") * 3 - 500).alias("x"), "c")  # beyond both ends
    got = {r["column"]: r["psi"] for r in di.binned_psi(now, bins).collect()}
    counts = np.histogram(np.arange(1000) * 3 - 500.0, [-np.inf, *[99.9 * k + 1e-9 for k in range(1, 10)], np.inf])[0] / 1000
    assert got["x"] == pytest.approx(sum((c - 0.1) * math.log(c / 0.1) for c in counts)) and got["c"] == 0
    assert di.binned_psi(base, bins).filter("psi > 0").count() == 0
    with pytest.raises(dr.DriftError):
        store.extra("t", "none")
    with pytest.raises(dr.DriftError):
        store.extra("other", "bins")


def correlated(spark, n, tie, seed):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=(3, n))
    d = tie * a + math.sqrt(1 - tie * tie) * b
    return spark.createDataFrame([(float(x) + 1e6, float(y), None if i % 10 == 0 else float(z)) for i, (x, y, z) in enumerate(zip(a, d, c))], "a double, d double, c double")


def test_a_planted_change_of_one_correlation_is_found(spark):
    base, now = di.co_moments(correlated(spark, 2000, 0.2, 1)), di.co_moments(correlated(spark, 2000, 0.6, 2))
    got = {(r["a"], r["b"]): r for r in di.correlation_drift(now, base).collect()}
    assert got["a", "d"]["p_value"] < 1e-10 and all(r["p_value"] > 0.01 for k, r in got.items() if k != ("a", "d"))
    assert got["a", "d"]["r_base"] == pytest.approx(0.2, abs=0.06) and got["a", "c"]["n_base"] == 1800


def test_moments_of_parts_are_those_of_the_whole(spark):
    df = correlated(spark, 900, 0.5, 3).withColumn("part", F.monotonically_increasing_id() % 3)
    whole = di.co_moments(df.drop("part"))
    merged = di.merge_moments(*[di.co_moments(df.filter(F.col("part") == k).drop("part")) for k in range(3)])
    for x, y in zip(rows(whole.select("a", "b", *di.MOMENTS), "a", "b"), rows(merged.select("a", "b", *di.MOMENTS), "a", "b")):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], rel=1e-9)
    few = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0)], "a double, b double, c double")
    got = di.correlation_drift(di.co_moments(few), di.co_moments(few)).collect()
    assert all(r["z"] is None and r["p_value"] is None for r in got) and len(got) == 3


def test_findings_of_a_changed_table(spark):
    base = correlated(spark, 1500, 0.1, 4)
    quiet = di.distribution_findings(correlated(spark, 1500, 0.1, 5), di.measure(base))
    assert quiet.count() == 0
    moved = di.distribution_findings(correlated(spark, 1500, 0.7, 6).withColumn("c", F.col("c") * 3), di.measure(base))
    assert {(r["check"], r["column"]) for r in moved.collect()} == {("correlation", "a~d"), ("distribution", "c"), ("numeric_psi", "c")}


def step_up(p, bonferroni=False):
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, low = [0.0] * len(p), 1.0
    for rank in range(len(p), 0, -1):
        i = order[rank - 1]
        low = min(low, p[i] * len(p) / rank)
        out[i] = min(1.0, p[i] * len(p)) if bonferroni else low
    return out


@pytest.mark.parametrize("method", si.METHODS)
def test_adjusted_p_values(spark, method):
    rng = random.Random(6)
    groups = {g: [rng.choice([0.5, rng.random() ** 4]) for _ in range(n)] for g, n in (("a", 900), (None, 60), ("b", 1))}
    data = [(g, i, p) for g, ps in groups.items() for i, p in enumerate(ps)] + [("a", 5000, None)]
    df = spark.createDataFrame(data, "g string, i int, p double")
    got = {(r["g"], r["i"]): r for r in si.adjust(df, "p", ["g"], method, ranges=5).collect()}
    assert len(got) == len(data) and got["a", 5000]["adjusted"] is None
    for g, ps in groups.items():
        assert [got[g, i]["adjusted"] for i in range(len(ps))] == pytest.approx(step_up(ps, method == "any"))
        assert got[g, 0]["tests"] == len(ps)
    with pytest.raises(ValueError):
        si.adjust(df, "p", ["g"], "none")


def holt(ys, a, b):
    level, trend, out = ys[0], 0.0, [(ys[0], 0.0, None)]
    for y in ys[1:]:
        fitted = level + trend
        new = a * y + (1 - a) * fitted
        trend, level = b * (new - level) + (1 - b) * trend, new
        out.append((level, trend, fitted))
    return out


@pytest.mark.parametrize("ranges", [1, 6, 40])
def test_smoothing_over_ranges_equals_the_recursion(spark, ranges):
    rng = random.Random(7)
    series = {("long", None): 400, ("b", 1): 30, ("b", 2): 1, (None, 3): 25}
    data = [(k, j, float(t * 2), rng.random() * 100) for (k, j), n in series.items() for t in range(n)] + [("b", 1, None, 3.0), ("b", 1, 999.0, None)]
    got = sm.smooth(spark.createDataFrame(data, "k string, j int, x double, y double"), "x", "y", ["k", "j"], 0.4, 0.2, ranges).collect()
    for (k, j), n in series.items():
        mine = sorted((r for r in got if (r["k"], r["j"]) == (k, j)), key=lambda r: r["x"])
        assert len(mine) == n
        for r, want in zip(mine, holt([r["y"] for r in mine], 0.4, 0.2)):
            assert (r["level"], r["trend"]) == pytest.approx(want[:2]) and (r["fitted"] is None) == (want[2] is None)
            assert r["fitted"] is None or r["residual"] == pytest.approx(r["y"] - want[2])
    one = sm.smooth(spark.createDataFrame(data[:400], "k string, j int, x double, y double"), "x", "y", ranges=ranges)
    assert one.count() == 400 and sm.smooth(one.limit(0), "x", "y").count() == 0


def test_intervals_hold_what_they_promise(spark):
    rng = np.random.default_rng(8)
    level, ys = 50.0, []
    for _ in range(3000):  # the model behind simple smoothing with weight 0.3
        e = rng.normal(0, 2)
        ys.append(level + e)
        level += 0.3 * e
    points = sm.smooth(spark.createDataFrame([(float(i), y) for i, y in enumerate(ys)], "x double, y double"), "x", "y", level=0.3, trend=0.0, ranges=4)
    assert sm.coverage(points).first()["inside"] == pytest.approx(0.95, abs=0.015)
    ahead = rows(sm.forecast(points, "x", 4, level=0.3, trend=0.0).select("step", "x", "y", "lo", "hi"), "step")
    assert [r[1] for r in ahead] == [3000.0, 3001.0, 3002.0, 3003.0]
    half = [r[4] - r[2] for r in ahead]
    assert half[0] == pytest.approx(1.96 * 2, rel=0.05) and half[3] / half[0] == pytest.approx(math.sqrt(1 + 3 * 0.09))


def test_sensitivity_and_switching_points(spark):
    df = spark.createDataFrame([("x", 1, 100.0, 200.0, 0.5), ("x", 2, 100.0, 180.0, 0.5), ("x", 3, 50.0, 60.0, 1.0), ("y", 4, 1.0, 2.0, 1.0), ("x", 5, 1.0, None, 1.0)],
                               "g string, id int, cost double, benefit double, probability double")
    bounds = {"cost": (0.5, 1.5), "benefit": (0.9, 1.2), "probability": (0.0, 1.0)}
    one = {(r["id"], r["factor"]): r for r in se.one_at_a_time(df, bounds).collect()}
    assert (one[1, "cost"]["low"], one[1, "cost"]["high"], one[1, "cost"]["swing"]) == (75.0, 25.0, 50.0) and one[1, "benefit"]["elasticity"] == pytest.approx(2.0)
    pair = {(r["id"], r["factor_a"], r["factor_b"]): r for r in se.pairwise(df, bounds).collect()}[1, "cost", "probability"]
    assert (pair["worst"], pair["best"], pair["high_high"]) == (0.0, 75.0, 25.0)
    got = {(r["id"], r["factor"]): r for r in se.switching_points(df, "id", bounds, ["g"]).collect()}
    assert set(k for k, _ in got) == {1, 2, 3}  # group y has no rival, a null outcome no place
    for (i, f), r in got.items():
        assert r["rival"] == (2 if i == 1 else 1)
        c = {n: getattr(df.filter(f"id = {i}").first(), n) * (r["switch"] if n == f else 1) for n in bounds}
        assert (c["benefit"] - c["cost"]) * c["probability"] == pytest.approx(r["rival_base"])
        assert r["reachable"] == (bounds[f][0] <= r["switch"] <= bounds[f][1])


def test_sketches_of_parts_merge(spark, folder):
    rng = np.random.default_rng(9)
    x = rng.gamma(2.0, 10.0, 6000)
    df = spark.createDataFrame([(i, float(v), f"t{i % 700}", None if i % 4 == 0 else i % 50) for i, v in enumerate(x)], "i long, x double, t string, n int")
    store = sk.SketchStore(spark, folder)
    for k in range(4):
        store.add(f"d{k}", df.filter(F.col("i") % 4 == k))
    store.add("d0", df.filter(F.col("i") % 4 == 0))  # a part that comes again
    store.add("empty", df.limit(0))
    got = {r["column"]: r for r in sk.profile(store.read()).collect()}
    assert (got["x"]["rows"], got["x"]["n"], got["n"]["nulls"]) == (6000, 6000, 1500)
    assert got["x"]["mean"] == pytest.approx(x.mean()) and got["x"]["std"] == pytest.approx(x.std(ddof=1)) and got["x"]["hi"] == x.max()
    for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert abs((x <= got["x"][q]).mean() - p) <= sk.RANK_ERROR
    assert got["t"]["q50"] is None and got["t"]["distinct"] == pytest.approx(700, rel=sk.DISTINCT_ERROR)
