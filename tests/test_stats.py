import math

import numpy as np
import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablewright.operators import binned_forest as bf, forecast as fc, intent as nl, models as m, prescribe as p, programs as lp, stats as s


def test_t_test_known_value(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", float(v)) for v in (2, 4, 6, 8, 10)], "g string, x double")
    r = s.hypothesis_test(df, "x", "g").first()
    assert r["test_type"] == "Two-sample T-test" and r["statistic"] == pytest.approx(-1.897367, abs=1e-5)
    assert r["p_value"] == pytest.approx(0.09434977, abs=1e-6) and not r["is_significant"]


def test_anova_known_value(spark):
    data = {"a": (6, 8, 4, 5, 3, 4), "b": (8, 12, 9, 11, 6, 8), "c": (13, 9, 11, 8, 7, 12)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "g string, x double")
    r = s.hypothesis_test(df, "x", "g").first()
    assert r["statistic"] == pytest.approx(9.264706, abs=1e-5) and r["p_value"] == pytest.approx(0.0023987, abs=1e-6)


def test_chi_square_with_and_without_correction(spark):
    two = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5, "p string, q string")
    r = s.hypothesis_test(two, "p", "q").first()
    a, b, c, d = 10, 20, 30, 5
    n = a + b + c + d
    expect = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert r["statistic"] == pytest.approx(expect) and r["degrees_of_freedom"] == 1
    three = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 10 + [("b", "x")] * 20 + [("c", "y")] * 20, "p string, q string")
    r = s.hypothesis_test(three, "p", "q").first()
    assert r["statistic"] == pytest.approx(40.0) and r["degrees_of_freedom"] == 2 and r["p_value"] == pytest.approx(math.exp(-20))


def test_pearson_test_and_missing_branch(spark):
    df = spark.createDataFrame([(float(k), float(k * k), "ab"[k % 2]) for k in range(10)], "x double, y double, t string")
    r = s.hypothesis_test(df, "x", "y").first()
    assert r["statistic"] == pytest.approx(np.corrcoef(range(10), [k * k for k in range(10)])[0, 1]) and r["is_significant"]
    assert s.hypothesis_test(df, "t", "x").count() == 0
    with pytest.raises(ValueError):
        s.hypothesis_test(df, "x", "nope")


@pytest.mark.parametrize("chunk", [10_000, 7])
def test_spearman_equals_pandas(spark, monkeypatch, chunk):
    monkeypatch.setattr("tablewright.functions.chunks.CHUNK_ROWS", chunk)
    rng = np.random.default_rng(2)
    x = np.where(rng.random(200) < 0.4, 5.0, rng.integers(0, 30, 200)).astype(float)
    y = x * 2 + rng.normal(size=200).round(1)
    y[::9] = np.nan
    df = spark.createDataFrame([(float(a), None if np.isnan(b) else float(b)) for a, b in zip(x, y)], "x double, y double")
    pdf = pd.DataFrame({"x": x, "y": y}).dropna().rank()
    got = s.spearman(df, "x", "y").first()
    assert got["r"] == pytest.approx(pdf["x"].corr(pdf["y"])) and got["n"] == len(pdf)


def test_numeric_summary_equals_pandas(spark):
    v = pd.Series([1.0, 2, 2, 3, 9, 30])
    r = s.numeric_summary(spark.createDataFrame([(x,) for x in v] + [(None,)], "x double")).first()
    z = (v - v.mean()) / v.std(ddof=0)
    assert (r["count"], r["median"], r["mode"], r["outliers_count"]) == (6, 2.5, 2.0, 1)
    assert [r["std"], r["q75"], r["skewness"], r["kurtosis"]] == pytest.approx([v.std(), v.quantile(0.75), (z**3).mean(), (z**4).mean() - 3])


def test_strong_pairs_and_insights(spark):
    pairs = spark.createDataFrame([("a", "b", -0.9, 5), ("a", "c", 0.6, 5), ("b", "c", 0.4, 5), ("c", "d", None, 5)], "a string, b string, r double, n long")
    assert [(r["correlation"], r["strength"]) for r in s.strong_correlations(pairs).collect()] == [(-0.9, "strong"), (0.6, "moderate")]
    assert tuple(s.correlation_insights(pairs).first()) == ("a", "b", 0.9, 1)


# ---- models

def test_models_and_choice(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(float(a), float(b), float(3 * a - 2 * b + 1), "up" if a > 0 else "down") for a, b in x],
                               "a double, b double, y double, label string")
    out = m.regression_models(df, "y", ["a", "b"], max_depth=5, trees=10)
    score = {r["model"]: r["score"] for r in out["metrics"].collect()}
    assert score["linear_regression"] == pytest.approx(1.0) and score["random_forest"] > 0.7
    assert m.best_model(out["metrics"]).first()["best_model"] == "linear_regression"
    c = m.classification_models(df, "label", ["a", "b"], max_depth=5, trees=10)
    assert all(r["score"] > 0.9 for r in c["metrics"].collect())
    assert c["report"].filter("label = 'accuracy'").count() == 2
    again = m.regression_models(df.repartition(5), "y", ["a", "b"], max_depth=5, trees=10)["metrics"]
    assert {r["model"]: r["n"] for r in again.collect()} == {r["model"]: r["n"] for r in out["metrics"].collect()}
    with pytest.raises(m.ModelError):
        m.regression_models(df.limit(5), "y")


def test_tie_goes_to_the_forest(spark):
    t = spark.createDataFrame([("linear_regression", 0.5), ("random_forest", 0.5)], "model string, score double")
    assert m.best_model(t).first()["recommendation"] == "Use random forest model (R² = 0.500)"


def test_optimum_at_the_corner(spark):
    df = spark.createDataFrame([(float(k % 10), float(k % 7), 2.0 * (k % 10) - 3.0 * (k % 7) + 5) for k in range(70)], "a double, b double, y double")
    out = p.optimize(df, "y", "maximize")
    assert {r["feature"]: r["optimal"] for r in out["features"].collect()} == {"a": 9.0, "b": 0.0}
    assert out["outcome"].first()["predicted_outcome"] == pytest.approx(23.0)
    assert {r["action"] for r in p.change_advice(out["features"]).collect()} == {"Increase a by 100.0%", "Decrease b by 100.0%"}


def test_dispatch(spark):
    df = spark.createDataFrame([(float(k), float(k % 3), "ab"[k % 2]) for k in range(40)], "x double, y double, g string")
    assert set(p.analyze_by_type(df, "descriptive")) == {"info", "columns", "numeric", "categorical"}
    with pytest.raises(ValueError):
        p.analyze_by_type(df, "predictive")
    with pytest.raises(ValueError):
        p.analyze_by_type(df, "psychic", "x")
    out = nl.execute_intent(df, {"analysis_type": "diagnostic", "target_column": "x", "feature_columns": ["g"]})
    assert out["hypothesis"].first()["test_type"] == "Two-sample T-test"


# ---- forecasts and programs

def test_simple_regression_edges(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert tuple(fc.simple_regression(one, "x", "y").first())[:3] == (0.0, 0.0, 0.0)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert tuple(fc.simple_regression(flat, "x", "y").first())[:3] == (0.0, 3.0, 0.0)
    assert fc.correlation(flat, "x", "y").first()["r"] == 0.0


def test_zero_range_histogram(spark):
    df = spark.createDataFrame([(4.0,)] * 6, "y double")
    assert [r["count"] for r in fc.histogram(df, "y", 3).orderBy("bin").collect()] == [6, 0, 0]


def test_moving_average_forecast(spark):
    df = spark.createDataFrame([(float(k), float(v)) for k, v in enumerate([9, 9, 1, 2, 3])], "x double, y double")
    got = [(r["x"], r["y"]) for r in fc.moving_average_forecast(df, "x", "y", 3, 2).orderBy("step").collect()]
    assert got == [(5.0, 2.0), (6.0, pytest.approx(7 / 3))]
    assert fc.moving_average_forecast(df.limit(2), "x", "y", 3, 2).count() == 0


def test_scenarios(spark):
    df = spark.createDataFrame([("a", 10000.0, 18000.0, None), ("b", 20000.0, 30000.0, 0.6), ("c", 20000.0, 25000.0, 0.0)],
                               "name string, cost double, benefit double, probability double")
    got = [(r["name"], r["roi"], r["expected_value"], r["recommendation"]) for r in fc.score_scenarios(df).collect()]
    assert got == [("a", 80.0, 8000.0, "Highly Recommended"), ("b", 50.0, 6000.0, "Highly Recommended"), ("c", 25.0, 5000.0, "Recommended")]


def brute(c, px, py):
    pts = [(0, 0)] + [(r / a, 0) for a, b, r in c if a] + [(0, r / b) for a, b, r in c if b]
    for i, (a1, b1, r1) in enumerate(c):
        for a2, b2, r2 in c[i + 1:]:
            det = a1 * b2 - a2 * b1
            if det:
                pts.append(((r1 * b2 - r2 * b1) / det, (a1 * r2 - a2 * r1) / det))
    ok = [px * x + py * y for x, y in pts if x >= 0 and y >= 0 and all(a * x + b * y <= r + 1e-9 * max(1, abs(r)) for a, b, r in c)]
    return max(ok) if ok else None


def test_programs_equal_all_corners(spark):
    rng = np.random.default_rng(4)
    problems = {0: ([(1, 1, 10), (1, 0, 6), (0, 1, 8)], 3, 4), 1: ([(1, 1, -1)], 1, 1), 2: ([(0, 0, -1), (1, 0, 3)], 1, 1)}
    for k in range(3, 60):
        n = int(rng.integers(1, 9))
        c = [tuple(float(v) for v in (*rng.integers(-3, 6, 2), rng.integers(-2, 20))) for _ in range(n)]
        problems[k] = (c, float(rng.integers(-3, 5)), float(rng.integers(-3, 5)))
    con = spark.createDataFrame([(k, *map(float, row)) for k, (c, _, _) in problems.items() for row in c], "p long, a double, b double, r double")
    goal = spark.createDataFrame([(k, float(x), float(y)) for k, (_, x, y) in problems.items()], "p long, px double, py double")
    for slice_rows in (10_000, 3):
        got = {r["p"]: r["value"] for r in lp.solve_programs(con, goal, "p", slice_rows).collect()}
        for k, (c, x, y) in problems.items():
            e = brute(c, x, y)
            assert (got[k] is None) == (e is None), (k, problems[k], got[k], e)
            if e is not None:
                assert got[k] == pytest.approx(e, abs=1e-6), (k, problems[k])
    first = lp.solve_programs(con, goal, "p").filter("p = 0").first()
    assert (first["x"], first["y"], first["value"]) == (2.0, 8.0, 38.0)


# ---- questions

@pytest.mark.parametrize("text, kind, objective", [
    ("Describe the average price", "descriptive", None), ("why is there a relationship", "diagnostic", None),
    ("predict the future", "predictive", None), ("recommend the best way to increase sales", "prescriptive", "maximize"),
    ("minimize cost, what should we improve", "prescriptive", "minimize"), ("hello", "descriptive", None)])
def test_intent(spark, text, kind, objective):
    r = nl.classify_questions(spark.createDataFrame([(text,)], "q string"), "q").first()
    assert (r["analysis_type"], r["objective"]) == (kind, objective)
    if text == "hello":
        assert r["confidence"] == 0.3


def test_reply_validation(spark):
    texts = ['x {"analysis_type": "predictive", "target_column": "a", "confidence": 1} y', '{"analysis_type": "predictive", "confidence": 1}',
             '{"analysis_type": "predictive", "target_column": "", "confidence": 1, "feature_columns": ["a", "z"]}', "{broken"]
    got = nl.parse_replies(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", ["a", "b"])
    assert rows(got.select("valid"), "i") == [(True,), (False,), (False,), (False,)]


def test_answers(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, t string")
    text = nl.answer("descriptive", p.analyze_by_type(df, "descriptive"), spark).first()["answer"]
    assert text.startswith("Your dataset has 1 rows and 2 columns.")
    assert nl.answer("predictive", {}, spark).first()["answer"].startswith("Analysis completed.")


def test_registered_models_have_the_default_forests(spark, monkeypatch):
    from tablewright.registry import stats as registered

    seen = []

    def fitted(df, *args, max_depth=m.MAX_DEPTH, trees=m.TREES, **more):
        seen.append((max_depth, trees))
        return {"metrics": df, "report": df}

    monkeypatch.setattr(m, "regression_models", fitted)
    monkeypatch.setattr(m, "classification_models", fitted)
    monkeypatch.setattr(m, "best_model", lambda df: df)
    for name in ("ml_regression", "ml_best_regression", "ml_classification"):
        registered.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [(m.MAX_DEPTH, 100)] * 3


def plain_tree(x, y, w, impurity, depth):
    """Value per row of a tree grown by trying every threshold between values."""
    out = np.zeros(len(y))
    value = lambda k: (w[k] * y[k]).sum() / max(w[k].sum(), 1)
    stack = [(np.arange(len(y)), 0)]
    while stack:
        rows_, level = stack.pop()
        out[rows_] = value(rows_)
        best = (1e-12, None)
        for f in range(x.shape[1] if level < depth else 0):
            for t in np.unique(x[rows_, f])[:-1]:
                low = x[rows_, f] <= t
                a, b = rows_[low], rows_[~low]
                if w[a].sum() >= 1 and w[b].sum() >= 1:
                    n = w[rows_].sum()
                    gain = impurity(rows_) - (w[a].sum() * impurity(a) + w[b].sum() * impurity(b)) / n
                    if gain > best[0] + 1e-12:
                        best = (gain, (a, b))
        if best[1]:
            stack += [(part, level + 1) for part in best[1]]
    return out


@pytest.mark.parametrize("kind", ["variance", "gini"])
def test_trees_of_cells_equal_trees_of_rows(kind):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, (300, 2))
    w = rng.poisson(1.0, 300)
    cells = x[:, 0] * 5 + x[:, 1]
    if kind == "variance":
        y = rng.normal(size=300) + x[:, 0] * x[:, 1]
        spread = lambda k: np.average(y[k] ** 2, weights=w[k]) - np.average(y[k], weights=w[k]) ** 2
        sums = np.stack([np.bincount(cells, v, 25) for v in (w, w * y, w * y * y)])
        leaf, _ = bf._grow([5, 5], sums, bf._variance, 3, 2, rng)
        got = leaf[1] / leaf[0]
    else:
        y = (rng.random(300) < 0.1 + 0.15 * x[:, 0]).astype(float)
        spread = lambda k: 2 * np.average(y[k], weights=w[k]) * (1 - np.average(y[k], weights=w[k]))
        sums = np.stack([np.bincount(cells, w * (y == v), 25) for v in (0, 1)])
        leaf, _ = bf._grow([5, 5], sums, bf._gini, 3, 2, rng)
        got = leaf[1] / leaf.sum(axis=0)
    assert got[cells] == pytest.approx(plain_tree(x, y, w, spread, 3))


def test_forests_of_few_features_are_grown_from_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    df = spark.createDataFrame([(float(a), int(10 * b), bool(c > 0), float(a * a + int(10 * b) // 5), "up" if a * b > 0 else "down") for a, b, c in x],
                               "a double, b int, c boolean, y double, label string").withColumn("c", F.col("c").cast("int"))
    score = lambda out: {r["model"]: r["score"] for r in out["metrics"].collect()}["random_forest"]
    share = lambda out: {r["feature"]: r["value"] for r in out["importance"].collect() if r["model"] == "random_forest"}
    features = ["a", "b", "c"]
    with monkeypatch.context() as patch:  # MLlib's forests of the same rows
        patch.setattr(bf, "fits", lambda *a: False)
        rows_r, rows_c = m.regression_models(df, "y", features, trees=20), m.classification_models(df, "label", features, trees=20)
    monkeypatch.setattr(m.RandomForestRegressor, "fit", lambda *a: pytest.fail("rows are read once a level and tree"))
    monkeypatch.setattr(m.RandomForestClassifier, "fit", lambda *a: pytest.fail("rows are read once a level and tree"))
    out, again = m.regression_models(df, "y", features, trees=20), m.classification_models(df, "label", features, trees=20)
    assert score(out) == pytest.approx(score(rows_r), abs=0.2) and score(again) == pytest.approx(score(rows_c), abs=0.15)  # as seeds differ
    assert sum(share(out).values()) == pytest.approx(1)
    assert share(out) == pytest.approx(share(rows_r), abs=0.25) and share(again) == pytest.approx(share(rows_c), abs=0.25)
    assert again["report"].filter("label in ('up', 'down') and model = 'random_forest'").agg(F.sum("support")).first()[0] == \
        again["metrics"].first()["n"]
    assert len(bf.cuts(df, ["a"])[0]) == 31 and bf.cuts(df, ["c"]) == [[0.5]]
    assert not bf.fits([[0.0] * 31] * 4)
