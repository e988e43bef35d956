"""Queries over statistics, models, prescriptions and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import forecast as fc, models as m, prescribe as p, programs as lp, sensitivity as se, significance as si, smoothing as sm, stats as st
from .common import big, dirty, joined, r, rounded, table, unions, view

QUERIES, SQL = {}, {}
ORDERS, LINE = view("orders"), view("lineitem")
NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

# ST-1
QUERIES["st_dataset_info"] = lambda s, d: st.dataset_info(dirty(s, d, "orders"))["info"]
SQL["st_dataset_info"] = f"""WITH v AS {ORDERS} SELECT count(*) AS total_rows, 6 AS total_columns, 3 AS numeric_columns,
    2 AS categorical_columns, {big(" + ".join(f"(count(*) - count({c}))" for c in COLS))} AS missing_values_total,
    {big(f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v) t)")} AS duplicate_rows FROM v"""
QUERIES["st_missing_columns"] = lambda s, d: st.dataset_info(dirty(s, d, "orders"))["columns"].select("position", "column", "missing")
SQL["st_missing_columns"] = unions([f"""SELECT {i} AS position, '{c}' AS "column", count(*) - count({c}) AS missing
    FROM {ORDERS} v""" for i, c in enumerate(COLS)])

# ST-2, ST-3
QUERIES["st_numeric"] = lambda s, d: rounded(st.numeric_summary(dirty(s, d, "orders")), 3)


def _numeric_sql(c) -> str:
    z = f"({c} - a) / sd"
    q = {"mean": "any_value(a)", "std": f"stddev_samp({c})", "variance": f"var_samp({c})", "min": f"min({c})",
         "max": f"max({c})", "q25": "any_value(q1)", "median": f"median({c})", "q75": "any_value(q3)",
         "iqr": "any_value(q3 - q1)", "skewness": f"avg(pow({z}, 3))", "kurtosis": f"avg(pow({z}, 4)) - 3",
         "mode": f"(SELECT {c} FROM v WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"}
    return (f"""SELECT * FROM (WITH v AS {ORDERS}, m AS (SELECT avg({c}) AS a, stddev_pop({c}) AS sd, quantile_cont({c}, 0.25) AS q1,
      quantile_cont({c}, 0.75) AS q3 FROM v) SELECT '{c}' AS "column", count({c}) AS count, """
            + ", ".join(f"{r(x, 3)} AS {n}" for n, x in q.items())
            + f""", {big(f"sum(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END)")}
      AS outliers_count FROM v, m) t""")


SQL["st_numeric"] = unions([_numeric_sql(c) for c in NUM])
_IQR = ["l_quantity", "l_price", "l_net", "l_discount"]
QUERIES["st_iqr"] = lambda s, d: rounded(st.iqr_outliers(dirty(s, d, "lineitem"), _IQR))
SQL["st_iqr"] = unions([f"""SELECT * FROM (WITH v AS {LINE}, m AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM v)
    SELECT '{c}' AS "column", {r("any_value(q1 - 1.5 * (q3 - q1))")} AS lower, {r("any_value(q3 + 1.5 * (q3 - q1))")} AS upper,
    {big(f"sum(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END)")} AS outliers_count
    FROM v, m) t""" for c in _IQR])


# ST-4
def _categorical(s, d) -> DataFrame:
    out = st.categorical_summary(table(s, d, "events"), ["event_type", "props"])
    entries = F.array_sort(F.transform(F.map_entries("distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return out.withColumn("distribution", F.array_join(entries, ";"))


QUERIES["st_categorical"] = _categorical
SQL["st_categorical"] = unions([f"""SELECT * FROM (WITH k AS (SELECT {c} AS v, count(*) AS n FROM events WHERE {c} IS NOT NULL GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS i FROM k)
    SELECT '{c}' AS "column", {big("sum(n)")} AS count, count(*) AS unique_values, arg_min(v, i) AS most_frequent,
      arg_min(n, i) AS most_frequent_count, arg_max(v, i) AS least_frequent, arg_max(n, i) AS least_frequent_count,
      string_agg(CASE WHEN i <= 10 THEN v || '=' || n END, ';' ORDER BY v || '=' || n) AS distribution FROM o) t"""
    for c in ("event_type", "props")])

# ST-5, ST-7, ST-8
PART = ["p_partkey", "p_size", "p_retailprice"]
_pairs = [(a, b) for i, a in enumerate(PART) for b in PART[i + 1:]]
QUERIES["st_pearson"] = lambda s, d: rounded(st.pearson_matrix(table(s, d, "part")))
_P = unions([f"""SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM part""" for a, b in _pairs])
SQL["st_pearson"] = f"SELECT a, b, {r('r')} AS r, n FROM ({_P}) t"
_DIRTY = ["l_quantity", "l_price", "l_net", "l_gross", "l_tax", "l_const", "l_discount"]
QUERIES["st_pearson_dirty"] = lambda s, d: rounded(st.pearson_matrix(dirty(s, d, "orders")).unionByName(
    st.pearson_matrix(dirty(s, d, "lineitem"), _DIRTY)))
SQL["st_pearson_dirty"] = unions([
    *[f"""SELECT '{a}' AS a, '{b}' AS b, {r(f"corr({a}, {b})")} AS r, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n
      FROM {ORDERS} v""" for i, a in enumerate(NUM) for b in NUM[i + 1:]],
    *[f"SELECT '{a}' AS a, '{b}' AS b, " + ("NULL" if {a, b} & {"l_tax", "l_const"} else r(f"corr({a}, {b})"))
      + f" AS r, count(*) AS n FROM {LINE} v" for i, a in enumerate(_DIRTY) for b in _DIRTY[i + 1:]]])
QUERIES["st_strong"] = lambda s, d: rounded(st.strong_correlations(st.pearson_matrix(dirty(s, d, "lineitem"))))
_L = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_price", "l_net", "l_gross", "l_discount"]
_LP = unions([f"""SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS c FROM {LINE} v"""
              for i, a in enumerate(_L) for b in _L[i + 1:]])
SQL["st_strong"] = f"""SELECT feature1, feature2, {r("c")} AS correlation, CASE WHEN abs(c) >= 0.7 THEN 'strong' ELSE 'moderate' END
    AS strength FROM ({_LP}) t WHERE abs(c) >= 0.5"""
QUERIES["st_insights"] = lambda s, d: rounded(st.correlation_insights(st.pearson_matrix(table(s, d, "part"))))
SQL["st_insights"] = f"""SELECT arg_max(a, abs(r)) AS feature1, arg_max(b, abs(r)) AS feature2, {r("max(abs(r))")} AS max_abs_r,
    count(CASE WHEN abs(r) >= 0.7 THEN 1 END) AS strong_count FROM ({_P}) t"""

# ST-6
QUERIES["st_spearman"] = lambda s, d: rounded(st.spearman_matrix(table(s, d, "part")))
_rank = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
SQL["st_spearman"] = unions([f"""SELECT '{a}' AS a, '{b}' AS b, {r("corr(x, y)")} AS r, count(*) AS n
    FROM (SELECT {_rank(a)} AS x, {_rank(b)} AS y FROM part) t""" for a, b in _pairs])
QUERIES["st_spearman_gaps"] = lambda s, d: rounded(st.spearman(dirty(s, d, "orders"), "o_custkey", "o_totalprice"))
SQL["st_spearman_gaps"] = f"""SELECT 'o_custkey' AS a, 'o_totalprice' AS b, {r("corr(x, y)")} AS r, count(*) AS n
    FROM (SELECT {_rank("o_custkey")} AS x, {_rank("o_totalprice")} AS y FROM {ORDERS} v WHERE o_totalprice IS NOT NULL) t"""

# ST-9 to ST-12
_test = lambda df: rounded(df.select("test_type", "statistic", "p_value", "is_significant", "degrees_of_freedom", "n"))


def _below(density, x: str, steps: int = 4000) -> str:
    """Integral of a density from 0 to x by Simpson's rule: another way than the continued fractions of the library."""
    at = f"(({x}) * i / {steps})"
    return f"""(({x}) / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4
      ELSE 2 END) * {density(at)})))"""


_T = lambda t, v: "1 - 2 * " + _below(
    lambda x: f"exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - ({v} + 1) / 2 * ln(1 + {x} * {x} / {v})) / sqrt({v} * pi())", f"abs({t})")
_F = lambda f, a, b: "1 - " + _below(
    lambda x: f"exp(lgamma(({a} + {b}) / 2) - lgamma({a} / 2) - lgamma({b} / 2) + {a} / 2 * ln({a} / {b}) - ({a} + {b}) / 2 * ln(1 + {a} * {x} / {b})) * pow({x}, {a} / 2 - 1)", f)
# the square root of a chi-square value has a density without a pole
_C = lambda c, k: "1 - " + _below(lambda x: f"exp((1 - {k} / 2) * ln(2) - lgamma({k} / 2) - {x} * {x} / 2) * pow({x}, {k} - 1)", f"sqrt({c})")


def _tested(kind: str, inner: str, p: str) -> str:
    """The result of a test from one row (s, d1, n, ...) and its p-value."""
    return f"""SELECT '{kind}' AS test_type, {r("s")} AS statistic, {r("p")} AS p_value, p < 0.05 AS is_significant, d1 AS degrees_of_freedom, n
    FROM (SELECT *, {p} AS p FROM ({inner}) x) y"""


QUERIES["st_pearson_t"] = lambda s, d: _test(st.hypothesis_test(table(s, d, "part"), "p_retailprice", "p_size"))
SQL["st_pearson_t"] = _tested("Pearson Correlation Test", "SELECT corr(p_retailprice, p_size) AS s, (count(*) - 2)::DOUBLE AS d1, count(*) AS n FROM part",
                              _T("(s * sqrt(d1 / (1 - s * s)))", "d1"))
_two = lambda s, d: table(s, d, "labels").withColumn("kind", F.when(F.col("quality") == 1, "good").otherwise("bad")).join(
    table(s, d, "documents"), "doc_id")
QUERIES["st_ttest_t"] = lambda s, d: _test(st.hypothesis_test(_two(s, d), "n_chars", "kind"))
_TWO = "(SELECT n_chars, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS kind FROM labels JOIN documents USING (doc_id))"
SQL["st_ttest_t"] = f"""WITH g AS (SELECT kind, count(*) AS n, avg(n_chars) AS m, var_samp(n_chars) AS v FROM {_TWO} t GROUP BY kind),
    a AS (SELECT * FROM g WHERE kind = 'bad'), b AS (SELECT * FROM g WHERE kind = 'good')
    """ + _tested("Two-sample T-test", """SELECT (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS s,
      (a.n + b.n - 2)::DOUBLE AS d1, a.n + b.n AS n FROM a, b""", _T("s", "d1"))
QUERIES["st_anova_f"] = lambda s, d: _test(st.hypothesis_test(table(s, d, "orders"), "o_totalprice", "o_orderpriority"))
SQL["st_anova_f"] = f"""WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
    t AS (SELECT avg(o_totalprice) AS a FROM orders)
    """ + _tested("One-way ANOVA", f"""SELECT (sum(n * pow(m - a, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS s,
      (count(*) - 1)::DOUBLE AS d1, (sum(n) - count(*))::DOUBLE AS d2, {big("sum(n)")} AS n FROM g, t""", _F("s", "d1", "d2"))


def _chi2(table_sql, a, b, yates) -> str:
    e = "r * c * 1.0 / t"
    gap = f"greatest(abs(o - {e}) - {0.5 if yates else 0}, 0)"
    return f"""WITH v AS (SELECT {a} AS a, {b} AS b FROM {table_sql} s WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
      ra AS (SELECT a, count(*) AS r FROM v GROUP BY a), cb AS (SELECT b, count(*) AS c FROM v GROUP BY b),
      n AS (SELECT count(*) AS t FROM v), o AS (SELECT a, b, count(*) AS o FROM v GROUP BY a, b),
      x AS (SELECT r, c, t, coalesce(o, 0) AS o FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN o USING (a, b))
      """ + _tested("Chi-square Test of Independence", f"""SELECT sum(pow({gap}, 2) / ({e})) AS s,
        ((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM cb) - 1)::DOUBLE AS d1, any_value(t) AS n FROM x""", _C("s", "d1"))


QUERIES["st_chi2"] = lambda s, d: _test(st.hypothesis_test(table(s, d, "orders"), "o_orderpriority", "o_orderstatus"))
SQL["st_chi2"] = _chi2("orders", "o_orderpriority", "o_orderstatus", False)
QUERIES["st_chi2_yates"] = lambda s, d: _test(st.hypothesis_test(
    table(s, d, "labels").select(F.col("quality").cast("string").alias("q"), F.col("toxic").cast("string").alias("t")), "q", "t"))
SQL["st_chi2_yates"] = _chi2("(SELECT quality::VARCHAR AS q, toxic::VARCHAR AS tx FROM labels)", "q", "tx", True)
QUERIES["st_contingency"] = lambda s, d: st.contingency(dirty(s, d, "orders"), "o_orderpriority", "o_orderstatus")
SQL["st_contingency"] = f"""SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM {ORDERS} v
    WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2"""

# ML-7 and ML-8 with given predictions; the models themselves rows-only
_FLAGS = "CASE WHEN l_quantity > 40 THEN 'R' WHEN l_quantity > 20 THEN 'A' ELSE 'N' END"
QUERIES["ml_report"] = lambda s, d: rounded(m.classification_report(
    table(s, d, "lineitem").withColumn("guess", F.expr(_FLAGS)), "l_returnflag", "guess"))
SQL["ml_report"] = f"""WITH v AS (SELECT l_returnflag AS l, {_FLAGS} AS p FROM lineitem),
    k AS (SELECT l AS label FROM v UNION SELECT p FROM v),
    c AS (SELECT label, (SELECT count(*) FROM v WHERE l = label) AS support, (SELECT count(*) FROM v WHERE p = label) AS guessed,
      (SELECT count(*) FROM v WHERE l = label AND p = label) AS hits FROM k),
    e AS (SELECT *, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re FROM c),
    f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM e)
    SELECT label, {r("pr")} AS precision, {r("re")} AS recall, {r("f1")} AS f1_score, support FROM f
    UNION ALL SELECT 'accuracy', {r("sum(hits) / sum(support)")}, {r("sum(hits) / sum(support)")}, {r("sum(hits) / sum(support)")},
      {big("sum(support)")} FROM f
    UNION ALL SELECT 'macro avg', {r("avg(pr)")}, {r("avg(re)")}, {r("avg(f1)")}, {big("sum(support)")} FROM f
    UNION ALL SELECT 'weighted avg', {r("sum(pr * support) / sum(support)")}, {r("sum(re * support) / sum(support)")},
      {r("sum(f1 * support) / sum(support)")}, {big("sum(support)")} FROM f"""
QUERIES["ml_label_codes"] = lambda s, d: m.label_codes(table(s, d, "orders"), "o_orderpriority")
SQL["ml_label_codes"] = """SELECT o_orderpriority AS label, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code
    FROM orders GROUP BY 1"""
QUERIES["ml_regression_scores"] = lambda s, d: rounded(m.regression_scores(
    table(s, d, "lineitem").withColumn("guess", F.col("l_quantity") * 2100), "l_extendedprice", "guess"))
SQL["ml_regression_scores"] = f"""WITH v AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 2100 AS e FROM lineitem)
    SELECT {r("1 - sum(e * e) / (var_pop(y) * count(*))")} AS r2_score, {r("sqrt(avg(e * e))")} AS rmse, count(*) AS n FROM v"""
_FRAME = ["l_quantity", "l_discount", "l_tax"]
QUERIES["ml_model_frame"] = lambda s, d: m.model_frame(table(s, d, "lineitem"), "l_extendedprice", _FRAME)[0].agg(
    F.count("*").alias("n"), F.round(F.avg(F.col("_test").cast("double")), 1).alias("test_share"))
SQL["ml_model_frame"] = "SELECT count(*) AS n, 0.2::DOUBLE AS test_share FROM lineitem"
QUERIES["ml_linear_exact"] = lambda s, d: _linear(s, d)


def _linear(s, d) -> DataFrame:
    """A target that is linear in its features: the fit must find it whatever the split."""
    df = table(s, d, "lineitem").select("l_quantity", "l_discount", (3 * F.col("l_quantity") - 50 * F.col("l_discount") + 7).alias("y"))
    frame, features = m.model_frame(df, "y")
    out = p.optimize(df, "y")["features"]
    return rounded(out.select("feature", "coefficient", "low", "high", "optimal"), 3)


SQL["ml_linear_exact"] = f"""SELECT 'l_quantity' AS feature, 3.0::DOUBLE AS coefficient, {r("min(l_quantity)", 3)} AS low,
    {r("max(l_quantity)", 3)} AS high, {r("max(l_quantity)", 3)} AS optimal FROM lineitem
    UNION ALL SELECT 'l_discount', -50.0, {r("min(l_discount)", 3)}, {r("max(l_discount)", 3)}, {r("min(l_discount)", 3)} FROM lineitem"""
_reg = lambda s, d: m.regression_models(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
QUERIES["ml_regression"] = lambda s, d: _reg(s, d)["metrics"]
QUERIES["ml_best_regression"] = lambda s, d: m.best_model(_reg(s, d)["metrics"])
_cls = lambda s, d: m.classification_models(table(s, d, "lineitem").select(
    "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"), "l_returnflag")
QUERIES["ml_classification"] = lambda s, d: _cls(s, d)["report"]

# PR-1 to PR-3
QUERIES["pr_bounds"] = lambda s, d: rounded(p.feature_bounds(dirty(s, d, "orders"), "o_totalprice"))
SQL["pr_bounds"] = unions([f"""SELECT '{c}' AS feature, {r(f"min({c})")} AS low, {r(f"max({c})")} AS high, {r(f"avg({c})")} AS mean
    FROM {ORDERS} v WHERE o_totalprice IS NOT NULL""" for c in ("o_orderkey", "o_custkey")])
_simple = lambda s, d: p.optimize(table(s, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_extendedprice", "minimize")
QUERIES["pr_optimum"] = lambda s, d: rounded(_simple(s, d)["outcome"], 2)
SQL["pr_optimum"] = f"""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
      min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_extendedprice) AS y FROM lineitem)
    SELECT 'minimize l_extendedprice' AS objective, {r("a + b * CASE WHEN b > 0 THEN lo ELSE hi END", 2)} AS predicted_outcome,
      {r("y", 2)} AS current_average_outcome, {r("a + b * CASE WHEN b > 0 THEN lo ELSE hi END - y", 2)} AS improvement FROM m"""
QUERIES["pr_advice"] = lambda s, d: rounded(p.change_advice(_simple(s, d)["features"]), 2)
SQL["pr_advice"] = f"""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, min(l_quantity) AS lo, max(l_quantity) AS hi,
      avg(l_quantity) AS q FROM lineitem), o AS (SELECT *, CASE WHEN b > 0 THEN lo ELSE hi END AS x FROM m),
    c AS (SELECT *, (x - q) / q * 100 AS pc FROM o)
    SELECT 0 AS position, 'l_quantity' AS feature, {r("q", 2)} AS current_average, {r("x", 2)} AS recommended_value, {r("x - q", 2)} AS change,
      {r("pc", 2)} AS percent_change, CASE WHEN x > q THEN 'Increase' ELSE 'Decrease' END || printf(' l_quantity by %.1f%%', abs(pc))
      AS action FROM c WHERE abs(pc) > 5"""


def _insights(s, d) -> DataFrame:
    df = dirty(s, d, "orders")
    strong = st.strong_correlations(st.pearson_matrix(dirty(s, d, "lineitem"), ["l_net", "l_gross"]))
    return p.actionable_insights(st.dataset_info(df)["info"], strong, None, p.change_advice(_simple(s, d)["features"]))


QUERIES["pr_insights"] = _insights
SQL["pr_insights"] = f"""SELECT 0 AS step, printf('High missing data (%.1f%%): consider imputation or better collection', pct) AS insight
    FROM (SELECT ({" + ".join(f"(count(*) - count({c}))" for c in COLS)}) * 100.0 / (count(*) * 6) AS pct FROM {ORDERS} v) t
    WHERE pct > 10
    UNION ALL SELECT 2, printf('Strong relationship found: l_net and l_gross (r=%.3f)', corr(l_net, l_gross)) FROM {LINE} v
    UNION ALL SELECT 4, action || ' to improve outcomes' FROM ({SQL["pr_advice"]}) a"""
QUERIES["pr_dispatch"] = lambda s, d: rounded(p.analyze_by_type(
    table(s, d, "orders"), "diagnostic", target="o_totalprice", feature="o_orderstatus")["hypothesis"].select(
    "test_type", "statistic", "n"))
SQL["pr_dispatch"] = f"""WITH g AS (SELECT o_orderstatus, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
    t AS (SELECT avg(o_totalprice) AS a FROM orders)
    SELECT 'One-way ANOVA' AS test_type, {r("(sum(n * pow(m - a, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*)))")}
      AS statistic, {big("sum(n)")} AS n FROM g, t"""

# TM-1 to TM-4
QUERIES["tm_summary"] = lambda s, d: rounded(fc.series_summary(table(s, d, "events"), "value"))
SQL["tm_summary"] = f"""SELECT {r("avg(value)")} AS mean, {r("median(value)")} AS median, (SELECT ROUND(value, 6) FROM events GROUP BY value
    ORDER BY count(*) DESC, value LIMIT 1) AS mode, {r("stddev_pop(value)")} AS std_dev FROM events"""
QUERIES["tm_hist"] = lambda s, d: rounded(fc.histogram(table(s, d, "events"), "value", 12))
SQL["tm_hist"] = f"""WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 12 AS w FROM events),
    k AS (SELECT least(floor((value - lo) / w), 11)::INTEGER AS bin, count(*) AS n FROM events, m GROUP BY 1)
    SELECT b.i::INTEGER AS bin, {r("lo + b.i * w")} AS bin_start, {r("lo + (b.i + 1) * w")} AS bin_end, coalesce(n, 0) AS count
    FROM range(12) b(i) CROSS JOIN m LEFT JOIN k ON k.bin = b.i"""
QUERIES["tm_correlation"] = lambda s, d: rounded(fc.correlation(table(s, d, "events"), "event_id", "value", ["user_id"]))
SQL["tm_correlation"] = f"""SELECT user_id, {r("CASE WHEN count(*) < 2 OR min(value) = max(value) THEN 0 ELSE corr(event_id, value) END")} AS r
    FROM events GROUP BY user_id"""
QUERIES["tm_ols"] = lambda s, d: rounded(fc.simple_regression(table(s, d, "events"), "event_id", "value", ["event_type"]), 6)
SQL["tm_ols"] = f"""SELECT event_type, {r("regr_slope(value, event_id)", 6)} AS slope, {r("regr_intercept(value, event_id)", 6)} AS intercept,
    {r("regr_r2(value, event_id)", 6)} AS r2, {r("max(event_id)", 6)} AS last_x, count(*) AS n FROM events GROUP BY event_type"""

# TM-5 to TM-8
QUERIES["tm_ma"] = lambda s, d: rounded(fc.moving_average(table(s, d, "events"), "event_id", "value", 3, ["user_id"]).select(
    "event_id", "user_id", "moving_avg"))
_MA = "avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING)"
SQL["tm_ma"] = f"""SELECT event_id, user_id, {r("ma")} AS moving_avg FROM (SELECT event_id, user_id, {_MA} AS ma,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) t WHERE k >= 3"""
QUERIES["tm_ma_global"] = lambda s, d: rounded(fc.moving_average(table(s, d, "events"), "event_id", "value", 5).select(
    "event_id", "moving_avg"))
SQL["tm_ma_global"] = f"""SELECT event_id, {r("ma")} AS moving_avg FROM (SELECT event_id, avg(value) OVER (ORDER BY event_id
    ROWS 4 PRECEDING) AS ma, row_number() OVER (ORDER BY event_id) AS k FROM events) t WHERE k >= 5"""
QUERIES["tm_ma_chunks"] = lambda s, d: rounded(fc.moving_average(table(s, d, "events"), "event_id", "value", 3, ["user_id"], 700).select(
    "event_id", "user_id", "moving_avg"))
SQL["tm_ma_chunks"] = SQL["tm_ma"]
QUERIES["tm_ma_forecast"] = lambda s, d: rounded(fc.moving_average_forecast(
    table(s, d, "events"), "event_id", "value", 3, 5, ["user_id"]))
SQL["tm_ma_forecast"] = f"""WITH RECURSIVE t AS (SELECT user_id, list(value ORDER BY event_id) AS v, max(event_id) AS last FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) e WHERE k <= 3
      GROUP BY user_id HAVING count(*) = 3),
    f AS (SELECT user_id, last, 1 AS step, (v[1] + v[2] + v[3]) / 3 AS y, [v[2], v[3], (v[1] + v[2] + v[3]) / 3] AS v FROM t
      UNION ALL SELECT user_id, last, step + 1, (v[1] + v[2] + v[3]) / 3, [v[2], v[3], (v[1] + v[2] + v[3]) / 3] FROM f WHERE step < 5)
    SELECT user_id, step, (last + step)::DOUBLE AS x, {r("y")} AS y FROM f"""
QUERIES["tm_reg_forecast"] = lambda s, d: rounded(fc.regression_forecast(
    table(s, d, "events"), "event_id", "value", 5, ["event_type"]))
SQL["tm_reg_forecast"] = f"""SELECT event_type, i::INTEGER AS step, {r("last + i")} AS x, {r("a + b * (last + i)")} AS y
    FROM (SELECT event_type, regr_slope(value, event_id) AS b, regr_intercept(value, event_id) AS a, max(event_id) AS last
    FROM events GROUP BY 1) t, range(1, 6) g(i)"""
_guess = lambda s, d: table(s, d, "events").withColumn("guess", F.when(F.col("event_id") % 2 == 0, F.col("value") * 1.1)
                                                       .otherwise(F.col("value") - 2)).withColumn(
    "actual", F.when(F.col("event_id") % 100 == 0, 0.0).otherwise(F.col("value")))
QUERIES["tm_accuracy"] = lambda s, d: rounded(fc.forecast_accuracy(_guess(s, d), "actual", "guess", ["event_type"]))
SQL["tm_accuracy"] = f"""SELECT event_type, {r("avg(CASE WHEN a <> 0 THEN abs((a - g) / a) ELSE 0 END) * 100")} AS mape,
    {r("sqrt(avg((a - g) * (a - g)))")} AS rmse FROM (SELECT event_type, CASE WHEN event_id % 100 = 0 THEN 0.0 ELSE value END AS a,
    CASE WHEN event_id % 2 = 0 THEN value * 1.1 ELSE value - 2 END AS g FROM events) t GROUP BY 1"""


# TM-9: one program per supplier from its nation's suppliers' balances; SQL tries all corners
def _programs(s, d) -> tuple[DataFrame, DataFrame]:
    sup = table(s, d, "supplier")
    c = sup.select(F.col("s_nationkey").alias("nation"), (1 + F.col("s_suppkey") % 7).cast("double").alias("a"),
                   (1 + F.col("s_suppkey") % 5).cast("double").alias("b"), (F.abs("s_acctbal") + 10).alias("r"))
    return c, table(s, d, "nation").select(F.col("n_nationkey").alias("nation"), (1 + F.col("n_nationkey") % 3).alias("px"),
                                           (1 + F.col("n_nationkey") % 4).alias("py"))


QUERIES["tm_lp"] = lambda s, d: rounded(lp.solve_programs(*_programs(s, d), "nation").select("nation", "value"), 3)
SQL["tm_lp"] = f"""WITH c AS (SELECT s_nationkey AS nation, s_suppkey AS i, (1 + s_suppkey % 7)::DOUBLE AS a, (1 + s_suppkey % 5)::DOUBLE AS b,
      abs(s_acctbal) + 10 AS r FROM supplier),
    p AS (SELECT n_nationkey AS nation, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM nation UNION SELECT nation, r / a, 0.0 FROM c
      UNION SELECT nation, 0.0, r / b FROM c
      UNION SELECT u.nation, (u.r * w.b - w.r * u.b) / (u.a * w.b - w.a * u.b), (u.a * w.r - w.a * u.r) / (u.a * w.b - w.a * u.b)
        FROM c u JOIN c w ON u.nation = w.nation AND u.i < w.i AND u.a * w.b - w.a * u.b <> 0),
    ok AS (SELECT * FROM p WHERE x >= 0 AND y >= 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.nation = p.nation
      AND c.a * p.x + c.b * p.y > c.r + 1e-7))
    SELECT nation, {r("max((1 + nation % 3) * x + (1 + nation % 4) * y)", 3)} AS value FROM ok GROUP BY nation"""

# TM-10
_scen = lambda s, d: table(s, d, "part").select(
    "p_partkey", F.col("p_retailprice").alias("cost"), (F.col("p_retailprice") * (F.col("p_size") + 70) / 100).alias("benefit"),
    F.when(F.col("p_partkey") % 4 != 0, (F.col("p_partkey") % 10) / 10.0).alias("probability"))
QUERIES["tm_scenarios"] = lambda s, d: rounded(fc.score_scenarios(_scen(s, d)).select(
    "p_partkey", "roi", "expected_value", "recommendation"), 6)
SQL["tm_scenarios"] = f"""SELECT p_partkey, {r("roi", 6)} AS roi, {r("(b - c) * CASE WHEN p IS NULL OR p = 0 THEN 1 ELSE p END", 6)} AS expected_value,
    CASE WHEN roi >= 50 THEN 'Highly Recommended' WHEN roi >= 20 THEN 'Recommended' WHEN roi >= 0 THEN 'Consider' ELSE 'Avoid' END
    AS recommendation FROM (SELECT *, (b - c) / c * 100 AS roi FROM (SELECT p_partkey, p_retailprice AS c,
    p_retailprice * (p_size + 70) / 100 AS b, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 10) / 10.0::DOUBLE END AS p FROM part) t) u"""


# Many tests at once: an invented p-value per line item, a group per return flag, one value of a third of them
_P = "CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN 0.75 ELSE pow(CAST((l_orderkey * 7919 + l_linenumber * 104729) % 10007 AS DOUBLE) / 10007, 3) END"
QUERIES["st_adjusted"] = lambda s, d: rounded(si.adjust(table(s, d, "lineitem").select(
    "l_orderkey", "l_linenumber", "l_returnflag", F.expr(_P).cast("double").alias("p")), "p", ["l_returnflag"], ranges=5).select(
    "l_orderkey", "l_linenumber", "tests", "adjusted"), 9)
SQL["st_adjusted"] = f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag AS g, CAST({_P} AS DOUBLE) AS p FROM lineitem),
    k AS (SELECT *, count(p) OVER (PARTITION BY g) AS m, count(p) OVER (PARTITION BY g, p IS NULL ORDER BY p) AS rank FROM t)
    SELECT l_orderkey, l_linenumber, CASE WHEN p IS NOT NULL THEN m END AS tests, CASE WHEN p IS NOT NULL THEN
      {r("least(1.0, min(p * m / rank) OVER (PARTITION BY g, p IS NULL ORDER BY p DESC))", 9)} END AS adjusted FROM k"""
QUERIES["st_bonferroni"] = lambda s, d: rounded(si.adjust(table(s, d, "lineitem").select(
    "l_returnflag", F.expr(_P).cast("double").alias("p")), "p", ["l_returnflag"], method="any").groupBy("l_returnflag", "tests").agg(
    F.count_if(F.col("adjusted") < 0.05).alias("found"), F.min("adjusted").alias("least")).filter("tests is not null"), 9)
SQL["st_bonferroni"] = f"""SELECT l_returnflag, m AS tests, count(*) FILTER (least(1.0, p * m) < 0.05) AS found, {r("min(least(1.0, p * m))", 9)} AS least FROM (
    SELECT l_returnflag, p, count(*) OVER (PARTITION BY l_returnflag) AS m FROM (SELECT l_returnflag, CAST({_P} AS DOUBLE) AS p FROM lineitem) t
    WHERE p IS NOT NULL) u GROUP BY 1, 2"""


# Smoothing: orders a day by priority, cut into ranges; the recursion follows the definition
def _daily(s, d) -> DataFrame:
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    return table(s, d, "orders").groupBy("o_orderpriority", day.alias("day")).agg(F.count("*").alias("n"))


_smooth = lambda s, d, ranges=7: sm.smooth(_daily(s, d), "day", "n", ["o_orderpriority"], ranges=ranges)
QUERIES["tm_smooth"] = lambda s, d: rounded(_smooth(s, d))
_HOLT = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day) AS i FROM (
      SELECT o_orderpriority, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS day, count(*) AS n FROM orders GROUP BY 1, 2) g),
    h AS (SELECT o_orderpriority, i, day, n::DOUBLE AS y, n::DOUBLE AS l, 0.0::DOUBLE AS t, NULL::DOUBLE AS fitted FROM e WHERE i = 1
      UNION ALL SELECT e.o_orderpriority, e.i, e.day, e.n::DOUBLE, 0.3 * e.n + 0.7 * (h.l + h.t),
        0.1 * (0.3 * e.n + 0.7 * (h.l + h.t) - h.l) + 0.9 * h.t, h.l + h.t FROM h JOIN e ON e.o_orderpriority = h.o_orderpriority AND e.i = h.i + 1)"""
SQL["tm_smooth"] = f"""{_HOLT} SELECT o_orderpriority, day::DOUBLE AS day, y AS n, {r("l")} AS level, {r("t")} AS trend, {r("fitted")} AS fitted,
    {r("y - fitted")} AS residual FROM h"""
QUERIES["tm_interval"] = lambda s, d: rounded(sm.forecast(_smooth(s, d), "day", 5, ["o_orderpriority"]))
SQL["tm_interval"] = f"""{_HOLT}, v AS (SELECT o_orderpriority, max(day) AS last, arg_max(l, day) AS l, arg_max(t, day) AS t, avg((y - fitted) * (y - fitted)) AS v
      FROM h GROUP BY 1)
    SELECT o_orderpriority, k::INTEGER AS step, (last + k)::DOUBLE AS x, {r("l + k * t")} AS y,
      {r("l + k * t - 1.959963984540054 * sqrt(v * (1 + coalesce(list_sum(list_transform(range(1, k), lambda j: pow(0.3 + 0.03 * j, 2))), 0)))")} AS lo,
      {r("l + k * t + 1.959963984540054 * sqrt(v * (1 + coalesce(list_sum(list_transform(range(1, k), lambda j: pow(0.3 + 0.03 * j, 2))), 0)))")} AS hi
    FROM v, range(1, 6) g(k)"""
QUERIES["tm_coverage"] = lambda s, d: rounded(sm.coverage(_smooth(s, d, 3), ["o_orderpriority"]))
SQL["tm_coverage"] = f"""{_HOLT} SELECT o_orderpriority, count(fitted) AS points, {r("avg((abs(y - fitted) <= 1.959963984540054 * s)::INTEGER)")} AS inside
    FROM (SELECT *, sqrt(avg((y - fitted) * (y - fitted)) OVER (PARTITION BY o_orderpriority)) AS s FROM h) x WHERE fitted IS NOT NULL GROUP BY 1"""

# Scenarios of the parts: how the expected value and the first place of a size react to each assumption
_BOUNDS = {"cost": (0.8, 1.2), "benefit": (0.9, 1.3), "probability": (0.5, 1.1)}
_case = lambda s, d: table(s, d, "part").select(
    "p_partkey", "p_size", F.col("p_retailprice").alias("cost"), (F.col("p_retailprice") * (F.col("p_size") + 70) / 100).alias("benefit"),
    ((F.col("p_partkey") % 10 + 1) / 10).alias("probability"))
_CASE = """(SELECT p_partkey, p_size, p_retailprice AS cost, p_retailprice * (p_size + 70) / 100 AS benefit, (p_partkey % 10 + 1) / 10 AS probability FROM part)"""
_EV = lambda **m: f"(benefit * {m.get('benefit', 1.0)} - cost * {m.get('cost', 1.0)}) * (probability * {m.get('probability', 1.0)})"
QUERIES["tm_one_at_a_time"] = lambda s, d: rounded(se.one_at_a_time(_case(s, d), _BOUNDS).select(
    "p_partkey", "factor", "base", "low", "high", "swing", "elasticity"))
SQL["tm_one_at_a_time"] = unions([f"""SELECT p_partkey, '{f}' AS factor, {r(_EV())} AS base, {r(_EV(**{f: lo}))} AS low, {r(_EV(**{f: hi}))} AS high,
    {r(f"abs({_EV(**{f: hi})} - {_EV(**{f: lo})})")} AS swing, {r(f"({_EV(**{f: hi})} - {_EV(**{f: lo})}) / nullif({_EV()} * {hi - lo}, 0)")} AS elasticity
    FROM {_CASE} t""" for f, (lo, hi) in _BOUNDS.items()])
QUERIES["tm_pairwise"] = lambda s, d: rounded(se.pairwise(_case(s, d), _BOUNDS).drop("p_size", "cost", "benefit", "probability"))
_CORNERS = lambda a, b: {n: _EV(**{a: _BOUNDS[a][i], b: _BOUNDS[b][j]}) for n, (i, j) in
                         {"low_low": (0, 0), "low_high": (0, 1), "high_low": (1, 0), "high_high": (1, 1)}.items()}
SQL["tm_pairwise"] = unions([f"""SELECT p_partkey, '{a}' AS factor_a, '{b}' AS factor_b, {", ".join(f"{r(v)} AS {n}" for n, v in _CORNERS(a, b).items())},
    {r(f"least({', '.join(_CORNERS(a, b).values())})")} AS worst, {r(f"greatest({', '.join(_CORNERS(a, b).values())})")} AS best,
    {r(f"{_CORNERS(a, b)['high_high']} - {_EV(**{a: _BOUNDS[a][1]})} - {_EV(**{b: _BOUNDS[b][1]})} + {_EV()}")} AS interaction FROM {_CASE} t"""
    for a, b in (("cost", "benefit"), ("cost", "probability"), ("benefit", "probability"))])
QUERIES["tm_switch"] = lambda s, d: rounded(se.switching_points(_case(s, d), "p_partkey", _BOUNDS, ["p_size"]))
SQL["tm_switch"] = f"""WITH t AS (SELECT *, {_EV()} AS base FROM {_CASE} x), o AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY base DESC, p_partkey) AS k FROM t),
    p AS (SELECT a.*, b.p_partkey AS rival, b.base AS rival_base FROM o a JOIN o b ON a.p_size = b.p_size AND b.k = CASE WHEN a.k = 1 THEN 2 ELSE 1 END)
    """ + unions([f"""SELECT p_size, p_partkey, '{f}' AS factor, {r("base")} AS base, rival, {r("rival_base")} AS rival_base, {r("m")} AS switch,
      coalesce(m BETWEEN {lo} AND {hi}, false) AS reachable FROM (SELECT *, (rival_base - {_EV(**{f: 0.0})}) / nullif(base - {_EV(**{f: 0.0})}, 0) AS m FROM p) x"""
      for f, (lo, hi) in _BOUNDS.items()])
