"""Queries over the drift operators: orders before 1998 against a changed later part."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.stage import shared_dir
from ..operators import distribution as di, drift as dr
from ..sources.sinks import BaselineStore
from .common import big, r, rounded, table, unions

QUERIES, SQL = {}, {}
_BASE = """SELECT o_custkey, o_totalprice, o_orderpriority, o_orderstatus, o_orderkey, 'old' AS note FROM {orders}
    WHERE o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'"""
_NOW = """SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 4 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderpriority = '5-LOW' THEN '6-NONE' WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 2 = 0 THEN '1-URGENT'
      ELSE o_orderpriority END AS o_orderpriority, o_orderstatus, CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderdate
    FROM {orders} WHERE o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'"""


def _tables(s, d) -> tuple[DataFrame, DataFrame]:
    o = table(s, d, "orders")
    return s.sql(_BASE, orders=o), s.sql(_NOW, orders=o)


def _duck(sql: str) -> str:
    return "(" + sql.replace("TIMESTAMP_NTZ", "TIMESTAMP").format(orders="orders") + ")"


B, N = _duck(_BASE), _duck(_NOW)


def _profiles(s, d):
    base, now = _tables(s, d)
    return dr.profile(base), dr.profile(now)


# DR-1
QUERIES["dr_profile"] = lambda s, d: rounded(dr.profile(_tables(s, d)[0])["columns"])


def _profile_sql(c, dtype, num) -> str:
    stat = ["avg({c})", "median({c})", "stddev_samp({c})", "quantile_cont({c}, 0.25)", "quantile_cont({c}, 0.75)"]
    names = ["mean", "median", "std", "q25", "q75"]
    return (f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, {str(num).lower()} AS is_numeric,
      {r(f"(count(*) - count({c})) / count(*)")} AS null_pct, """
            + ", ".join((r(x.format(c=c)) if num else "NULL::DOUBLE") + f" AS {n}" for x, n in zip(stat, names))
            + f" FROM {B} b")


SQL["dr_profile"] = unions([_profile_sql(c, t, n) for c, t, n in (
    ("o_custkey", "bigint", True), ("o_totalprice", "double", True), ("o_orderpriority", "string", False),
    ("o_orderstatus", "string", False), ("o_orderkey", "bigint", True), ("note", "string", False))])
QUERIES["dr_profile_categories"] = lambda s, d: rounded(dr.profile(_tables(s, d)[0])["categories"])
_cats = lambda t, cols: unions([
    f"""SELECT '{c}' AS "column", {c} AS value, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM {t} t
    WHERE {c} IS NOT NULL GROUP BY {c}""" for c in cols])
SQL["dr_profile_categories"] = f"""SELECT "column", value, {r("share")} AS share
    FROM ({_cats(B, ["o_orderpriority", "o_orderstatus", "note"])}) t"""

# DR-2
QUERIES["dr_schema"] = lambda s, d: dr.schema_changes(*reversed(_profiles(s, d)))
SQL["dr_schema"] = """SELECT * FROM (VALUES ('note', 'removed', 'string', NULL), ('o_orderdate', 'added', NULL, 'timestamp_ntz'),
    ('o_orderkey', 'retyped', 'bigint', 'double')) t("column", change, was, now)"""

# DR-3
_findings = lambda f: rounded(f.select("check", "column", "severity", "actual_value"))


def _volume(s, d) -> DataFrame:
    base, now = _tables(s, d)
    return _findings(dr.volume_drift(s, now.count(), base.count()))


_band = lambda x, steps: "CASE " + " ".join(f"WHEN {x} > {b} THEN '{n}'" for b, n in steps) + " END"
_VOL, _SHIFT = dr.VOLUME_BANDS, dr.SHIFT_BANDS
QUERIES["dr_volume"] = _volume
SQL["dr_volume"] = f"""WITH x AS (SELECT ((SELECT count(*) FROM {N} n) - (SELECT count(*) FROM {B} b)) * 1.0
      / (SELECT count(*) FROM {B} b) AS v)
    SELECT 'volume_drift' AS "check", NULL::VARCHAR AS "column", {_band("abs(v)", _VOL)} AS severity, {r("v")} AS actual_value
    FROM x WHERE abs(v) > 0.10"""


# DR-4 to DR-6: every numeric column of both sides that kept its type
def _numeric(s, d, check) -> DataFrame:
    base, now = _profiles(s, d)
    return _findings(dr.numeric_drift(dr.numeric_shifts(now, base, ["o_orderkey"])).filter(F.col("check") == check))


def _shift_sql(check, f) -> str:
    return unions([f"""SELECT * FROM (SELECT '{check}' AS "check", '{c}' AS "column", {_band("abs(v)", _SHIFT)} AS severity,
      {r("v")} AS actual_value FROM (SELECT ((SELECT {f}({c}) FROM {N} n) - (SELECT {f}({c}) FROM {B} b))
      / (SELECT {f}({c}) FROM {B} b) AS v) x) y WHERE severity IS NOT NULL""" for c in ("o_custkey", "o_totalprice")])


QUERIES["dr_mean"] = lambda s, d: _numeric(s, d, "mean_shift")
SQL["dr_mean"] = _shift_sql("mean_shift", "avg")
QUERIES["dr_median"] = lambda s, d: _numeric(s, d, "median_shift")
SQL["dr_median"] = _shift_sql("median_shift", "median")
QUERIES["dr_variance"] = lambda s, d: _numeric(s, d, "variance_shift")
SQL["dr_variance"] = unions([f"""SELECT * FROM (SELECT 'variance_shift' AS "check", '{c}' AS "column", CASE WHEN v > 2 OR v < 0.5
    THEN 'high' WHEN v > 1.5 OR v < 0.67 THEN 'medium' END AS severity, {r("v")} AS actual_value
    FROM (SELECT (SELECT stddev_samp({c}) FROM {N} n) / (SELECT stddev_samp({c}) FROM {B} b) AS v) x) y
    WHERE severity IS NOT NULL""" for c in ("o_custkey", "o_totalprice")])

# DR-7 to DR-9
_TEXT = ["o_orderpriority", "o_orderstatus"]


def _shares(s, d) -> DataFrame:
    base, now = _profiles(s, d)
    return dr.category_shares(now, base, _TEXT)


_SHARES = f"""SELECT coalesce(b."column", n."column") AS "column", coalesce(b.value, n.value) AS value,
    coalesce(b.share, 0) AS base_share, coalesce(n.share, 0) AS current_share FROM ({_cats(B, _TEXT)}) b
    FULL OUTER JOIN ({_cats(N, _TEXT)}) n ON b."column" = n."column" AND b.value = n.value"""
QUERIES["dr_psi"] = lambda s, d: rounded(dr.psi(_shares(s, d)))
SQL["dr_psi"] = f"""SELECT "column", {r("sum((c - b) * ln(c / b))")} AS psi FROM (SELECT "column",
    CASE WHEN base_share > 0 THEN base_share ELSE 0.0001 END AS b,
    CASE WHEN current_share > 0 THEN current_share ELSE 0.0001 END AS c FROM ({_SHARES}) s) t GROUP BY 1"""
QUERIES["dr_new_cat"] = lambda s, d: rounded(dr.new_categories(_shares(s, d)))
SQL["dr_new_cat"] = f"""SELECT "column", value, {r("current_share")} AS share FROM ({_SHARES}) s WHERE base_share = 0"""
QUERIES["dr_missing_cat"] = lambda s, d: rounded(dr.missing_categories(_shares(s, d)))
SQL["dr_missing_cat"] = f"""SELECT "column", value, {r("base_share")} AS share FROM ({_SHARES}) s WHERE current_share = 0"""


# DR-12, DR-10, DR-13
def _report(s, d) -> dict:
    base, now = _profiles(s, d)
    return dr.compare(now, base)


_ALL = unions([
    """SELECT 'schema_drift' AS "check", NULL::VARCHAR AS "column", 'high' AS severity, 3.0::DOUBLE AS actual_value""",
    *[f"SELECT * FROM ({SQL[k]}) t" for k in ("dr_volume", "dr_mean", "dr_median", "dr_variance")],
    f"""SELECT 'categorical_psi', "column", CASE WHEN psi > 0.25 THEN 'high' ELSE 'medium' END, psi FROM ({SQL["dr_psi"]}) t
    WHERE psi >= 0.10""",
    f"""SELECT 'missing_category', "column", 'high', share FROM ({SQL["dr_missing_cat"]}) t WHERE share > 0.10""",
    f"""SELECT 'new_category', "column", 'medium', share FROM ({SQL["dr_new_cat"]}) t WHERE share > 0.05"""])
QUERIES["dr_findings"] = lambda s, d: _findings(_report(s, d)["findings"])
SQL["dr_findings"] = _ALL
QUERIES["dr_rollup"] = lambda s, d: _report(s, d)["summary"].select(
    "overall_severity", "findings", "high", "medium", "low", F.size("recommendations").alias("advice"))
SQL["dr_rollup"] = f"""WITH f AS ({_ALL}) SELECT CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END)
    WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS overall_severity, count(*) AS findings,
    {big("sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END)")} AS high,
    {big("sum(CASE WHEN severity = 'medium' THEN 1 ELSE 0 END)")} AS medium,
    {big("sum(CASE WHEN severity = 'low' THEN 1 ELSE 0 END)")} AS low,
    CAST(sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS INTEGER) AS advice FROM f"""
_LIMITS = {"o_totalprice": 0.2, "o_custkey": 0.2}
_alert = lambda a: rounded(a.select("rule_type", "column", "threshold", "actual_value", "severity", "dataset"))
QUERIES["dr_alerts"] = lambda s, d: _alert(dr.alerts(_report(s, d)["findings"], _LIMITS, "orders"))
SQL["dr_alerts"] = f"""SELECT 'mean_shift' AS rule_type, "column", 0.2::DOUBLE AS threshold, actual_value, severity,
    'orders' AS dataset FROM ({SQL["dr_mean"]}) t WHERE abs(actual_value) > 0.2"""


# DR-11, DR-14, SNK-3: a baseline on disk
def _store(s) -> BaselineStore:
    return BaselineStore(s, f"{shared_dir(s)}/baselines-{uuid.uuid4().hex}")


def _monitored(s, d) -> DataFrame:
    base, now = _tables(s, d)
    store = _store(s)
    dr.run(base, store, "orders")
    return _alert(dr.monitor(now, store, "orders", _LIMITS))


QUERIES["dr_monitor"] = _monitored
SQL["dr_monitor"] = SQL["dr_alerts"]


def _rotation(s, d) -> DataFrame:
    """Counter and baseline size after the first run, four clean runs and a drifted one."""
    base, now = _tables(s, d)
    store, out = _store(s), []
    for step, df in enumerate([base, base, base, base, base, now]):
        dr.run(df, store, "orders")
        b = store.load("orders")
        out.append((step, b["clean_runs"], b["version"], b["rows"]))
    return s.createDataFrame(out, "step int, clean_runs int, version long, baseline_rows long")


QUERIES["dr_rotation"] = _rotation
SQL["dr_rotation"] = f"""SELECT step, clean_runs, version, n AS baseline_rows FROM (VALUES (0, 0, 0::BIGINT), (1, 1, 1), (2, 2, 2),
    (3, 3, 3), (4, 0, 4), (5, 0, 5)) t(step, clean_runs, version), (SELECT count(*) AS n FROM {B} b) c"""


# Distances of whole distributions: every numeric column of both sides
_NUM = ["o_custkey", "o_totalprice", "o_orderkey"]
_NORMAL = lambda z: f"""(1 - sqrt(2 / pi()) * abs({z}) / 3000 * list_sum(list_transform(range(0, 1001),
    lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(abs({z}) * i / 1000, 2) / 2))))"""


def _ks(s, d) -> DataFrame:
    base, now = _tables(s, d)
    return rounded(di.ks(di.value_table(now, _NUM), di.value_table(base, _NUM), ranges=6))


QUERIES["dr_ks"] = _ks
SQL["dr_ks"] = unions([f"""SELECT '{c}' AS "column", n_base, n_current, {r("d")} AS distance, "at", {r("""CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1,
      2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * x * x))))) END""")} AS p_value
    FROM (SELECT n_base, n_current, max(gap) AS d, arg_min(v, (-gap, v)) AS "at", max(gap) * sqrt(n_base * 1.0 * n_current / (n_base + n_current)) AS x FROM (
      SELECT v, (SELECT count({c}) FROM {B} b) AS n_base, (SELECT count({c}) FROM {N} n) AS n_current,
        abs(sum(sum(b)) OVER (ORDER BY v)::DOUBLE / (SELECT count({c}) FROM {B} b) - sum(sum(1 - b)) OVER (ORDER BY v)::DOUBLE / (SELECT count({c}) FROM {N} n)) AS gap
      FROM (SELECT {c}::DOUBLE AS v, 1 AS b FROM {B} b UNION ALL SELECT {c}::DOUBLE, 0 FROM {N} n) u WHERE v IS NOT NULL GROUP BY v) g
      GROUP BY n_base, n_current) t""" for c in _NUM])


def _stored(s, d, name: str) -> DataFrame:
    """A table the baseline keeps, written and read back."""
    store = BaselineStore(s, f"{shared_dir(s)}/baseline-{uuid.uuid4().hex}")
    base = _tables(s, d)[0]
    store.save("orders", dr.profile(base), extra=di.measure(base, _NUM))
    return store.extra("orders", name)


# Bins are the baseline's: its own quantiles, open at both ends
QUERIES["dr_binned_psi"] = lambda s, d: rounded(di.binned_psi(_tables(s, d)[1], _stored(s, d, "bins")))
_BINNED = lambda c, t: f"""(SELECT bin, count(*) / (SELECT count({c}) FROM {t} t)::DOUBLE AS share FROM (
      SELECT len(list_filter(e, lambda x: {c}::DOUBLE > x)) AS bin FROM {t} t, edges WHERE {c} IS NOT NULL) z GROUP BY bin)"""
SQL["dr_binned_psi"] = unions([f"""SELECT '{c}' AS "column", {r("sum((c - b) * ln(c / b))")} AS psi FROM (
    WITH edges AS (SELECT list_sort(list_distinct([{", ".join(f"quantile_cont({c}::DOUBLE, {i / 10})" for i in range(1, 10))}])) AS e FROM {B} b)
    SELECT CASE WHEN coalesce(b.share, 0) > 0 THEN b.share ELSE 0.0001 END AS b, CASE WHEN coalesce(n.share, 0) > 0 THEN n.share ELSE 0.0001 END AS c
    FROM range(10) g(bin) JOIN edges ON g.bin <= len(e) LEFT JOIN {_BINNED(c, B)} b USING (bin) LEFT JOIN {_BINNED(c, N)} n USING (bin)) t""" for c in _NUM])


# Correlations of a later part whose one pair is tied together, against the stored co-moments
def _tied(s, d) -> DataFrame:
    now = _tables(s, d)[1]
    return now.withColumn("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 100).otherwise(F.col("o_custkey").cast("double")))


QUERIES["dr_correlation"] = lambda s, d: rounded(di.correlation_drift(di.co_moments(_tied(s, d), _NUM), _stored(s, d, "moments")))
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1:]]
_TIED = f"""(SELECT * REPLACE (CASE WHEN o_orderkey::BIGINT % 2 = 0 THEN o_totalprice / 100 ELSE o_custkey::DOUBLE END AS o_custkey) FROM {N} n)"""
SQL["dr_correlation"] = unions([f"""SELECT a, b, {r("rb")} AS r_base, {r("rc")} AS r_current, nb AS n_base, nc AS n_current, {r("z")} AS z, {r(_NORMAL("z"))} AS p_value
    FROM (SELECT *, (atanh(rc) - atanh(rb)) / sqrt(1.0 / (nb - 3) + 1.0 / (nc - 3)) AS z FROM (SELECT '{x}' AS a, '{y}' AS b,
      (SELECT corr({x}, {y}) FROM {B} b) AS rb, (SELECT corr({x}, {y}) FROM {_TIED} n) AS rc,
      (SELECT count(*) FROM {B} b WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS nb,
      (SELECT count(*) FROM {_TIED} n WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS nc) t) u""" for x, y in _PAIRS])


def _merged(s, d) -> DataFrame:
    """Co-moments of three parts of the line items, merged."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    m = di.merge_moments(*[di.co_moments(li.filter(F.col("l_orderkey") % 3 == k).drop("l_orderkey")) for k in range(3)])
    share = lambda c: F.col(c) / F.col("n")
    return rounded(m.select("a", "b", "n", "mean_a", "mean_b", share("s_aa").alias("var_a"), share("s_bb").alias("var_b"), share("s_ab").alias("cov")), 4)


QUERIES["dr_moments"] = _merged
SQL["dr_moments"] = unions([f"""SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f"avg({a})", 4)} AS mean_a, {r(f"avg({b})", 4)} AS mean_b,
    {r(f"var_pop({a})", 4)} AS var_a, {r(f"var_pop({b})", 4)} AS var_b, {r(f"covar_pop({a}, {b})", 4)} AS cov FROM lineitem"""
    for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))])
