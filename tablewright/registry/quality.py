"""Queries over the data-quality operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import sketches as sk
from ..functions.columns import col
from ..functions.stage import shared_dir
from ..operators import quality as q
from .common import big, dirty, joined, r, rounded, table, unions, view

QUERIES, SQL = {}, {}


def _flat(d: DataFrame) -> DataFrame:
    return rounded(joined(d, "columns").select("defect_type", "columns", "severity", "count", "percentage"))


def _defect(kind, column, severity, count, pct, source, having) -> str:
    return (f"SELECT '{kind}' AS defect_type, '{column}' AS columns, {severity} AS severity, {big(count)} AS count, "
            f"{r(pct)} AS percentage FROM {source} HAVING {having}")


def _ladder(pct: str, steps) -> str:
    return "CASE " + " ".join(f"WHEN {pct} >= {b} THEN '{s}'" for b, s in steps) + " END"


NULL_STEPS = [(50, "critical"), (20, "high"), (5, "medium"), (0, "low")]
DUP_STEPS = [(80, "critical"), (20, "high"), (5, "medium"), (0, "low")]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _share(count: str) -> str:
    return f"({count}) * 100.0 / count(*)"


def _null_sql(columns, source) -> str:
    parts = []
    for c in columns:
        n = f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
        parts.append(_defect("null_values", c, _ladder(_share(n), NULL_STEPS), n, _share(n), source, f"{n} > 0"))
    return unions(parts)


QUERIES["dq_null_values"] = lambda s, d: _flat(q.null_values(q.moment_facts(dirty(s, d, "orders"))))
SQL["dq_null_values"] = _null_sql(ORDER_COLUMNS, view("orders"))

QUERIES["dq_preflight"] = lambda s, d: _preflight(table(s, d, "orders"))
SQL["dq_preflight"] = "SELECT CAST(count(*) AS BIGINT) AS total_rows, 6 AS total_columns FROM orders"


def _preflight(df: DataFrame) -> DataFrame:
    q.require_rows(df)
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.lit(len(df.columns)).alias("total_columns"))


# DQ-1, text cells classed by their spelling and JSON cells by their type
def _mixed(df: DataFrame, lexical: bool) -> DataFrame:
    facts = q.moment_facts(df).join(q.type_facts(df, lexical), "column")
    return _flat(q.mixed_types(facts))


def _json_cells(s, d) -> DataFrame:
    e = table(s, d, "events")
    cell = F.when(F.col("event_id") % 10 == 0, F.lit('"n/a"')).when(F.col("event_id") % 7 == 0, F.lit("true")).otherwise(
        F.col("value").cast("string"))
    return e.select("event_id", F.parse_json(cell).alias("cell"))


QUERIES["dq_mixed_types"] = lambda s, d: _mixed(dirty(s, d, "customer").select("c_custkey", "c_code"), True)
_n = "sum(CASE WHEN try_cast(trim(c_code) AS BIGINT) IS NULL THEN 1 ELSE 0 END)"
SQL["dq_mixed_types"] = _defect("mixed_types", "c_code", _ladder(_share(_n), [(20, "high"), (0, "medium")]), _n,
                                _share(_n), view("customer"), f"{_n} > 0")

QUERIES["dq_mixed_json"] = lambda s, d: _mixed(_json_cells(s, d), False)
_n = "sum(CASE WHEN event_id % 10 = 0 OR event_id % 7 = 0 THEN 1 ELSE 0 END)"
SQL["dq_mixed_json"] = _defect("mixed_types", "cell", _ladder(_share(_n), [(20, "high"), (0, "medium")]), _n,
                               _share(_n), "events", f"{_n} > 0")

QUERIES["dq_cell_types"] = lambda s, d: q.type_counts(_json_cells(s, d))
SQL["dq_cell_types"] = """SELECT 'cell' AS "column", CASE WHEN event_id % 10 = 0 THEN 'str' WHEN event_id % 7 = 0
    THEN 'bool' ELSE 'float' END AS cell_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 2"""

# DQ-2
QUERIES["dq_column_naming"] = lambda s, d: _flat(q.column_naming(q.moment_facts(
    table(s, d, "customer").toDF("c_custkey", "name#1", "2024", "acct bal", " "))))
SQL["dq_column_naming"] = unions([
    f"SELECT 'column_naming' AS defect_type, '{c}' AS columns, 'medium' AS severity, {big('count(*)')} AS count, "
    f"100.0::DOUBLE AS percentage FROM customer" for c in ("name#1", "2024", " ")])

# DQ-4, DQ-7, DQ-8, DQ-9 on the dirty line items
QUERIES["dq_negative"] = lambda s, d: _flat(q.negative_values(q.moment_facts(dirty(s, d, "lineitem"))))
_n = "sum(CASE WHEN l_quantity < 0 THEN 1 ELSE 0 END)"
SQL["dq_negative"] = _defect("negative_values", "l_quantity", "'high'", _n, _share(_n), view("lineitem"), f"{_n} > 0")

QUERIES["dq_zero_variance"] = lambda s, d: _flat(q.zero_variance(q.moment_facts(dirty(s, d, "lineitem"))))
SQL["dq_zero_variance"] = _defect("zero_variance", "l_const", "'high'", "count(l_const)", "100", view("lineitem"),
                                  "min(l_const) = max(l_const)")


def _outliers(df: DataFrame) -> DataFrame:
    facts = q.pin(q.moment_facts(df))
    return _flat(q.extreme_outliers(facts.join(q.outlier_facts(df, facts.collect(), q.OUTLIER_SIGMA), "column")))


QUERIES["dq_outliers_5s"] = lambda s, d: _outliers(dirty(s, d, "lineitem"))
SQL["dq_outliers_5s"] = unions([f"""SELECT * FROM (WITH v AS {view("lineitem")},
    m AS (SELECT avg(CAST({c} AS DOUBLE)) AS a, stddev_samp(CAST({c} AS DOUBLE)) AS sd FROM v)
    SELECT 'extreme_outliers' AS defect_type, '{c}' AS columns, 'medium' AS severity,
      CAST(sum(CASE WHEN abs({c} - a) > 5 * sd THEN 1 ELSE 0 END) AS BIGINT) AS count,
      {r(f"sum(CASE WHEN abs({c} - a) > 5 * sd THEN 1 ELSE 0 END) * 100.0 / count(*)")} AS percentage FROM v, m) t
    WHERE count > 0""" for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_price",
                                 "l_net", "l_gross", "l_const", "l_discount"]])

QUERIES["dq_infinite"] = lambda s, d: _flat(q.infinite_values(q.moment_facts(dirty(s, d, "lineitem"))))
_n = "sum(CASE WHEN isinf(l_tax) THEN 1 ELSE 0 END)"
SQL["dq_infinite"] = _defect("infinite_values", "l_tax", "'high'", _n, _share(_n), view("lineitem"), f"{_n} > 0")

# DQ-5, DQ-10, DQ-11 from distinct counts
_facts = lambda df: q.moment_facts(df).join(q.distinct_facts(df), "column")
QUERIES["dq_case"] = lambda s, d: _flat(q.case_inconsistency(_facts(dirty(s, d, "customer"))))
_n = "count(DISTINCT c_mktsegment) - count(DISTINCT lower(c_mktsegment))"
SQL["dq_case"] = _defect("case_inconsistency", "c_mktsegment", "'low'", _n, _share(_n), view("customer"), f"{_n} > 0")

_keys = lambda s, d: table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key_text"), "c_name")
QUERIES["dq_cardinality"] = lambda s, d: _flat(q.extreme_cardinality(_facts(_keys(s, d))))
_u = "SELECT 'extreme_cardinality' AS defect_type, '{a}' AS columns, 'medium' AS severity, count({b}) AS count, " \
     "100.0::DOUBLE AS percentage FROM customer HAVING count(DISTINCT {b}) = count({b})"
SQL["dq_cardinality"] = _u.format(a="key_text", b="c_custkey")
QUERIES["dq_cardinality_all_text"] = lambda s, d: _flat(q.extreme_cardinality(_facts(_keys(s, d)), strict=False))
SQL["dq_cardinality_all_text"] = unions([_u.format(a="key_text", b="c_custkey"), _u.format(a="c_name", b="c_name")])

QUERIES["dq_non_unique_id"] = lambda s, d: _flat(q.non_unique_id(_facts(table(s, d, "events")).unionByName(
    _facts(table(s, d, "labels")))))
SQL["dq_non_unique_id"] = unions([
    _defect("non_unique_id", c, "'high'", f"count({c}) - count(DISTINCT {c})",
            _share(f"count({c}) - count(DISTINCT {c})"), t, f"count({c}) > count(DISTINCT {c})")
    for t, c in (("events", "event_id"), ("events", "user_id"), ("labels", "doc_id"))])

# DQ-6
QUERIES["dq_duplicates"] = lambda s, d: _flat(q.duplicate_rows(
    q.duplicate_facts(dirty(s, d, "nation")), ["n_nationkey", "n_name", "n_regionkey"]))
SQL["dq_duplicates"] = f"""WITH g AS (SELECT count(*) AS n FROM {view("nation")} v GROUP BY n_nationkey, n_name, n_regionkey),
    t AS (SELECT sum(n) AS total, sum(n) - count(*) AS copies FROM g)
    SELECT 'duplicate_rows' AS defect_type, 'n_nationkey,n_name,n_regionkey' AS columns,
      {_ladder("copies * 100.0 / total", DUP_STEPS)} AS severity, {big("copies")} AS count,
      {r("copies * 100.0 / total")} AS percentage FROM t WHERE copies > 0"""
QUERIES["dq_duplicate_documents"] = lambda s, d: _flat(q.duplicate_rows(
    q.duplicate_facts(table(s, d, "documents").drop("doc_id")), ["text", "lang", "source", "n_chars"]))
SQL["dq_duplicate_documents"] = f"""WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars),
    t AS (SELECT sum(n) AS total, sum(n) - count(*) AS copies FROM g)
    SELECT 'duplicate_rows' AS defect_type, 'text,lang,source,n_chars' AS columns,
      {_ladder("copies * 100.0 / total", DUP_STEPS)} AS severity, {big("copies")} AS count,
      {r("copies * 100.0 / total")} AS percentage FROM t WHERE copies > 0"""

# DQ-12
_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_price", "l_net", "l_gross",
         "l_discount"]
QUERIES["dq_redundant_pairs"] = lambda s, d: _flat(q.duplicate_measurement(
    q.pair_correlations(dirty(s, d, "lineitem")), F.col("n")))
SQL["dq_redundant_pairs"] = unions([
    _defect("duplicate_measurement", f"{a},{b}", "'low'", "count(*)", "100", view("lineitem"),
            f"abs(corr({a}, {b})) > 0.99") for i, a in enumerate(_LINE) for b in _LINE[i + 1:]])

# DQ-13
QUERIES["dq_profiles"] = lambda s, d: rounded(q.column_profiles(_facts(dirty(s, d, "orders"))).drop("position", "dtype"))
SQL["dq_profiles"] = unions([
    f"""SELECT '{c}' AS column_name, {big(f"count(*) - count({c})")} AS null_count,
    {r(f"(count(*) - count({c})) * 100.0 / count(*)")} AS null_pct, count(DISTINCT {c}) AS unique_count,
    {r(f"count(DISTINCT {c}) * 100.0 / count(*)")} AS unique_pct, false AS has_mixed_types,
    """ + (f"{r(f'min({c})')} AS min_val, {r(f'max({c})')} AS max_val, {r(f'avg({c})')} AS mean_val, "
           f"{r(f'stddev_samp({c})')} AS std_val" if c in ("o_orderkey", "o_custkey", "o_totalprice") else
           "NULL::DOUBLE AS min_val, NULL::DOUBLE AS max_val, NULL::DOUBLE AS mean_val, NULL::DOUBLE AS std_val")
    + f" FROM {view('orders')}" for c in ORDER_COLUMNS])

# DQ-14 and DQ-15: every check over the dirty orders
QUERIES["dq_score"] = lambda s, d: q.assess(dirty(s, d, "orders"))["summary"]
SQL["dq_score"] = f"""WITH f AS ({_null_sql(ORDER_COLUMNS, view("orders"))}),
    w AS (SELECT *, CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 15 WHEN 'medium' THEN 5 ELSE 2 END AS weight,
      CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS rank FROM f)
    SELECT arg_max(severity, rank) AS overall_severity, max(rank) = 3 AS has_critical_issues,
      'Critical findings: ' || string_agg(CASE WHEN rank = 3 THEN
        printf('%.1f%% of ''%s'' is null', percentage, columns) END, '; ') AS halt_reason,
      greatest(0.0::DOUBLE, (100 - sum(weight))::DOUBLE) AS quality_score, count(*) AS defect_count FROM w"""

QUERIES["dq_owner"] = lambda s, d: joined(q.assess(dirty(s, d, "customer"))["defects"], "columns").select(
    "defect_type", "columns", "severity", "remediation_class")
SQL["dq_owner"] = f"""SELECT 'case_inconsistency' AS defect_type, 'c_mktsegment' AS columns, 'low' AS severity,
    'agent_autonomous' AS remediation_class FROM {view("customer")}
    HAVING count(DISTINCT c_mktsegment) > count(DISTINCT lower(c_mktsegment))"""

QUERIES["dq_assess_lineitem"] = lambda s, d: _flat(q.assess(dirty(s, d, "lineitem"))["defects"])
SQL["dq_assess_lineitem"] = "SELECT * FROM (" + unions([
    "SELECT * FROM (" + SQL[k] + ")" for k in ("dq_negative", "dq_zero_variance", "dq_outliers_5s", "dq_infinite",
                                              "dq_redundant_pairs")]) + ")"

# DQ-16 and DQ-17
QUERIES["profile_legacy"] = lambda s, d: rounded(joined(q.table_profile(dirty(s, d, "orders")),
                                                        "numeric_columns", "categorical_columns", "datetime_columns"))


def _outside(c: str) -> str:
    return (f"(SELECT count(*) FROM v, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM v) q "
            f"WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))")


_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
_PROFILE = f"""WITH v AS {view("orders")}, b AS (SELECT count(*) AS n,
      {" + ".join(f"(count(*) - count({c}))" for c in ORDER_COLUMNS)} AS missing,
      {" + ".join(f"count({c})" for c in _NUM)} AS present FROM v),
    x AS (SELECT {" + ".join(_outside(c) for c in _NUM)} AS outside),
    g AS (SELECT sum(k) - count(*) AS copies FROM (SELECT count(*) AS k FROM v GROUP BY ALL) t),
    p AS (SELECT n, missing * 100.0 / (n * 6) AS missing_pct, outside * 100.0 / greatest(present, 1) AS outlier_pct,
      copies FROM b, x, g)"""
_PROFILE = _PROFILE.replace("GROUP BY ALL", "GROUP BY " + ", ".join(ORDER_COLUMNS))
SQL["profile_legacy"] = _PROFILE + f"""
    SELECT n AS rows, 6 AS columns, {r("missing_pct")} AS missing_pct, 'o_orderkey,o_custkey,o_totalprice' AS numeric_columns,
      'o_orderstatus,o_orderpriority' AS categorical_columns, '' AS datetime_columns, {r("outlier_pct")} AS outlier_pct,
      {big("copies")} AS duplicates, {r("greatest(0, 100 - missing_pct - outlier_pct * 0.5 - copies * 20.0 / n)")}
      AS quality_score FROM p"""
QUERIES["recommend_cleaning"] = lambda s, d: joined(
    q.recommend_cleaning(q.table_profile(dirty(s, d, "orders"))), "reasons").select("method", "confidence", "reasons")
SQL["recommend_cleaning"] = _PROFILE + """, s AS (SELECT *, 100 - missing_pct - outlier_pct * 0.5 - copies * 20.0 / n AS score FROM p)
    SELECT CASE WHEN missing_pct > 30 THEN 'ml_based' WHEN outlier_pct > 20 THEN 'statistical' WHEN score < 60 THEN
      'domain_specific' ELSE 'basic' END AS method,
      CASE WHEN missing_pct > 30 THEN 0.9::DOUBLE WHEN outlier_pct > 20 THEN 0.8::DOUBLE WHEN score < 60 THEN 0.85::DOUBLE
      ELSE 0.7::DOUBLE END AS confidence,
      CASE WHEN missing_pct > 30 THEN printf('High missing data percentage (%.1f%%)', missing_pct) ||
        ',ML-based imputation recommended for complex patterns'
      WHEN outlier_pct > 20 THEN printf('High outlier percentage (%.1f%%)', outlier_pct) ||
        ',Statistical methods best for outlier handling'
      WHEN score < 60 THEN 'Domain-specific cleaning needed'
      ELSE 'Data quality is acceptable for basic cleaning' END AS reasons FROM s"""


# Sketches of six parts, merged: exact facts as they are, sketched ones as whether they are within the stated error
def _sketched(s, d) -> DataFrame:
    root = f"{shared_dir(s)}/sketches-{uuid.uuid4().hex}"
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("o_part"))
    store = sk.SketchStore(s, root)
    for part in range(6):
        store.add(str(part), o.filter(F.col("o_orderkey") % 6 == part))
    found = sk.profile(store.read())
    names = o.columns
    # the rank that the sketched quantiles have in the table itself, and the distinct counts
    row = {r["column"]: r for r in found.collect()}
    real = o.agg(*[F.count_distinct(col(c)).alias(f"d_{c}") for c in names], *[
        (F.count_if(col(c) <= row[c][q]) / F.count(col(c))).alias(f"{q}_{c}") for c in names if row[c]["q25"] is not None for q in ("q25", "q50", "q75")]).first().asDict()
    near = [(c, all(abs(real[f"{q}_{c}"] - p) <= sk.RANK_ERROR for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)) if row[c][q] is not None),
             abs(row[c]["distinct"] - real[f"d_{c}"]) <= sk.DISTINCT_ERROR * real[f"d_{c}"]) for c in names]
    ok = s.createDataFrame(near, "_c string, quantiles_near boolean, distinct_near boolean")
    return rounded(found.join(F.broadcast(ok), F.col("column") == F.col("_c")).select(
        "column", "dtype", "rows", "n", "nulls", "lo", "hi", "mean", "std", "quantiles_near", "distinct_near"), 4)


QUERIES["dq_sketches"] = _sketched
SQL["dq_sketches"] = unions([f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS rows, count(x) AS n, count(*) - count(x) AS nulls, """ + (
    ", ".join(f"{r(f'{f}(x)', 4)} AS {n}" for f, n in (("min", "lo"), ("max", "hi"), ("avg", "mean"), ("stddev_samp", "std"))) if t != "string"
    else ", ".join(f"NULL::DOUBLE AS {n}" for n in ("lo", "hi", "mean", "std"))) + f""", true AS quantiles_near, true AS distinct_near
    FROM (SELECT {e} AS x FROM orders) t""" for c, t, e in (
        ("o_orderkey", "bigint", "o_orderkey"), ("o_custkey", "bigint", "o_custkey"), ("o_totalprice", "double", "o_totalprice"),
        ("o_orderpriority", "string", "o_orderpriority"), ("o_part", "double", "CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END"))])
