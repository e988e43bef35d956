"""Queries over the cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import chunks
from ..operators import cleaning as c, forest, neighbours, quality as q
from .common import big, dirty, joined, r, rounded, table, unions, view

QUERIES, SQL = {}, {}
CUSTOMER, EVENTS, LINE, NATION, ORDERS = (view(n) for n in ("customer", "events", "lineitem", "nation", "orders"))

# CL-1
QUERIES["cl_strip"] = lambda s, d: c.strip_whitespace(dirty(s, d, "customer"), ["c_name", "c_code"])
SQL["cl_strip"] = f"""SELECT c_custkey, trim(c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment,
    trim(c_code) AS c_code FROM {CUSTOMER}"""
QUERIES["cl_strip_changes"] = lambda s, d: c.strip_changes(dirty(s, d, "customer"))
SQL["cl_strip_changes"] = unions([
    f"""SELECT '{n}' AS "column", {big(f"sum(CASE WHEN trim({n}) <> {n} THEN 1 ELSE 0 END)")} AS values_changed
    FROM {CUSTOMER}""" for n in ("c_name", "c_mktsegment", "c_code")])

# CL-2 and CL-3
QUERIES["cl_dominant_type"] = lambda s, d: q.type_facts(dirty(s, d, "customer").select("c_code", "c_name"), lexical=True)
SQL["cl_dominant_type"] = f"""WITH k AS (SELECT CASE WHEN try_cast(trim(c_code) AS BIGINT) IS NULL THEN 'str' ELSE 'int' END AS t,
      count(*) AS n FROM {CUSTOMER} GROUP BY 1)
    SELECT 'c_code' AS "column", (SELECT t FROM k ORDER BY n DESC, t LIMIT 1) AS dominant, count(*) AS types,
      {big("sum(n) - max(n)")} AS mixed FROM k
    UNION ALL SELECT 'c_name', 'str', 1, 0"""
QUERIES["cl_coerce"] = lambda s, d: c.coerce_column(dirty(s, d, "customer").select("c_custkey", "c_code"), "c_code")[0]
SQL["cl_coerce"] = f"""SELECT c_custkey, trim(c_code) AS c_code, try_cast(trim(c_code) AS DOUBLE) AS c_code_value
    FROM {CUSTOMER}"""
QUERIES["cl_coerce_meta"] = lambda s, d: c.coerce_column(dirty(s, d, "customer"), "c_code")[1]
SQL["cl_coerce_meta"] = f"""SELECT 'c_code' AS "column", 'numeric' AS kind, 'int' AS dominant_type,
    {big("sum(CASE WHEN trim(c_code) <> c_code THEN 1 ELSE 0 END)")} AS values_changed,
    {big("sum(CASE WHEN try_cast(trim(c_code) AS DOUBLE) IS NULL THEN 1 ELSE 0 END)")} AS uncoerced FROM {CUSTOMER}"""


def _json_cells(s, d) -> DataFrame:
    e = table(s, d, "events")
    cell = F.when(F.col("event_id") % 10 == 0, F.lit('" 7 "')).when(F.col("event_id") % 11 == 0, F.lit('" n/a"')).otherwise(
        F.col("value").cast("string"))
    return e.select("event_id", F.parse_json(cell).alias("cell"))


def _coerced_json(s, d) -> DataFrame:
    out, _ = c.coerce_column(_json_cells(s, d), "cell")
    cls = q.cell_class(F.col("cell"), out.schema["cell"].dataType)
    return out.select("event_id", cls.alias("cell_type"), F.col("cell").cast("string").try_cast("double").alias("number"))


QUERIES["cl_coerce_json"] = lambda s, d: rounded(_coerced_json(s, d))
SQL["cl_coerce_json"] = """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'float' WHEN event_id % 11 = 0 THEN 'str'
    ELSE 'float' END AS cell_type, ROUND(CASE WHEN event_id % 10 = 0 THEN 7.0::DOUBLE WHEN event_id % 11 = 0 THEN NULL
    ELSE value END, 6) AS number FROM events"""

# CL-4
_MAP = f"""SELECT variant, canonical, n FROM (SELECT c_mktsegment AS variant, count(*) AS n, first(c_mktsegment) OVER (
      PARTITION BY lower(c_mktsegment) ORDER BY count(*) DESC, c_mktsegment) AS canonical FROM {CUSTOMER} v
      GROUP BY c_mktsegment) t"""
QUERIES["cl_case_mapping"] = lambda s, d: c.case_mapping(dirty(s, d, "customer"), "c_mktsegment")
SQL["cl_case_mapping"] = _MAP + " WHERE variant <> canonical"
QUERIES["cl_case"] = lambda s, d: c.normalize_case(dirty(s, d, "customer"), "c_mktsegment").select(
    "c_custkey", "c_mktsegment")
SQL["cl_case"] = f"SELECT c_custkey, canonical AS c_mktsegment FROM {CUSTOMER} v JOIN ({_MAP}) m ON v.c_mktsegment = m.variant"

# CL-5
QUERIES["cl_dedup"] = lambda s, d: c.drop_exact_duplicates(dirty(s, d, "nation"))
SQL["cl_dedup"] = f"SELECT DISTINCT * FROM {NATION} v"


def _first_copies(s, d) -> DataFrame:
    docs = table(s, d, "documents")
    kept = c.drop_exact_duplicates(c.with_position(docs, "doc_id").drop("doc_id"), keep_position=True)
    return kept.select(F.col(c.POS).alias("first_doc"), "lang", "source", "n_chars")


QUERIES["cl_dedup_first"] = _first_copies
SQL["cl_dedup_first"] = """SELECT min(doc_id) AS first_doc, lang, source, n_chars FROM documents
    GROUP BY text, lang, source, n_chars"""

# CL-6
QUERIES["cl_headers"] = lambda s, d: c.normalize_headers(
    table(s, d, "customer").toDF("Cust Key", "Name ($)", "2024", "name", "MktSegment!"))
SQL["cl_headers"] = """SELECT c_custkey AS cust_key, c_name AS name, c_nationkey AS column_2, c_acctbal AS name_2,
    c_mktsegment AS mktsegment FROM customer"""
QUERIES["cl_headers_flagged"] = lambda s, d: c.normalize_headers(
    table(s, d, "nation").toDF("amount#", "amount", "Kept Name"), {"amount#"})
SQL["cl_headers_flagged"] = 'SELECT n_nationkey AS amount_2, n_name AS amount, n_regionkey AS "Kept Name" FROM nation'

# CL-7 to CL-10
for _m, _f in (("mean", "avg"), ("median", "median")):
    QUERIES[f"cl_{_m}"] = lambda s, d, m=_m: rounded(c.impute_nulls(dirty(s, d, "orders"), "o_totalprice", m).select(
        "o_orderkey", "o_totalprice"))
    SQL[f"cl_{_m}"] = f"""SELECT o_orderkey, {r(f"coalesce(o_totalprice, (SELECT {_f}(o_totalprice) FROM {ORDERS} w))")}
      AS o_totalprice FROM {ORDERS} v"""
QUERIES["cl_mode"] = lambda s, d: c.impute_nulls(dirty(s, d, "orders"), "o_orderpriority", "mode").select(
    "o_orderkey", "o_orderpriority")
SQL["cl_mode"] = f"""SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM {ORDERS} w WHERE
    o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM {ORDERS} v"""
QUERIES["cl_ffill"] = lambda s, d: c.impute_nulls(dirty(s, d, "events"), "value", "forward_fill", "event_id",
                                                  ("user_id",)).select("event_id", "user_id", "value")
SQL["cl_ffill"] = f"""SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id)
    AS value FROM {EVENTS} v"""
QUERIES["cl_ffill_global"] = lambda s, d: c.impute_nulls(dirty(s, d, "events"), "value", "forward_fill", "event_id").select(
    "event_id", "value")
SQL["cl_ffill_global"] = f"""SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id) AS value FROM {EVENTS} v"""

# the same over many chunks
QUERIES["cl_ffill_chunks"] = lambda s, d: chunks.forward_fill(dirty(s, d, "events").select("event_id", "user_id", "value"), ["value"], "event_id", ["user_id"], 700)
SQL["cl_ffill_chunks"] = SQL["cl_ffill"]
QUERIES["cl_ffill_global_chunks"] = lambda s, d: chunks.forward_fill(dirty(s, d, "events").select("event_id", "value"), ["value"], "event_id", chunk_rows=700)
SQL["cl_ffill_global_chunks"] = SQL["cl_ffill_global"]


# CL-11 to CL-13
def _cleaned(s, d) -> dict:
    df = dirty(s, d, "customer")
    return c.clean(df, q.assess(df, lexical=True)["defects"])


def _actions(s, d) -> DataFrame:
    a = _cleaned(s, d)["actions"]
    return joined(a.select("operation", "defect_type", "status", "scope", "target_columns", "rows_affected",
                           "values_changed", "rule"), "target_columns").drop("rule")


QUERIES["cl_actions"] = _actions
SQL["cl_actions"] = f"""SELECT 'type_coercion' AS operation, 'mixed_types' AS defect_type, 'applied' AS status, 'column' AS scope,
    'c_code' AS target_columns, 0::BIGINT AS rows_affected,
    {big("sum(CASE WHEN trim(c_code) <> c_code THEN 1 ELSE 0 END)")} AS values_changed FROM {CUSTOMER} v
    UNION ALL SELECT 'case_normalization', 'case_inconsistency', 'applied', 'column', 'c_mktsegment', 0,
      {big("sum(n)")} FROM ({_MAP}) m WHERE variant <> canonical"""
QUERIES["cl_clean_table"] = lambda s, d: _cleaned(s, d)["table"].select("c_custkey", "c_code", "c_code_value", "c_mktsegment")
SQL["cl_clean_table"] = f"""SELECT c_custkey, trim(c_code) AS c_code, try_cast(trim(c_code) AS DOUBLE) AS c_code_value,
    canonical AS c_mktsegment FROM {CUSTOMER} v JOIN ({_MAP}) m ON v.c_mktsegment = m.variant"""


def _summary(s, d) -> DataFrame:
    df = dirty(s, d, "nation").withColumnRenamed("n_name", "n name!")
    return c.clean(df, q.assess(df)["defects"])["summary"]


QUERIES["cl_summary"] = _summary
SQL["cl_summary"] = f"""SELECT 2 AS total_findings, 2 AS autonomous_findings, 2 AS actions, count(*) AS rows_before,
    count(DISTINCT n_nationkey) AS rows_after, 3 AS columns_before, 3 AS columns_after FROM {NATION} v"""

# CL-20, CL-21, CL-24, CL-25
QUERIES["cl_basic"] = lambda s, d: rounded(c.basic_clean(dirty(s, d, "orders")))
_mode = lambda n: f"(SELECT {n} FROM {ORDERS} w WHERE {n} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_med = lambda n: f"(SELECT median({n}) FROM {ORDERS} w)"
_BASIC = f"""SELECT DISTINCT {r(f"coalesce(o_orderkey, {_med('o_orderkey')})")} AS o_orderkey,
    {r(f"coalesce(o_custkey, {_med('o_custkey')})")} AS o_custkey,
    coalesce(o_orderstatus, {_mode("o_orderstatus")}) AS o_orderstatus,
    {r(f"coalesce(o_totalprice, {_med('o_totalprice')})")} AS o_totalprice, o_orderdate,
    coalesce(o_orderpriority, {_mode("o_orderpriority")}) AS o_orderpriority FROM {ORDERS} v"""
SQL["cl_basic"] = _BASIC
QUERIES["cl_auto"] = lambda s, d: rounded(c.auto_clean(dirty(s, d, "orders")))
SQL["cl_auto"] = _BASIC

_CLIP = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_price", "l_net", "l_gross", "l_tax",
         "l_const", "l_discount"]
QUERIES["cl_iqr_clip"] = lambda s, d: rounded(c.statistical_clean(dirty(s, d, "lineitem")), 2)
SQL["cl_iqr_clip"] = f"""WITH v AS (SELECT DISTINCT * FROM {LINE} t), q AS (SELECT """ + ", ".join(
    f"quantile_cont({n}, 0.25) AS {n}_1, quantile_cont({n}, 0.75) AS {n}_3, median({n}) AS {n}_2" for n in _CLIP) + """ FROM v)
    SELECT """ + ", ".join(
    r(f"greatest(least(coalesce({n}, {n}_2), {n}_3 + 1.5 * ({n}_3 - {n}_1)), {n}_1 - 1.5 * ({n}_3 - {n}_1))", 2) + f" AS {n}"
    for n in _CLIP) + ", l_returnflag, l_shipdate FROM v, q"


def _domain_source(s, d) -> DataFrame:
    li = dirty(s, d, "lineitem")
    price = F.when(F.col("l_orderkey") % 97 == 0, None).when(F.col("l_orderkey") % 89 == 0, -F.col("l_net")).otherwise(
        F.col("l_net"))
    return li.select("l_orderkey", "l_linenumber", price.alias("sale_price"),
                     F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_text"), "l_returnflag")


QUERIES["cl_domain"] = lambda s, d: c.domain_clean(_domain_source(s, d)).withColumn(
    "ship_text", F.col("ship_text").cast("timestamp_ntz"))
SQL["cl_domain"] = f"""SELECT DISTINCT * FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN NULL
    WHEN l_orderkey % 89 = 0 THEN -l_net ELSE l_net END AS sale_price, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ship_text,
    l_returnflag FROM {LINE} v) t WHERE sale_price >= 0"""


# CL-22: brute force in SQL. The ranking is by distance, then by the donor's numbers.
def _gaps(s, d) -> DataFrame:
    p = table(s, d, "part")
    return p.select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_size").cast("double")).alias("p_size"),
                    F.when(F.col("p_partkey") % 15 != 0, F.col("p_retailprice")).alias("p_retailprice"))


def _knn(s, d) -> DataFrame:
    out = neighbours.impute_neighbours(_gaps(s, d).withColumnRenamed("p_partkey", "part_id").withColumn(
        "part_id", F.concat(F.lit("P"), F.col("part_id"))), ["p_size", "p_retailprice"], 5)
    return rounded(out)


QUERIES["cl_knn"] = _knn
SQL["cl_knn"] = f"""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_size::DOUBLE END AS a,
      CASE WHEN p_partkey % 15 <> 0 THEN p_retailprice END AS b FROM part),
    pairs AS (SELECT r.p_partkey, f.f, CASE WHEN f.f = 'a' THEN o.a ELSE o.b END AS x, o.a, o.b,
        2.0 * (CASE WHEN r.a IS NOT NULL AND o.a IS NOT NULL THEN (r.a - o.a) * (r.a - o.a) ELSE 0 END
          + CASE WHEN r.b IS NOT NULL AND o.b IS NOT NULL THEN (r.b - o.b) * (r.b - o.b) ELSE 0 END)
          / (CASE WHEN r.a IS NOT NULL AND o.a IS NOT NULL THEN 1 ELSE 0 END
          + CASE WHEN r.b IS NOT NULL AND o.b IS NOT NULL THEN 1 ELSE 0 END) AS dist
      FROM v r, v o, (VALUES ('a'), ('b')) f(f)
      WHERE ((f.f = 'a' AND r.a IS NULL AND o.a IS NOT NULL AND r.b IS NOT NULL AND o.b IS NOT NULL)
         OR (f.f = 'b' AND r.b IS NULL AND o.b IS NOT NULL AND r.a IS NOT NULL AND o.a IS NOT NULL))),
    best AS (SELECT p_partkey, f, avg(x) AS x FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, f
      ORDER BY dist, a NULLS FIRST, b NULLS FIRST) AS k FROM pairs) t WHERE k <= 5 GROUP BY 1, 2)
    SELECT 'P' || v.p_partkey AS part_id,
      {r("coalesce(v.a, fa.x, (SELECT avg(a) FROM v))")} AS p_size,
      {r("coalesce(v.b, fb.x, (SELECT avg(b) FROM v))")} AS p_retailprice
    FROM v LEFT JOIN best fa ON fa.p_partkey = v.p_partkey AND fa.f = 'a'
      LEFT JOIN best fb ON fb.p_partkey = v.p_partkey AND fb.f = 'b'"""

# CL-23: random trees, rows only
QUERIES["cl_iforest"] = lambda s, d: forest.drop_isolated(
    table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
QUERIES["cl_ml_based"] = lambda s, d: c.ml_clean(_gaps(s, d))
