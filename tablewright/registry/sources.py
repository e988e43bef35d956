"""Queries over readers and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.stage import shared_dir
from ..operators import drift as dr, insight as i, models as m, quality as q
from ..plans import reports
from ..sources import readers as rd, sinks as sk
from .common import big, dirty, joined, r, rounded, table, unions, view
from .insight import _FAR, SQL as INSIGHT_SQL

RECOMMENDED = INSIGHT_SQL["in_recommendations"]

QUERIES, SQL = {}, {}


def _folder(s, name) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


# SRC-1: missing-value spellings and inferred types
_MARKED = """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'N/A' WHEN 1 THEN 'null' WHEN 2 THEN 'NaN'
    ELSE CAST(o_totalprice AS VARCHAR(30)) END AS price, CASE WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'False' END AS flag FROM {orders}"""


def _csv(s, d, sep=",") -> str:
    path = _folder(s, "csv")
    s.sql(_MARKED, orders=table(s, d, "orders")).write.option("header", True).option("sep", sep).csv(path)
    return path


QUERIES["src_csv"] = lambda s, d: rounded(rd.read_csv(s, _csv(s, d)))
SQL["src_csv"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 2 THEN ROUND(o_totalprice, 6) END AS price,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, o_orderkey % 2 = 0 AS flag FROM orders"""
QUERIES["src_tsv"] = lambda s, d: rounded(rd.read_tsv(s, _csv(s, d, "\t")))
SQL["src_tsv"] = SQL["src_csv"]
QUERIES["src_csv_schema"] = lambda s, d: rounded(rd.read_csv(s, _csv(s, d), T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("price", T.DoubleType()),
    T.StructField("priority", T.StringType()), T.StructField("flag", T.BooleanType())])))
SQL["src_csv_schema"] = SQL["src_csv"]
# SRC-10
QUERIES["src_csv_list"] = lambda s, d: rd.read_csv(s, [_csv(s, d), _csv(s, d)]).groupBy("flag").agg(F.count("*").alias("n"))
SQL["src_csv_list"] = "SELECT o_orderkey % 2 = 0 AS flag, 2 * count(*) AS n FROM orders GROUP BY 1"


# SRC-3: every 100th line has too many cells
def _strict(s, d) -> DataFrame:
    path = _folder(s, "strict")
    lines = table(s, d, "orders").select(F.when(F.col("o_orderkey") % 100 == 0, F.concat_ws(",", "o_orderkey", F.lit("a,b,c"))).when(
        F.col("o_orderkey") % 50 == 1, "").otherwise(F.concat_ws(",", "o_orderkey", F.col("o_orderstatus"))))
    lines.write.text(path)
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("status", T.StringType())])
    good, bad = rd.read_strict_csv(s, path, schema, rejects=True, header=False)
    return good.agg(F.count("*").alias("n")).select(F.lit("good").alias("kind"), "n").unionAll(
        bad.agg(F.count("*").alias("n")).select(F.lit("rejected").alias("kind"), "n"))


QUERIES["src_strict_csv"] = _strict
SQL["src_strict_csv"] = """SELECT 'good' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 100 <> 0 AND o_orderkey % 50 <> 1
    UNION ALL SELECT 'rejected', count(*) FROM orders WHERE o_orderkey % 100 = 0"""


# SRC-4
def _text(s, d, plain: bool) -> str:
    path = _folder(s, "text")
    o = table(s, d, "orders")
    if plain:
        o.select(F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.concat_ws(" ", F.lit("order"), "o_orderkey"))).write.text(path)
    else:
        o.select(F.col("o_orderkey").cast("string").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias(
            "p")).write.option("header", True).option("sep", "\t").csv(path)
    return path


QUERIES["src_text_lines"] = lambda s, d: rd.read_text(s, _text(s, d, True)).groupBy("file").agg(
    F.count("*").alias("n"), F.min("Line").alias("lo"), F.max("Line").alias("hi"), F.count_distinct("Line").alias("d")).agg(
    F.sum("n").alias("lines"), (F.max("lo") == 1).alias("from_one"), (F.sum("hi") == F.sum("d")).alias("dense"))
SQL["src_text_lines"] = "SELECT count(*) AS lines, true AS from_one, true AS dense FROM orders WHERE o_orderkey % 5 <> 0"
QUERIES["src_text_table"] = lambda s, d: rd.read_text(s, _text(s, d, False))
SQL["src_text_table"] = "SELECT o_orderkey::VARCHAR AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE '' END AS p FROM orders"



def _mixed_text(s, d) -> DataFrame:
    """Comma, tab and plain files in one folder, as one scan."""
    root = _folder(s, "text")
    o = table(s, d, "orders")
    cells = lambda k, *names: o.filter(F.col("o_orderkey") % 3 == k).select(*[F.col(c).cast("string").alias(n) for c, n in names])
    priority = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    o = o.withColumn("p", priority).withColumn("note", F.concat(F.lit('a "b", '), F.col("o_custkey")))
    cells(0, ("o_orderkey", "k"), ("p", "p"), ("note", "note")).write.option("header", True).option("escape", '"').csv(f"{root}/comma")
    cells(1, ("o_orderkey", "k"), ("p", "q")).write.option("header", True).option("sep", "\t").csv(f"{root}/tab")
    o.filter("o_orderkey % 3 = 2").select(F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.concat_ws(" ", F.lit("order"), "o_orderkey"))).write.text(f"{root}/plain")
    d = rd.read_text_maps(s, root)
    return d.select(F.element_at(F.split("file", "/"), -2).alias("kind"), "table", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in ("k", "p", "q", "note", "Content")])


QUERIES["src_text_mixed"] = _mixed_text
SQL["src_text_mixed"] = """WITH o AS (SELECT *, o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority ELSE '' END AS pr FROM orders)
    SELECT 'comma' AS kind, true AS "table", key AS k, pr AS p, NULL::VARCHAR AS q, 'a "b", ' || o_custkey AS note, NULL::VARCHAR AS "Content" FROM o WHERE o_orderkey % 3 = 0
    UNION ALL SELECT 'tab', true, key, NULL, pr, NULL, NULL FROM o WHERE o_orderkey % 3 = 1
    UNION ALL SELECT 'plain', false, NULL, NULL, NULL, NULL, 'order ' || key FROM o WHERE o_orderkey % 3 = 2 AND o_orderkey % 5 <> 0"""

# SRC-5: one JSON document per user and day
_doc = lambda s, d, item: table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
    F.to_json(F.collect_list(item), {"ignoreNullFields": "false"}).alias("doc"))
_item = lambda: F.struct("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind"),
                 (F.col("event_id") % 10).alias("digit"), (F.col("event_id") % 2 == 0).alias("even"))
QUERIES["src_json_objects"] = lambda s, d: rd.json_rows(_doc(s, d, _item()), "doc")
SQL["src_json_objects"] = """SELECT CASE WHEN event_id = 0 THEN '' ELSE event_id::VARCHAR END AS event_id,
    CASE WHEN event_id % 4 <> 0 THEN event_type ELSE '' END AS kind, CASE WHEN event_id % 10 = 0 THEN '' ELSE (event_id % 10)::VARCHAR END
    AS digit, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '' END AS even FROM events"""
QUERIES["src_json_scalars"] = lambda s, d: rd.json_rows(_doc(s, d, F.col("event_type")), "doc").groupBy("Value").agg(F.count("*").alias("n"))
SQL["src_json_scalars"] = """SELECT '"' || event_type || '"' AS "Value", count(*) AS n FROM events GROUP BY 1"""
QUERIES["src_json_entries"] = lambda s, d: rd.json_rows(table(s, d, "events"), "props").groupBy("Key", "Value").agg(F.count("*").alias("n"))
SQL["src_json_entries"] = """SELECT 'k' AS "Key", json_extract_string(props, '$.k') AS "Value", count(*) AS n FROM events GROUP BY 2"""

# SRC-6: one XML document per order
_xml = lambda: F.concat(F.lit("<order id=\""), F.col("o_orderkey"), F.lit("\"><status>"), F.col("o_orderstatus"), F.lit("</status><item n=\"1\">x"),
                F.col("o_custkey"), F.lit("</item><item><deep>"), F.col("o_orderpriority"), F.lit("</deep></item></order>"))
QUERIES["src_xml"] = lambda s, d: rd.xml_columns(rd.flatten_documents(
    table(s, d, "orders").select("o_orderkey", _xml().alias("doc")), "o_orderkey", "doc"))
SQL["src_xml"] = """SELECT o_orderkey, o_orderkey::VARCHAR AS "order.$.id", o_orderstatus AS "order.status[0]", '1' AS "order.item[0].$.n",
    'x' || o_custkey AS "order.item[0]._", o_orderpriority AS "order.item[1].deep[0]" FROM orders"""


# SRC-7: the suppliers as a cell grid
def _cells(s, d) -> DataFrame:
    sup = table(s, d, "supplier")
    cell = lambda c, kind, v, f=None: F.struct(F.lit(c).alias("col"), F.lit(kind).alias("dtype") if isinstance(kind, str) else kind.alias(
        "dtype"), v.cast("string").alias("value"), (F.lit(None) if f is None else f).cast("string").alias("formula"))
    key = F.col("s_suppkey")
    body = sup.select((key + 2).alias("row"), F.inline(F.array(
        cell(1, "n", key), cell(2, "s", F.col("s_name")),
        cell(3, F.when(key % 10 == 0, "e").otherwise("n"), F.when(key % 10 == 0, "#REF!").otherwise(F.col("s_nationkey").cast("string"))),
        cell(4, "n", F.when(key % 8 != 0, F.col("s_acctbal")), F.when(key % 8 == 0, "=A1*2")))))
    head = s.range(1).select(F.lit(1).cast("long").alias("row"), F.inline(F.array(
        cell(1, "s", F.lit("key")), cell(2, "s", F.lit("name")), cell(3, "s", F.lit(None)), cell(4, "s", F.lit("balance")))))
    return head.unionByName(body)


QUERIES["src_grid"] = lambda s, d: rd.grid_to_table(_cells(s, d))[0]
SQL["src_grid"] = """SELECT s_suppkey + 2 AS "row", s_suppkey::VARCHAR AS key, s_name AS name,
    CASE WHEN s_suppkey % 10 <> 0 THEN s_nationkey::VARCHAR END AS "Column 3", CASE WHEN s_suppkey % 8 <> 0 THEN s_acctbal::VARCHAR END AS balance
    FROM supplier"""
QUERIES["src_grid_errors"] = lambda s, d: rd.grid_to_table(_cells(s, d))[1]
SQL["src_grid_errors"] = """SELECT s_suppkey + 2 AS "row", 'Column 3' AS "column", 'error_cell' AS issue, '#REF!' AS raw_value FROM supplier
    WHERE s_suppkey % 10 = 0 UNION ALL SELECT s_suppkey + 2, 'balance', 'formula_cell', '=A1*2' FROM supplier WHERE s_suppkey % 8 = 0"""


# SRC-8, SRC-9, SRC-11
def _any(s, d) -> DataFrame:
    path = _folder(s, "any") + "/orders.CSV"
    table(s, d, "orders").select("o_orderkey", "o_orderpriority").write.option("header", True).csv(path)
    return rd.read_any(s, path)


QUERIES["src_any"] = _any
SQL["src_any"] = "SELECT o_orderkey, o_orderpriority FROM orders"
QUERIES["src_preview"] = lambda s, d: joined(rd.preview(table(s, d, "part"))[1], "names")
SQL["src_preview"] = "SELECT count(*) AS rows, 6 AS columns, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS names FROM part"
_path = lambda: F.concat(F.lit("/data/"), F.when(F.col("p_partkey") % 3 == 0, "..").otherwise("_"), F.col("p_name"), F.lit(" "), F.col("p_brand"),
                 F.lit(".v1.csv"))
QUERIES["src_dataset_key"] = lambda s, d: table(s, d, "part").select("p_partkey", rd.dataset_key(_path()).alias("key"))
SQL["src_dataset_key"] = """SELECT p_partkey, replace(lower(p_name || '_' || regexp_replace(p_brand, '[^A-Za-z0-9._-]', '_', 'g')), ' ', '_') || '.v1'
    AS key FROM part"""


# SNK-1, SNK-5
def _exported(s, d) -> DataFrame:
    path = _folder(s, "export")
    sk.write_csv(table(s, d, "customer"), f"{path}/clean")
    done = sk.export_tables({"a": table(s, d, "nation"), "b": table(s, d, "region"), "c": table(s, d, "part")}, ["a", "b"], path)
    out = s.read.option("header", True).csv(f"{path}/clean").agg(F.count("*").alias("n")).select(F.lit("clean").alias("name"), "n")
    for p in done:
        out = out.unionAll(s.read.json(p).agg(F.count("*").alias("n")).select(F.lit(p.rsplit("/", 1)[1]).alias("name"), "n"))
    return out


QUERIES["snk_export"] = _exported
SQL["snk_export"] = """SELECT 'clean' AS name, count(*) AS n FROM customer UNION ALL SELECT 'a', count(*) FROM nation
    UNION ALL SELECT 'b', count(*) FROM region"""


# SNK-2
def _alert_log(s, d) -> DataFrame:
    o = table(s, d, "orders")
    base, now = o.filter("o_orderdate < '1998-01-01'"), o.filter("o_orderdate >= '1998-01-01'").withColumn(
        "o_totalprice", F.col("o_totalprice") * 2)
    found = dr.alerts(dr.compare(dr.profile(now), dr.profile(base))["findings"], {"o_totalprice": 0.3}, "orders")
    path = _folder(s, "alerts")
    sk.write_alerts(found, path)
    return rounded(s.read.json(path).select("dataset", "column", "severity", F.col("actual_value").cast("double")))


QUERIES["snk_alerts"] = _alert_log
SQL["snk_alerts"] = f"""SELECT 'orders' AS dataset, 'o_totalprice' AS "column", 'high' AS severity,
    {r("(2 * avg(CASE WHEN o_orderdate >= '1998-01-01' THEN o_totalprice END) - avg(CASE WHEN o_orderdate < '1998-01-01' THEN o_totalprice END)) / avg(CASE WHEN o_orderdate < '1998-01-01' THEN o_totalprice END)")}
    AS actual_value FROM orders"""


# SNK-4, SNK-7, SNK-8, SNK-9
def _results(s, d) -> DataFrame:
    path = _folder(s, "results")
    counts = table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    sk.append(sk.result_rows(counts, "u1", "orders", "descriptive"), path)
    sk.append(sk.result_rows(counts, "u2", "orders", "diagnostic"), path)
    return s.read.parquet(path).select("user_id", "analysis_type", "results")


QUERIES["snk_results"] = _results
SQL["snk_results"] = unions([f"""SELECT '{u}' AS user_id, '{t}' AS analysis_type, '{{"o_orderstatus":"' || o_orderstatus || '","n":' || count(*) || '}}'
    AS results FROM orders GROUP BY o_orderstatus""" for u, t in (("u1", "descriptive"), ("u2", "diagnostic"))])


def _model_row(s, d) -> DataFrame:
    scores = m.regression_scores(table(s, d, "lineitem").withColumn("guess", F.col("l_quantity") * 2100), "l_extendedprice", "guess").first()
    metrics = s.createDataFrame([("linear_regression", scores["r2_score"], 0.0, 1), ("random_forest", -9.0, 0.0, 1)],
                                "model string, score double, rmse double, n long")
    rows = sk.model_rows(metrics, m.best_model(metrics), "regression", "l_extendedprice", "u1", "lineitem")
    return rows.select("model_type", "algorithm", "target_column", F.col("accuracy_score").cast("double").alias("accuracy_score"))


QUERIES["snk_model"] = _model_row
SQL["snk_model"] = f"""SELECT 'regression' AS model_type, 'linear_regression' AS algorithm, 'l_extendedprice' AS target_column,
    {r("1 - sum(pow(l_extendedprice - l_quantity * 2100, 2)) / (var_pop(l_extendedprice) * count(*))", 4)} AS accuracy_score FROM lineitem"""


def _catalogue(s, d) -> DataFrame:
    path = _folder(s, "catalogue")
    for name in ("orders", "part"):
        sk.append(sk.catalogue_row(table(s, d, name), name, "u1", f"{name}.csv", None), path)
    sk.append(sk.catalogue_row(table(s, d, "orders"), "orders", "u1", "orders.csv", None, "cleaned"), path)
    rows = s.read.parquet(path)
    return sk.current_status(rows).drop("updated_at").join(rows.groupBy("dataset_id").agg(F.max("rows").alias("rows")), "dataset_id")


QUERIES["snk_catalogue"] = _catalogue
SQL["snk_catalogue"] = """SELECT 'orders' AS dataset_id, 'cleaned' AS status, count(*) AS rows FROM orders
    UNION ALL SELECT 'part', 'uploaded', count(*) FROM part"""


def _activity(s, d) -> DataFrame:
    path = _folder(s, "activity")
    failed = F.col("event_type") == "error"
    sk.append(sk.activity_table(table(s, d, "events"), F.col("user_id"), F.col("event_type"), F.when(failed, "error").otherwise("success"),
                                F.col("props"), F.when(failed, F.concat(F.lit("event "), F.col("event_id")))), path)
    return s.read.parquet(path).drop("created_at")


QUERIES["snk_activity"] = _activity
SQL["snk_activity"] = """SELECT user_id, event_type AS action, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
    props AS metadata, CASE WHEN event_type = 'error' THEN 'event ' || event_id END AS error_message FROM events"""


# SNK-6: the whole flow from table to report
def _report(s, d) -> DataFrame:
    df = table(s, d, "orders")
    return reports.build_report(df, order="o_orderkey")["report"].groupBy("section").agg(F.count("*").alias("lines"))


QUERIES["snk_report"] = _report
SQL["snk_report"] = f"""SELECT * FROM (SELECT 0 AS section, 1::BIGINT AS lines UNION ALL SELECT 2, 6
    UNION ALL SELECT 3, 3 * CAST(count(DISTINCT date_trunc('month', o_orderdate)) >= 2 AS BIGINT) FROM orders
    UNION ALL SELECT 4, 6 UNION ALL SELECT 5, count(*) FROM ({_FAR}) f WHERE far > 0
    UNION ALL SELECT 6, count(*) FROM ({RECOMMENDED}) r) t WHERE lines > 0"""
QUERIES["flow_halts"] = lambda s, d: s.createDataFrame([(out["halted"], out["halt_reason"]) for out in [
    reports.build_report(dirty(s, d, "orders"))]], "halted boolean, halt_reason string")
SQL["flow_halts"] = f"""SELECT true AS halted, printf('Critical findings: %.1f%% of ''o_orderdate'' is null',
    (count(*) - count(o_orderdate)) * 100.0 / count(*)) AS halt_reason FROM {view("orders")} v"""
