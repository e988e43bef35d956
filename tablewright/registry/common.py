"""Shared by the query modules: table access, the dirty views, rounding at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# The driver tables are clean; these views make them dirty, in the same SQL for both engines.
VIEWS = {
    "orders": (["orders"], """SELECT o_orderkey, o_custkey,
        CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_orderdate END AS o_orderdate,
        CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM {orders}"""),
    "lineitem": (["lineitem"], """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CASE WHEN (l_orderkey * 7 + l_linenumber) % 50 = 0 THEN -l_quantity ELSE l_quantity END AS l_quantity,
        CASE WHEN l_orderkey % 1000 = 0 AND l_linenumber = 1 THEN CAST(1000000000 AS DOUBLE)
             ELSE l_extendedprice END AS l_price,
        l_extendedprice AS l_net, l_extendedprice * 1.07 + 3 AS l_gross,
        CASE WHEN l_orderkey % 500 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_tax END AS l_tax,
        CAST(1 AS DOUBLE) AS l_const, l_discount, l_returnflag, l_shipdate FROM {lineitem}"""),
    "customer": (["customer"], """SELECT c_custkey,
        CASE WHEN c_custkey % 4 = 0 THEN concat('  ', c_name, ' ') ELSE c_name END AS c_name, c_nationkey, c_acctbal,
        CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment)
             WHEN c_custkey % 7 = 0 THEN concat(substring(c_mktsegment,1,1), lower(substring(c_mktsegment,2)))
             ELSE c_mktsegment END AS c_mktsegment,
        CASE WHEN c_custkey % 9 = 0 THEN 'oops'
             WHEN c_custkey % 2 = 0 THEN concat(' ', CAST(c_nationkey AS VARCHAR(10)), ' ')
             ELSE CAST(c_nationkey AS VARCHAR(10)) END AS c_code FROM {customer}"""),
    "nation": (["nation"], """SELECT n_nationkey, n_name, n_regionkey FROM {nation}
        UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM {nation} WHERE n_nationkey % 5 = 0"""),
    "events": (["events"], """SELECT event_id, ts, user_id, event_type,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM {events}"""),
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dirty(spark: SparkSession, d: str, name: str) -> DataFrame:
    sources, sql = VIEWS[name]
    return spark.sql(sql, **{s: table(spark, d, s) for s in sources})


def view(name: str) -> str:
    """The dirty view as SQL text over the plain table names."""
    sources, sql = VIEWS[name]
    return "(" + sql.format(**{s: s for s in sources}) + ")"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for display, so that the order of additions does not show."""
    return df.select([
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema])


def r(x: str, digits: int = 6) -> str:
    return f"ROUND(CAST({x} AS DOUBLE), {digits})"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def joined(df: DataFrame, *names: str) -> DataFrame:
    """Array columns as comma-separated text."""
    return df.select([F.array_join(F.col(f.name), ",").alias(f.name) if f.name in names else F.col(f.name)
                      for f in df.schema])


def unions(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)
