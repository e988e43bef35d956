"""Run registered queries and their SQL side by side and compare rows, names and types.

    python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    if isinstance(v, dict):
        return tuple(sorted((k, _value(x)) for k, x in v.items()))
    return v


def compare(spark, con, query, sql, sf) -> tuple[str, float]:
    start = time.time()
    df = query(spark, sf)
    names = sorted(df.columns)
    mine = [tuple(_value(r[df.columns.index(n)]) for n in names) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return f"rows-only {len(mine)}", took
    rel = con.sql(sql)
    cols = list(rel.columns)
    if sorted(cols) != names:
        return f"FAIL columns {names} vs {sorted(cols)}", took
    theirs = [tuple(_value(r[cols.index(n)]) for n in names) for r in rel.fetchall()]
    kinds = lambda rows: [{type(r[i]).__name__ for r in rows if r[i] is not None} for i in range(len(names))]
    if mine and theirs and kinds(mine) != kinds(theirs):
        bad = [(n, a, b) for n, a, b in zip(names, kinds(mine), kinds(theirs)) if a != b]
        return f"FAIL types {bad}", took
    a, b = Counter(mine), Counter(theirs)
    if a != b:
        return f"FAIL rows {len(mine)} vs {len(theirs)}; mine {list((a - b).items())[:3]}; sql {list((b - a).items())[:3]}", took
    return f"ok {len(mine)}", took


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def session(cpus="8"):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    spark, con = session(), connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in queries:
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            text, took = compare(spark, con, queries[name], oracle.get(name), sf)
        except Exception as e:  # noqa: BLE001
            text, took = f"FAIL {type(e).__name__}: {str(e)[:700]}", 0.0
        failed += text.startswith("FAIL")
        print(f"{name:28s} {took:6.2f}s {text[:900]}", flush=True)
    print("failed:", failed)
