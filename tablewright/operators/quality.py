"""Data-quality checks, column profiles, score and ownership.

All per-column checks read one `column_facts` table (a row per column) that comes
from one wide aggregate, so a report scans the input a fixed number of times no
matter how many checks run.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from ..functions import severity as sev
from ..functions.columns import (
    as_number, col, finite, groupable, is_date, long_rows, nan_to_null,
    numeric_columns, percent, pin, text_as_number, text_columns, variant_columns,
)
from ..functions.dates import looks_like_date
from ..functions.jobs import together
from ..functions.quantiles import exact_quantiles

# Name parts that imply a value cannot be negative.
NON_NEGATIVE_WORDS = ("revenue", "quantity", "count", "price", "amount", "volume")

# Who owns the fix of each finding.
OWNERS = {
    "mixed_types": "agent_autonomous",
    "column_naming": "agent_autonomous",
    "case_inconsistency": "agent_autonomous",
    "duplicate_rows": "agent_autonomous",
    "null_values": "human_policy_agent_execution",
    "non_unique_id": "human_policy_agent_execution",
    "zero_variance": "human_only",
    "extreme_outliers": "human_only",
    "extreme_cardinality": "human_only",
    "negative_values": "human_only",
    "infinite_values": "human_only",
    "duplicate_measurement": "human_only",
}
UNKNOWN_OWNER = "human_only"

OUTLIER_SIGMA = 5.0
REDUNDANT_R = 0.99

DEFECTS = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("defect_type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("count", T.LongType()),
    T.StructField("percentage", T.DoubleType()),
    T.StructField("details", T.StringType()),
])


class DataError(ValueError):
    """The input cannot be assessed at all."""


def require_rows(df: DataFrame) -> None:
    """DQ-0."""
    if not isinstance(df, DataFrame):
        raise DataError(f"expected a DataFrame, got {type(df).__name__}")
    if not df.columns or df.isEmpty():
        raise DataError("the table has no rows or no columns")


# ---------------------------------------------------------------- facts

def moment_facts(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls, number statistics, negatives, infinities. One scan.

    The generated code is kept short, since a wide table easily outgrows what the JVM
    compiles: the number view is null exactly where a number, boolean or date is
    missing, so only other columns need a count of their own.
    """
    fields = list(df.schema)
    own = [isinstance(f.dataType, (T.NumericType, T.BooleanType)) or is_date(f.dataType) for f in fields]
    # Number views first, in a projection, so that each text is read as a number once and not per statistic.
    d = df.select(*[as_number(f).alias(f"x{i}") for i, f in enumerate(fields)],
                  *[col(f.name).alias(f"c{i}") for i, f in enumerate(fields) if not own[i]])
    aggs = [F.count(F.lit(1)).alias("rows")]
    entries = []
    for i, f in enumerate(fields):
        x = F.col(f"x{i}")
        numeric = isinstance(f.dataType, (T.NumericType, T.BooleanType))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        present = F.col(f"n{i}")
        if not own[i]:
            aggs.append(F.count(f"c{i}").alias(f"p{i}"))
            present = F.col(f"p{i}")
        negative = infinite = F.lit(0).cast("long")
        if implies_non_negative(f.name):
            aggs.append(F.count_if(x < 0).alias(f"neg{i}"))
            negative = F.col(f"neg{i}")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            aggs.append(F.count_if(F.abs(x) == float("inf")).alias(f"inf{i}"))
            infinite = F.col(f"inf{i}")
        entries.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(numeric).alias("is_numeric"),
            F.lit(isinstance(f.dataType, T.StringType)).alias("is_text"),
            F.col("rows"), (F.col("rows") - present).alias("nulls"), F.col(f"n{i}").alias("numbers"),
            F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std"),
            F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
            negative.alias("negatives"), infinite.alias("infinites"),
        ))
    return d.agg(*aggs).select(long_rows(entries))


def distinct_facts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """One row per column: distinct values and, for text, distinct values ignoring case."""
    df = groupable(nan_to_null(df))
    columns = df.columns if columns is None else columns
    text = set(text_columns(df))
    count = (lambda c: F.approx_count_distinct(c, 0.01)) if approx else F.count_distinct
    aggs, entries = [], []
    for i, name in enumerate(columns):
        aggs.append(count(col(name)).alias(f"d{i}"))
        lower = F.lit(None).cast("long")
        if name in text:
            aggs.append(count(F.lower(col(name))).alias(f"l{i}"))
            lower = F.col(f"l{i}")
        entries.append(F.struct(F.lit(name).alias("column"), F.col(f"d{i}").alias("distinct"),
                                lower.alias("distinct_lower")))
    return df.agg(*aggs).select(long_rows(entries))


def outlier_facts(df: DataFrame, facts: list, sigma: float) -> DataFrame:
    """One row per column: values further than `sigma` standard deviations from the mean."""
    df = nan_to_null(df)
    by_name = {f.name: f for f in df.schema}
    aggs, entries = [], []
    for i, r in enumerate(facts):
        std = r["std"]
        if std is None or std != std or std <= 0 or std == float("inf"):
            continue
        x = as_number(by_name[r["column"]])
        aggs.append(F.count_if(F.abs(x - F.lit(r["mean"])) > F.lit(sigma * std)).alias(f"o{i}"))
        entries.append(F.struct(F.lit(r["column"]).alias("column"), F.col(f"o{i}").alias("outliers")))
    if not aggs:
        return df.sparkSession.createDataFrame([], "column string, outliers long")
    return df.agg(*aggs).select(long_rows(entries))


def duplicate_facts(df: DataFrame) -> DataFrame:
    """rows and distinct_rows. Copies of one row are combined before the shuffle."""
    d = groupable(nan_to_null(df))
    return d.groupBy(*map(col, d.columns)).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows")
    )


def cell_class(c: Column, dtype: T.DataType) -> Column:
    """Class of one cell: int, float, bool, datetime, str, dict or list."""
    if isinstance(dtype, T.VariantType):
        t = F.schema_of_variant(c)
        return (
            F.when(t.isNull() | (t == "VOID"), None)
            .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "float")
            .when(t == "BOOLEAN", "bool")
            .when(t.startswith("TIMESTAMP") | (t == "DATE"), "datetime")
            .when(t.startswith("OBJECT"), "dict")
            .when(t.startswith("ARRAY"), "list")
            .otherwise("str")
        )
    t = F.trim(c)
    return (
        F.when(c.isNull(), None)
        .when(t.rlike(r"^[+-]?\d+$"), "int")
        .when(text_as_number(c).isNotNull(), "float")
        .when(F.lower(t).isin("true", "false"), "bool")
        .otherwise("str")
    )


def type_counts(df: DataFrame, lexical: bool = False) -> DataFrame:
    """(column, cell_type, n). A typed column cannot be mixed; VARIANT can, text only if `lexical`."""
    names = variant_columns(df) + (text_columns(df) if lexical else [])
    if not names:
        return df.sparkSession.createDataFrame([], "column string, cell_type string, n long")
    entries = [F.struct(F.lit(n).alias("column"), cell_class(col(n), df.schema[n].dataType).alias("cell_type"))
               for n in names]
    return (
        df.select(long_rows(entries)).filter("cell_type is not null")
        .groupBy("column", "cell_type").agg(F.count("*").alias("n"))
    )


def type_facts(df: DataFrame, lexical: bool = False) -> DataFrame:
    """CL-2: dominant cell class per column (ties to the smallest name) and cells of other classes."""
    return type_counts(df, lexical).groupBy("column").agg(
        F.min_by("cell_type", F.struct(-F.col("n"), F.col("cell_type"))).alias("dominant"),
        F.count("*").alias("types"),
        (F.sum("n") - F.max("n")).alias("mixed"),
    )


# ---------------------------------------------------------------- single checks

def _finding(kind: str, category: str, severity: Column, count: Column, rows: Column, details: Column,
             columns: Column | None = None, pct: Column | None = None) -> list[Column]:
    return [
        F.lit(kind).alias("defect_type"), F.lit(category).alias("category"), severity.alias("severity"),
        (F.array("column") if columns is None else columns).alias("columns"),
        count.cast("long").alias("count"),
        (percent(count, rows) if pct is None else pct).cast("double").alias("percentage"),
        details.alias("details"),
    ]


def implies_non_negative(name: str) -> bool:
    return any(w in name.lower() for w in NON_NEGATIVE_WORDS)


def bad_name(name: str) -> bool:
    return not name.strip() or name.isdigit() or re.search(r"[^A-Za-z0-9_ ]", name) is not None


def mixed_types(facts: DataFrame) -> DataFrame:
    """DQ-1 over column facts with `mixed` and `types`."""
    pct = percent(F.col("mixed"), F.col("rows"))
    return facts.filter("types > 1").select(*_finding(
        "mixed_types", "structural_integrity",
        sev.ladder(pct, [(20, sev.HIGH), (0, sev.MEDIUM)]), F.col("mixed"), F.col("rows"),
        F.format_string("%d cells of '%s' differ from its main type %s", "mixed", "column", "dominant")))


def column_naming(facts: DataFrame) -> DataFrame:
    """DQ-2."""
    name = F.col("column")
    bad = (F.trim(name) == "") | name.rlike(r"^\d+$") | name.rlike(r"[^A-Za-z0-9_ ]")
    return facts.filter(bad).select(*_finding(
        "column_naming", "structural_integrity", F.lit(sev.MEDIUM), F.col("rows"), F.col("rows"),
        F.format_string("column name '%s' is blank, a number or has special characters", "column"),
        pct=F.lit(100.0)))


def null_values(facts: DataFrame) -> DataFrame:
    """DQ-3."""
    pct = percent(F.col("nulls"), F.col("rows"))
    steps = [(50, sev.CRITICAL), (20, sev.HIGH), (5, sev.MEDIUM), (0, sev.LOW)]
    return facts.filter("nulls > 0").select(*_finding(
        "null_values", "completeness", sev.ladder(pct, steps), F.col("nulls"), F.col("rows"),
        F.format_string("%.1f%% of '%s' is null", pct, F.col("column"))))


def negative_values(facts: DataFrame) -> DataFrame:
    """DQ-4."""
    return facts.filter("negatives > 0").select(*_finding(
        "negative_values", "consistency", F.lit(sev.HIGH), F.col("negatives"), F.col("rows"),
        F.format_string("%d values below zero in '%s'", "negatives", "column")))


def case_inconsistency(facts: DataFrame) -> DataFrame:
    """DQ-5."""
    variants = F.col("distinct") - F.col("distinct_lower")
    return facts.filter(variants > 0).select(*_finding(
        "case_inconsistency", "consistency", F.lit(sev.LOW), variants, F.col("rows"),
        F.format_string("'%s' has %d values but %d when case is ignored", "column", "distinct", "distinct_lower")))


def duplicate_rows(dup: DataFrame, columns: list[str]) -> DataFrame:
    """DQ-6 over `duplicate_facts`."""
    copies = F.col("rows") - F.col("distinct_rows")
    pct = percent(copies, F.col("rows"))
    steps = [(80, sev.CRITICAL), (20, sev.HIGH), (5, sev.MEDIUM), (0, sev.LOW)]
    return dup.filter(copies > 0).select(*_finding(
        "duplicate_rows", "uniqueness", sev.ladder(pct, steps), copies, F.col("rows"),
        F.format_string("%.1f%% of the rows are copies (%d of %d)", pct, copies, F.col("rows")),
        columns=F.array(*map(F.lit, columns))))


def zero_variance(facts: DataFrame) -> DataFrame:
    """DQ-7: one distinct number; a single value fires too."""
    return facts.filter("numbers > 0 and (std = 0 or min = max)").select(*_finding(
        "zero_variance", "statistical_red_flag", F.lit(sev.HIGH), F.col("numbers"), F.col("rows"),
        F.format_string("'%s' never varies", "column"), pct=F.lit(100.0)))


def extreme_outliers(facts: DataFrame) -> DataFrame:
    """DQ-8."""
    return facts.filter("outliers > 0").select(*_finding(
        "extreme_outliers", "statistical_red_flag", F.lit(sev.MEDIUM), F.col("outliers"), F.col("rows"),
        F.format_string("%d values of '%s' lie beyond 5 standard deviations", "outliers", "column")))


def infinite_values(facts: DataFrame) -> DataFrame:
    """DQ-9."""
    return facts.filter("infinites > 0").select(*_finding(
        "infinite_values", "statistical_red_flag", F.lit(sev.HIGH), F.col("infinites"), F.col("rows"),
        F.format_string("%d infinite values in '%s'", "infinites", "column")))


def extreme_cardinality(facts: DataFrame, strict: bool = True) -> DataFrame:
    """DQ-10. `strict` keeps the clause that at least one value reads as a number."""
    nonnull = F.col("rows") - F.col("nulls")
    hit = F.col("is_text") & (nonnull > 0) & (F.col("distinct") == nonnull)
    if strict:
        hit = hit & (F.col("numbers") > 0)
    return facts.filter(hit).select(*_finding(
        "extreme_cardinality", "statistical_red_flag", F.lit(sev.MEDIUM), nonnull, F.col("rows"),
        F.format_string("every value of '%s' is unique", "column"), pct=F.lit(100.0)))


def non_unique_id(facts: DataFrame) -> DataFrame:
    """DQ-11."""
    repeats = F.col("rows") - F.col("nulls") - F.col("distinct")
    is_id = (F.col("column") == "id") | F.col("column").endswith("_id")
    return facts.filter(is_id & (repeats > 0)).select(*_finding(
        "non_unique_id", "referential_integrity", F.lit(sev.HIGH), repeats, F.col("rows"),
        F.format_string("id column '%s' repeats %d values", "column", repeats)))


def pair_sums(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Row, np.ndarray]:
    """(i, j, n, sx, sy, qx, qy, p) of every pair i < j: count, sums, squares and products of the centred values where
    both are present; with the columns' mean, min, max and variance, and the centre.

    All pairs come from one scan: each task adds up the cross products of its rows as
    small matrices, columns centred beforehand, and sends one row per pair.
    Generated pair expressions would outgrow the code generator at about 30 pairs.
    """
    fields = {f.name: f for f in df.schema}
    d = df.select([as_number(fields[c]).alias(f"x{i}") for i, c in enumerate(columns)])
    stats = d.agg(*[f(F.col(f"x{i}")).alias(f"{n}{i}") for i in range(len(columns))
                    for f, n in ((F.avg, "m"), (F.min, "lo"), (F.max, "hi"), (F.var_pop, "v"))]).first()
    centre = np.array([m if (m := stats[f"m{i}"]) is not None and math.isfinite(m) else 0.0 for i in range(len(columns))])
    left, right = np.triu_indices(len(columns), 1)

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - centre
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            with np.errstate(invalid="ignore", over="ignore"):
                part = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            n, s, q, p = total
            yield pd.DataFrame({
                "i": left.astype("int32"), "j": right.astype("int32"), "n": n[left, right], "sx": s[left, right],
                "sy": s[right, left], "qx": q[left, right], "qy": q[right, left], "p": p[left, right]})

    sums = d.mapInPandas(cross, "i int, j int, n double, sx double, sy double, qx double, qy double, p double").groupBy(
        "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "qx", "qy", "p")])
    return sums, stats, centre


def pair_correlations(df: DataFrame, columns: list[str] | None = None, booleans: bool = False) -> DataFrame:
    """(a, b, r, n) for every column pair a before b, over the rows where both are present; r is null when a side is constant."""
    df = nan_to_null(df)
    columns = numeric_columns(df, booleans) if columns is None else columns
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double, n long")
    sums, stats, _ = pair_sums(df, columns)
    names = F.array(*map(F.lit, columns))
    constant = [i for i in range(len(columns)) if stats[f"lo{i}"] is None or stats[f"lo{i}"] == stats[f"hi{i}"]]
    spread = F.array(*[F.lit(v) if (v := stats[f"v{i}"]) is not None else F.lit(0.0) for i in range(len(columns))])
    mean = lambda c: F.try_divide(F.col(c), F.col("n"))
    vx = F.try_divide("qx", "n") - mean("sx") * mean("sx")
    vy = F.try_divide("qy", "n") - mean("sy") * mean("sy")
    cov = F.try_divide("p", "n") - mean("sx") * mean("sy")
    # A side can also be constant on the shared rows only; rounding leaves a trace far below its variance.
    flat = (vx <= F.get(spread, F.col("i")) * 1e-18) | (vy <= F.get(spread, F.col("j")) * 1e-18)
    if constant:
        flat = flat | F.col("i").isin(constant) | F.col("j").isin(constant)
    r = F.when(~flat, F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
    return sums.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"),
                       F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
                       F.col("n").cast("long").alias("n"))


def duplicate_measurement(pairs: DataFrame, rows: Column) -> DataFrame:
    """DQ-12 over `pair_correlations`."""
    return pairs.filter(F.abs("r") > REDUNDANT_R).select(*_finding(
        "duplicate_measurement", "referential_integrity", F.lit(sev.LOW), rows, rows,
        F.format_string("'%s' and '%s' are almost perfectly correlated", "a", "b"),
        columns=F.array("a", "b"), pct=F.lit(100.0)))


# ---------------------------------------------------------------- report

def owner(defect_type: Column) -> Column:
    """DQ-15."""
    table = F.create_map(*[F.lit(x) for kv in OWNERS.items() for x in kv])
    return F.coalesce(F.element_at(table, defect_type), F.lit(UNKNOWN_OWNER))


def with_owner(defects: DataFrame) -> DataFrame:
    return defects.withColumn("remediation_class", owner(F.col("defect_type")))


def column_profiles(facts: DataFrame) -> DataFrame:
    """DQ-13 over facts joined with distinct facts."""
    stat = lambda c: F.when(F.col("is_numeric"), finite(F.col(c)))
    return facts.select(
        "position", F.col("column").alias("column_name"), "dtype",
        F.col("nulls").alias("null_count"), percent(F.col("nulls"), F.col("rows")).alias("null_pct"),
        F.col("distinct").alias("unique_count"), percent(F.col("distinct"), F.col("rows")).alias("unique_pct"),
        F.coalesce(F.col("types") > 1, F.lit(False)).alias("has_mixed_types") if "types" in facts.columns
        else F.lit(False).alias("has_mixed_types"),
        stat("min").alias("min_val"), stat("max").alias("max_val"),
        stat("mean").alias("mean_val"), stat("std").alias("std_val"),
    )


def roll_up(defects: DataFrame) -> DataFrame:
    """DQ-14: one row (overall_severity, has_critical_issues, halt_reason, quality_score, defect_count)."""
    critical = F.when(F.col("severity") == sev.CRITICAL, F.struct("ordinal", "details"))
    reasons = F.transform(F.array_sort(F.collect_list(critical)), lambda s: s["details"])
    return defects.agg(
        sev.worst(F.col("severity")).alias("overall_severity"),
        (F.count_if(F.col("severity") == sev.CRITICAL) > 0).alias("has_critical_issues"),
        F.when(F.count(critical) > 0, F.concat(F.lit("Critical findings: "), F.array_join(reasons, "; ")))
        .alias("halt_reason"),
        F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(F.sum(sev.weight(F.col("severity"))), F.lit(0)))
        .alias("quality_score"),
        F.count("*").alias("defect_count"),
    )


def all_facts(df: DataFrame, lexical: bool = False, approx: bool = False) -> DataFrame:
    """Moments, outliers, distinct counts and cell types of every column, a row per column.

    The parts are as long as the schema is wide, so they are put together on the
    driver and every check reads the result from there.
    """
    def measured():
        facts = moment_facts(df)
        known = facts.collect()
        far = outlier_facts(df, known, OUTLIER_SIGMA)
        return facts.schema, known, far.schema, far.collect()

    def counted(part: DataFrame):
        return lambda: (part.schema, part.collect())

    parts = [distinct_facts(df, approx=approx)]
    if lexical or variant_columns(df):
        parts.append(type_facts(df, lexical))
    (base, known, *far), *others = together(df.sparkSession, measured, *map(counted, parts))
    rows = {r["column"]: r.asDict() for r in known}
    schema = T.StructType(list(base))
    for part, found in [tuple(far), *others]:
        for r in found:
            rows[r["column"]].update(r.asDict())
        schema = T.StructType([*schema, *(f for f in part if f.name != "column")])
    for f in ("dominant string", "types long", "mixed long"):
        name, kind = f.split()
        if name not in schema.names:
            schema = schema.add(name, kind)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return df.sparkSession.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows.values()], schema)


def assess(df: DataFrame, lexical: bool = False, approx: bool = False) -> dict[str, DataFrame]:
    """All checks: tables `defects` (with owner), `profiles`, `summary` and the `facts` behind them."""
    require_rows(df)
    facts, copies, pairs = together(
        df.sparkSession, lambda: all_facts(df, lexical, approx), lambda: pin(duplicate_facts(df)),
        lambda: pin(pair_correlations(df, booleans=True)))
    total = facts.first()["rows"]
    checks = [
        (0, mixed_types(facts)), (0, column_naming(facts)), (1, null_values(facts)),
        (2, negative_values(facts)), (2, case_inconsistency(facts)),
        (3, duplicate_rows(copies, df.columns)),
        (4, zero_variance(facts)), (4, extreme_outliers(facts)), (4, infinite_values(facts)),
        (4, extreme_cardinality(facts)), (5, non_unique_id(facts)),
        (6, duplicate_measurement(pairs, F.lit(total))),
    ]
    marked = [d.select(F.lit(g).alias("g"), F.lit(k).alias("k"), *d.columns) for k, (g, d) in enumerate(checks)]
    place = {n: i for i, n in enumerate(df.columns)}
    found = reduce(DataFrame.unionAll, marked).collect()  # one row per finding, bounded by the schema
    found.sort(key=lambda r: (r["g"], *(place[c] for c in r["columns"][:1]), r["k"], *(place[c] for c in r["columns"][1:2])))
    records = [(i, *r[2:]) for i, r in enumerate(found)]
    defects = with_owner(df.sparkSession.createDataFrame(records, DEFECTS))
    return {"defects": defects, "profiles": column_profiles(facts), "summary": roll_up(defects), "facts": facts}


# ---------------------------------------------------------------- older profile

def table_profile(df: DataFrame) -> DataFrame:
    """DQ-16: one row (rows, columns, missing_pct, column lists, outlier_pct, duplicates, quality_score).

    Outliers are counted for every numeric column. A text column is a date column
    when all its values read as dates; all columns are tested in the pass that counts the rows.
    """
    df = nan_to_null(df)
    numeric, text = numeric_columns(df), text_columns(df)
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(col(t).isNotNull() & ~looks_like_date(col(t))).alias(f"b{i}") for i, t in enumerate(text)]).first()
    dates = [t for i, t in enumerate(text) if seen[f"b{i}"] == 0]
    rows = seen["rows"]
    fields = {f.name: f for f in df.schema}
    quart = exact_quantiles(df, {n: as_number(fields[n]) for n in numeric}, [0.25, 0.75], rows=rows)
    outside, present = F.lit(0).cast("long"), F.lit(0).cast("long")
    missing = F.lit(0).cast("long")
    for n in df.columns:
        missing = missing + F.count_if(col(n).isNull())
    for n in numeric:
        q1, q3 = quart[n]
        present = present + F.count(col(n))
        if q1 is None:
            continue
        x = as_number(fields[n])
        outside = outside + F.count_if((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)))
    main = df.agg(missing.alias("missing"), outside.alias("outside"), present.alias("present"))
    dup = duplicate_facts(df)
    cells = rows * len(df.columns)
    one = main.select(
        percent(F.col("missing"), F.lit(cells)).alias("missing_pct"),
        percent(F.col("outside"), F.greatest("present", F.lit(1))).alias("outlier_pct"),
    )
    dup = dup.select((F.col("rows") - F.col("distinct_rows")).alias("duplicates"))
    return pin(one).withColumn("_j", F.lit(1)).join(pin(dup).withColumn("_j", F.lit(1)), "_j").select(
        F.lit(rows).cast("long").alias("rows"), F.lit(len(df.columns)).alias("columns"),
        "missing_pct",
        F.array(*map(F.lit, numeric)).cast("array<string>").alias("numeric_columns"),
        F.array(*[F.lit(t) for t in text if t not in dates]).cast("array<string>").alias("categorical_columns"),
        F.array(*map(F.lit, dates)).cast("array<string>").alias("datetime_columns"),
        "outlier_pct", "duplicates",
        F.greatest(F.lit(0.0), 100 - F.col("missing_pct") - F.col("outlier_pct") * 0.5
                   - F.coalesce(F.try_divide(F.col("duplicates"), F.lit(rows)), F.lit(0.0)) * 20)
        .alias("quality_score"),
    )


# Parameters of each cleaning method.
METHOD_PARAMETERS = {
    "basic": {"drop_threshold": "0.5", "fill_numeric": "median", "fill_categorical": "mode"},
    "statistical": {"outlier_method": "iqr", "outlier_threshold": "1.5", "imputation": "iterative"},
    "ml_based": {"imputer": "knn", "n_neighbors": "5", "outlier_detector": "isolation_forest"},
    "domain_specific": {"datetime_format": "infer", "business_rules": "True", "custom_validation": "True"},
}


# The reasons given with a method.
REASONS = {
    "missing": "High missing data percentage (%.1f%%)",
    "patterns": "ML-based imputation recommended for complex patterns",
    "outliers": "High outlier percentage (%.1f%%)",
    "handling": "Statistical methods best for outlier handling",
    "domain": "Domain-specific cleaning needed",
    "dates": "Datetime columns detected",
    "fine": "Data quality is acceptable for basic cleaning",
}


def recommend_cleaning(profiles: DataFrame) -> DataFrame:
    """DQ-17: cleaning method, confidence, reasons and parameters for each profile row."""
    has_dates = F.size("datetime_columns") > 0
    rules = [  # (condition, method, confidence, reasons)
        (F.col("missing_pct") > 30, "ml_based", 0.9,
         F.array(F.format_string(REASONS["missing"], "missing_pct"),
                 F.lit(REASONS["patterns"]))),
        (F.col("outlier_pct") > 20, "statistical", 0.8,
         F.array(F.format_string(REASONS["outliers"], "outlier_pct"),
                 F.lit(REASONS["handling"]))),
        (has_dates | (F.col("quality_score") < 60), "domain_specific", 0.85,
         F.array_compact(F.array(F.lit(REASONS["domain"]),
                                 F.when(has_dates, REASONS["dates"])))),
        (F.lit(True), "basic", 0.7, F.array(F.lit(REASONS["fine"]))),
    ]
    choice = None
    for cond, method, confidence, reasons in reversed(rules):
        params = F.create_map(*[F.lit(x) for kv in METHOD_PARAMETERS[method].items() for x in kv])
        s = F.struct(F.lit(method).alias("method"), F.lit(confidence).alias("confidence"),
                     reasons.alias("reasons"), params.alias("parameters"))
        choice = s if choice is None else F.when(cond, s).otherwise(choice)
    return profiles.withColumn("_c", choice).select(*profiles.columns, "_c.*")
