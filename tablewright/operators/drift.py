"""Baseline profiles, drift findings, alerts and baseline rotation."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import severity as sev
from ..functions.columns import as_number, col, long_rows, nan_to_null, numeric_columns, percent, pin
from ..functions.quantiles import exact_quantiles
from ..functions.values import value_counts

# Severity bands.
SHIFT_BANDS = [(0.30, sev.HIGH), (0.15, sev.MEDIUM), (0.05, sev.LOW)]
VOLUME_BANDS = [(0.50, sev.HIGH), (0.20, sev.MEDIUM), (0.10, sev.LOW)]
STD_RATIO_HIGH = (0.5, 2.0)
STD_RATIO_MEDIUM = (0.67, 1.5)
PSI_HIGH, PSI_MEDIUM, PSI_FLOOR = 0.25, 0.10, 0.0001
MISSING_SHARE, NEW_SHARE = 0.10, 0.05
ROTATE_AFTER = 4

FINDING = "check string, column string, severity string, actual_value double, detail string"
COLUMN_STATS = ("column string, dtype string, is_numeric boolean, null_pct double, mean double, median double, "
                "std double, q25 double, q75 double")
CATEGORY_STATS = "column string, value string, share double"


class DriftError(ValueError):
    """Drift cannot be computed for this input."""


def profile(df: DataFrame, skip_dates: bool = False, approx: bool = False) -> dict:
    """DR-1: `rows`, `columns` (one row per column) and `categories` (column, value, share of non-null).

    Shares stay a table of their own: a text column can have as many values as rows.
    """
    df = nan_to_null(df)
    numeric = numeric_columns(df, booleans=True)
    other = [c for c in df.columns if c not in numeric]
    if skip_dates:
        other = [c for c in other if df.schema[c].dataType.simpleString() not in ("date", "timestamp", "timestamp_ntz")]
    fields = {f.name: f for f in df.schema}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(col(c)).alias(f"n{i}"))
        if c in numeric:
            x = as_number(fields[c])
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    one = df.agg(*aggs).first()
    rows = one["rows"]
    quart = exact_quantiles(df, {c: as_number(fields[c]) for c in numeric}, [0.25, 0.5, 0.75], rows=rows, approx=approx)
    clean = lambda v: None if v is None or v != v else float(v)
    records = []
    for i, c in enumerate(df.columns):
        q = quart.get(c, [None] * 3)
        num = c in numeric
        records.append((c, fields[c].dataType.simpleString(), num,
                        (rows - one[f"n{i}"]) / rows if rows else None,
                        clean(one[f"m{i}"]) if num else None, clean(q[1]), clean(one[f"s{i}"]) if num else None,
                        clean(q[0]), clean(q[2])))
    spark = df.sparkSession
    counts = value_counts(df, other) if other else None
    if counts is None:
        shares = spark.createDataFrame([], CATEGORY_STATS)
    else:
        totals = {c: one[f"n{df.columns.index(c)}"] for c in other}
        total = F.element_at(F.create_map(*[F.lit(x) for kv in totals.items() for x in kv]), F.col("column"))
        shares = counts.select("column", "value", F.try_divide(F.col("n").cast("double"), total).alias("share"))
    return {"rows": rows, "columns": spark.createDataFrame(records, COLUMN_STATS), "categories": shares}


def _signed(x: Column) -> Column:
    return F.format_string("%+.1f%%", x * 100)


def schema_changes(current: dict, base: dict) -> DataFrame:
    """DR-2: (column, change, was, now) of added, removed and retyped columns."""
    b = base["columns"].select(F.col("column"), F.col("dtype").alias("was"))
    c = current["columns"].select(F.col("column"), F.col("dtype").alias("now"))
    both = b.join(c, "column", "full_outer")
    change = (F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
              .when(F.col("was") != F.col("now"), "retyped"))
    return both.withColumn("change", change).filter("change is not null").select("column", "change", "was", "now")


def schema_drift(changes: DataFrame) -> DataFrame:
    n = F.count("*")
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "change", "column"))), ", ")
    return changes.agg(n.alias("n"), text.alias("t")).filter("n > 0").select(
        F.lit("schema_drift").alias("check"), F.lit(None).cast("string").alias("column"),
        F.lit(sev.HIGH).alias("severity"), F.col("n").cast("double").alias("actual_value"),
        F.concat(F.lit("schema drift: "), F.col("t")).alias("detail"))


def volume_drift(spark, current_rows: int, base_rows: int) -> DataFrame:
    """DR-3."""
    if base_rows == 0:
        raise DriftError("the baseline has no rows; volume drift is undefined")
    change = (current_rows - base_rows) / base_rows
    d = spark.createDataFrame([(change, current_rows, base_rows)], "x double, now long, was long")
    return d.withColumn("severity", sev.ladder(F.abs("x"), VOLUME_BANDS, inclusive=False)).filter(
        "severity is not null").select(
        F.lit("volume_drift").alias("check"), F.lit(None).cast("string").alias("column"), "severity",
        F.col("x").alias("actual_value"),
        F.concat(F.lit("row count "), _signed(F.col("x")), F.format_string(" (%d to %d)", "was", "now"))
        .alias("detail"))


def _relative(now: Column, was: Column, what: Column) -> Column:
    broken = F.raise_error(F.concat(what, F.lit(": the baseline value is zero and the current value is not")))
    return (F.when(now.isNull() | was.isNull(), None).when(was != 0, (now - was) / F.nullif(was, F.lit(0.0)))
            .when(now == 0, 0.0).otherwise(broken.cast("double")))


def numeric_shifts(current: dict, base: dict, skip: list[str]) -> DataFrame:
    """DR-4 to DR-6 raw: (column, mean_shift, median_shift, std_ratio) of the comparable numeric columns."""
    b = base["columns"].filter("mean is not null").select(
        "column", *[F.col(c).alias(f"b_{c}") for c in ("mean", "median", "std")])
    c = current["columns"].filter("is_numeric")
    d = c.join(b, "column").filter(~F.col("column").isin(skip)) if skip else c.join(b, "column")
    ratio = (F.when(F.col("std").isNull() | F.col("b_std").isNull(), None)
             .when(F.col("b_std") != 0, F.col("std") / F.nullif("b_std", F.lit(0.0)))
             .when(F.col("std") == 0, None)
             .otherwise(F.raise_error(F.concat(F.col("column"), F.lit(": the baseline std is zero and the current is not")))
                        .cast("double")))
    return d.select("column",
                    _relative(F.col("mean"), F.col("b_mean"), F.col("column")).alias("mean_shift"),
                    _relative(F.col("median"), F.col("b_median"), F.col("column")).alias("median_shift"),
                    ratio.alias("std_ratio"))


def std_severity(ratio: Column) -> Column:
    return (F.when((ratio > STD_RATIO_HIGH[1]) | (ratio < STD_RATIO_HIGH[0]), sev.HIGH)
            .when((ratio > STD_RATIO_MEDIUM[1]) | (ratio < STD_RATIO_MEDIUM[0]), sev.MEDIUM))


def numeric_drift(shifts: DataFrame) -> DataFrame:
    """DR-4 to DR-6 as findings."""
    shift = lambda check, c, word: F.struct(
        F.lit(check).alias("check"), F.col("column"),
        sev.ladder(F.abs(c), SHIFT_BANDS, inclusive=False).alias("severity"), F.col(c).alias("actual_value"),
        F.concat(F.col("column"), F.lit(f" {word} "), _signed(F.col(c)), F.lit(" vs baseline")).alias("detail"))
    spread = F.struct(
        F.lit("variance_shift").alias("check"), F.col("column"), std_severity(F.col("std_ratio")).alias("severity"),
        F.col("std_ratio").alias("actual_value"),
        F.concat(F.col("column"), F.format_string(" std ratio %.2f vs baseline", "std_ratio")).alias("detail"))
    return shifts.select(F.inline(F.array(
        shift("mean_shift", "mean_shift", "mean"), shift("median_shift", "median_shift", "median"), spread,
    ))).filter("severity is not null")


def category_shares(current: dict, base: dict, columns: list[str]) -> DataFrame:
    """(column, value, base_share, current_share) over the union of categories, 0 where absent.

    Both sides are added up in one group-by; every (column, value) occurs once per side.
    """
    zero = F.lit(0.0)
    both = base["categories"].select("column", "value", F.col("share").alias("b"), zero.alias("c")).unionAll(
        current["categories"].select("column", "value", zero.alias("b"), F.col("share").alias("c")))
    return both.filter(F.col("column").isin(columns)).groupBy("column", "value").agg(
        F.sum("b").alias("base_share"), F.sum("c").alias("current_share"))


def psi(shares: DataFrame) -> DataFrame:
    """DR-7 raw: (column, psi) over all categories."""
    floor = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(PSI_FLOOR))
    b, c = floor("base_share"), floor("current_share")
    return shares.groupBy("column").agg(F.sum((c - b) * F.ln(c / b)).alias("psi"))


def psi_drift(scores: DataFrame) -> DataFrame:
    severity = F.when(F.col("psi") > PSI_HIGH, sev.HIGH).when(F.col("psi") >= PSI_MEDIUM, sev.MEDIUM)
    return scores.select(
        F.lit("categorical_psi").alias("check"), "column", severity.alias("severity"), F.col("psi").alias("actual_value"),
        F.concat(F.col("column"), F.format_string(" PSI %.3f vs baseline", "psi")).alias("detail"),
    ).filter("severity is not null")


def new_categories(shares: DataFrame) -> DataFrame:
    """DR-8: every category that the baseline lacks, with its share."""
    return shares.filter("base_share = 0 and current_share > 0").select(
        "column", "value", F.col("current_share").alias("share"))


def missing_categories(shares: DataFrame) -> DataFrame:
    """DR-9: every category that is gone, with its former share."""
    return shares.filter("current_share = 0 and base_share > 0").select(
        "column", "value", F.col("base_share").alias("share"))


def category_drift(shares: DataFrame) -> DataFrame:
    make = lambda d, check, severity, bound, words: d.filter(F.col("share") > bound).select(
        F.lit(check).alias("check"), "column", F.lit(severity).alias("severity"), F.col("share").alias("actual_value"),
        F.format_string(f"%s: {words} '%s' (%.1f%%)", F.col("column"), F.col("value"), F.col("share") * 100)
        .alias("detail"))
    # At most 1/bound categories per column pass the filter.
    return make(missing_categories(shares), "missing_category", sev.HIGH, MISSING_SHARE, "missing category").unionAll(
        make(new_categories(shares), "new_category", sev.MEDIUM, NEW_SHARE, "new category"))


def roll_up(findings: DataFrame) -> DataFrame:
    """DR-10: one row (overall_severity, findings, high, medium, low, drift_summary, recommendations)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    advice = F.when(F.col("severity") == sev.HIGH, F.concat(
        F.lit("Investigate "), F.coalesce("column", F.lit("dataset")), F.lit(" "),
        F.translate("check", "_", " "), F.lit(" ("), F.col("detail"), F.lit(") before trusting this period.")))
    d = findings.agg(sev.worst(F.col("severity")).alias("overall_severity"), F.count("*").alias("findings"),
                     n(sev.HIGH).alias("high"), n(sev.MEDIUM).alias("medium"), n(sev.LOW).alias("low"),
                     F.array_sort(F.collect_list(advice)).alias("recommendations"))
    text = F.when(F.col("findings") == 0, "No drift detected against baseline.").otherwise(F.concat(
        F.format_string("%d drift findings: %d high, %d medium, %d low; overall ", "findings", "high", "medium", "low"),
        F.col("overall_severity")))
    return d.select("overall_severity", "findings", "high", "medium", "low", text.alias("drift_summary"),
                    "recommendations")


def compare(current: dict, base: dict) -> dict[str, DataFrame]:
    """DR-12: all drift tables of two profiles. Nothing is written."""
    if current["rows"] == 0:
        raise DriftError("the current table is empty")
    changes = pin(schema_changes(current, base))
    flagged = [r["column"] for r in changes.collect()]
    spark = changes.sparkSession
    shifts = numeric_shifts(current, base, flagged)
    b_text = {r["column"] for r in base["columns"].filter("not is_numeric").collect()}
    c_text = {r["column"] for r in current["columns"].filter("not is_numeric").collect()}
    shares = category_shares(current, base, sorted((b_text & c_text) - set(flagged)))
    parts = [schema_drift(changes), volume_drift(spark, current["rows"], base["rows"]), numeric_drift(shifts),
             psi_drift(psi(shares)), category_drift(shares)]
    findings = pin(reduce(DataFrame.unionAll, parts))
    return {"findings": findings, "schema": changes, "shifts": shifts, "new_categories": new_categories(shares),
            "missing_categories": missing_categories(shares), "summary": roll_up(findings)}


def drift(df: DataFrame, base: dict) -> dict[str, DataFrame]:
    return compare(profile(df), base)


def alerts(findings: DataFrame, thresholds: dict[str, float], dataset: str) -> DataFrame:
    """DR-13: mean shifts that were findings and exceed the column's threshold."""
    if any(t <= 0 for t in thresholds.values()):
        raise ValueError("thresholds must be above zero")
    table = findings.sparkSession.createDataFrame(list(thresholds.items()) or [], "column string, threshold double")
    hit = findings.filter(F.col("check") == "mean_shift").join(F.broadcast(table), "column")
    return hit.filter(F.abs("actual_value") > F.col("threshold")).select(
        F.expr("uuid()").alias("alert_id"), F.current_timestamp().alias("triggered_at"),
        F.lit("mean_shift").alias("rule_type"), "column", "threshold", "actual_value", "severity", "detail",
        F.lit(dataset).alias("dataset"))


def run(df: DataFrame, store, key: str, batch: int | None = None) -> dict[str, DataFrame] | None:
    """DR-11: compare with the stored baseline and rotate it. A stream batch that comes again changes nothing.

    No baseline: create one, return None. A high finding resets the counter; the
    fourth clean run in a row makes the current profile the new baseline.
    """
    base = store.load(key, before=batch)
    current = profile(df)
    if base is None:
        store.save(key, current, clean_runs=0, batch=batch)
        return None
    report = compare(current, base)
    high = report["summary"].first()["overall_severity"] == sev.HIGH
    runs = 0 if high else base["clean_runs"] + 1
    if runs >= ROTATE_AFTER:
        store.save(key, current, clean_runs=0, batch=batch)
    else:
        store.touch(key, base, runs, batch=batch)
    return report


def monitor(df: DataFrame, store, key: str, thresholds: dict[str, float]) -> DataFrame | None:
    """DR-14: alerts against the stored baseline, which is only read."""
    base = store.load(key)
    if base is None:
        return None
    return alerts(drift(df, base)["findings"], thresholds, key)
