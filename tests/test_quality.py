import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablewright.operators import quality as q
from tablewright.plans import reports

DAY = dt.datetime(2026, 1, 1)


def sales(spark, n, revenue, extra=None):
    data = [(DAY + dt.timedelta(days=i), "NSEW"[i % 4], revenue(i)) for i in range(n)]
    return spark.createDataFrame(data + (extra or []), "date timestamp, region string, revenue double")


def found(df, **options):
    out = q.assess(df, **options)
    return {(r["defect_type"], r["columns"][0]): r for r in out["defects"].collect()}, out["summary"].first(), out


def test_clean_table_scores_full(spark):
    defects, summary, _ = found(sales(spark, 50, lambda i: 1000.0 + (i * 37 % 400) * 10))
    assert defects == {} and summary["quality_score"] == 100.0
    assert summary["overall_severity"] == "low" and not summary["has_critical_issues"] and summary["halt_reason"] is None


@pytest.mark.parametrize("every, n, severity", [(30, 100, "high"), (60, 100, "critical"), (6, 100, "medium"), (1, 100, "low")])
def test_null_ladder(spark, every, n, severity):
    df = sales(spark, n, lambda i: None if i < every else float(i))
    defects, summary, _ = found(df)
    d = defects["null_values", "revenue"]
    assert (d["count"], d["percentage"], d["severity"]) == (every, float(every), severity)
    assert summary["has_critical_issues"] == (severity == "critical")


def test_critical_null_halts_with_statistics(spark):
    df = sales(spark, 50, lambda i: None if i < 30 else (i - 30) * 100.0)
    out = reports.build_report(df)
    assert out["halted"] and "revenue" in out["halt_reason"]
    p = {r["column_name"]: r for r in out["quality"]["profiles"].collect()}["revenue"]
    assert p["mean_val"] == 950 and p["std_val"] == pytest.approx(591.608, abs=1e-3) and p["null_count"] == 30


@pytest.mark.parametrize("copies, rest, severity", [(90, 10, "critical"), (4, 96, "low")])
def test_duplicates(spark, copies, rest, severity):
    data = [(DAY, "N", 1.0)] * copies + [(DAY + dt.timedelta(days=i + 1), "S", float(i)) for i in range(rest)]
    defects, _, _ = found(spark.createDataFrame(data, "date timestamp, region string, revenue double"))
    d = defects["duplicate_rows", "date"]
    assert (d["count"], d["severity"], d["remediation_class"]) == (copies - 1, severity, "agent_autonomous")


def test_mixed_cells_only_in_variant_or_lexical(spark):
    texts = ["1", "2", "3", "4", "5", "6", "7", "8", "9", '"three"']
    v = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("revenue"))
    d = found(v)[0]["mixed_types", "revenue"]
    assert (d["count"], d["percentage"], d["severity"]) == (1, 10.0, "medium")
    t = spark.createDataFrame([(x.strip('"'),) for x in texts], "revenue string")
    assert ("mixed_types", "revenue") not in found(t)[0]
    assert found(t, lexical=True)[0]["mixed_types", "revenue"]["count"] == 1


def test_dominant_type_tie_goes_to_the_smaller_name(spark):
    df = spark.createDataFrame([("1",), ("a",)], "c string")
    assert q.type_facts(df, lexical=True).first()["dominant"] == "int"


def test_statistical_flags(spark):
    flat = found(sales(spark, 50, lambda i: 100.0))[0]
    assert flat["zero_variance", "revenue"]["severity"] == "high" and flat["zero_variance", "revenue"]["count"] == 50
    spike = found(sales(spark, 100, lambda i: 5000.0 if i == 0 else 1000.0 + (i * 13 % 7)))[0]
    assert (spike["extreme_outliers", "revenue"]["count"], spike["extreme_outliers", "revenue"]["severity"]) == (1, "medium")
    negative = found(sales(spark, 10, lambda i: -500.0 if i == 3 else 10.0 + i))[0]
    assert negative["negative_values", "revenue"]["percentage"] == 10.0
    infinite = found(sales(spark, 10, lambda i: float("inf") if i == 3 else float(i)))[0]
    assert infinite["infinite_values", "revenue"]["count"] == 1


def test_nan_is_null(spark):
    defects, _, _ = found(sales(spark, 10, lambda i: float("nan") if i < 2 else float(i)))
    assert defects["null_values", "revenue"]["count"] == 2


def test_ids_names_and_redundant_columns(spark):
    data = [(i if i else 1, f"n{i % 3}", float(i), i * 2.0 + 1) for i in range(10)]
    defects, _, out = found(spark.createDataFrame(data, "id long, `a name` string, x double, `y#` double"))
    assert defects["non_unique_id", "id"]["count"] == 1
    assert ("column_naming", "y#") in defects and ("column_naming", "a name") not in defects
    pairs = [r["columns"] for r in out["defects"].filter("defect_type = 'duplicate_measurement'").collect()]
    assert ["x", "y#"] in pairs
    owners = {r["defect_type"]: r["remediation_class"] for r in out["defects"].collect()}
    assert owners["duplicate_measurement"] == "human_only" and owners["non_unique_id"] == "human_policy_agent_execution"


def test_unknown_finding_is_human_only_and_stamp_is_overwritten(spark):
    df = spark.createDataFrame([("brand_new", "agent_autonomous"), ("null_values", "x")], "defect_type string, remediation_class string")
    assert rows(q.with_owner(df), "defect_type") == [("brand_new", "human_only"), ("null_values", "human_policy_agent_execution")]


def test_empty_input_is_refused(spark):
    with pytest.raises(q.DataError):
        q.assess(spark.createDataFrame([], "a int"))
    with pytest.raises(q.DataError):
        q.require_rows([1, 2])


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 1.0, None if i % 2 else float(i)) for i in range(20)], "x double, c double, y double")
    got = {(r["a"], r["b"]): (r["r"], r["n"]) for r in q.pair_correlations(df).collect()}
    assert got["x", "c"][0] is None and got["x", "y"] == (pytest.approx(1.0), 10)


def test_large_offset_keeps_the_correlation(spark):
    df = spark.createDataFrame([(1e12 + i, 1e12 - i) for i in range(50)], "x double, y double")
    assert q.pair_correlations(df).first()["r"] == pytest.approx(-1.0, abs=1e-6)


def test_result_does_not_depend_on_partitions(spark):
    df = sales(spark, 60, lambda i: None if i % 7 == 0 else float(i % 11) - 2)
    a = rows(q.assess(df.repartition(1))["defects"].drop("details"), "ordinal")
    b = rows(q.assess(df.repartition(9))["defects"].drop("details"), "ordinal")
    assert a == b


def test_cleaning_method_rules(spark):
    base = (100, 3, ["a"], ["b"], [], 0)
    data = [(1, 31.0, 0.0, [], 99.0), (2, 5.0, 21.0, [], 99.0), (3, 5.0, 5.0, ["d"], 99.0), (4, 5.0, 5.0, [], 59.0), (5, 5.0, 5.0, [], 61.0)]
    df = spark.createDataFrame(data, "i int, missing_pct double, outlier_pct double, datetime_columns array<string>, quality_score double")
    got = {r["i"]: (r["method"], r["confidence"]) for r in q.recommend_cleaning(df).collect()}
    assert got == {1: ("ml_based", 0.9), 2: ("statistical", 0.8), 3: ("domain_specific", 0.85), 4: ("domain_specific", 0.85), 5: ("basic", 0.7)}


def test_legacy_profile_finds_date_text(spark):
    df = spark.createDataFrame([(float(i), f"2024-01-{i + 1:02d}", "x") for i in range(20)] + [(1000.0, None, None)], "n double, d string, t string")
    p = q.table_profile(df).first()
    assert p["datetime_columns"] == ["d"] and p["categorical_columns"] == ["t"] and p["duplicates"] == 0
    assert p["missing_pct"] == pytest.approx(2 / 63 * 100) and p["outlier_pct"] == pytest.approx(100 / 21)


def test_late_values_decide_about_dates(spark):
    texts = [f"2024-01-{1 + k % 28:02}" for k in range(150)] + ["no date"] * 250
    p = q.table_profile(spark.createDataFrame([(t, f"  2024-01-01{' ' * 60}") for t in texts], "late string, padded string")).first()
    assert p["datetime_columns"] == ["padded"] and p["categorical_columns"] == ["late"]
