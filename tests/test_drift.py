import datetime as dt
import os

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablewright.operators import drift as d
from tablewright.plans import reports
from tablewright.sources.sinks import BaselineStore

DAY = dt.datetime(2026, 1, 1)


def numbers(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def texts(spark, *counts):
    return spark.createDataFrame([(t,) for t, n in counts for _ in range(n)], "region string")


def findings(base, now):
    out = d.drift(now, d.profile(base))
    return {(r["check"], r["column"]): r for r in out["findings"].collect()}, out["summary"].first()


def test_no_drift_against_itself(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(days=k), "NSEW"[k % 4], 1000.0 + k) for k in range(50)], "date timestamp, region string, revenue double")
    found, summary = findings(df, df)
    assert found == {} and summary["overall_severity"] == "low" and summary["recommendations"] == []


def test_mean_and_median(spark):
    found, summary = findings(numbers(spark, [10, 20, 30, 40, 50]), numbers(spark, [22, 32, 42, 52, 62]))
    assert found["mean_shift", "x"]["actual_value"] == pytest.approx(0.4) and found["mean_shift", "x"]["severity"] == "high"
    assert found["median_shift", "x"]["severity"] == "high" and ("variance_shift", "x") not in found
    assert summary["overall_severity"] == "high" and len(summary["recommendations"]) == 2


def test_variance(spark):
    found, _ = findings(numbers(spark, [20, 25, 30, 35, 40]), numbers(spark, [5, 17.5, 30, 42.5, 55]))
    assert list(found) == [("variance_shift", "x")] and found["variance_shift", "x"]["actual_value"] == pytest.approx(2.5)


@pytest.mark.parametrize("shift, severity", [(0.05, None), (0.06, "low"), (0.151, "medium"), (0.31, "high")])
def test_bands_are_strict(spark, shift, severity):
    found, _ = findings(numbers(spark, [100] * 5), numbers(spark, [100 * (1 + shift)] * 5))
    assert (found["mean_shift", "x"]["severity"] if found else None) == severity


def test_volume(spark):
    found, _ = findings(numbers(spark, [1, 2] * 50), numbers(spark, [1, 2] * 80))
    assert found["volume_drift", None]["actual_value"] == pytest.approx(0.6) and found["volume_drift", None]["severity"] == "high"


def test_psi(spark):
    found, _ = findings(texts(spark, ("a", 90), ("b", 10)), texts(spark, ("a", 10), ("b", 90)))
    assert list(found) == [("categorical_psi", "region")]
    assert found["categorical_psi", "region"]["actual_value"] == pytest.approx(3.515559, abs=1e-5)


def test_new_and_missing_categories(spark):
    found, _ = findings(texts(spark, ("a", 50), ("b", 50)), texts(spark, ("a", 50), ("c", 50)))
    assert found["categorical_psi", "region"]["actual_value"] == pytest.approx(8.515490, abs=1e-4)
    assert found["missing_category", "region"]["severity"] == "high" and found["new_category", "region"]["severity"] == "medium"


def test_schema_change_hides_the_column(spark):
    base = spark.createDataFrame([(1.0, "n"), (2.0, "s")] * 2, "revenue double, region string")
    now = spark.createDataFrame([("1", 0.1)] * 4, "revenue string, discount double")
    found, _ = findings(base, now)
    assert list(found) == [("schema_drift", None)] and found["schema_drift", None]["actual_value"] == 3.0


def test_zero_baseline_is_an_error(spark):
    with pytest.raises(Exception, match="baseline value is zero"):
        findings(numbers(spark, [0, 0, 0, 0]), numbers(spark, [5, 6, 7, 8]))
    assert findings(numbers(spark, [0, 0]), numbers(spark, [0, 0]))[0] == {}
    with pytest.raises(d.DriftError):
        d.compare(d.profile(numbers(spark, [])), d.profile(numbers(spark, [1])))
    with pytest.raises(d.DriftError):
        d.volume_drift(spark, 5, 0)


def test_booleans_and_dates(spark):
    base = spark.createDataFrame([(True, DAY)] * 3 + [(False, DAY)] * 3, "b boolean, t timestamp")
    p = d.profile(base)
    assert p["columns"].filter("column = 'b'").first()["mean"] == 0.5
    assert p["categories"].select("column").distinct().first()["column"] == "t"
    assert d.profile(base, skip_dates=True)["categories"].count() == 0


def test_alerts_only_for_breached_thresholds(spark):
    data = [("mean_shift", "revenue", "high", 0.32, ""), ("mean_shift", "units", "high", -0.40, ""), ("mean_shift", "cost", "low", 0.03, ""),
            ("median_shift", "cost", "high", 0.9, "")]
    f = spark.createDataFrame(data, d.FINDING)
    out = d.alerts(f, {"revenue": 0.15, "units": 0.20, "cost": 0.50, "other": 0.1}, "k")
    assert sorted(r["column"] for r in out.collect()) == ["revenue", "units"]
    with pytest.raises(ValueError):
        d.alerts(f, {"revenue": 0.0}, "k")


def test_rotation_and_monitoring(spark, folder):
    base = spark.createDataFrame([("NSEW"[k % 4], 1000.0 + k) for k in range(50)], "region string, revenue double")
    store = BaselineStore(spark, folder)
    assert d.monitor(base, store, "sales", {"revenue": 0.1}) is None
    assert d.run(base, store, "sales") is None
    near, far = base.withColumn("revenue", F.col("revenue") * 1.03), base.withColumn("revenue", F.col("revenue") * 1.4)
    counts = []
    for df in (near, near, far, near, near, near):
        d.run(df, store, "sales")
        counts.append(store.load("sales")["clean_runs"])
    assert counts == [1, 2, 0, 1, 2, 3]
    old = store.load("sales")["profile"]
    d.run(near, store, "sales")
    new = store.load("sales")
    assert new["clean_runs"] == 0 and new["profile"] != old
    mean = new["columns"].filter("column = 'revenue'").first()["mean"]
    assert mean == pytest.approx(1024.5 * 1.03)
    version = new["version"]
    log = f"{folder}/alerts"
    found = reports.monitor_to_log(far, store, "sales", {"revenue": 0.2}, log)
    assert found.count() == 1 and spark.read.json(log).count() == 1
    assert store.load("sales")["version"] == version


def test_corrupt_baseline_and_unsafe_key(spark, folder):
    store = BaselineStore(spark, folder)
    os.makedirs(f"{folder}/bad/versions")
    with open(f"{folder}/bad/versions/part-0.parquet", "w") as f:
        f.write("nonsense")
    with pytest.raises(d.DriftError):
        store.load("bad")
    for key in ("../x", "a/b", "", ".hidden"):
        with pytest.raises(ValueError):
            store.load(key)
