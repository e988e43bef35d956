import numpy as np
import pytest
from helpers import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.functions.chunks import POS, with_position
from tablewright.operators import cleaning as c, forest, neighbours, quality as q


@pytest.fixture(scope="module")
def dirty(spark):
    data = [("north", None, "1", 1.0), ("North", None, "2", 2.0), ("north", -5.0, "3", 3.0), ("NORTH", 4.0, "oops", 4.0),
            ("south", 5.0, "5", 5.0), ("south", 6.0, "6", 6.0), ("south", 6.0, "6", 6.0), ("east", 7.0, "7", 7.5),
            ("east", 8.0, "8", 8.0), ("west", 9.0, "9", 9.0), ("west", 1.0, "10", 9.5), ("north", 2.0, "11", 9.7)]
    df = spark.createDataFrame(data, "region string, quantity double, code string, `amount#` double")
    return df.withColumn("code", F.parse_json(F.when(F.col("code") == "oops", '"oops"').otherwise(F.col("code"))))


def test_gated_pass_fixes_only_autonomous_findings(dirty):
    before = q.assess(dirty)["defects"]
    kinds = {r["defect_type"] for r in before.collect()}
    assert {"mixed_types", "column_naming", "null_values", "negative_values", "case_inconsistency", "duplicate_rows"} <= kinds
    out = c.clean(dirty, before)
    table = out["table"]
    after = {r["defect_type"] for r in q.assess(table)["defects"].collect()}
    assert not after & {"column_naming", "case_inconsistency", "duplicate_rows"}
    assert {"null_values", "negative_values"} <= after
    assert table.count() == 11 and "amount" in table.columns
    assert table.filter("quantity is null").count() == 2 and table.filter("quantity = -5").count() == 1
    actions = rows(out["actions"].select("operation", "status", "scope", "rows_affected"), "ordinal")
    assert actions == [("type_coercion", "applied", "column", 0), ("case_normalization", "applied", "column", 0),
                       ("deduplication", "applied", "row", 1), ("header_normalization", "applied", "table", 0)]
    assert out["summary"].first()["rows_after"] == 11
    assert {(r["variant"], r["canonical"]) for r in out["mappings"].collect()} == {("North", "north"), ("NORTH", "north")}


def test_second_pass_changes_nothing(dirty):
    once = c.clean(dirty, q.assess(dirty)["defects"])["table"]
    found = q.assess(once)["defects"].filter("defect_type <> 'mixed_types'")
    twice = c.clean(once, found)
    assert twice["actions"].count() == 0
    key = lambda df: sorted(str(r) for r in df.withColumn("code", F.col("code").cast("string")).collect())
    assert key(once) == key(twice["table"])


def test_refuses_what_is_not_autonomous(dirty, spark):
    bad = {"defect_type": "null_values", "remediation_class": "human_only", "columns": ["quantity"]}
    with pytest.raises(c.CleaningError):
        c.apply_finding(dirty, bad)
    with pytest.raises(c.CleaningError):
        c.apply_finding(dirty, {**bad, "remediation_class": "agent_autonomous"})
    odd = q.assess(dirty)["defects"].filter("defect_type = 'null_values'").withColumn("remediation_class", F.lit("agent_autonomous"))
    out = c.clean(dirty, odd)
    assert rows(out["actions"].select("operation", "status")) == [("no_op", "skipped")] and out["table"].count() == 12
    none = q.assess(dirty)["defects"].withColumn("remediation_class", F.lit("human_only"))
    assert c.clean(dirty, none)["actions"].count() == 0


def test_failed_action_leaves_the_table(dirty):
    gone = q.assess(dirty)["defects"].filter("defect_type = 'case_inconsistency'").withColumn("columns", F.array(F.lit("no such")))
    out = c.clean(dirty, gone)
    a = out["actions"].first()
    assert a["status"] == "failed" and len(a["error"]) <= 240 and out["table"].count() == 12


@pytest.mark.parametrize("values, expect", [
    (["north", "North", "north", "north"], ["north"] * 4), (["North", "north"], ["North"] * 2), ([None, "a"], [None, "a"])])
def test_case(spark, values, expect):
    df = spark.createDataFrame([(v,) for v in values], "r string")
    assert sorted(str(r[0]) for r in c.normalize_case(df, "r").collect()) == sorted(map(str, expect))


@pytest.mark.parametrize("names, targets, expect", [
    (["Unit Price ($)", "2024", "  ok_col  "], None, ["unit_price", "column_1", "ok_col"]),
    (["A", "a", "a!"], None, ["a", "a_2", "a_3"]),
    (["amount#", "amount"], {"amount#"}, ["amount_2", "amount"]),
    (["", "__x__y", "x-y"], None, ["column_0", "x_y", "x_y_2"])])
def test_headers(names, targets, expect):
    assert c.header_mapping(names, targets) == expect


def test_coercion_never_makes_a_null(spark):
    v = spark.createDataFrame([(t,) for t in ("1", "2", '"oops"', "4", "5", '" 6 "', "null")], "t string").select(
        F.parse_json("t").alias("code"))
    out, meta = c.coerce_column(v, "code")
    m = meta.first()
    assert (m["kind"], m["dominant_type"], m["values_changed"], m["uncoerced"]) == ("numeric", "int", 1, 1)
    assert sorted(r[0] for r in out.selectExpr("cast(code as string)").collect() if r[0]) == ["1", "2", "4", "5", "6.0", "oops"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(["1", " 2 ", "x", "3.5", "", "true", "\t7"])), min_size=1, max_size=12))
def test_coercion_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    out, _ = c.coerce_column(df, "c")
    assert out.filter("c is null").count() == sum(v is None for v in values)


def test_strip_is_unicode(spark):
    df = spark.createDataFrame([(" a ",), ("\x1cb ",), ("c",)], "t string")
    assert [r[0] for r in c.strip_whitespace(df).collect()] == ["a", "b", "c"]
    assert c.strip_changes(df).first()["values_changed"] == 2


@pytest.mark.parametrize("method, expect", [
    ("mean", [1, 7 / 3, 3, 7 / 3, 3]), ("median", [1, 3, 3, 3, 3]), ("mode", [1, 3, 3, 3, 3]), ("forward_fill", [1, 1, 3, 3, 3])])
def test_impute(spark, method, expect):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0), (3, None), (4, 3.0)], "i long, x double")
    got = [r["x"] for r in c.impute_nulls(df, "x", method, order="i").orderBy("i").collect()]
    assert got == pytest.approx(expect)


def test_impute_errors(spark):
    df = spark.createDataFrame([("a", None)], "t string, n double")
    with pytest.raises(ValueError):
        c.impute_nulls(df, "t", "mean")
    with pytest.raises(ValueError):
        c.impute_nulls(df, "x", "mode")
    with pytest.raises(ValueError):
        c.impute_nulls(df, "t", "guess")
    assert c.impute_nulls(df, "n", "mode").first()["n"] is None


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (9, None), (7, None)], "p long, t string")
    kept = c.drop_exact_duplicates(with_position(df, "p").select("t", POS), keep_position=True)
    assert sorted((r["t"] or "", r[POS]) for r in kept.collect()) == [("", 7), ("a", 1), ("b", 2)]


def test_statistical_clip(spark):
    df = spark.createDataFrame([(float(v),) if v is not None else (None,) for v in [*range(1, 21), 1000, None]], "x double")
    got = sorted(r["x"] for r in c.statistical_clean(df).collect())
    q1, q3 = np.quantile([*range(1, 21), 1000], [0.25, 0.75])
    assert got[-1] == q3 + 1.5 * (q3 - q1) and got.count(11.0) == 2


def test_domain_clean(spark):
    df = spark.createDataFrame([(1, "2024-01-01", -1.0), (2, "2024-01-02", 5.0), (3, "2024-02-01", None)], "i int, d string, unit_price double")
    out = c.domain_clean(df)
    assert rows(out.select("i")) == [(2,)] and dict(out.dtypes)["d"] == "timestamp"


# ---- nearest neighbours against brute force

def brute(x, k):
    d = neighbours._distances(x, x)
    out = x.copy()
    for i, f in zip(*np.nonzero(np.isnan(x))):
        ok = [j for j in range(len(x)) if not np.isnan(x[j, f]) and not np.isnan(d[i, j])]
        ok.sort(key=lambda j: (d[i, j], tuple(np.nan_to_num(x[j], nan=-np.inf))))
        out[i, f] = np.mean([x[j, f] for j in ok[:k]]) if ok else np.nanmean(x[:, f])
    return out


@pytest.mark.parametrize("block_rows, step", [(40, 0), (40, 1), (100_000, 1), (7, 2)])
def test_neighbours_equal_brute_force(spark, block_rows, step):
    rng = np.random.default_rng(step)
    x = rng.normal(size=(240, 3)) * [1, 10, 3]
    if step:
        x = np.round(x, step - 1)
    x[:80] = x[0]  # a third of the rows are copies
    x[rng.random(x.shape) < 0.2] = np.nan
    x[-1] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
                               "i long, a double, b double, c double")
    got = neighbours.impute_neighbours(df, ["a", "b", "c"], 5, block_rows).orderBy("i").toPandas()[["a", "b", "c"]].to_numpy()
    assert np.abs(got - brute(x, 5)).max() < 1e-9


def test_each_isolation_tree_draws_from_the_whole_table(spark):
    n = 60_000
    drawn = forest.samples(spark.range(0, n, 1, 4), [F.col("id").cast("double")]).toPandas()
    trees = {t: forest._least(g)[:, 0] for t, g in drawn.groupby("tree")}
    assert len(trees) == forest.TREES and all(len(set(x)) == forest.SAMPLE for x in trees.values())
    every = np.concatenate(list(trees.values()))
    # 25,600 draws from 60,000 rows hit 20,840 of them on average; from a pool of 25,600 rows only 16,180.
    assert 20_300 < len(set(every)) < 21_400
    assert np.allclose(np.histogram(every, 4, (0, n))[0] / len(every), 0.25, atol=0.02)
    assert forest.isolation_scores(spark.range(0), ["id"]).count() == 0
    few = forest.isolation_scores(spark.range(5), ["id"]).collect()
    assert all(0 < r[forest.SCORE] < 1 for r in few)


def test_isolation_forest_drops_the_odd_rows(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(950, 2)), rng.uniform(8, 12, size=(50, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double")
    kept = {r["i"] for r in forest.drop_isolated(df, ["a", "b"], 0.1).collect()}
    assert 890 <= len(kept) <= 910 and sum(i >= 950 for i in kept) == 0
    again = {r["i"] for r in forest.drop_isolated(df, ["a", "b"], 0.1).collect()}
    assert kept == again


def test_window_of_a_block_holds_the_nearest_and_little_else():
    from tablewright.operators import neighbours as nb

    rng = np.random.default_rng(6)
    for null in (None, 1):
        b = np.column_stack([rng.integers(0, 100_000, 20_000), rng.integers(0, 50, 20_000), rng.normal(size=20_000)]).astype(float)
        if null is not None:
            b[:, null] = np.nan
        a = b[np.argsort(b[:, 0])[4000:4100]] + np.array([0.5, 0.0, 0.1])
        a[:, 2] = np.nan
        kept = nb._window(a, b, 5)
        assert len(kept) < 4_000 and (np.diff(kept) > 0).all()
        d = nb._distances(a, b)
        for row in d:
            assert np.isin(np.flatnonzero(row <= np.partition(row, 4)[4]), kept).all()
    assert len(nb._window(np.full((1, 3), np.nan), b, 5)) == len(b)
