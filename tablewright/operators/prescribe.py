"""Bounded linear optimum, change advice, actionable insights and analysis dispatch."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import as_number, nan_to_null, numeric_columns
from . import models, stats

# Fixed values.
MIN_ROWS, CHANGE_PCT, MISSING_PCT = 5, 5.0, 10.0


def feature_bounds(df: DataFrame, target: str) -> DataFrame:
    """(feature, low, high, mean) over the complete rows."""
    frame, features = _complete(df, target)
    row = frame.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(features)
                      for f, n in ((F.min, "lo"), (F.max, "hi"), (F.avg, "m"))])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high"),
                 F.col(f"m{i}").alias("mean")) for i, c in enumerate(features)])))


def _complete(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    df = nan_to_null(df)
    fields = {f.name: f for f in df.schema}
    features = [c for c in numeric_columns(df) if c != target]
    if not features:
        raise models.ModelError("no numeric features to optimise")
    return df.select([as_number(fields[c]).alias(c) for c in [*features, target]]).na.drop(), features


def optimize(df: DataFrame, target: str, objective: str = "maximize") -> dict[str, DataFrame]:
    """PR-1: `features` (position, feature, coefficient, bounds, optimal value, change) and `outcome` (one row).

    The fitted outcome is linear, so the optimum inside the observed ranges is a
    corner: the upper bound where the coefficient helps, the lower where it hurts,
    the mean where it is zero.
    """
    frame, features = _complete(df, target)
    if frame.count() < MIN_ROWS:
        raise models.ModelError(f"at least {MIN_ROWS} complete rows are needed")
    ready = VectorAssembler(inputCols=features, outputCol="_x").transform(frame)
    fit = LinearRegression(featuresCol="_x", labelCol=target, solver="normal").fit(ready)
    spark = df.sparkSession
    weights = spark.createDataFrame([(i, f, float(w)) for i, (f, w) in enumerate(zip(features, fit.coefficients.toArray()))],
                                    "position int, feature string, coefficient double")
    sign = 1.0 if objective == "maximize" else -1.0
    gain = F.col("coefficient") * F.lit(sign)
    table = feature_bounds(df, target).join(weights, "feature").withColumn(
        "optimal", F.when(gain > 0, F.col("high")).when(gain < 0, F.col("low")).otherwise(F.col("mean"))
    ).withColumn("change", F.col("optimal") - F.col("mean")).withColumn(
        "percent_change", F.coalesce(F.try_divide(F.col("change"), F.col("mean")) * 100, F.lit(0.0)))
    average = frame.agg(F.avg(f"`{target}`").alias("m")).first()["m"]
    outcome = table.agg((F.sum(F.col("coefficient") * F.col("optimal")) + F.lit(float(fit.intercept))).alias("p")).select(
        F.lit(f"{objective} {target}").alias("objective"), F.col("p").alias("predicted_outcome"),
        F.lit(average).alias("current_average_outcome"), (F.col("p") - F.lit(average)).alias("improvement"))
    return {"features": table, "outcome": outcome}


def change_advice(features: DataFrame) -> DataFrame:
    """PR-2: features whose optimum is more than 5 % away from the mean."""
    way = F.when(F.col("change") > 0, "Increase").otherwise("Decrease")
    return features.filter(F.abs("percent_change") > CHANGE_PCT).select(
        "position", "feature", F.col("mean").alias("current_average"), F.col("optimal").alias("recommended_value"), "change",
        "percent_change",
        F.concat(way, F.lit(" "), F.col("feature"), F.format_string(" by %.1f%%", F.abs("percent_change")))
        .alias("action"))


def actionable_insights(info: DataFrame | None = None, strong: DataFrame | None = None,
                        choice: DataFrame | None = None, advice: DataFrame | None = None) -> DataFrame:
    """PR-3: (step, insight) from whatever result tables exist."""
    parts = []
    if info is not None:
        pct = F.try_divide(F.col("missing_values_total") * 100.0, F.col("total_rows") * F.col("total_columns"))
        parts.append(info.filter(pct > MISSING_PCT).select(
            F.lit(0).alias("step"),
            F.format_string("High missing data (%.1f%%): consider imputation or better collection", pct).alias("insight")))
        parts.append(info.filter("duplicate_rows > 0").select(
            F.lit(1).alias("step"),
            F.format_string("Remove %d duplicate rows to improve data quality", "duplicate_rows").alias("insight")))
    if strong is not None:
        parts.append(strong.orderBy(F.desc(F.abs("correlation")), "feature1", "feature2").limit(1).select(
            F.lit(2).alias("step"),
            F.format_string("Strong relationship found: %s and %s (r=%.3f)", "feature1", "feature2", "correlation")
            .alias("insight")))
    if choice is not None:
        parts.append(choice.select(F.lit(3).alias("step"),
                                   F.concat(F.lit("Model recommendation: "), F.col("recommendation")).alias("insight")))
    if advice is not None:
        parts.append(advice.orderBy("position").limit(3).select(F.lit(4).alias("step"),
                                            F.concat(F.col("action"), F.lit(" to improve outcomes")).alias("insight")))
    return reduce(DataFrame.unionByName, parts)


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))


def _model(df: DataFrame, target: str) -> dict[str, DataFrame]:
    if _numeric(df, target):
        out = models.regression_models(df, target)
        return {**out, "choice": models.best_model(out["metrics"], "R²")}
    out = models.classification_models(df, target)
    return {**out, "choice": models.best_model(out["metrics"], "Accuracy")}


def analyze_by_type(df: DataFrame, kind: str, target: str | None = None, feature: str | None = None,
                    objective: str | None = None) -> dict[str, DataFrame]:
    """PR-4 for one analysis type; result tables by name."""
    if kind == "descriptive":
        return {**stats.dataset_info(df), "numeric": stats.numeric_summary(df), "categorical": stats.categorical_summary(df)}
    if kind == "diagnostic":
        pairs = stats.pearson_matrix(df)
        out = {"pearson": pairs, "spearman": stats.spearman_matrix(df), "strong": stats.strong_correlations(pairs),
               "insights": stats.correlation_insights(pairs)}
        if target and feature:
            out["hypothesis"] = stats.hypothesis_test(df, target, feature)
        return out
    if kind not in ("predictive", "prescriptive"):
        raise ValueError(f"unknown analysis type {kind!r}")
    if not target:
        raise ValueError(f"{kind} analysis needs a target column")
    if kind == "predictive":
        return _model(df, target)
    out = optimize(df, target, objective or "maximize")
    out["advice"] = change_advice(out["features"])
    out["actionable"] = actionable_insights(advice=out["advice"])
    return out


def full_analysis(df: DataFrame, target: str | None = None) -> dict[str, dict[str, DataFrame]]:
    """PR-4: all four parts; models and optimum only with a target, the optimum only for a numeric one."""
    out = {"descriptive": analyze_by_type(df, "descriptive"), "diagnostic": analyze_by_type(df, "diagnostic"),
           "predictive": {}, "prescriptive": {}}
    choice = advice = None
    if target and target in df.columns:
        out["predictive"] = _model(df, target)
        choice = out["predictive"]["choice"]
        if _numeric(df, target):
            out["prescriptive"] = optimize(df, target)
            advice = out["prescriptive"]["advice"] = change_advice(out["prescriptive"]["features"])
    out["prescriptive"]["actionable"] = actionable_insights(
        out["descriptive"]["info"], out["diagnostic"]["strong"], choice, advice)
    return out
