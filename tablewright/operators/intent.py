"""Questions in batch: intent by keywords, column mentions, stored replies, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import col, numeric_columns, text_columns
from . import prescribe, stats

# Analysis types in rank order with their keywords.
KEYWORDS = {
    "descriptive": ["summary", "describe", "statistics", "mean", "average", "count", "distribution", "overview"],
    "diagnostic": ["correlation", "relationship", "why", "cause", "impact", "influence", "affect", "related"],
    "predictive": ["predict", "forecast", "future", "will", "model", "estimate", "trend"],
    "prescriptive": ["optimize", "recommend", "should", "best", "improve", "action", "strategy"],
}
# The larger lists used together with a data profile.
PROFILE_KEYWORDS = {
    "descriptive": ["summary", "describe", "statistics", "mean", "median", "distribution", "frequency", "count",
                    "average", "overview", "profile", "explore"],
    "diagnostic": ["why", "cause", "reason", "correlation", "relationship", "impact", "influence", "factor",
                   "explain", "analyze", "drill down"],
    "predictive": ["predict", "forecast", "future", "trend", "model", "regression", "classification",
                   "machine learning", "estimate", "project"],
    "prescriptive": ["recommend", "optimize", "suggest", "should", "best", "improve", "decision", "action",
                     "strategy", "solution", "maximize", "minimize"],
}
NO_HIT_CONFIDENCE = 0.3
TYPES = list(KEYWORDS)

# Methods, charts and focus per type, and the next steps.
METHODS = {
    "descriptive": (["summary_statistics", "distributions", "correlations"],
                    ["histograms", "box_plots", "scatter_plots"], "Understanding current state of data"),
    "diagnostic": (["correlation_analysis", "regression_analysis", "hypothesis_testing"],
                   ["heatmaps", "regression_plots", "feature_importance"], "Understanding why things happened"),
    "predictive": (["time_series_analysis", "machine_learning", "forecasting"],
                   ["trend_lines", "prediction_intervals", "model_performance"], "Predicting future outcomes"),
    "prescriptive": (["optimization", "simulation", "decision_trees"],
                     ["decision_trees", "optimization_plots", "scenario_analysis"], "Recommending best actions"),
}
NEXT_STEPS = {
    "descriptive": ["Generate summary statistics", "Create data visualizations", "Identify patterns and trends"],
    "diagnostic": ["Perform correlation analysis", "Conduct hypothesis testing",
                   "Analyze relationships between variables"],
    "predictive": ["Prepare features for modeling", "Split data into training/testing sets",
                   "Build and validate predictive models"],
    "prescriptive": ["Define optimization objectives", "Identify decision variables",
                     "Build recommendation engine"],
}
# Answer texts.
ANSWERS = {
    "descriptive": "Your dataset has %d rows and %d columns. It contains %d numeric and %d categorical features with %d missing values.",
    "diagnostic": "Found strong correlation between %s and %s (correlation: %.3f). This suggests these variables are closely related.",
    "predictive": "Built predictive model using %s. %s",
    "prescriptive": "Based on the analysis, here are the top recommendations: %s",
    "default": "Analysis completed. Please check the detailed results for specific insights.",
}
CLEAN_FIRST, CLEAN_BELOW = "Clean and preprocess the data", 70


def _hits(text: Column, words: list[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + text.contains(w).cast("int")
    return total


def _best(scores: list[tuple[str, Column]]) -> Column:
    """The type with the most hits, the first one on ties."""
    top = F.greatest(*[s for _, s in scores])
    out = F.lit(scores[-1][0])
    for name, s in reversed(scores[:-1]):
        out = F.when(s == top, name).otherwise(out)
    return out


def classify_questions(df: DataFrame, text: str) -> DataFrame:
    """NL-1: add analysis_type, hits, confidence and objective to a table of questions.

    The keyword lists are part of the expression, so questions need no join.
    """
    q = F.lower(col(text))
    names = {t: f"_s_{t}" for t in TYPES}
    d = df.withColumn("_q", q)
    for t in TYPES:
        d = d.withColumn(names[t], _hits(F.col("_q"), KEYWORDS[t]))
    scores = [(t, F.col(names[t])) for t in TYPES]
    hits = F.greatest(*[s for _, s in scores])
    words = F.size(F.filter(F.split("_q", r"(?U)\s+"), lambda w: w != ""))
    objective = (F.when(F.col("_q").contains("maximize") | F.col("_q").contains("increase"), "maximize")
                 .when(F.col("_q").contains("minimize"), "minimize"))
    return d.select(*map(col, df.columns), _best(scores).alias("analysis_type"), hits.alias("hits"),
                    F.when(hits > 0, hits / words).otherwise(F.lit(NO_HIT_CONFIDENCE)).alias("confidence"),
                    objective.alias("objective"))


def column_mentions(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """NL-2: add target_column (first mentioned in schema order) and feature_columns (the others)."""
    q = F.lower(col(text))
    found = F.filter(F.array(*map(F.lit, columns)), lambda n: F.contains(q, F.lower(n)))
    d = df.withColumn("_m", found)
    return d.select(*map(col, df.columns), F.get("_m", F.lit(0)).alias("target_column"),
                    F.when(F.size("_m") > 1, F.slice("_m", 2, max(len(columns), 1))).alias("feature_columns"))


def classify_with_profile(df: DataFrame, text: str, rows: int, has_dates: bool) -> DataFrame:
    """NL-3: add analysis_type, score and confidence (share of all points), weighted by the data profile."""
    d = df.withColumn("_q", F.lower(col(text)))
    bonus = {"descriptive": 2 if rows < 100 else 0, "predictive": (1 if rows > 1000 else 0) + (1 if has_dates else 0)}
    for t in TYPES:
        d = d.withColumn(f"_s_{t}", _hits(F.col("_q"), PROFILE_KEYWORDS[t]) + F.lit(bonus.get(t, 0)))
    scores = [(t, F.col(f"_s_{t}")) for t in TYPES]
    top = F.greatest(*[s for _, s in scores])
    total = F.lit(0)
    for _, s in scores:
        total = total + s
    return d.select(*map(col, df.columns), _best(scores).alias("analysis_type"), top.alias("score"),
                    (top / F.greatest(total, F.lit(1))).alias("confidence"))


def _lookup(kind: Column, table: dict, make) -> Column:
    out = F.lit(None)
    for t, v in table.items():
        out = F.when(kind == t, make(v)).otherwise(out)
    return out


def suggestions(df: DataFrame, quality_score: float, kind: str = "analysis_type") -> DataFrame:
    """NL-4: add methods, visualizations, focus and next_steps for each row's analysis type."""
    array = lambda v: F.array(*map(F.lit, v))
    steps = _lookup(col(kind), NEXT_STEPS, array)
    if quality_score < CLEAN_BELOW:
        steps = F.concat(F.array(F.lit(CLEAN_FIRST)), F.coalesce(steps, F.array().cast("array<string>")))
    return df.select(*map(col, df.columns),
                     _lookup(col(kind), METHODS, lambda v: array(v[0])).alias("methods"),
                     _lookup(col(kind), METHODS, lambda v: array(v[1])).alias("visualizations"),
                     _lookup(col(kind), METHODS, lambda v: F.lit(v[2])).alias("focus"), steps.alias("next_steps"))


REPLY = "analysis_type string, target_column string, feature_columns array<string>, objective string, confidence double"


def parse_replies(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """NL-5: add the fields of the JSON object inside a reply and `valid`.

    The object reaches from the first '{' to the last '}'. It is valid with all
    required keys, an allowed type and only known columns.
    """
    body = F.regexp_extract(col(text), r"(?s)(\{.*\})", 1)
    d = df.withColumn("_j", F.when(body != "", body).otherwise(col(text)))
    keys = F.json_object_keys("_j")
    d = d.withColumn("_keys", keys).withColumn("_p", F.from_json("_j", REPLY))
    known = F.array(*map(F.lit, columns)).cast("array<string>")
    target, feats = F.col("_p.target_column"), F.col("_p.feature_columns")
    ok = (
        F.array_contains("_keys", "analysis_type") & F.array_contains("_keys", "target_column")
        & F.array_contains("_keys", "confidence") & F.col("_p.analysis_type").isin(TYPES)
        & (F.coalesce(target, F.lit("")).isin("") | F.array_contains(known, target))
        & (feats.isNull() | (F.size(F.array_except(F.coalesce(feats, known), known)) == 0)))
    return d.select(*map(col, df.columns), "_p.*", F.coalesce(ok, F.lit(False)).alias("valid"))


def execute_intent(df: DataFrame, intent: dict) -> dict[str, DataFrame]:
    """NL-6: run the analysis an intent asks for; the first feature column serves the hypothesis test."""
    features = intent.get("feature_columns") or []
    return prescribe.analyze_by_type(
        df, intent["analysis_type"], target=intent.get("target_column"),
        feature=intent.get("feature_column") or (features[0] if features else None),
        objective=intent.get("objective"))


def answer(kind: str, result: dict[str, DataFrame], spark) -> DataFrame:
    """NL-7: one row (answer) from the result tables of an analysis."""
    text, source = None, None
    if kind == "descriptive" and "info" in result:
        source = result["info"]
        parts = ["total_rows", "total_columns", "numeric_columns", "categorical_columns", "missing_values_total"]
    elif kind == "diagnostic" and "strong" in result:
        source, parts = result["strong"].limit(1), ["feature1", "feature2", "correlation"]
    elif kind == "predictive" and "choice" in result:
        source, parts = result["choice"], [F.translate("best_model", "_", " "), F.col("recommendation")]
    elif kind == "prescriptive" and "actionable" in result:
        source = result["actionable"].orderBy("step", "insight").limit(3).agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("step", "insight"))), lambda s: s["insight"]), " ").alias("i"))
        parts = ["i"]
    if source is not None:
        text = F.format_string(ANSWERS[kind], *parts)
    row = spark.range(1).select(F.lit(ANSWERS["default"]).alias("fallback"), F.lit(1).alias("one"))
    if source is None:
        return row.select(F.col("fallback").alias("answer"))
    found = source.select(text.alias("text")).withColumn("one", F.lit(1))
    return row.join(found, "one", "left").select(F.coalesce("text", "fallback").alias("answer"))


def dataset_context(df: DataFrame, sample: int = 3) -> dict[str, DataFrame]:
    """NL-8: `shape` (one row) and `sample` (first rows)."""
    missing = F.lit(0).cast("long")
    for n in df.columns:
        missing = missing + F.count_if(col(n).isNull())
    shape = df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.array(*map(F.lit, numeric_columns(df))).cast("array<string>").alias("numeric_columns"),
        F.array(*map(F.lit, text_columns(df))).cast("array<string>").alias("categorical_columns"),
        missing.alias("missing"))
    return {"shape": shape, "sample": df.limit(sample)}
