"""Regression and classification models, on MLlib but for forests of few features, their scores and the choice between them."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import as_number, col, long_rows, nan_to_null, numeric_columns
from ..functions.stage import spread, staged
from . import binned_forest

# Fixed values.
TEST_SHARE, SEED, TREES, MIN_ROWS = 20, 42, 100, 10
MAX_DEPTH = 10


class ModelError(ValueError):
    pass


def split_mark(df: DataFrame, test_share: int = TEST_SHARE, seed: int = SEED) -> Column:
    """True for the test part: a hash of the row, so the split does not depend on partitions."""
    return F.pmod(F.xxhash64(*[col(c) for c in df.columns], F.lit(seed)), F.lit(100)) < test_share


def model_frame(df: DataFrame, target: str, features: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """ML-1: features as double, target, `_test`; complete rows only, written once for the many passes of a fit."""
    if target not in df.columns:
        raise ModelError(f"target column {target!r} not found")
    df = nan_to_null(df)
    features = [c for c in numeric_columns(df) if c != target] if features is None else list(features)
    if not features:
        raise ModelError("no numeric features")
    fields = {f.name: f for f in df.schema}
    numeric_target = isinstance(fields[target].dataType, T.NumericType)
    label = as_number(fields[target]) if numeric_target else col(target).cast("string")
    frame = df.select(*[as_number(fields[c]).alias(c) for c in features], label.alias("_y")).na.drop()
    frame = staged(spread(frame.withColumn("_test", split_mark(frame))))
    if frame.count() < MIN_ROWS:
        raise ModelError(f"at least {MIN_ROWS} complete rows are needed")
    return frame, features


def _stages(features: list[str]) -> list:
    return [VectorAssembler(inputCols=features, outputCol="_x"),
            StandardScaler(inputCol="_x", outputCol="_xs", withMean=True, withStd=True)]


def regression_scores(predictions: DataFrame, label: str = "_y", guess: str = "prediction") -> DataFrame:
    """(r2_score, rmse, n) of a predictions table."""
    e = F.col(label) - F.col(guess)
    return predictions.agg(
        (1 - F.try_divide(F.sum(e * e), F.var_pop(label) * F.count(label))).alias("r2_score"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))


def regression_models(df: DataFrame, target: str, features: list[str] | None = None,
                      max_depth: int = MAX_DEPTH, trees: int = TREES) -> dict[str, DataFrame]:
    """ML-2 and ML-3: `metrics` (model, score, rmse) and `importance` (model, feature, value)."""
    frame, features = model_frame(df, target, features)
    train, test = frame.filter("not _test"), frame.filter("_test")
    fits = {
        "linear_regression": LinearRegression(featuresCol="_xs", labelCol="_y", solver="normal"),
        "random_forest": RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=trees, seed=SEED,
                                               maxDepth=max_depth),
    }
    prep = Pipeline(stages=_stages(features)).fit(train)
    ready, unseen = prep.transform(train), prep.transform(test)
    thresholds = binned_forest.cuts(train, features)
    metrics, weights = [], []
    for name, est in fits.items():
        if name == "random_forest" and binned_forest.fits(thresholds):
            guess, values = binned_forest.regression(train, test, features, "_y", thresholds, max_depth, trees, SEED)
        else:
            model = est.fit(ready)
            guess = model.transform(unseen)
            values = (model.coefficients if name == "linear_regression" else model.featureImportances).toArray()
        s = regression_scores(guess).first()
        metrics.append((name, s["r2_score"], s["rmse"], s["n"]))
        weights += [(name, f, float(v)) for f, v in zip(features, values)]
    spark = df.sparkSession
    return {"metrics": spark.createDataFrame(metrics, "model string, score double, rmse double, n long"),
            "importance": spark.createDataFrame(weights, "model string, feature string, value double")}


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """ML-8: (label, code) with codes in sorted order. The classes of a target are few by nature."""
    w = Window.partitionBy(F.lit(0)).orderBy("label")
    return df.select(col(column).cast("string").alias("label")).filter("label is not null").distinct().withColumn(
        "code", F.row_number().over(w) - 1)


def classification_report(predictions: DataFrame, label: str, guess: str) -> DataFrame:
    """ML-7: (label, precision, recall, f1_score, support) per class plus accuracy, macro avg and weighted avg."""
    cells = predictions.groupBy(col(label).cast("string").alias("l"), col(guess).cast("string").alias("p")).agg(
        F.count("*").alias("n"))
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    # One row per class from here on.
    sides = cells.select(long_rows([
        F.struct(F.col("l").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"),
                 hit.cast("long").alias("hits")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("long").alias("hits"))]))
    c = sides.groupBy("label").agg(*[F.sum(x).alias(x) for x in ("support", "guessed", "hits")])
    zero = F.lit(0.0)
    c = c.withColumn("precision", F.coalesce(F.try_divide("hits", "guessed"), zero)).withColumn(
        "recall", F.coalesce(F.try_divide("hits", "support"), zero))
    c = c.withColumn("f1_score", F.coalesce(F.try_divide(
        2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    names = ["precision", "recall", "f1_score"]
    total = F.sum("support")
    roll = c.agg(
        total.alias("support"), F.try_divide(F.sum("hits"), total).alias("acc"),
        *[F.avg(n).alias(f"m_{n}") for n in names],
        *[F.try_divide(F.sum(F.col(n) * F.col("support")), total).alias(f"w_{n}") for n in names])
    lines = roll.select(long_rows([
        F.struct(F.lit("accuracy").alias("label"), *[F.col("acc").alias(n) for n in names], F.col("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"m_{n}").alias(n) for n in names], F.col("support")),
        F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"w_{n}").alias(n) for n in names], F.col("support"))]))
    return c.select("label", *names, "support").unionByName(lines)


def classification_models(df: DataFrame, target: str, features: list[str] | None = None,
                          max_depth: int = MAX_DEPTH, trees: int = TREES) -> dict[str, DataFrame]:
    """ML-5 and ML-6: `metrics`, `report` per model and forest `importance`."""
    frame, features = model_frame(df.withColumn(target, col(target).cast("string")), target, features)
    codes = StringIndexer(inputCol="_y", outputCol="_label", stringOrderType="alphabetAsc").fit(frame)
    frame = codes.transform(frame)
    train, test = frame.filter("not _test"), frame.filter("_test")
    n = train.count()
    fits = {
        # The usual unit-strength ridge penalty, expressed per row.
        "logistic_regression": LogisticRegression(featuresCol="_xs", labelCol="_label", maxIter=1000,
                                                  regParam=1.0 / max(n, 1), standardization=False),
        "random_forest": RandomForestClassifier(featuresCol="_x", labelCol="_label", numTrees=trees, seed=SEED,
                                                maxDepth=max_depth),
    }
    prep = Pipeline(stages=_stages(features)).fit(train)
    ready, unseen = prep.transform(train), prep.transform(test)
    names = F.array(*map(F.lit, codes.labels))
    thresholds = binned_forest.cuts(train, features)
    metrics, reports, weights = [], [], []
    for name, est in fits.items():
        if name == "random_forest" and binned_forest.fits(thresholds, len(codes.labels)):
            guess, values = binned_forest.classification(train, test, features, "_label", len(codes.labels), thresholds,
                                                         max_depth, trees, SEED)
        else:
            model = est.fit(ready)
            guess = model.transform(unseen)
            values = model.featureImportances.toArray() if name == "random_forest" else []
        guess = staged(guess.select(
            F.col("_y").alias("label"), F.get(names, F.col("prediction").cast("int")).alias("guess")))
        report = classification_report(guess, "label", "guess").withColumn("model", F.lit(name))
        s = guess.agg(F.avg((F.col("label") == F.col("guess")).cast("double")).alias("a"),
                      F.count("*").alias("n")).first()
        metrics.append((name, s["a"], s["n"]))
        reports.append(report)
        if name == "random_forest":
            weights = [(name, f, float(v)) for f, v in zip(features, values)]
    spark = df.sparkSession
    return {"metrics": spark.createDataFrame(metrics, "model string, score double, n long"),
            "report": reduce(DataFrame.unionByName, reports),
            "importance": spark.createDataFrame(weights, "model string, feature string, value double")}


def best_model(metrics: DataFrame, score_name: str = "R²") -> DataFrame:
    """ML-4: one row (best_model, score, recommendation); a tie goes to the forest."""
    pick = F.max_by(F.struct("model", "score"), F.struct(F.col("score"), F.col("model") == "random_forest"))
    return metrics.agg(pick.alias("b")).select(
        F.col("b.model").alias("best_model"), F.col("b.score").alias("score"),
        F.concat(F.lit("Use "), F.translate("b.model", "_", " "), F.lit(f" model ({score_name} = "),
                 F.format_string("%.3f", "b.score"), F.lit(")")).alias("recommendation"))
