"""Sinks: exports, logs, catalogues and the versioned baseline store."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col
from ..operators.dashboard import ALLOWED
from ..operators.drift import CATEGORY_STATS, COLUMN_STATS, DriftError
from .readers import check_key


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-1."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_alerts(alerts: DataFrame, path: str, dataset: str | None = None, batch: int | None = None) -> None:
    """SNK-2: append JSON files under dataset=<key>/run=<time>; those of a stream batch replace dataset=<key>/run=batch-<id>."""
    if batch is not None:
        alerts.drop("dataset").write.mode("overwrite").json(f"{path}/dataset={dataset}/run=batch-{batch}")
        return
    stamp = F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss'Z'")
    alerts.withColumn("run", stamp).write.mode("append").partitionBy("dataset", "run").json(path)


def export_tables(tables: dict[str, DataFrame], names: list[str], path: str, fmt: str = "json") -> list[str]:
    """SNK-5: write the chosen result tables; unknown names are refused before anything is written."""
    unknown = [n for n in names if n not in tables]
    if unknown:
        raise ValueError(f"unknown tables {unknown}")
    for n in names:
        w = tables[n].write.mode("overwrite")
        (w.option("header", True) if fmt == "csv" else w).format(fmt).save(f"{path}/{n}")
    return [f"{path}/{n}" for n in names]


def result_rows(df: DataFrame, user: str, dataset: str, analysis_type: str) -> DataFrame:
    """SNK-4: rows (user_id, dataset_id, analysis_type, results JSON, created_at)."""
    if analysis_type not in ALLOWED["analytics_results", "analysis_type"]:
        raise ValueError(f"analysis type {analysis_type!r} is not allowed")
    return df.select(F.lit(user).alias("user_id"), F.lit(dataset).alias("dataset_id"),
                     F.lit(analysis_type).alias("analysis_type"),
                     F.to_json(F.struct(*map(col, df.columns))).alias("results"),
                     F.current_timestamp().alias("created_at"))


def model_rows(metrics: DataFrame, choice: DataFrame, model_type: str, target: str, user: str, dataset: str) -> DataFrame:
    """SNK-7: one registry row with the winner and the winner's score (null where it does not fit the column)."""
    if model_type not in ALLOWED["ml_models", "model_type"]:
        raise ValueError(f"model type {model_type!r} is not allowed")
    return choice.select(
        F.lit(user).alias("user_id"), F.lit(dataset).alias("dataset_id"), F.lit(model_type).alias("model_type"),
        F.col("best_model").alias("algorithm"), F.lit(target).alias("target_column"),
        F.col("score").try_cast("decimal(5,4)").alias("accuracy_score"), F.current_timestamp().alias("created_at"))


def catalogue_row(df: DataFrame, dataset: str, user: str, name: str, size: int | None, status: str = "uploaded") -> DataFrame:
    """SNK-8: one catalogue row per load or status change; see `current_status`."""
    if status not in ALLOWED["datasets", "status"]:
        raise ValueError(f"status {status!r} is not allowed")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(dataset).alias("dataset_id"), F.lit(user).alias("user_id"), F.lit(name).alias("name"), "rows",
        F.lit(len(df.columns)).alias("columns"), F.array(*map(F.lit, df.columns)).alias("column_names"),
        F.lit(size).cast("long").alias("size"), F.lit(status).alias("status"),
        F.current_timestamp().alias("updated_at"))


def current_status(catalogue: DataFrame) -> DataFrame:
    """The newest status per dataset."""
    return catalogue.groupBy("dataset_id").agg(F.max_by("status", "updated_at").alias("status"),
                                               F.max("updated_at").alias("updated_at"))


def activity_rows(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """SNK-9: log rows (user_id, action, status, metadata JSON, error_message, created_at)."""
    allowed = ALLOWED["activity_logs", "status"]
    if any(e.get("status", "success") not in allowed for e in entries):
        raise ValueError(f"status must be one of {allowed}")
    rows = [(e["user_id"], e["action"], e.get("status", "success"), {k: str(v) for k, v in (e.get("metadata") or {}).items()},
             e.get("error_message")) for e in entries]
    d = spark.createDataFrame(rows, "user_id string, action string, status string, m map<string,string>, error_message string")
    return d.select("user_id", "action", "status", F.to_json("m").alias("metadata"), "error_message",
                    F.current_timestamp().alias("created_at"))


def activity_table(df: DataFrame, user: Column, action: Column, status: Column, metadata: Column, error: Column) -> DataFrame:
    """SNK-9 for many actions at once: log rows from a table; a status outside the list fails the write."""
    allowed = ALLOWED["activity_logs", "status"]
    checked = F.when(status.isin(allowed), status).otherwise(
        F.raise_error(F.concat(F.lit("status is not allowed: "), F.coalesce(status, F.lit("null")))))
    return df.select(user.alias("user_id"), action.alias("action"), checked.alias("status"), metadata.alias("metadata"),
                     error.alias("error_message"), F.current_timestamp().alias("created_at"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


class BaselineStore:
    """SNK-3: baseline profiles under a root folder; every change is a new version, the highest counts.

    `<root>/<key>/versions` holds one row per version and names a profile folder
    `<root>/<key>/profiles/<id>` with the column and category tables.
    """

    VERSIONS = ("version long, profile string, rows long, clean_runs int, created_at timestamp, updated_at timestamp, batch long")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _dir(self, key: str) -> str:
        return f"{self.root}/{check_key(key)}"

    def _latest(self, key: str, before: int | None = None):
        """The highest version; with `before`, of those that no stream batch from that id on has made."""
        try:
            versions = self.spark.read.schema(self.VERSIONS).parquet(f"{self._dir(key)}/versions")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        try:
            if before is not None:
                versions = versions.filter(F.col("batch").isNull() | (F.col("batch") < before))
            return versions.orderBy(F.desc("version")).first()
        except Exception as e:
            raise DriftError(f"the baseline of {key!r} is unreadable: {type(e).__name__}") from e

    def load(self, key: str, before: int | None = None) -> dict | None:
        """The baseline; with `before`, as it was before the stream batch of that id, however often that one came."""
        head = self._latest(key, before)
        if head is None:
            return None
        path = f"{self._dir(key)}/profiles/{head['profile']}"
        try:
            columns = self.spark.read.schema(COLUMN_STATS).parquet(f"{path}/columns")
            categories = self.spark.read.schema(CATEGORY_STATS).parquet(f"{path}/categories")
            if columns.filter("column is null or dtype is null").limit(1).count():
                raise ValueError("columns without a name or type")
        except Exception as e:
            raise DriftError(f"the baseline of {key!r} is unreadable: {type(e).__name__}") from e
        return {"rows": head["rows"], "columns": columns, "categories": categories, "clean_runs": head["clean_runs"],
                "profile": head["profile"], "version": head["version"], "created_at": head["created_at"]}

    def _write(self, key: str, profile: str, rows: int, clean_runs: int, created, version: int, batch: int | None) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        self.spark.createDataFrame([(version, profile, rows, clean_runs, created or now, now, batch)], self.VERSIONS).coalesce(
            1).write.mode("append").parquet(f"{self._dir(key)}/versions")

    def extra(self, key: str, name: str) -> DataFrame:
        """A further table that was saved with the baseline, such as `distribution.measure` gives."""
        head = self._latest(key)
        if head is None:
            raise DriftError(f"there is no baseline of {key!r}")
        try:
            return self.spark.read.parquet(f"{self._dir(key)}/profiles/{head['profile']}/extra/{check_key(name)}")
        except AnalysisException as e:
            raise DriftError(f"the baseline of {key!r} has no table {name!r}") from e

    def save(self, key: str, profile: dict, clean_runs: int = 0, extra: dict[str, DataFrame] | None = None,
             batch: int | None = None) -> None:
        """Store a profile, with further tables by name, as the new baseline. The version row comes last, so a failed
        write leaves the old one."""
        head = self._latest(key)
        name = uuid.uuid4().hex
        path = f"{self._dir(key)}/profiles/{name}"
        profile["columns"].coalesce(1).write.parquet(f"{path}/columns")
        profile["categories"].write.parquet(f"{path}/categories")
        for table, df in (extra or {}).items():
            df.write.parquet(f"{path}/extra/{check_key(table)}")
        self._write(key, name, profile["rows"], clean_runs, None, head["version"] + 1 if head else 0, batch)

    def touch(self, key: str, base: dict, clean_runs: int, batch: int | None = None) -> None:
        """Keep the profile, change the counter."""
        head = self._latest(key)
        self._write(key, base["profile"], base["rows"], clean_runs, base["created_at"], head["version"] + 1, batch)
