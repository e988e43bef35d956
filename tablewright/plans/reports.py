"""Whole flows: quality to report, monitoring, cleaning and questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import cleaning, drift, insight, intent, quality
from ..sources import readers, sinks

FALLBACK = "No narrative is available for this run; the tables below hold all findings."


def report_rows(insights: dict[str, DataFrame], drift_report: dict[str, DataFrame] | None = None,
                narrative: dict[str, str] | None = None) -> DataFrame:
    """SNK-6: (section, ordinal, title, body), the report as a table."""
    spark = insights["metadata"].sparkSession
    parts = []
    head = list((narrative or {"notice": FALLBACK}).items())
    parts.append(spark.createDataFrame([(0, i, k, v) for i, (k, v) in enumerate(head)],
                                       "section int, ordinal int, title string, body string"))
    line = lambda d, section, ordinal, title, body: d.select(
        F.lit(section).alias("section"), ordinal.cast("int").alias("ordinal"), title.alias("title"), body.alias("body"))
    if drift_report is not None:
        s = drift_report["summary"]
        parts.append(line(s, 1, F.lit(0), F.concat(F.lit("Drift: "), F.col("overall_severity")), F.col("drift_summary")))
        parts.append(line(s.select(F.posexplode("recommendations").alias("i", "r")), 1, F.col("i") + 1,
                          F.lit("Drift recommendation"), F.col("r")))
    parts.append(line(insights["summary"], 2, F.col("position"), F.col("column_name"), F.concat_ws(
        ", ", F.col("dtype"), F.format_string("%d values", "count"), F.format_string("%d null", "null_count"),
        F.when(F.col("mean_val").isNotNull(), F.format_string("mean %.2f", "mean_val")))))
    parts.append(line(insights["trends"], 3, F.lit(0), F.col("metric"), F.concat_ws(
        " ", F.col("direction"), F.when(F.col("overall_change_pct").isNotNull(),
                                        F.format_string("%.1f%% change", "overall_change_pct")))))
    parts.append(line(insights["segment_leaders"], 4, F.lit(0),
                      F.concat_ws(" by ", "metric_column", "segment_column"),
                      F.format_string("'%s' has the highest mean, %.2f", "top_segment", "top_mean")))
    parts.append(line(insights["anomalies"], 5, F.lit(0), F.col("column"),
                      F.format_string("%d values (%.2f%%) %s", "count", "pct", "direction")))
    parts.append(line(insights["recommendations"], 6, F.col("ordinal"), F.col("priority"), F.col("message")))
    return reduce(DataFrame.unionByName, parts)


def build_report(df: DataFrame, store: sinks.BaselineStore | None = None, key: str | None = None,
                 order: str | None = None, narrative: dict[str, str] | None = None) -> dict:
    """Quality, then drift (with a key), then insight, then the report table. A critical finding stops the run."""
    checked = quality.assess(df)
    state = checked["summary"].first()
    if state["has_critical_issues"]:
        return {"halted": True, "halt_reason": state["halt_reason"], "quality": checked}
    moved = drift.run(df, store, key) if store is not None and key else None
    found = insight.insights(df, checked, order)
    return {"halted": False, "halt_reason": None, "quality": checked, "drift": moved, "insights": found,
            "report": report_rows(found, moved, narrative)}


def report_from_files(spark, sources: list[str], store: sinks.BaselineStore | None = None, **options) -> dict:
    """SRC-1, SRC-10, SRC-11 in front of `build_report`; all sources are read as one table."""
    df = readers.read_csv(spark, sources)
    one = spark.range(1).select(readers.dataset_key(F.lit(sources[0])).alias("k")).first()["k"]
    return build_report(df, store, one if store is not None else None, **options)


def monitor_to_log(df: DataFrame, store: sinks.BaselineStore, key: str, thresholds: dict[str, float],
                   alert_path: str) -> DataFrame | None:
    """Read-only drift check; alerts are logged before anyone is told."""
    found = drift.monitor(df, store, key, thresholds)
    if found is not None and not found.isEmpty():
        sinks.write_alerts(found, alert_path)
    return found


def assess_and_clean(df: DataFrame, order: str | None = None) -> dict[str, DataFrame]:
    checked = quality.assess(df)
    return {**cleaning.clean(df, checked["defects"], order), "defects": checked["defects"]}


def ask(df: DataFrame, question: str) -> dict:
    """A question about a table: intent, columns, analysis, answer."""
    spark = df.sparkSession
    q = spark.createDataFrame([(question,)], "question string")
    q = intent.column_mentions(intent.classify_questions(q, "question"), "question", df.columns)
    found = q.first().asDict()
    tables = intent.execute_intent(df, found)
    return {"intent": q, "tables": tables, "answer": intent.answer(found["analysis_type"], tables, spark)}
