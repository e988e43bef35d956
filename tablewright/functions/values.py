"""Value-count tables: the one shuffle behind distinct counts, modes, top values and PSI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import as_number, col, long_rows


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) with values as text, nulls left out.

    The group-by combines on the map side, so a value that fills a third of the
    table reaches the shuffle as one row per map task.
    """
    entries = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    return (
        df.select(long_rows(entries))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def number_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) with values as double, nulls left out."""
    fields = {f.name: f for f in df.schema}
    entries = [F.struct(F.lit(c).alias("column"), as_number(fields[c]).alias("value")) for c in columns]
    return (
        df.select(long_rows(entries))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def most_frequent(value: str = "value", n: str = "n") -> Column:
    """Aggregate over value counts: the most frequent value, ties to the smallest."""
    return F.min_by(F.col(value), F.struct(-F.col(n), F.col(value)))


def top_values(counts: DataFrame, k: int = 10, by: tuple[str, ...] = ("column",)) -> DataFrame:
    """The k most frequent values per column with rank and share of the non-null rows.

    The rank filter becomes a group limit before the shuffle, so only k rows per
    map task and column travel.
    """
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("value"))
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.join(total, list(by)).withColumn("pct", F.col("n") * 100.0 / F.col("total"))


def modes(df: DataFrame, numeric: list[str], text: list[str]) -> dict[str, object]:
    """Most frequent value per column, ties to the smallest; columns without values are absent."""
    out: dict[str, object] = {}
    if numeric:
        for r in number_counts(df, numeric).groupBy("column").agg(most_frequent().alias("m")).collect():
            out[r["column"]] = r["m"]
    if text:
        for r in value_counts(df, text).groupBy("column").agg(most_frequent().alias("m")).collect():
            out[r["column"]] = r["m"]
    return out
