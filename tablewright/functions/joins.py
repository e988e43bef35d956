"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT_SHARE = 0.001


def lookup(df: DataFrame, table: DataFrame, key: Column, table_key: str, weight: str, total: int) -> DataFrame:
    """Left join `df` to `table`, which has one row per key and knows how many rows carry it.

    Keys with more than HOT_SHARE of all rows number at most 1/HOT_SHARE, so that
    part is broadcast. The rest is joined by shuffle; rows already served, or with
    a null key, take a spread-out salt instead of all meeting in one partition.
    Columns of `table` other than key and weight are added.
    """
    names = [c for c in table.columns if c not in (table_key, weight)]
    hot = F.col(weight) > F.lit(total * HOT_SHARE)
    picked = [F.struct(*names).alias("_hot"), F.col(table_key).alias("_hk")]
    d = df.withColumn("_k", key).join(
        F.broadcast(table.filter(hot).select(*picked)), F.col("_k") == F.col("_hk"), "left"
    )
    served = F.col("_hk").isNotNull() | F.col("_k").isNull()
    d = d.withColumn("_ck", F.when(~served, F.col("_k"))).withColumn(
        "_salt", F.when(served, F.pmod(F.monotonically_increasing_id(), F.lit(997)) + 1).otherwise(F.lit(0))
    )
    cold = table.filter(~hot).select(
        F.struct(*names).alias("_cold"), F.col(table_key).alias("_ck2"), F.lit(0).cast("long").alias("_salt2")
    )
    d = d.join(cold, (F.col("_ck") == F.col("_ck2")) & (F.col("_salt") == F.col("_salt2")), "left")
    return d.select(
        *df.columns, *[F.coalesce(F.col(f"_hot.{n}"), F.col(f"_cold.{n}")).alias(n) for n in names]
    )
