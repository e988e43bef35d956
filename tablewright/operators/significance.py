"""Many tests at once: p-values adjusted so that the share of false discoveries, or any false one, is controlled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col
from ..functions.joins import lookup
from ..functions.ranges import Running, running
from ..functions.stage import staged

METHODS = ("fdr", "any")


def adjust(tests: DataFrame, p: str, groups: list[str], method: str = "fdr", ranges: int | None = None) -> DataFrame:
    """Add `tests` (in the group), `adjusted` and `method`; null p-values are no tests and stay null.

    fdr: the step-up rule of Benjamini and Hochberg, adjusted(i) = min over j >= i of p(j) * m / j, at most 1.
    any: Bonferroni, p * m, at most 1.
    Equal p-values are counted before anything is ranked. The running count (the rank) and the reverse running
    minimum go by ranges, so one group may hold all tests and one p-value a third of them.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    group = F.struct(*[col(g) for g in groups]) if groups else F.struct(F.lit(0).alias("_all"))
    d = tests.withColumn("_g", F.to_json(group, {"ignoreNullFields": "false"}))
    counts = staged(d.filter(col(p).isNotNull()).groupBy("_g", col(p).cast("double").alias("_p")).agg(F.count("*").alias("_n")))
    sizes = counts.groupBy("_g").agg(F.sum("_n").alias("_m"))
    ranked = running(counts, ["_g"], "_p", {"_rank": Running(F.col("_n"))}, ranges).join(sizes, "_g")
    raw = F.col("_p") * F.col("_m") / F.col("_rank") if method == "fdr" else F.col("_p") * F.col("_m")
    ranked = ranked.withColumn("_raw", raw)
    ranked = running(ranked, ["_g"], "_p", {"_low": Running(F.col("_raw"), "min", back=True)}, ranges)
    table = ranked.select(F.struct("_g", "_p").alias("_key"), "_n", F.col("_m").alias("tests"), F.least(F.lit(1.0), F.col("_low")).alias("adjusted"))
    key = F.when(col(p).isNotNull(), F.struct("_g", col(p).cast("double").alias("_p")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return lookup(d, staged(table), key, "_key", "_n", total).drop("_g").withColumn("method", F.lit(method))
