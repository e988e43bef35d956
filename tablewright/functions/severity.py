"""Severity names, ladders and weights."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
CRITICAL, HIGH, MEDIUM, LOW = "critical", "high", "medium", "low"
RANK = {LOW: 0, MEDIUM: 1, HIGH: 2, CRITICAL: 3}
SCORE_WEIGHT = {CRITICAL: 30, HIGH: 15, MEDIUM: 5, LOW: 2}


def ladder(value: Column, steps: list[tuple[float, str]], inclusive: bool = True) -> Column:
    """First step whose bound is reached (>= or >), steps given from the top; null below all."""
    out = F.lit(None).cast("string")
    for bound, name in reversed(steps):
        hit = value >= F.lit(bound) if inclusive else value > F.lit(bound)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), severity)


def weight(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SCORE_WEIGHT.items() for x in kv]), severity)


def worst(severity: Column) -> Column:
    """Aggregate: the worst severity, LOW when there is no row."""
    return F.coalesce(F.max_by(severity, rank(severity)), F.lit(LOW))
