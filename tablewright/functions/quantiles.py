"""Exact quantiles with linear interpolation, for tables of any size.

`percentile` keeps every distinct value of a column in one buffer. It is used
only when rows times columns are checked to be few. Larger tables are narrowed down
instead: each pass counts the rows per value bucket inside the interval that
holds the wanted rank (a map-side combined group-by of at most BUCKETS rows per
interval), and the next pass looks into that one bucket, until its rows are
at most SMALL_ROWS or all its values are equal. Nothing but the bucket table reaches the
driver and no column is sorted or shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 4096
IN_MEMORY_CELLS = 1_000_000
SMALL_ROWS = 10_000


def exact_quantiles(
    df: DataFrame,
    exprs: dict[str, Column],
    probs: list[float],
    in_memory: int = IN_MEMORY_CELLS,
    rows: int | None = None,
    approx: bool = False,
) -> dict[str, list[float | None]]:
    """{name: [quantile per prob]}; null where a column has no value. Expressions must be double.

    `approx` answers from one sketch per column instead (relative rank error 1/10000).
    """
    if not exprs:
        return {}
    d = df.select([e.alias(n) for n, e in exprs.items()])
    if approx:
        row = d.agg(*[F.percentile_approx(_q(n), probs, 10_000).alias(n) for n in exprs]).first()
        return {n: (list(row[n]) if row[n] is not None else [None] * len(probs)) for n in exprs}
    rows = d.count() if rows is None else rows
    if rows * len(exprs) <= in_memory:
        row = d.agg(*[F.percentile(_q(n), F.array(*map(F.lit, probs))).alias(n) for n in exprs]).first()
        return {n: (list(row[n]) if row[n] is not None else [None] * len(probs)) for n in exprs}
    return _narrowed(d, list(exprs), probs, min(in_memory, SMALL_ROWS))


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _narrowed(d: DataFrame, names: list[str], probs: list[float], bound: int) -> dict:
    stats = d.agg(
        *[f(_q(n)).alias(f"{t}{i}") for i, n in enumerate(names)
          for f, t in ((F.count, "n"), (F.min, "lo"), (F.max, "hi"))]
    ).first()
    out: dict[str, list] = {}
    found: dict[tuple[str, int], float] = {}
    todo: dict[tuple[str, float, float, int], set[int]] = {}  # interval and rows below it -> ranks
    wanted: dict[str, list[tuple[int, int, float]]] = {}
    for i, name in enumerate(names):
        n = stats[f"n{i}"]
        if n == 0:
            out[name] = [None] * len(probs)
            continue
        wanted[name] = []
        for p in probs:
            h = (n - 1) * p
            k = math.floor(h)
            wanted[name].append((k, min(k + 1, n - 1), h - k))
            todo.setdefault((name, stats[f"lo{i}"], stats[f"hi{i}"], 0), set()).update((k, min(k + 1, n - 1)))
    while todo:
        todo = _one_pass(d, todo, found, bound)
    for name, ranks in wanted.items():
        out[name] = [
            found[name, a] if w == 0 else found[name, a] + (found[name, b] - found[name, a]) * w
            for a, b, w in ranks
        ]
    return out


def _one_pass(d: DataFrame, todo: dict, found: dict, bound: int) -> dict:
    for (name, lo, hi, below), ranks in list(todo.items()):
        if lo == hi:
            found.update({(name, k): lo for k in ranks})
            del todo[name, lo, hi, below]
    if not todo:
        return {}
    intervals = list(todo)
    entries = []
    for i, (name, lo, hi, _) in enumerate(intervals):
        x = _q(name)
        # Scale before subtracting so that a range wider than the double range stays finite.
        pos = (x / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * BUCKETS
        bucket = F.when(x == F.lit(hi), BUCKETS - 1).otherwise(F.least(F.floor(pos).cast("int"), F.lit(BUCKETS - 1)))
        # Infinite ends cannot be scaled: they get a bucket of their own.
        bucket = F.when(x == float("-inf"), -1).when(x == float("inf"), BUCKETS).otherwise(bucket)
        if math.isinf(lo) or math.isinf(hi):
            bucket = F.when(x == float("-inf"), -1).when(x == float("inf"), BUCKETS).otherwise(0)
        entries.append(F.when((x >= F.lit(lo)) & (x <= F.lit(hi)),
                              F.struct(F.lit(i).alias("i"), bucket.alias("b"), x.alias("x"))))
    table = (
        d.select(F.explode(F.array(*entries)).alias("e"))
        .filter(F.col("e").isNotNull())
        .groupBy("e.i", "e.b")
        .agg(F.count("*").alias("n"), F.min("e.x").alias("lo"), F.max("e.x").alias("hi"))
        .collect()
    )
    nxt: dict = {}
    small: dict = {}
    for i, key in enumerate(intervals):
        name, _, _, below = key
        ranks = sorted(todo[key])
        for r in sorted((r for r in table if r["i"] == i), key=lambda r: r["b"]):
            mine = {k for k in ranks if below <= k < below + r["n"]}
            if mine:
                if r["lo"] == r["hi"]:
                    found.update({(name, k): r["lo"] for k in mine})
                else:
                    target = small if r["n"] <= bound else nxt
                    target.setdefault((name, r["lo"], r["hi"], below), set()).update(mine)
            below += r["n"]
    if small:
        _read_small(d, small, found)
    return nxt


def _read_small(d: DataFrame, small: dict, found: dict) -> None:
    """Sort the few rows left in each interval (count checked) inside one aggregate."""
    keys = list(small)
    picks = []
    for i, (name, lo, hi, below) in enumerate(keys):
        x = _q(name)
        values = F.sort_array(F.collect_list(F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), x)))
        for k in sorted(small[keys[i]]):
            picks.append(((name, k), F.get(values, F.lit(k - below))))
    row = d.agg(*[e.alias(f"p{j}") for j, (_, e) in enumerate(picks)]).first()
    for j, (key, _) in enumerate(picks):
        found[key] = row[f"p{j}"]
