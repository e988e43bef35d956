"""Exact nearest-neighbour imputation without comparing every row to every row.

Distances follow the nan-Euclidean rule: over the features both rows have, scaled
by features / shared features. Equal number vectors are combined first, with
their count. The distinct vectors are cut into blocks of bounded size that share
one null pattern; a block's per-feature range gives a lower bound for the distance
to any vector in it. A fixed sample gives each incomplete row an upper bound for
its k-th neighbour, and only blocks whose lower bound does not exceed it are
visited. Every visited block returns at most the k best per row and feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import as_number, col
from ..functions.joins import lookup
from ..functions.stage import spread, staged

BLOCK_ROWS = 20_000
REQUESTS_PER_TASK = 20_000
SAMPLE_ROWS = 2_000
BATCH = 128


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Nan-Euclidean squared distances, NaN where no feature is shared."""
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    diff = np.where(ma, a, 0.0)[:, None, :] - np.where(mb, b, 0.0)[None, :, :]
    both = ma[:, None, :] & mb[None, :, :]
    shared = both.sum(axis=2)
    total = np.where(both, diff * diff, 0.0).sum(axis=2)
    return np.where(shared > 0, total * a.shape[1] / np.maximum(shared, 1), np.nan)


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    return np.array(values.tolist(), dtype=float).reshape(len(values), width)


def _window(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Places in b, in order, of all rows that can be among the k nearest of a row of a; the rows of b share one null pattern."""
    every = np.arange(len(b))
    there = ~np.isnan(b[0])
    if len(b) <= k or not there.any():
        return every
    g = int(np.where(there, np.ptp(np.where(there, b, 0.0), axis=0), -1.0).argmax())
    some = b[::max(1, len(b) // 256)]
    near = np.sort(_distances(a, some), axis=1)
    if len(some) < k:
        return every
    reach = near[:, k - 1]  # by some rows of b: the k-th nearest of all is no farther
    shared = (~np.isnan(a) & there).sum(axis=1)
    # Widened by rounding size.
    r = np.sqrt((reach * (1 + 1e-9) + 1e-12) * shared / a.shape[1]) * (1 + 1e-9) + 1e-9 * np.abs(a[:, g])
    r, x = r[shared > 0], a[shared > 0, g]
    lo, hi = (x - r).min(initial=np.inf), (x + r).max(initial=-np.inf)
    if not len(x) or not np.isfinite(lo) or not np.isfinite(hi):
        return every
    return np.flatnonzero((b[:, g] >= lo) & (b[:, g] <= hi))


def impute_neighbours(df: DataFrame, columns: list[str], k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """CL-22: fill numeric nulls with the mean of the k nearest rows that have the feature.

    Ties at the k-th place go to the smaller vector. Rows that can be compared with
    no other row take the column mean. Filled columns become double.
    """
    spark = df.sparkSession
    fields = {f.name: f for f in df.schema}
    width = len(columns)
    vector = F.array(*[as_number(fields[c]) for c in columns])
    has_null = lambda v: F.exists(v, lambda x: x.isNull())
    vectors = staged(
        df.groupBy(vector.alias("v")).agg(F.count("*").alias("n"))
        .withColumn("id", F.monotonically_increasing_id())
        .withColumn("pattern", F.array_join(F.transform("v", lambda x: F.when(x.isNull(), "0").otherwise("1")), ""))
    )
    requests = vectors.filter(has_null(F.col("v")))
    if requests.isEmpty():
        return df
    means = df.agg(*[F.avg(as_number(fields[c])).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    means = [means[f"m{i}"] for i in range(width)]
    donors = staged(_with_block(vectors, width, block_rows))
    blocks = donors.groupBy("block").agg(
        F.first("pattern").alias("pattern"),
        *[F.min(F.get("v", F.lit(i))).alias(f"lo{i}") for i in range(width)],
        *[F.max(F.get("v", F.lit(i))).alias(f"hi{i}") for i in range(width)],
    ).collect()  # one row per block of BLOCK_ROWS vectors
    sample = np.array([r["v"] for r in donors.orderBy(F.rand(7)).select("v").limit(SAMPLE_ROWS).collect()],
                      dtype=float).reshape(-1, width)
    shape = spark.sparkContext.broadcast((
        np.array([r["block"] for r in blocks]),
        np.array([[ch == "1" for ch in r["pattern"]] for r in blocks]).reshape(-1, width),
        np.array([[r[f"lo{i}"] for i in range(width)] for r in blocks], dtype=float).reshape(-1, width),
        np.array([[r[f"hi{i}"] for i in range(width)] for r in blocks], dtype=float).reshape(-1, width),
        sample,
    ))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For every missing feature of a vector, the blocks that can hold one of its k nearest donors."""
        block, has, lo, hi, known = shape.value
        for pdf in batches:
            for start in range(0, len(pdf), BATCH):
                part = pdf.iloc[start:start + BATCH]
                a = _matrix(part["v"], width)
                near = _distances(a, known)
                there = ~np.isnan(a)
                gap = np.maximum(np.maximum(lo[None] - a[:, None, :], a[:, None, :] - hi[None]), 0.0)
                both = there[:, None, :] & has[None]
                shared = both.sum(axis=2)
                low = np.where(both, gap * gap, 0.0).sum(axis=2) * width / np.maximum(shared, 1)
                ids = part["id"].to_numpy()
                for f in range(width):
                    usable = np.where(np.isnan(known[:, f])[None, :] | np.isnan(near), np.inf, near)
                    # Distinct vectors count at least one row each, so k of them suffice.
                    reach = np.sort(usable, axis=1)[:, k - 1] if known.shape[0] >= k else np.full(len(a), np.inf)
                    # The bound is widened by rounding size: distances are computed in another order.
                    visit = (~there[:, f])[:, None] & has[None, :, f] & (shared > 0) & \
                        (low <= reach[:, None] * (1 + 1e-9) + 1e-12)
                    r, b = np.nonzero(visit)
                    if len(r):
                        yield pd.DataFrame({"id": ids[r], "feature": np.full(len(r), f, dtype="int32"),
                                            "block": block[b], "v": [part["v"].iloc[i] for i in r]})

    visits = staged(spread(requests.select("id", "v")).mapInPandas(
        route, "id long, feature int, block string, v array<double>"))
    # A block asked for by many rows is copied to several tasks, each with its share of the requests.
    asked = visits.groupBy("block").agg(F.ceil(F.count("*") / REQUESTS_PER_TASK).cast("int").alias("copies"))
    served = donors.join(asked, "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    sized = {r["block"]: r["copies"] for r in asked.filter("copies > 1").collect()}  # one entry per busy block
    busy = F.create_map(*[F.lit(x) for kv in sized.items() for x in kv]) if sized else None
    copies = F.coalesce(F.try_element_at(busy, F.col("block")), F.lit(1)) if busy is not None else F.lit(1)
    visits = visits.withColumn("copy", F.pmod(F.xxhash64("id", "feature"), copies).cast("int"))

    def nearest(_, asks: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"id": [], "feature": [], "distance": [], "n": [], "v": []}
        if len(asks) and len(have):
            b = _matrix(have["v"], width)
            order = np.lexsort(np.nan_to_num(b, nan=-np.inf).T[::-1])  # ties go to the smaller vector
            b, n = b[order], have["n"].to_numpy()[order]
            a = _matrix(asks["v"], width)
            wide = int(np.where(np.isnan(b[0]), -1.0, np.ptp(np.nan_to_num(b), axis=0)).argmax())
            by = np.argsort(a[:, wide], kind="stable")  # requests of a batch lie side by side
            ids, features = asks["id"].to_numpy(), asks["feature"].to_numpy()
            for start in range(0, len(asks), BATCH):
                part = by[start:start + BATCH]
                kept = _window(a[part], b, k)
                d = _distances(a[part], b[kept])
                for row, (i, f) in enumerate(zip(ids[part], features[part])):
                    mine = np.flatnonzero(~np.isnan(d[row]) & ~np.isnan(b[kept, f]))
                    if len(mine) > k:
                        mine = mine[d[row][mine] <= np.partition(d[row][mine], k - 1)[k - 1]]
                    for j in mine[np.argsort(d[row][mine], kind="stable")[:k]]:
                        out["id"].append(i)
                        out["feature"].append(f)
                        out["distance"].append(d[row][j])
                        out["n"].append(int(n[kept[j]]))
                        out["v"].append([None if np.isnan(x) else x for x in b[kept[j]]])
        return pd.DataFrame(out)

    found = visits.groupBy("block", "copy").cogroup(served.groupBy("block", "copy")).applyInPandas(
        nearest, "id long, feature int, distance double, n long, v array<double>")
    best = Window.partitionBy("id", "feature").orderBy("distance", "v").rowsBetween(Window.unboundedPreceding, -1)
    take = F.least(F.col("n"), F.lit(k) - F.coalesce(F.sum("n").over(best), F.lit(0)))
    filled = (
        found.withColumn("take", take).filter("take > 0")
        .withColumn("x", F.expr("v[feature]"))
        .groupBy("id", "feature").agg((F.sum(F.col("x") * F.col("take")) / F.sum("take")).alias("x"))
        .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "x"))).alias("x"))
    )
    answers = staged(requests.join(filled, "id", "left").select(
        F.col("v").alias("_v"), F.col("n").alias("_n"),
        *[F.coalesce(F.get("v", F.lit(i)), F.element_at("x", F.lit(i)), F.lit(means[i])).alias(f"_x{i}")
          for i in range(width)]))
    total = df.count()
    key = F.when(has_null(vector), vector)
    joined = lookup(df, answers, key, "_v", "_n", total)
    place = {c: i for i, c in enumerate(columns)}
    return joined.select([
        F.coalesce(as_number(fields[c]), F.col(f"_x{place[c]}")).alias(c) if c in place else col(c)
        for c in df.columns])


def _with_block(vectors: DataFrame, width: int, block_rows: int) -> DataFrame:
    """Cut the vectors of each null pattern into blocks by their widest-ranging present feature.

    A value that many vectors share in that feature is cut again by a hash, so no
    block grows beyond its size.
    """
    present = vectors.filter(F.exists("v", lambda x: x.isNotNull()))
    spread = present.agg(*[F.stddev_pop(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)]).first()
    ranked = sorted(range(width), key=lambda i: -(spread[f"s{i}"] or 0.0))
    lead = F.coalesce(*[F.get("v", F.lit(i)) for i in ranked])
    present = present.withColumn("_lead", lead)
    sizes = present.groupBy("pattern").agg(
        F.count("*").alias("rows"), F.percentile_approx("_lead", [i / 1024 for i in range(1, 1024)], 20_000).alias("c"))
    out = present.join(sizes, "pattern")  # one row per null pattern
    # Cuts used: every (1024 / wanted)-th, where wanted is the number of blocks the pattern needs.
    wanted = F.least(F.lit(1024), F.greatest(F.lit(1), F.expr(f"cast(ceil(rows / {block_rows}) as int)")))
    below = F.size(F.filter("c", lambda x: x <= F.col("_lead")))
    cut = F.floor(below * wanted / 1024).cast("int")
    out = out.withColumn("_cut", cut)
    counts = out.groupBy("pattern", "_cut").agg(F.ceil(F.count("*") / (2 * block_rows)).alias("_parts"))
    out = out.join(counts, ["pattern", "_cut"])
    part = F.pmod(F.xxhash64("v"), F.col("_parts"))
    return out.select("id", "v", "n", "pattern",
                      F.concat_ws("/", "pattern", F.col("_cut").cast("string"), part.cast("string")).alias("block"))
