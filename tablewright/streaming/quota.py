"""Per-key request quota with windows that open at the first request.

A window opens with the first request of a key, lasts 60 seconds and admits 100
requests; the first request after it has expired opens the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.columns import col
from ..functions.stage import staged

# Fixed values.
LIMIT, WINDOW_MS = 100, 60_000
BLOCK_MS = 3_600_000
PIECE = 100_000  # rows judged and handed on at a time
WHOLE_KEY = 250_000  # distinct milliseconds a key may have to be handled in one group


def apply_quota(df: DataFrame, key: str, time: str, tie: str, limit: int = LIMIT, window_ms: int = WINDOW_MS,
                block_ms: int = BLOCK_MS, whole_key: int = WHOLE_KEY, state: DataFrame | None = None) -> DataFrame:
    """SS-4 in batch: add window_start (ms) and accepted. `state` (key, start, count) continues earlier windows.

    Which request opens a window depends on all before it, yet a busy key must not
    go through one task. Requests are reduced to the distinct milliseconds of each
    key. A key with at most `whole_key` of them stays in one group; a busier key is cut into
    time blocks, which hold at most BLOCK_MS each. Every group tells, for each request that
    could open its first window, which one opens its last (ranges with the same
    outcome are merged). Chaining these short tables gives the window each group
    starts in; then all groups find their windows independently, and rows are
    numbered inside their window. Keys with few requests share groups.
    """
    key_type = df.schema[key].dataType.simpleString()
    ms = F.unix_millis(col(time).cast("timestamp"))
    d = df.withColumn("_ms", ms)
    seen = staged(d.select(col(key).alias("key"), "_ms").filter("key is not null and _ms is not null").distinct())
    size = seen.count()
    if state is None:
        state = df.sparkSession.createDataFrame([], f"key {key_type}, start long, count long")
    # At most rows / whole_key keys are busy, so this table stays small.
    busy = seen.groupBy("key").agg(F.count("*").alias("n"), F.min("_ms").alias("first")).filter(
        F.col("n") > whole_key).join(state, "key", "left").select(
        F.col("key").alias("_bk"), F.floor(F.col("first") / block_ms).cast("long").alias("_lead"),
        F.coalesce("start", F.lit(-1)).alias("_open"))
    part = F.when(F.col("_bk").isNotNull(), F.floor(F.col("_ms") / block_ms).cast("long")).otherwise(F.lit(-1))
    seen = seen.join(F.broadcast(busy), F.col("key") == F.col("_bk"), "left").select(
        "key", "_ms", part.alias("part"), F.coalesce(part == F.col("_lead"), F.lit(False)).alias("lead"), "_open")

    def outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.sort(pdf["_ms"].to_numpy())
        last = _follow(np.searchsorted(m, m + window_ms, side="right"), len(m))
        start = pdf["part"].iloc[0] * block_ms
        # A window of an earlier block ends less than window_ms into this one: only these can open the first.
        # In a key's first block the window carried in may have opened inside the block.
        upto = min(len(m), int(np.searchsorted(m, start - 1 + window_ms, side="right")) + 1)
        upto = len(m) if pdf["lead"].iloc[0] else upto
        ends = m[last[:upto]]
        cut = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))
        return pd.DataFrame({"key": pdf["key"].iloc[0], "part": pdf["part"].iloc[0], "upto": m[cut], "last": ends[cut],
                             "open": pdf["_open"].iloc[0]})

    table = seen.filter("part >= 0").groupBy("key", "part").applyInPandas(
        outcomes, f"key {key_type}, part long, upto long, last long, open long")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, carry = [], int(pdf["open"].iloc[0])
        for block, rows in pdf.sort_values(["part", "upto"]).groupby("part", sort=True):
            out.append((rows["key"].iloc[0], block, carry))
            upto, last = rows["upto"].to_numpy(), rows["last"].to_numpy()
            i = 0 if carry < 0 else int(np.searchsorted(upto, carry + window_ms, side="right"))
            if i < len(upto):
                carry = int(last[i])
        return pd.DataFrame(out, columns=["key", "part", "carry"])

    carries = table.groupBy("key").applyInPandas(chain, f"key {key_type}, part long, carry long").unionByName(
        state.select("key", F.lit(-1).cast("long").alias("part"), F.col("start").alias("carry")))

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        """Start of the window each request falls into, for all keys of the group at once."""
        code, names = pd.factorize(pdf["key"])
        order = np.lexsort((pdf["_ms"].to_numpy(), code))
        code, m, carry = code[order], pdf["_ms"].to_numpy()[order], pdf["carry"].to_numpy()[order]
        # One number line for all keys, far enough apart that a window never reaches the next key.
        low, width = m.min(), int(m.max() - m.min()) + window_ms + 2
        line = code.astype("int64") * width + (m - low)
        begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        end = np.append(begin[1:], len(m))
        limit_of = np.repeat(end, end - begin)
        after = np.minimum(np.searchsorted(line, line + window_ms, side="right"), limit_of)
        held = carry[begin] >= 0
        reach = np.clip(carry[begin] + window_ms - low, -1, width - 1)
        first = np.where(held, np.searchsorted(line, code[begin].astype("int64") * width + reach, side="right"), begin)
        first = np.minimum(np.maximum(first, begin), end)
        opens = np.full(len(m), -1)
        front = first[first < end]
        while len(front):
            opens[front] = front
            front = front[after[front] < limit_of[front]]
            front = after[front]
        at = np.maximum.accumulate(opens)
        own = at >= np.repeat(begin, end - begin)
        return pd.DataFrame({"key": names.take(code), "_ms": m, "window_start": np.where(own, m[np.maximum(at, 0)], carry)})

    # Keys that are not busy share groups of about `whole_key` requests.
    quiet = max(1, -(-size // max(whole_key, 1)))
    grouped = seen.join(carries, ["key", "part"], "left").select(
        "key", "_ms", F.coalesce("carry", F.lit(-1).cast("long")).alias("carry"), "part",
        F.when(F.col("part") >= 0, F.col("key")).alias("busy"),
        F.when(F.col("part") < 0, F.pmod(F.xxhash64("key"), F.lit(quiet))).alias("bucket"))
    starts = grouped.groupBy("busy", "part", "bucket").applyInPandas(
        windows, f"key {key_type}, _ms long, window_start long").select(
        F.col("key").alias("_k"), F.col("_ms").alias("_m"), "window_start")
    joined = d.join(starts, (col(key) == F.col("_k")) & (F.col("_ms") == F.col("_m")), "left")
    # Both the open windows and the numbering go by (key, window): one exchange, one window per group.
    before = state.select(F.col("key").alias("_sk"), F.col("start").alias("_ss"), F.col("count").alias("_used"))
    joined = joined.join(before, (col(key) == F.col("_sk")) & (F.col("window_start") == F.col("_ss")), "left")
    rank = F.row_number().over(Window.partitionBy(col(key), "window_start").orderBy("_ms", col(time), col(tie)))
    return joined.withColumn("accepted", rank + F.coalesce("_used", F.lit(0)) <= limit).select(
        *map(col, df.columns), "window_start", "accepted")


def _follow(nxt: np.ndarray, n: int) -> np.ndarray:
    """Index of the last opener in the chain from each index, by doubling the jumps."""
    last = np.where(nxt < n, nxt, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


class QuotaTable:
    """SS-4 on a stream for keys of any size: open windows are kept as a table, one version per micro-batch.

    Every micro-batch is judged by `apply_quota`, which spreads a busy key over
    tasks. A version is written under its batch id; a repeated batch reads the same
    predecessor and writes the same version again.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, time: str, tie: str, **options):
        self.spark, self.root = spark, root.rstrip("/")
        self.key, self.time, self.tie, self.options = key, time, tie, options

    def apply(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The batch with `accepted`; its end state becomes version `batch_id`."""
        old = self.spark.read.parquet(f"{self.root}/v{batch_id - 1}") if batch_id else None
        judged = staged(apply_quota(batch, self.key, self.time, self.tie, state=old, **self.options))
        counts = judged.filter("window_start is not null").groupBy(
            col(self.key).alias("key"), F.col("window_start").alias("start")).agg(
            F.sum(F.col("accepted").cast("long")).alias("count"))
        if old is not None:
            counts = counts.unionByName(old)
        open_now = counts.groupBy("key", "start").agg(F.sum("count").alias("count")).groupBy("key").agg(
            F.max(F.struct("start", "count")).alias("s")).select("key", "s.start", "s.count")
        # One row per key: a key that is late or replayed must find its own window, however new others are.
        open_now.write.mode("overwrite").parquet(f"{self.root}/v{batch_id}")
        return judged.drop("window_start")


STATE = T.StructType([T.StructField("start", T.LongType()), T.StructField("count", T.LongType())])


def _time_order(time: pd.Series, tie: pd.Series) -> np.ndarray:
    """Positions by time and tie, missing ones last; numbers are sorted without tables of distinct values."""
    if tie.dtype.kind in "iufM":
        return np.lexsort((tie.to_numpy(), time.to_numpy()))
    return pd.DataFrame({"time": time, "tie": tie}).sort_values(["time", "tie"], kind="stable").index.to_numpy()


def stream_quota(df: DataFrame, key: str, time: str, tie: str, limit: int = LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """SS-4 as a stateful operator: add accepted. State per key is the window start and its count.

    The requests of a key inside one micro-batch are taken in time order by one
    task, so set a read limit on the source; for keys that outgrow a task see
    `QuotaTable`. Every request gets a verdict: one that comes late counts in the
    window its key has open, as in `QuotaTable`. A watermark would drop it unseen,
    so there is none, and state keeps one row per key.
    """
    names = df.columns

    def admit(ids, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True)
        order = _time_order(rows[time], rows[tie])
        start, count = state.get if state.exists else (None, 0)
        flags = np.zeros(len(rows), bool)
        times = rows[time].to_numpy()
        for lo in range(0, len(rows), PIECE):  # in pieces: the rows themselves are the only large thing held
            for i, t in enumerate(times[order[lo:lo + PIECE]].astype("datetime64[ms]").astype("int64").tolist(), lo):
                if start is None or t > start + window_ms:
                    start, count = t, 0
                flags[i] = count < limit
                count += count < limit
        state.update((start, count))
        for lo in range(0, len(rows), PIECE):
            part = rows.take(order[lo:lo + PIECE])
            part["accepted"] = flags[lo:lo + PIECE]
            yield part[[*names, "accepted"]]

    schema = T.StructType([*df.schema.fields, T.StructField("accepted", T.BooleanType())])
    return df.groupBy(col(key)).applyInPandasWithState(admit, schema, STATE, "append", "NoTimeout")
