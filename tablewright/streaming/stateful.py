"""Stream operators on state variables of the RocksDB provider: quota windows and newest rows per key.

State lives beside the tasks and is checkpointed as changes only; nothing is rewritten whole per micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.columns import col
from .quota import LIMIT, WINDOW_MS

SETTINGS = {"spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            # Timers are looked at with the next data; else a query over what is there now would never end.
            "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
IDLE_MS, REPLAY_MS = 3_600_000, 600_000
BUCKETS = 1024  # groups of keys of a feed
IDS = 10_000  # admitted requests an entry holds


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None):
    """Start stateful queries inside: a query keeps the settings it was started with, the session gets its own back.

    `partitions` of the state are fixed by a query's first start; default: the session's shuffle partitions.
    """
    new = SETTINGS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plain(kind: T.DataType) -> T.DataType:
    """State cells of times are whole microseconds, whatever the session time zone."""
    return T.LongType() if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else kind


def _cells(values: pd.Series) -> list:
    """Python values; times as microseconds, missing ones as None."""
    if values.dtype.kind == "M":
        return [None if v is pd.NaT else int(v.value) // 1000 for v in values.dt.tz_localize(None).astype("datetime64[ns]")]
    return [None if v is None or v is pd.NA or (isinstance(v, float) and v != v and values.dtype.kind != "f") else v for v in values.tolist()]


def quota(df: DataFrame, key: str, time: str, tie: str, limit: int = LIMIT, window_ms: int = WINDOW_MS,
          idle_ms: int = IDLE_MS, replay_ms: int = REPLAY_MS, state: DataFrame | None = None) -> DataFrame:
    """SS-4 with state variables: add `accepted`. Start the query inside `state_settings`.

    `window` (start, count) is the window a key has open; `admitted` holds the admitted requests by their `tie`: a
    micro-batch appends its own as entries of at most IDS, and each ends `replay_ms` after it was written. Requests of a micro-batch are taken in time order. Every request gets a
    verdict: a late one counts in the window its key has open; one that was admitted before and comes again
    is admitted without being counted again. A timer clears the window of a key that was silent for `idle_ms`, so state
    holds active keys only; both spans are processing time and must exceed the lateness that is to be told apart.
    `state` (key, start, count), for example a version of `QuotaTable`, continues earlier windows. Null keys are a key of
    their own; a null time is refused. One key's requests of one micro-batch are one task's; for keys beyond that see
    `QuotaTable`.
    """
    names, id_type = df.columns, _plain(df.schema[tie].dataType)
    entry = T.StructType([T.StructField("ids", T.ArrayType(id_type))])
    cells = _cells

    class Windows(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.window = handle.getValueState("window", "start long, count long, timer long")
            self.admitted = handle.getListState("admitted", entry, ttlDurationMs=replay_ms)

        def _wake(self, now: int, old: int | None) -> int:
            if old:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(now + idle_ms)
            return now + idle_ms

        def handleInitialState(self, key, initialState, timerValues) -> None:
            r = initialState.iloc[0]
            self.window.update((int(r["start"]), int(r["count"]), self._wake(timerValues.getCurrentProcessingTimeInMs(), None)))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            d = pd.concat(list(rows), ignore_index=True).sort_values([time, tie], kind="stable", ignore_index=True)
            start, count, timer = self.window.get() if self.window.exists() else (None, 0, None)
            now = timerValues.getCurrentProcessingTimeInMs()
            seen, fresh = {i for e in self.admitted.get() for i in e[0]}, []
            ids, known = cells(d[tie]), d[time].notna().to_numpy()
            ms = d[time].to_numpy().astype("datetime64[ms]").astype("int64")
            accepted = np.zeros(len(d), bool)
            for i, who in enumerate(ids):
                if who in seen:
                    accepted[i] = True
                elif known[i]:
                    if start is None or ms[i] > start + window_ms:
                        start, count = int(ms[i]), 0
                    if count < limit:
                        accepted[i], count = True, count + 1
                        if who is not None:
                            seen.add(who)
                            fresh.append(who)
            for i in range(0, len(fresh), IDS):
                self.admitted.appendValue((fresh[i:i + IDS],))
            if start is not None:
                self.window.update((start, count, self._wake(now, timer)))
            d["accepted"] = accepted
            yield d[[*names, "accepted"]]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.window.clear()
            return iter([])

        def close(self) -> None:
            pass

    schema = T.StructType([*df.schema.fields, T.StructField("accepted", T.BooleanType())])
    first = None if state is None else state.select(F.col("key").alias(key), "start", "count").groupBy(col(key))
    return df.groupBy(col(key)).transformWithStateInPandas(Windows(), schema, "Append", "ProcessingTime", initialState=first)


def _key_text(df: DataFrame, key: str) -> Column:
    """A text that differs for different keys; '' for null."""
    kind, k = df.schema[key].dataType, col(key)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        k = k + F.lit(0.0)  # one zero
    if isinstance(kind, (T.ArrayType, T.StructType, T.VariantType)):
        k = F.to_json(k, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    elif isinstance(kind, T.BinaryType):
        k = F.hex(k)
    text = F.unix_micros(k) if isinstance(kind, T.TimestampType) else k
    return F.coalesce(F.concat(F.lit("="), text.cast("string")), F.lit(""))


def newest(df: DataFrame, key: str, time: str, k: int, tie: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """SS-8 / SS-9 with state variables: the newest `k` rows of every key that a micro-batch changed.

    The state of a key is the ordered list of its newest rows; older ones are evicted. A micro-batch gives the whole new
    list of each key whose list changed (column `rank`, newest first) and nothing for others. Null times are oldest.
    Keys are dealt to `buckets` groups, so that a call serves many keys; a group holds a map from key to list, of which
    only the keys that come are read and only the changed ones written. The number is fixed by a query's first start.
    """
    names = df.columns
    cell = T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in df.schema.fields])
    value = T.StructType([T.StructField("rows", T.ArrayType(cell))])
    times = {f.name: isinstance(f.dataType, T.TimestampType) for f in df.schema.fields if _plain(f.dataType) != f.dataType}
    # Columns travel under plain names: a batch renames those that begin with an underscore.
    sent = {c: f"c{i}" for i, c in enumerate(names)}
    whole = {f.name: f"null{i}" for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.IntegralType) and f.nullable}
    at, by, cells = names.index(time), names.index(tie) if tie else None, _cells

    def order(row: tuple) -> tuple:
        keys = (row[at],) if by is None else (row[at], row[by])
        return tuple((v is not None, v if v is not None else 0) for v in keys)

    def read(part: pd.DataFrame, name: str) -> list:
        values = cells(part[sent[name]])  # pandas would turn whole numbers among nulls into floats
        return [None if gone else v for v, gone in zip(values, part[whole[name]])] if name in whole else values

    class Newest(StatefulProcessor):
        def init(self, handle) -> None:
            self.lists = handle.getMapState("lists", "key string", value)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            new: dict[str, list[tuple]] = {}
            for part in rows:  # never more than one batch of rows and k rows a key at a time
                came: dict[str, list[tuple]] = {}
                for who, row in zip(part["who"], zip(*(read(part, c) for c in names))):
                    came.setdefault(who, []).append(row)
                for who, found in came.items():
                    new[who] = sorted([*new.get(who, ()), *found], key=order, reverse=True)[:k]
            changed: list[tuple] = []
            for who, found in new.items():
                held = self.lists.getValue((who,))
                old = [] if held is None else [tuple(r) for r in held[0]]
                best = sorted([*old, *found], key=order, reverse=True)[:k]
                if best != old:
                    self.lists.updateValue((who,), (best,))
                    changed += [(*r, i) for i, r in enumerate(best, 1)]
            if not changed:
                return
            out = pd.DataFrame(changed, columns=[*names, "rank"], dtype=object)
            for c, zoned in times.items():
                out[c] = pd.to_datetime(out[c], unit="us", utc=zoned)
            yield out.astype({"rank": "int32"})

        def close(self) -> None:
            pass

    result = T.StructType([*df.schema.fields, T.StructField("rank", T.IntegerType())])
    plain = {c: F.coalesce(col(c), F.lit(0).cast(df.schema[c].dataType)) if c in whole else col(c) for c in names}
    d = df.select(_key_text(df, key).alias("who"), *[x.alias(sent[c]) for c, x in plain.items()], *[col(c).isNull().alias(n) for c, n in whole.items()])
    return d.withColumn("bucket", F.pmod(F.xxhash64("who"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(
        Newest(), result, "Append", "None")


class NewestTable:
    """What `newest` gives, as a table: every micro-batch adds the lists of the keys it changed, under its batch id.

    A repeated batch replaces its own folder. Rows written go with the keys a batch changes, not with all keys.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")

    def start(self, stream: DataFrame, time: str, k: int, tie: str | None, checkpoint: str,
              partitions: int | None = None, **trigger) -> StreamingQuery:
        with state_settings(self.spark, partitions):
            return newest(stream, self.key, time, k, tie).writeStream.foreachBatch(self.write).option(
                "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def changes(self) -> DataFrame:
        """All lists ever written, with `batch`."""
        return self.spark.read.option("basePath", self.root).parquet(f"{self.root}/batch=*")

    def read(self) -> DataFrame:
        """The newest list of every key."""
        every = self.changes()
        last = every.groupBy(col(self.key).alias("_k")).agg(F.max("batch").alias("_b"))
        return every.join(last, col(self.key).eqNullSafe(F.col("_k")) & (F.col("batch") == F.col("_b"))).drop("_k", "_b", "batch")


def user_feed(stream: DataFrame, user, key: str, time: str, k: int, tie: str | None = None) -> DataFrame:
    """SS-9: the newest `k` rows of one user; the filter reaches the source, so one key has state."""
    return newest(stream.filter(col(key) == F.lit(user)), key, time, k, tie)
