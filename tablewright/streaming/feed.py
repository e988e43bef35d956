"""The latest-events feed and the running flows: intake into two sinks, scheduled drift runs."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import col
from ..functions.stage import staged
from ..operators import drift
from ..operators.dashboard import latest
from ..sources.sinks import write_alerts
from . import intake, quota

log = logging.getLogger(__name__)
FEED_ROWS = 20


def latest_events(events: DataFrame, k: int = FEED_ROWS, key: str = "user_id", time: str = "timestamp",
                  tie: str | None = None) -> DataFrame:
    """SS-8 in batch: newest k events per user. On a stream: `stateful.NewestTable`."""
    return latest(events, key, time, k, tie)


def user_changes(stream: DataFrame, user) -> DataFrame:
    """SS-9: inserts of one user; the filter reaches the source. Their newest rows: `stateful.user_feed`."""
    return stream.filter(F.col("user_id") == F.lit(user))


def start_intake(requests: DataFrame, keys: DataFrame, events_path: str, rejects_path: str, state_path: str,
                 checkpoint: str, **trigger) -> StreamingQuery:
    """SS-7: requests (api_key, ts, id, body) into the event table, refused ones with a reason into a second one.

    Order: key format, quota, user, payload. The quota counts every request with a well-formed key, so unknown keys are
    limited too. `used` under the state path holds each key's newest use per micro-batch. Every micro-batch writes
    folders named after its id, so a retry replaces them.
    """
    table = quota.QuotaTable(requests.sparkSession, state_path, "key_hash", "ts", "id")
    plain = [c for c in requests.columns if c != "api_key"]

    def write(batch: DataFrame, batch_id: int) -> None:
        put = lambda d, path: d.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        formed, malformed = intake.by_format(batch)
        counted = table.apply(formed, batch_id)
        known, unknown = intake.by_user(counted.filter("accepted"), keys)
        put(malformed.unionByName(unknown.select(*plain, "reason")), f"{rejects_path}/keys")
        put(intake.last_used(known), f"{state_path}/used")
        judged = staged(intake.validate(known))
        put(intake.event_rows(judged.filter("valid")), events_path)
        bad = judged.filter("not valid").select("id", "ts", "body", F.array_join("errors", "; ").alias("reason"))
        limited = counted.filter("not accepted").select("id", "ts", "body", F.lit("rate limit exceeded").alias("reason"))
        put(bad.unionByName(limited), f"{rejects_path}/payload")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def scheduled_drift(stream: DataFrame, store, key: str, thresholds: dict[str, float], alert_path: str,
                    checkpoint: str, **trigger) -> StreamingQuery:
    """SS-11: a drift run with alerts per arriving batch; a failed run is logged and does not stop the next.

    Versions of the baseline and alerts carry the batch id, so a batch that is delivered twice is compared with the same
    baseline again and replaces its own alerts. A store serves one stream.
    """

    def once(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        batch.persist()  # a run reads the batch several times
        try:
            report = drift.run(batch, store, key, batch_id)
            if report is not None:
                found = drift.alerts(report["findings"], thresholds, key)
                if not found.isEmpty():
                    write_alerts(found, alert_path, key, batch_id)
        except Exception:
            log.exception("drift run of batch %s failed", batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
