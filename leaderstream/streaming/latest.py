"""One row per key kept by Spark's own state store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leaderstream.metrics import METRICS, Metric
from leaderstream.operators.flatten import accepted_rows, judge_events, rejected_events
from leaderstream.operators.upsert import upsert_latest
from leaderstream.session import check_time_zone
from leaderstream.streaming.epoch_log import EpochLog
from leaderstream.streaming.ingest import fold

# State off the heap, with changes rather than whole snapshots per checkpoint.
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def start_latest(
    stats: DataFrame,
    log: EpochLog,
    available_now: bool = False,
    compact_every: int | None = None,
    full_every: int | None = None,
    retention_seconds: float = 3600,
) -> StreamingQuery:
    """Keep the newest row per key of a stream of statistic rows.

    The state is one row per key. Each epoch appends only the rows it changed,
    so ``log.state()`` reads one row per key, whatever the batch boundaries.
    Without an ``offset``, rows of one time are told apart by their values.
    """
    check_time_zone(stats.sparkSession)
    for column in ("offset", "batch_id"):
        if column not in stats.columns:
            stats = stats.withColumn(column, F.lit(0).cast("bigint"))

    def write(changed: DataFrame, epoch: int) -> None:
        log.append(changed, epoch)
        fold(log, epoch, compact_every, full_every, retention_seconds)

    writer = (
        upsert_latest(stats)
        .writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", f"{log.root}/checkpoint")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    conf = stats.sparkSession.conf
    before = {key: conf.get(key, None) for key in _STATE_STORE}
    try:
        # A query copies the settings when it starts.
        for key, value in _STATE_STORE.items():
            conf.set(key, value)
        return writer.start()
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)


def start_latest_events(
    messages: DataFrame,
    log: EpochLog,
    metrics: Sequence[Metric] = METRICS,
    available_now: bool = False,
    **folding,
) -> list[StreamingQuery]:
    """``start_latest`` on raw messages, and a second query that keeps the rejects in ``<root>/rejects``."""
    judged = judge_events(messages, metrics)
    rejects = (
        rejected_events(judged)
        .select("event_time", "message", "reason")
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{log.root}/rejects")
        .option("checkpointLocation", f"{log.root}/rejects-checkpoint")
    )
    if available_now:
        rejects = rejects.trigger(availableNow=True)
    rows = accepted_rows(judged, null_keys="reject")
    return [start_latest(rows, log, available_now, **folding), rejects.start()]
