"""Streams of event messages into an epoch log."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leaderstream.metrics import INDIVIDUAL, METRICS, Metric
from leaderstream.operators.flatten import accepted_rows, judge_events, rejected_events
from leaderstream.operators.ranking import leaderboards
from leaderstream.operators.serving import snapshots
from leaderstream.session import check_time_zone
from leaderstream.streaming.epoch_log import EpochLog
from leaderstream.streaming.served import ServedRows


def ingest_batch(
    log: EpochLog,
    metrics: Sequence[Metric] = METRICS,
    compact_every: int | None = None,
    snapshots_to: str | None = None,
    full_every: int | None = None,
    retention_seconds: float = 3600,
    null_keys: str = "keep",
    after: Callable[[int], object] | None = None,
    served: ServedRows | None = None,
) -> Callable[[DataFrame, int], None]:
    """The callback of one micro-batch: its rows to the log, its rejects aside, its tables' first rows kept up."""
    if snapshots_to and served is None:
        served = ServedRows(log, metrics)

    def write(batch: DataFrame, epoch: int) -> None:
        judged = judge_events(batch, metrics).persist()
        try:
            if not judged.isEmpty():
                log.append(accepted_rows(judged, null_keys), epoch)
                write_rejects(judged, log, epoch)
                if served:
                    served.update(epoch)
                if snapshots_to:
                    _publish(served.read(log.epoch(epoch)), snapshots_to, epoch, "")
        finally:
            judged.unpersist()
        fold(log, epoch, compact_every, full_every, retention_seconds)
        if after:
            after(epoch)

    return write


def write_rejects(judged: DataFrame, log: EpochLog, epoch: int) -> None:
    rejects = rejected_events(judged).select("event_time", "message", "reason")
    rejects.write.mode("overwrite").parquet(f"{log.root}/rejects/epoch={epoch}")


def fold(
    log: EpochLog, epoch: int, compact_every: int | None, full_every: int | None, retention_seconds: float
) -> None:
    """After every so many epochs, empty ones included: fold, and delete what has long been folded."""
    full = bool(full_every) and (epoch + 1) % full_every == 0
    if full or (compact_every and (epoch + 1) % compact_every == 0):
        log.compact(full)
        log.vacuum(retention_seconds)


def start_ingest(
    messages: DataFrame,
    log: EpochLog,
    metrics: Sequence[Metric] = METRICS,
    processing_time: str | None = None,
    available_now: bool = False,
    **options,
) -> StreamingQuery:
    """Run a stream of messages (``value`` and, if known, ``offset``) into the log.

    The checkpoint lies next to the log, so the two cannot drift apart.
    ``options`` are those of ``ingest_batch``: ``compact_every`` folds the epochs
    since the last time and ``full_every`` everything, each after so many
    epochs, ``retention_seconds`` later folded folders go, ``snapshots_to``
    publishes the tables each epoch changed, ``null_keys="reject"`` keeps rows
    without a usable key out of the tables, ``served`` keeps the first rows of all tables up to date
    (snapshots come from these, by default from its own), and ``after`` is called with each epoch.
    """
    check_time_zone(messages.sparkSession)
    writer = (
        messages.writeStream.foreachBatch(ingest_batch(log, metrics, **options))
        .outputMode("append")
        .option("checkpointLocation", f"{log.root}/checkpoint")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def publish_snapshots(
    log: EpochLog,
    path: str,
    version: int,
    metrics: Sequence[Metric] = METRICS,
    prefix: str = INDIVIDUAL,
    served: ServedRows | None = None,
) -> None:
    """Write the current JSON document of every table as one version, from ``served`` rows or from the log."""
    _publish(served.read() if served else leaderboards(log.state(), metrics), path, version, prefix)


def _publish(rows: DataFrame, path: str, version: int, prefix: str) -> None:
    documents = snapshots(rows, prefix).withColumn("version", F.lit(version).cast("bigint"))
    documents.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={version}")
