"""The leaderboards of one epoch log behind a small interface."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leaderstream.metrics import INDIVIDUAL, METRICS, Metric
from leaderstream.operators import prompts, serving
from leaderstream.operators.ranking import leaderboard, leaderboards, rank_all
from leaderstream.session import check_time_zone
from leaderstream.sources import board_tables
from leaderstream.streaming import ingest
from leaderstream.streaming.bucket_log import BucketLog
from leaderstream.streaming.epoch_log import EpochLog


class Board:
    """Ingest events, then list, rank, filter and export the metric tables."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        metrics: Sequence[Metric] = METRICS,
        by: str = "number",
        buckets: int | None = None,
    ) -> None:
        """``buckets`` of each table keep the state in a ``BucketLog``; without them it is an ``EpochLog``."""
        check_time_zone(spark)
        self.log = BucketLog(spark, root, buckets) if buckets else EpochLog(spark, root)
        self.metrics = metrics
        self.by = by

    def ingest(self, messages: DataFrame, **trigger) -> StreamingQuery:
        return ingest.start_ingest(messages, self.log, self.metrics, **trigger)

    def stats(self, name: str | None = None) -> DataFrame:
        """Current rows of one table or of all."""
        return self.log.state(name)

    def tables(self, prefix: str = INDIVIDUAL) -> DataFrame:
        return serving.list_tables(self.log.read(), prefix)

    def leaderboard(
        self, name: str | None = None, team: str = "", cl: str = "", position: str = ""
    ) -> DataFrame:
        """Served rows of one table, or of all, with optional filters."""
        if name is None:
            served = leaderboards(self.stats(), self.metrics, self.by)
        else:
            served = leaderboard(self.stats(name), name, self.metrics, self.by)
        return serving.filter_rows(served, team, cl, position)

    def ranks(self, name: str | None = None) -> DataFrame:
        """Every row of one table, or of all, with its rank."""
        return rank_all(self.stats(name), self.metrics, self.by)

    def records(self, name: str) -> DataFrame:
        return serving.records(self.leaderboard(name))

    def facets(self, name: str) -> DataFrame:
        return serving.facet_values(self.leaderboard(name))

    def facet_options(self, name: str) -> DataFrame:
        """Values on offer for each filter of a table under every choice of the other filters, with counts."""
        return serving.facet_options(serving.facet_counts(self.leaderboard(name)))

    def snapshots(self, prefix: str = INDIVIDUAL) -> DataFrame:
        return serving.snapshots(self.leaderboard(), prefix)

    def register_views(self) -> list[str]:
        """Name every table as a view for ``spark.sql``, as of now: call again to follow the stream."""
        state = self.stats()
        names = serving.table_names(self.log.read())
        for name in names:
            serving.register_view(state, name)
        return names

    def register_source(self, name: str = "board_tables") -> None:
        """One name for all tables of a board with ``buckets``, which follows the stream: ``SELECT … WHERE table_name = …``."""
        if not isinstance(self.log, BucketLog):
            raise ValueError("a board without buckets has views by register_views alone")
        board_tables.register_table(self.log.spark, self.log.root, name)

    def ingest_views(self, messages: DataFrame, **trigger) -> StreamingQuery:
        """``ingest``, with the views replaced after each epoch."""
        return self.ingest(messages, after=lambda _: self.register_views(), **trigger)

    def vacuum(self, retention_seconds: float = 3600) -> list[str]:
        return self.log.vacuum(retention_seconds)

    def prompts(self, questions: DataFrame, category: str | None = None) -> DataFrame:
        best = leaderboards(self.stats(), self.metrics, self.by, rows=prompts.PROMPT_ROWS)
        return prompts.build_prompts(questions, serving.records(best), category)

    def compact(self, full: bool = False) -> int | None:
        return self.log.compact(full)
