"""The first rows of every table, kept up epoch by epoch instead of worked out anew."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaderstream.metrics import METRICS, SERVED_ROWS, Metric, rank_direction
from leaderstream.operators.balance import top_k_per_group
from leaderstream.operators.flatten import STATS
from leaderstream.operators.ranking import LANES, TIES, leaderboards, rank_order
from leaderstream.operators.upsert import anti_join_keys
from leaderstream.session import written
from leaderstream.streaming.epoch_log import EpochLog

_SCHEMA = T.StructType([*STATS.fields, T.StructField("_floor", T.BooleanType())])


class ServedRows:
    """Versions ``<root>/served/epoch=N`` of the first ``rows + reserve`` rows of each table of a log.

    A table that has more rows also has a floor: a copy of its last kept row at the time it was cut. All rows of
    the table that come before its floor are kept, so the kept rows are its first ones, however many are left. An
    epoch takes away the rows whose keys it brings anew and adds those of its rows that come before the floor. Both
    read the epoch and the kept rows only. Values that get worse use up the reserve; where fewer than ``rows`` are
    left above a floor, the table is filled again from the log, and no other table is.

    A replayed epoch starts from the version before it, so it counts once. Each task cuts a hot table of the epoch before
    it is shuffled. Rows that differ in no column of ``ties`` are served alike.
    """

    def __init__(
        self,
        log: EpochLog,
        metrics: Sequence[Metric] = METRICS,
        by: str = "number",
        rows: int = SERVED_ROWS,
        reserve: int = SERVED_ROWS,
        ties: Sequence[str] = TIES,
    ) -> None:
        self.log, self.metrics, self.by, self.rows, self.ties = log, metrics, by, rows, ties
        self.most = rows + reserve
        #: Tables that were filled from the log, by epoch.
        self.filled: dict[int, list[str]] = {}

    def versions(self) -> list[int]:
        return [n for n, _ in self.log._committed("served")]

    def _version(self, epoch: int) -> DataFrame:
        return self.log.spark.read.schema(_SCHEMA).parquet(f"{self.log.root}/served/epoch={epoch}")

    def _order(self) -> list:
        # A floor stands behind the rows that are equal to it.
        return [*rank_order(self.by, F.col("_direction"), self.ties), F.col("_floor").asc()]

    def _directed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_direction", rank_direction(self.metrics, F.col("table_name")))

    def _best(self, rows: DataFrame) -> DataFrame:
        """One row more than is kept of each table, to see whether there are more."""
        marked = self._directed(rows.select(*STATS.fieldNames(), F.lit(False).alias("_floor")))
        best = top_k_per_group(marked, ["table_name"], self._order(), self.most + 1, position="_pos", lanes=LANES)
        return best.select(*_SCHEMA.fieldNames())

    def _cut(self, rows: DataFrame) -> DataFrame:
        """Rows before their table's floor, the first ``most`` of them, and the floors. A bounded number for each table."""
        table = W.partitionBy("table_name")
        placed = self._directed(rows).withColumn("_pos", F.row_number().over(table.orderBy(*self._order())))
        floor = F.min(F.when(F.col("_floor"), F.col("_pos"))).over(table)
        inside = placed.withColumn("_at", floor).where(F.col("_at").isNull() | (F.col("_pos") <= F.col("_at")))
        inside = inside.withColumn("_n", F.count(F.when(~F.col("_floor"), 1)).over(table))
        last = (F.col("_pos") == self.most) & (F.col("_n") > self.most)
        out = (
            F.when(F.col("_floor"), F.when(F.col("_n") <= self.most, F.array(F.lit(True))))
            .when(last, F.array(F.lit(False), F.lit(True)))
            .when(F.col("_pos") <= self.most, F.array(F.lit(False)))
        )
        return inside.withColumn("_floor", F.explode(out)).select(*_SCHEMA.fieldNames())

    def update(self, epoch: int, retention_seconds: float = 3600) -> None:
        """Take in an epoch that the log holds. The first one fills every table from the log."""
        before = [n for n in self.versions() if n < epoch]
        path = f"{self.log.root}/served/epoch={epoch}"
        if not before:
            self._cut(self._best(self.log.state())).write.mode("overwrite").parquet(path)
            return
        old, batch = self._version(before[-1]), self.log.epoch(epoch)
        stay = anti_join_keys(old.where(~F.col("_floor")), batch)
        kept = written(self._cut(stay.unionByName(old.where("_floor")).unionByName(self._best(batch))), "served")
        left = kept.groupBy("table_name").agg(
            F.count(F.when(~F.col("_floor"), 1)).alias("_n"), F.max("_floor").alias("_more")
        )
        dry = left.where(F.col("_more") & (F.col("_n") < self.rows)).select("table_name")
        names = [r["table_name"] for r in dry.toLocalIterator()]
        if names:
            self.filled[epoch] = sorted(names)
            named = self.log.spark.createDataFrame([(n,) for n in names], "table_name string")
            again = self._cut(self._best(self.log.state(tables=named)))
            kept = kept.join(named, "table_name", "left_anti").unionByName(again)
        kept.write.mode("overwrite").parquet(path)
        self._vacuum(retention_seconds)

    def read(self, tables: DataFrame | None = None) -> DataFrame:
        """Rows as ``leaderboards`` gives them for the whole state, of all tables or the ``table_name`` of ``tables``."""
        versions = self.versions()
        if not versions:
            return leaderboards(self.log.state(tables=tables), self.metrics, self.by, self.rows, self.ties)
        kept = self._version(versions[-1]).where(~F.col("_floor")).drop("_floor")
        if tables is not None:
            kept = kept.join(tables.select("table_name").distinct(), "table_name", "left_semi")
        return leaderboards(kept, self.metrics, self.by, self.rows, self.ties)

    def _vacuum(self, retention_seconds: float) -> None:
        """Delete versions that are neither the last two nor younger than ``retention_seconds``."""
        before = (time.time() - retention_seconds) * 1000
        for _, folder in self.log._committed("served")[:-2]:
            path, fs = self.log._path(folder)
            if fs.getFileStatus(path).getModificationTime() <= before:
                fs.delete(path, True)
