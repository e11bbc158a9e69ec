"""The log of epochs as a log-structured merge by hash bucket of the key."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaderstream.metrics import INDIVIDUAL
from leaderstream.operators.flatten import STATS, empty_stats
from leaderstream.operators.upsert import resolve_batches
from leaderstream.streaming.epoch_log import EpochLog

#: Buckets of each table.
BUCKETS = 16
#: A run is merged with the newer ones once these have this share of its rows.
RATIO = 0.5

# Versions of the list of runs that belong to one epoch.
_STEPS = 1024
_RUNS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("run", T.StringType()),
        T.StructField("upto", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("buckets", T.IntegerType()),
    ]
)
_ROWS = T.StructType([*STATS.fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])
_PLACE = ["run", "table_name", "bucket"]
# A sketch of the keys in each file, by which Parquet readers skip row groups.
_SKETCH = {"parquet.bloom.filter.enabled#Name": "true", "parquet.bloom.filter.enabled#Team": "true"}


def _bucket(name: Column, team: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name, team), F.lit(buckets)).cast("int")


class BucketLog(EpochLog):
    """Runs ``<root>/runs/run=R/table_name=…/bucket=B``, and ``<root>/live/version=V``, which lists those that count.

    An epoch writes one run, with files for the buckets that its keys are in. ``compact`` merges, in each bucket by itself,
    the newest runs with older ones as long as the newer have ``RATIO`` of the rows of the next one. So sizes grow
    geometrically from run to run: a bucket has a logarithmic number of runs, a row is rewritten as
    often as that, and what is replaced but still there stays in proportion to the state. A bucket that no epoch touches is not
    rewritten. Rows of a bucket with a single run are read as they are; the others are resolved.

    A version counts once its ``_SUCCESS`` marker is there. A replayed epoch goes back to the version before it. The number
    of buckets belongs to the log: one that exists keeps its own.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        super().__init__(spark, root)
        known = self._live().select("buckets").first()
        self.buckets = known[0] if known else buckets

    def versions(self) -> list[int]:
        return [n for n, _ in self._committed("live")]

    def _live(self) -> DataFrame:
        """The runs that count, a row for each bucket: a few for each bucket there is, not for rows or epochs."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], _RUNS)
        return self.spark.read.schema(_RUNS).parquet(f"{self.root}/live/version={versions[-1]}")

    def _commit(self, runs: DataFrame, version: int) -> None:
        runs.select(*_RUNS.fieldNames()).hint("rebalance").write.mode("overwrite").parquet(
            f"{self.root}/live/version={version}"
        )

    def _write_run(self, rows: DataFrame, run: str) -> DataFrame:
        """Writes the rows and gives the run's buckets."""
        name = F.when(F.col("entity_type") == INDIVIDUAL, F.col("Name")).otherwise(F.lit(""))
        dealt = rows.withColumn("bucket", _bucket(name, F.col("Team"), self.buckets))
        writer = dealt.hint("rebalance", "table_name", "bucket").write.mode("overwrite").options(**_SKETCH)
        writer.partitionBy("table_name", "bucket").parquet(f"{self.root}/runs/run={run}")
        counts = self._runs([run]).groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("rows"))
        return counts.withColumn("buckets", F.lit(self.buckets))

    def _runs(self, runs: list[str]) -> DataFrame:
        if not runs:
            return empty_stats(self.spark).withColumns({"run": F.lit(""), "bucket": F.lit(0)})
        reader = self.spark.read.schema(_ROWS).option("basePath", f"{self.root}/runs")
        return reader.parquet(*[f"{self.root}/runs/run={r}" for r in runs])

    def _rows(self, places: DataFrame, table: str | None = None) -> DataFrame:
        """The rows of some buckets of some runs; Spark reads their folders alone where the list is small."""
        runs = sorted(r["run"] for r in places.select("run").distinct().toLocalIterator())
        rows = self._runs(runs)
        if table is not None:
            rows = rows.where(F.col("table_name") == table)
        return rows.join(places.select(*_PLACE), _PLACE, "left_semi").select(*STATS.fieldNames())

    def append(self, rows: DataFrame, epoch: int, batch: str | None = None) -> None:
        """As ``EpochLog.append``; rows that a later batch of the same epoch replaces are not written."""
        for version, folder in self._committed("live"):
            if version >= epoch * _STEPS:
                path, fs = self._path(folder)
                fs.delete(path, True)
        rows = self._numbered(rows, epoch, batch)
        if batch is not None:
            rows = resolve_batches(rows)
        written = self._write_run(rows, f"e{epoch}").withColumn("upto", F.lit(epoch).cast("bigint"))
        self._commit(self._live().unionByName(written), epoch * _STEPS)

    def epochs(self) -> list[int]:
        """The last epochs of the versions that are kept."""
        return sorted({v // _STEPS for v in self.versions()})

    def epoch(self, number: int) -> DataFrame:
        return self._runs([f"e{number}"]).select(*STATS.fieldNames())

    def read(self) -> DataFrame:
        return self._rows(self._live())

    def state(self, table: str | None = None, tables: DataFrame | None = None) -> DataFrame:
        live = self._live()
        if table is not None:
            live = live.where(F.col("table_name") == table)
        if tables is not None:
            live = live.join(tables.select("table_name").distinct(), "table_name", "left_semi")
        counted = live.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("table_name", "bucket")))
        settled, contested = self._rows(counted.where("_n = 1"), table), counted.where("_n > 1")
        if contested.isEmpty():
            return settled
        return settled.unionByName(resolve_batches(self._rows(contested, table)))

    def entity(self, team: str, name: str | None = None, table: str | None = None) -> DataFrame:
        """The current rows of one team or, with a ``name``, one player: one bucket of each table, and the row groups
        whose sketch has the key."""
        live = self._live().where(F.col("bucket") == _bucket(F.lit(name or ""), F.lit(team), self.buckets))
        who = (F.col("Team") == team) & (F.col("Name").isNull() if name is None else F.col("Name") == name)
        return resolve_batches(self._rows(live, table).where(who))

    def compact(self, full: bool = False) -> int | None:
        """Merge runs where newer ones have grown, or all runs of each bucket; returns the last epoch if any did."""
        versions = self.versions()
        if not versions:
            return None
        live = self._live()
        bucket = W.partitionBy("table_name", "bucket")
        newest = bucket.orderBy(F.col("upto").desc())
        newer = F.sum("rows").over(newest.rowsBetween(W.unboundedPreceding, -1))
        grown = F.when(F.lit(full) | newer.isNull(), True).otherwise(newer >= F.col("rows") * RATIO)
        judged = live.withColumn("_grown", grown.cast("int"))
        judged = judged.withColumn("_joins", F.min("_grown").over(newest.rowsBetween(W.unboundedPreceding, 0)) == 1)
        judged = judged.withColumn("_n", F.sum(F.col("_joins").cast("int")).over(bucket))
        chosen = judged.where(F.col("_joins") & (F.col("_n") > 1))
        if chosen.isEmpty():
            return None
        version = versions[-1] + 1
        merged = self._write_run(resolve_batches(self._rows(chosen)), f"m{version}")
        last = chosen.groupBy("table_name", "bucket").agg(F.max("upto").alias("upto"))
        merged = merged.join(last, ["table_name", "bucket"])
        stay = live.join(chosen.select(*_PLACE), _PLACE, "left_anti")
        self._commit(stay.unionByName(merged.select(*_RUNS.fieldNames())), version)
        return versions[-1] // _STEPS

    def vacuum(self, retention_seconds: float = 3600) -> list[str]:
        """Delete buckets of runs, and versions, that don't count since ``retention_seconds``; returns them."""
        before = (time.time() - retention_seconds) * 1000
        versions = self._committed("live")
        old = [v for v in versions if self._modified(f"{v[1]}/_SUCCESS") <= before]
        if not old or old[-1] == versions[0]:
            return []
        keep = [folder for number, folder in versions if number >= old[-1][0]]
        live = self.spark.read.schema(_RUNS).parquet(*keep).select(*_PLACE).distinct()
        counted = {f"run={r.run}/table_name={r.table_name}/bucket={r.bucket}" for r in live.toLocalIterator()}
        pattern, fs = self._path(f"{self.root}/runs/run=*/table_name=*/bucket=*")
        gone = [folder for number, folder in versions if number < old[-1][0]]
        for status in fs.globStatus(pattern) or []:
            folder = status.getPath().toString()
            if not any(folder.endswith(place) for place in counted) and status.getModificationTime() <= before:
                gone.append(folder)
        for folder in gone:
            path, fs = self._path(folder)
            fs.delete(path, True)
        return gone

    def _modified(self, name: str) -> int:
        path, fs = self._path(name)
        return fs.getFileStatus(path).getModificationTime()
