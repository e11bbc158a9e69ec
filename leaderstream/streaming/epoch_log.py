"""Restart-safe state of the upsert: an append-only log with compaction."""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaderstream.operators.flatten import STATS, empty_stats
from leaderstream.operators.upsert import resolve_batches


class EpochLog:
    """Statistic rows in ``<root>/epochs/epoch=N/table_name=…`` parquet folders.

    Writing costs one pass over the batch. A replayed batch overwrites its own
    folder, so it counts once. ``compact`` folds the epochs since the last time
    into ``<root>/folds/upto=N``, at the cost of those epochs; a full one folds
    everything into ``<root>/bases/upto=N``. Readers take the newest base, the
    folds after it and the epochs after those. A folder counts once its
    ``_SUCCESS`` marker is there. ``vacuum`` deletes what is folded.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[tuple[int, str]]:
        """Numbers and folders, from one listing."""
        path, fs = self._path(f"{self.root}/{kind}/*=*/_SUCCESS")
        found = fs.globStatus(path)
        if found is None:
            return []
        # The whole list as one text: a call for each folder would take most of the time.
        paths = self.spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found)
        text = self.spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(paths)
        folders = re.findall(r"(?:^\{|(?<=/_SUCCESS),)(.*?=(\d+))/_SUCCESS(?=,|\}$)", text)
        return sorted((int(number), folder) for folder, number in folders)

    def _write(self, rows: DataFrame, path: str) -> None:
        # Rebalancing gives few files per table and still splits a hot table.
        rows.hint("rebalance", "table_name").write.mode("overwrite").partitionBy("table_name").parquet(path)

    def append(self, rows: DataFrame, epoch: int, batch: str | None = None) -> None:
        """Write one batch: the epoch, or what the column ``batch`` says, is the ``batch_id`` of its rows."""
        self._write(self._numbered(rows, epoch, batch), f"{self.root}/epochs/epoch={epoch}")

    def _numbered(self, rows: DataFrame, epoch: int, batch: str | None) -> DataFrame:
        number = F.lit(epoch) if batch is None else F.col(batch)
        rows = rows.withColumn("batch_id", number.cast("bigint"))
        if "offset" not in rows.columns:
            rows = rows.withColumn("offset", F.monotonically_increasing_id())
        return rows.select(*STATS.fieldNames())

    def epochs(self) -> list[int]:
        """Committed epochs."""
        return [n for n, _ in self._committed("epochs")]

    def epoch(self, number: int) -> DataFrame:
        """The rows that one epoch wrote."""
        reader = self.spark.read.schema(STATS).option("basePath", f"{self.root}/epochs")
        return reader.parquet(f"{self.root}/epochs/epoch={number}").select(*STATS.fieldNames())

    def _parts(self) -> dict[str, list[tuple[int, str]]]:
        """The folders that make up the log."""
        bases = self._committed("bases")[-1:]
        folded = max([n for n, _ in bases], default=-1)
        folds = [f for f in self._committed("folds") if f[0] > folded]
        folded = max([folded, *[n for n, _ in folds]])
        epochs = [e for e in self._committed("epochs") if e[0] > folded]
        return {"bases": bases, "folds": folds, "epochs": epochs}

    def _read(self, parts: dict[str, list[tuple[int, str]]]) -> DataFrame:
        frames = []
        for kind, folders in parts.items():
            if folders:
                reader = self.spark.read.schema(STATS).option("basePath", f"{self.root}/{kind}")
                frames.append(reader.parquet(*[path for _, path in folders]).select(*STATS.fieldNames()))
        return reduce(DataFrame.unionByName, frames) if frames else empty_stats(self.spark)

    def read(self) -> DataFrame:
        """All rows that may still count, unresolved."""
        return self._read(self._parts())

    def state(self, table: str | None = None, tables: DataFrame | None = None) -> DataFrame:
        """The current rows of one table, whose folders alone are read, of the ``table_name`` of ``tables``, or of all."""
        log = self.read()
        if table is not None:
            log = log.where(F.col("table_name") == table)
        if tables is not None:
            log = log.join(tables.select("table_name").distinct(), "table_name", "left_semi")
        return resolve_batches(log)

    def compact(self, full: bool = False) -> int | None:
        """Fold the epochs since the last time, or all there is; returns the last one.

        Rows that an epoch of the fold replaces go; the rest still counts
        against older folders, so folds of folds give the same state.
        """
        parts = self._parts()
        upto = max((n for folders in parts.values() for n, _ in folders), default=-1)
        if full:
            if not (parts["folds"] or parts["epochs"]):
                return None
            self._write(resolve_batches(self._read(parts)), f"{self.root}/bases/upto={upto}")
            return upto
        if not parts["epochs"]:
            return None
        self._write(resolve_batches(self._read({"epochs": parts["epochs"]})), f"{self.root}/folds/upto={upto}")
        return upto

    def vacuum(self, retention_seconds: float = 3600) -> list[str]:
        """Delete folders that a fold or base holds since ``retention_seconds``; returns them.

        Readers that began before that may still read them.
        """
        parts = {kind: self._committed(kind) for kind in ("bases", "folds", "epochs")}
        before = (time.time() - retention_seconds) * 1000

        def settled(kind: str) -> int:
            """The last number of this kind that is old enough."""
            for number, folder in reversed(parts[kind]):
                marker, fs = self._path(f"{folder}/_SUCCESS")
                if fs.getFileStatus(marker).getModificationTime() <= before:
                    return number
            return -1

        base = settled("bases")
        fold = max(base, settled("folds"))
        gone = [f for n, f in parts["bases"] if n < base]
        gone += [f for n, f in parts["folds"] if n <= base]
        gone += [f for n, f in parts["epochs"] if n <= fold]
        for folder in gone:
            path, fs = self._path(folder)
            fs.delete(path, True)
        return gone
