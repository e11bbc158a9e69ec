"""The tables of a bucketed log as a Spark data source, resolved whenever they are read.

``spark.read.format("leaderstream").option("root", root).load()`` has the current rows of all tables. ``register_table`` names them
in the session's catalog, where each query looks up the runs that count when it is planned: one registration follows
the stream. Conditions on ``table_name`` decide which folders are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pds
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from leaderstream.operators.flatten import STATS

# Tasks get what is below by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "leaderstream"
_DDL = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STATS.fields)
_NAMES = [f.name for f in STATS.fields]
_KEY = ["entity_type", "Name", "Team"]
_INDIVIDUAL = "individual"
_ROWS = 65_536


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark hand it conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BoardTables)


def register_table(spark: SparkSession, root: str, name: str) -> None:
    """The tables of a log under one name for ``spark.sql``; an earlier one with this name goes.

    The catalog keeps no options of such a source, so the name gets a format of its own that knows its root.
    """
    register(spark)
    spark.dataSource.register(_of_root(root, f"{FORMAT}_{name}"))
    quoted = "`" + name.replace("`", "``") + "`"
    spark.sql(f"DROP TABLE IF EXISTS {quoted}")
    spark.sql(f"CREATE TABLE {quoted} USING `{FORMAT}_{name}`")


@dataclass
class _Piece(InputPartition):
    """A file of a run, and the files of the newer runs of its bucket."""

    table_name: str
    path: str
    newer: list[str]


class BoardTables(DataSource):
    """Options: ``root``, the folder of a ``BucketLog`` that pyarrow can read (a local one, or a URI of HDFS or an object store)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> BoardReader:
        return BoardReader(self.options["root"])


def _of_root(root: str, name_: str) -> type[DataSource]:
    class OfRoot(BoardTables):
        @classmethod
        def name(cls) -> str:
            return name_

        def reader(self, schema) -> BoardReader:
            return BoardReader(root)

    return OfRoot


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
    return pafs.LocalFileSystem(), root


class BoardReader(DataSourceReader):
    """A task for each file. A row counts unless a newer run of its bucket has its key, and newer runs are smaller, so a task reads
    their key columns beside its own file: no row is shuffled, and the rows of a hot key are spread like their files."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")
        self.tables: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute == ("table_name",):
                self._only({one.value})
            elif isinstance(one, In) and one.attribute == ("table_name",):
                self._only(set(one.value))
            else:
                yield one

    def _only(self, names: set) -> None:
        self.tables = names if self.tables is None else self.tables & names

    def _live(self, fs: pafs.FileSystem, root: str) -> list[dict]:
        """The runs of the newest finished version, newest first: a few for each bucket."""
        folders = fs.get_file_info(pafs.FileSelector(f"{root}/live", allow_not_found=True))
        versions = sorted((int(f.base_name.partition("=")[2]), f.path) for f in folders if f.base_name.startswith("version="))
        for _, path in reversed(versions):
            if fs.get_file_info(f"{path}/_SUCCESS").type != pafs.FileType.NotFound:
                wanted = None if self.tables is None else pc.field("table_name").isin(sorted(n for n in self.tables if n is not None))
                table = pds.dataset(path, filesystem=fs, format="parquet").to_table(filter=wanted)
                return sorted(table.to_pylist(), key=lambda r: -r["upto"])
        return []

    def partitions(self) -> list[InputPartition]:
        fs, root = _opened(self.root)
        newer: dict[tuple[str, int], list[str]] = {}
        pieces: list[InputPartition] = []
        for run in self._live(fs, root):
            folder = f"{root}/runs/run={run['run']}/table_name={run['table_name']}/bucket={run['bucket']}"
            files = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".parquet")]
            before = newer.setdefault((run["table_name"], run["bucket"]), [])
            pieces += [_Piece(run["table_name"], path, list(before)) for path in files]
            before += files
        # An empty list would stand for one partition without a description.
        return pieces or [_Piece("", "", [])]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _opened(self.root)
        replaced = None
        for path in partition.newer:
            keys = _keys(pq.read_table(path, columns=_KEY, filesystem=fs, partitioning=None))
            replaced = keys if replaced is None else pa.concat_tables([replaced, keys]).group_by(keys.column_names).aggregate([])
        with fs.open_input_file(partition.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(_ROWS):
                rows = pa.Table.from_batches([batch])
                rows = rows.append_column("table_name", pa.array([partition.table_name] * len(rows), pa.string())).select(_NAMES)
                at = _NAMES.index("event_time")
                rows = rows.set_column(at, "event_time", rows["event_time"].cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")))
                if replaced is not None:
                    rows = _without(rows, replaced)
                yield from rows.to_batches()


def _keys(rows: pa.Table) -> pa.Table:
    """Distinct keys; those with a NULL part replace nothing."""
    name = pc.if_else(pc.equal(rows["entity_type"], _INDIVIDUAL), rows["Name"], "")
    keys = pa.table({"name": name, "team": rows["Team"]}).drop_null()
    return keys.group_by(["name", "team"]).aggregate([])


def _without(rows: pa.Table, replaced: pa.Table) -> pa.Table:
    name = pc.if_else(pc.equal(rows["entity_type"], _INDIVIDUAL), rows["Name"], "")
    own = pa.table({"name": name, "team": rows["Team"], "at": pa.array(range(len(rows)), pa.int64())})
    # NULLs match nothing in a join.
    left = own.join(replaced, ["name", "team"], join_type="left anti")
    return rows.take(left["at"].combine_chunks().sort())
