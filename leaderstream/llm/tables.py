"""Reading, keeping and naming: what every operator of this folder needs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaderstream.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows written once below ``spark.checkpoint.dir`` and read from there.

    Cuts the lineage, and survives the loss of the executors that made it.
    """
    spark = frame.sparkSession
    path = shared_dir(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def free_name(frame: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it where a column has that name."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def free_names(frame: DataFrame, wanted: Iterable[str]) -> list[str]:
    return [free_name(frame, name) for name in wanted]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
