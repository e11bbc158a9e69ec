"""Session helpers for tests, the bench and stand-alone jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session. On a cluster the session comes from spark-submit instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leaderstream")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def check_time_zone(spark: SparkSession) -> None:
    """Times are text in UTC, so the session has to be too."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "GMT", "+00:00"):
        raise ValueError(f"set spark.sql.session.timeZone to UTC, not {zone}")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    Stream checkpoints and written tables go there, so that they outlive any
    executor. Only a local session may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="leaderstream-")
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows written once below the checkpoint folder and read from there, with their order within files."""
    path = shared_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def settled(frame: DataFrame) -> DataFrame:
    """The rows computed once and kept in the checkpoint folder."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))
    return frame.checkpoint()
