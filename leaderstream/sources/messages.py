"""Event messages from a topic or from files, and back to either."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topic_stream(
    spark: SparkSession, servers: str, topic: str, starting_offsets: str = "earliest", **options: str
) -> DataFrame:
    """Messages of a topic as ``value, partition, offset``.

    Needs the Kafka connector on the class path (``--packages``). Start offsets
    count for the first start only; afterwards the checkpoint rules. Set
    ``minPartitions`` to split a hot topic partition over several tasks, and
    ``maxOffsetsPerTrigger`` to bound a batch.
    """
    reader = spark.readStream.format("kafka").options(**topic_reader(servers, topic, starting_offsets, **options))
    return reader.load().select("value", "partition", "offset")


def topic_reader(servers: str, topic: str, starting_offsets: str = "earliest", **options: str) -> dict[str, str]:
    """All options of a reader; given ones go over the others."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        **options,
    }


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Messages from text files, one per line, as files appear in a folder."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("value")


def table_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Rows from parquet files as they appear at a path, a folder or a single file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    # Readers take a path for a pattern.
    path = re.sub(r"([\\*?\[\]{}])", r"\\\1", path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A stream reads folders and what a pattern matches, so a file has to look like a pattern.
    return reader.parquet(path if folder else f"{path[:-1]}[{path[-1]}]")


def write_topic(events: DataFrame, servers: str, topic: str) -> None:
    """Send ``value`` to a topic (needs the Kafka connector)."""
    events.select("value").write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()


def write_files(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write ``value`` as text, one message per line, unescaped UTF-8."""
    events.select(F.col("value").cast("string")).write.mode(mode).text(path)
