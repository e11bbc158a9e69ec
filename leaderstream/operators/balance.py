"""Building blocks that stay balanced when one key holds a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A key with more rows than this is spread over many tasks. There are at most
# as many such keys as the rows divided by it: 10^12 rows have a million at most.
HOT_KEY_ROWS = 1_000_000
_SALTS = 1 << 20


def top_k_per_group(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    position: str = "_pos",
    lanes: int = 1,
) -> DataFrame:
    """First ``k`` rows of each group under a total order, numbered from 1.

    Each task first cuts its own rows to ``k`` per group, so a hot group sends
    ``k`` rows per task. With few groups and a large ``k`` that is still much
    for one task: ``lanes`` adds a level in between, where each lane cuts the
    rows of every ``lanes``-th task. The lane follows the partition number,
    which a retried task keeps.
    """
    if lanes > 1:
        lane = W.partitionBy(*group, "_lane").orderBy(*order)
        rows = (
            rows.withColumn("_lane", F.spark_partition_id() % F.lit(lanes))
            .withColumn("_lane_pos", F.row_number().over(lane))
            .where(F.col("_lane_pos") <= k)
            .drop("_lane", "_lane_pos")
        )
    final = W.partitionBy(*group).orderBy(*order)
    return rows.withColumn(position, F.row_number().over(final)).where(F.col(position) <= k)


def key_facts(rows: DataFrame, keys: Sequence[str], fact: Column, counted: Column) -> DataFrame:
    """One row per key without NULLs: ``fact``, an aggregate, and ``_n``, its rows.

    ``_salt`` is a hash of the key. It is part of the grouping, so that the result
    is already distributed the way ``with_key_facts`` joins it, and comes first, so
    that the sort for the join seldom has to compare the texts of keys.
    """
    rows = rows.withColumn("_salt", F.xxhash64(*keys))
    # The join asks for these conditions too. Said here, they are the same in
    # both uses of the facts, which then share one shuffle.
    for key in ("_salt", *keys):
        rows = rows.where(F.col(key).isNotNull())
    return rows.groupBy("_salt", *keys).agg(fact, F.sum(counted).alias("_n"))


def with_key_facts(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    fact: str,
    spread_by: Sequence[str],
    hot_key_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Left-join one fact per key (see ``key_facts``) to the rows of that key.

    Keys above ``hot_key_rows`` rows, however many, reach their rows by a
    broadcast of one fact per so many rows at most. Their rows, and rows with a NULL key, take a
    salt from ``spread_by`` (columns that tell rows of one key apart) and so
    spread over the shuffle instead of meeting in one task. Every row comes out
    once.
    """
    keys = list(keys)
    hot = facts.where(F.col("_n") > hot_key_rows).select(
        *keys, F.col(fact).alias("_hot"), F.col("_salt").alias("_hot_salt")
    )
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(_SALTS)) + 1
    spread = F.col("_hot_salt").isNotNull() | null_key
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(spread, salt).otherwise(F.xxhash64(*keys))
    )
    # ``_n`` is asked for as well, and in this order, to keep the aggregates of
    # both uses equal.
    counted = F.col(fact).isNotNull() & (F.col("_n") >= 0)
    cold = facts.select("_salt", *keys, F.when(counted, F.col(fact)).alias("_cold"))
    return (
        rows.join(cold, ["_salt", *keys], "left")
        .withColumn(fact, F.coalesce("_hot", "_cold"))
        .drop("_hot", "_hot_salt", "_cold", "_salt")
    )


def salted_join(
    rows: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str], salts: int = 32
) -> DataFrame:
    """Inner join with a much smaller side that stays balanced under hot keys.

    Each key of ``rows`` is split in ``salts`` parts by ``spread_by`` and the
    small side repeated for each part. Spark still broadcasts the small side
    where its measured size allows.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return salted.join(small.select("*", parts), [*keys, "_salt"]).drop("_salt")
