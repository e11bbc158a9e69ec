"""Numbers for all rows of ordered groups, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaderstream.session import written

# Bits of a place within its partition, as ``monotonically_increasing_id`` has them.
_PLACE_BITS = 33


def free_name(taken: Sequence[str], wanted: str) -> str:
    """``wanted``, with as many underscores before it as it takes to be new."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted


def numbered(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    position: str = "place",
    total: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """All rows with their number in the order of their group, from 1, and the group's size in ``total``.

    Rows are dealt by ranges of group and order, with splitters that Spark samples. A row's number is its
    place in its range plus the group's rows in all ranges before, and these are sums over one count for
    each range and group: nothing grows with a group. Equal rows are told apart by where they
    were read, so a value that most rows hold is split like any other. NULLs form a group of their own;
    an empty table gives an empty result. Columns called like the new ones are replaced.

    The dealt rows are written once below ``spark.checkpoint.dir``, so that counts and rows agree
    after an executor is lost.
    """
    spark = rows.sparkSession
    rows = rows.drop(*[c for c in (position, total) if c])
    columns = rows.columns
    tie, at, part, first, before, size = (
        free_name(columns, n) for n in ("_tie", "_at", "_part", "_first", "_before", "_size")
    )
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c).asc_nulls_first() for c in group], *order, F.col(tie).asc()]
    dealt = (
        rows.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .drop(tie)
        .withColumn(at, F.monotonically_increasing_id())
    )
    dealt = written(dealt, "numbered").withColumn(part, F.shiftright(F.col(at), _PLACE_BITS))
    counts = dealt.groupBy(*group, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(size))
    earlier = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum(size).over(W.partitionBy(*group)))
    # Names of their own, as a join on equal or both NULL keeps the columns of either side.
    names = {c: free_name([*columns, total or ""], f"_of_{n}") for n, c in enumerate([*group, part])}
    facts = counts.select(
        *[F.col(c).alias(name) for c, name in names.items()],
        (F.col(before) - F.col(first) + 1).alias(before),
        *([total] if total else []),
    )
    same = F.lit(True)
    for c, name in names.items():
        same = same & F.col(c).eqNullSafe(F.col(name))
    found = dealt.join(facts, same).withColumn(position, F.col(at) + F.col(before))
    return found.select(*columns, position, *([total] if total else []))
