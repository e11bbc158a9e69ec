"""Ranked leaderboards of all metrics in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaderstream.functions.values import number
from leaderstream.metrics import (
    METRICS,
    SERVED_ROWS,
    UNRANKED_INDIVIDUAL_ROWS,
    Metric,
    rank_direction,
    unranked_individual,
)
from leaderstream.operators.balance import top_k_per_group
from leaderstream.operators.numbering import numbered
from leaderstream.operators.serving import read_table

# Lanes of the level between the tasks' own cut and the final one per table.
LANES = 64
# Equal values: total up to rows that are served alike.
TIES = ("Name", "Team", "offset", "Value", "Cl", "Position")


def rank_order(by: str, direction: Column, ties: Sequence[str]) -> list[Column]:
    """The order of a board, for a ``direction`` of ``asc``, ``desc`` or NULL."""
    ascending, descending = direction == "asc", direction == "desc"
    if by == "text":
        value = F.col("Value")
        first = [F.when(ascending, value).asc_nulls_first(), F.when(descending, value).desc_nulls_last()]
    elif by == "number":
        value = number(F.col("Value"))
        first = [F.when(ascending, value).when(descending, -value).asc_nulls_last()]
    else:
        raise ValueError(f"rank by 'number' or 'text', not {by!r}")
    return [*first, *[F.col(t).asc_nulls_first() for t in ties]]


def _ranked(best: DataFrame, rows: int, direction: Column) -> DataFrame:
    limit = F.when(unranked_individual(F.col("table_name")), min(rows, UNRANKED_INDIVIDUAL_ROWS)).otherwise(rows)
    return best.where(F.col("place") <= limit).withColumn("Rank", F.when(direction.isNotNull(), F.col("place")))


def leaderboards(
    stats: DataFrame,
    metrics: Sequence[Metric] = METRICS,
    by: str = "number",
    rows: int = SERVED_ROWS,
    ties: Sequence[str] = TIES,
) -> DataFrame:
    """The first ``rows`` rows of every table with their ``Rank`` and ``place``.

    ``by="number"`` compares values as numbers, texts that are none last.
    ``by="text"`` compares them as text, NULL first upwards and last downwards.
    ``ties`` must make the order total. A table whose metric has no direction
    keeps a NULL ``Rank`` and is ordered by ``ties`` alone; ``place`` numbers
    the rows of any table.
    """
    directed = stats.withColumn("_direction", rank_direction(metrics, F.col("table_name")))
    direction = F.col("_direction")
    order = rank_order(by, direction, ties)
    best = top_k_per_group(directed, ["table_name"], order, rows, position="place", lanes=LANES)
    return _ranked(best, rows, direction).drop("_direction")


def leaderboard(
    stats: DataFrame,
    name: str,
    metrics: Sequence[Metric] = METRICS,
    by: str = "number",
    rows: int = SERVED_ROWS,
    ties: Sequence[str] = TIES,
) -> DataFrame:
    """``leaderboards`` of one table; no rows for an unknown name.

    A global order with a limit: every task keeps its best rows in a heap.
    """
    direction = rank_direction(metrics, F.lit(name))
    order = rank_order(by, direction, ties)
    best = read_table(stats, name).orderBy(*order).limit(rows)
    numbered = best.withColumn("place", F.row_number().over(W.partitionBy("table_name").orderBy(*order)))
    return _ranked(numbered, rows, direction)


def rank_all(
    stats: DataFrame,
    metrics: Sequence[Metric] = METRICS,
    by: str = "number",
    ties: Sequence[str] = TIES,
) -> DataFrame:
    """Every row of every table with its ``Rank`` and ``place``, in the order of ``leaderboards`` and without its limit.

    Places come from ranges and sums of counts (see ``numbered``), so neither a hot table nor a value that
    most rows share meets in one task.
    """
    directed = stats.withColumn("_direction", rank_direction(metrics, F.col("table_name")))
    direction = F.col("_direction")
    placed = numbered(directed, ["table_name"], rank_order(by, direction, ties), position="place")
    return placed.withColumn("Rank", F.when(direction.isNotNull(), F.col("place"))).drop("_direction")
