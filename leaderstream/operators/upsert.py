"""Keyed upsert of statistic rows: the newest state per entity and metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaderstream.metrics import INDIVIDUAL
from leaderstream.operators.balance import key_facts, with_key_facts
from leaderstream.operators.flatten import null_key

KEY = ["table_name", "_name", "Team"]
# Offsets of several topic partitions may be equal, so the row itself decides last.
LATEST = ("event_time", "offset", "Value", "Cl", "Position")


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with ``_name``, the part of their key that tells players apart."""
    # Teams have no name; an empty one keeps the key free of NULLs for them.
    name = F.when(F.col("entity_type") == INDIVIDUAL, F.col("Name")).otherwise(F.lit(""))
    return rows.withColumn("_name", name)


def resolve_batches(log: DataFrame, batch: str = "batch_id", spread_by: str = "offset", **balance: int) -> DataFrame:
    """State after all batches: the rows of the newest batch of each key.

    Equals replacing, batch by batch, all rows of the keys a batch brings. Rows
    of one key within its newest batch all stay, and rows with a NULL key part
    are never replaced.
    """
    rows = keyed(log)
    newest = key_facts(rows, KEY, F.max(batch).alias("_newest"), F.lit(1))
    placed = with_key_facts(rows, newest, KEY, "_newest", [spread_by], **balance)
    kept = placed.where(null_key() | (F.col(batch) == F.col("_newest")))
    return kept.select(*log.columns)


def anti_join_keys(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State rows whose key does not occur in the batch (NULL keys never do).

    A plain join: Spark broadcasts the keys of a small batch, so that the state
    stays where it is, and splits a hot key of the state otherwise.
    """
    replaced = keyed(batch).select(*KEY).dropDuplicates()
    return keyed(state).join(replaced, KEY, "left_anti").select(*state.columns)


def apply_batch(state: DataFrame, batch: DataFrame) -> DataFrame:
    """One upsert step: drop the batch's keys from the state, append the batch."""
    return anti_join_keys(state, batch).unionByName(batch)


def upsert_latest(log: DataFrame, order: Sequence[str] = LATEST) -> DataFrame:
    """Exactly one row per key, the last one in ``order``. NULL keys are left out.

    Plain aggregates, so each task first cuts a hot key down to one row.
    """
    carried = [c for c in log.columns if c not in {"table_name", "Team"}]
    last = F.max_by(F.struct(*carried), F.struct(*order)).alias("_row")
    latest = keyed(log.where(~null_key())).groupBy(*KEY).agg(last)
    return latest.select("table_name", "Team", "_row.*").select(*log.columns)
