"""The statistics as they were: validity intervals over a log of batches, and lookups as of a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaderstream.operators.balance import key_facts, with_key_facts
from leaderstream.operators.upsert import KEY, keyed


def validity(log: DataFrame, batch: str = "batch_id", spread_by: str = "offset", **balance: int) -> DataFrame:
    """The log's rows with ``valid_to``: the next batch that brings their key, NULL while there is none.

    A row is part of the state from its own batch on and up to, not including, ``valid_to``. Rows with a NULL key part are
    never replaced; rows without a batch are in no state and left out. Rows are counted by key and batch first, so the
    window sees a key once for each batch that has it, however many rows it has; rows of hot keys are spread as in
    ``resolve_batches``.
    """
    rows = keyed(log.where(F.col(batch).isNotNull()))
    keys = [*KEY, batch]
    facts = key_facts(rows, keys, F.max(batch).alias("_same"), F.lit(1)).drop("_same")
    facts = facts.withColumn("valid_to", F.lead(batch).over(W.partitionBy(*KEY).orderBy(batch)))
    return with_key_facts(rows, facts, keys, "valid_to", [spread_by], **balance).select(*log.columns, "valid_to")


def states_at(log: DataFrame, times: Sequence[int], batch: str = "batch_id", **balance: int) -> DataFrame:
    """The state after each of the given batches: the rows of ``resolve_batches`` of the log up to there, with ``as_of``.

    All states come from one pass; each row is repeated for the times inside its interval, which a task reads from
    the short list. No times: no rows.
    """
    listed = F.array(*[F.lit(t).cast("bigint") for t in sorted(set(times))]).cast("array<bigint>")
    inside = F.filter(
        listed, lambda t: (t >= F.col(batch)) & (F.col("valid_to").isNull() | (t < F.col("valid_to")))
    )
    return validity(log, batch, **balance).withColumn("as_of", F.explode(inside)).drop("valid_to")


def as_of(lookups: DataFrame, log: DataFrame, batch: str = "batch_id", time: str = "as_of") -> DataFrame:
    """The rows that were current for each distinct key and time of ``lookups``, as ``table_name, Name, Team`` and ``time``, with ``as_of``.

    The batches of a key and the times asked of it are put in one order, where each time takes the last batch before it;
    rows then meet their lookups by equal key and batch. Neither step compares a lookup with more than it finds. Team
    tables are looked up with any ``Name``. Lookups with a NULL in key or time, or before the first batch of their key, find
    nothing.
    """
    names = ["entity_type", "table_name", "Name", "Team"]
    kind = F.element_at(F.split("table_name", "_"), 1).alias("entity_type")
    asked = keyed(lookups.select(kind, *names[1:], F.col(time).cast("bigint").alias("_at")))
    rows = keyed(log)
    points = asked.select(*KEY, "_at", F.lit(None).cast("bigint").alias("_batch"))
    points = points.unionByName(rows.select(*KEY, F.col(batch).alias("_at"), F.col(batch).alias("_batch")))
    points = points.dropna(subset=[*KEY, "_at"]).distinct()
    # At equal times the batch comes first: it is current as of itself.
    order = W.partitionBy(*KEY).orderBy(F.col("_at"), F.col("_batch").asc_nulls_last())
    found = points.withColumn("_found", F.last("_batch", ignorenulls=True).over(order))
    found = found.where(F.col("_batch").isNull() & F.col("_found").isNotNull())
    found = found.select(*KEY, F.col("_found").alias("_batch"), F.col("_at").alias("as_of"))
    current = rows.withColumn("_batch", F.col(batch)).join(found, [*KEY, "_batch"])
    return current.select(*log.columns, "as_of")
