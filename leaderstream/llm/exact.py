"""Exact duplicates by sorting content; DataFrame functions only.

Rows are range-partitioned by sampled splitters of their normalised text, sorted on disk where memory
ends, and each row is compared in full with its neighbour. Splitters are drawn from a key of bounded
length: the first characters, then a hash that splits long common beginnings, then a slice number. Only
texts with very many copies have more than one slice, so that no group meets in one task; their slices
are put together by a table that has a row for each such text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import free_names, kept, partitions

#: Characters of a text that the splitters see.
KEY_CHARS = 48
#: A text is sliced when its copies are more than the rows of a task divided by this.
SLICES_A_TASK = 4


def unchanged(text: Column) -> Column:
    """The normal form under which texts are compared: the text itself, NULL as empty."""
    return F.coalesce(text, F.lit(""))


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normal=unchanged, keep: str = "largest"
) -> DataFrame:
    """All rows and columns of ``docs``, and for the group of equal texts that a row is in:

    ``keep_id`` (the ``doc_id`` of the row that stays, the ``largest`` or ``smallest``), ``group_size``,
    ``kept`` (true in exactly one row of a group) and ``text_sha256`` (of the normalised text).

    A NULL text equals the empty one. A NULL ``doc_id`` comes after all others, so such a row stays only
    where a group has no other; of rows with the same ``doc_id`` any one stays. Columns of ``docs`` with
    these names are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    norm, key, hashed, slice_, copies, best, before = free_names(
        docs, ["_norm", "_key", "_hash", "_slice", "_copies", "_best", "_before"]
    )
    end = F.max if keep == "largest" else F.min
    rows = docs.withColumn(norm, normal(F.col(text))).withColumn(hashed, F.xxhash64(norm))

    hot, slices = _hot_texts(rows, norm, hashed, doc_id, end, partitions(spark))
    rows = rows.withColumn(key, F.substring(norm, 1, KEY_CHARS))
    if hot is None:
        rows = rows.withColumn(slice_, F.pmod(F.col(hashed), F.lit(1))).withColumns(
            {copies: F.lit(None).cast("bigint"), best: F.lit(None).cast(dict(docs.dtypes)[doc_id])}
        )
    else:
        hot_hash, hot_sha = free_names(rows, ["_hot_hash", "_hot_sha"])
        hot = hot.toDF(hot_hash, hot_sha, copies, best)
        same = (F.col(hashed) == F.col(hot_hash)) & (F.sha2(norm, 256) == F.col(hot_sha))
        rows = rows.join(F.broadcast(hot), same, "left").drop(hot_hash, hot_sha)
        rows = rows.withColumn(
            slice_, F.when(F.col(copies).isNotNull(), F.pmod(F.xxhash64(doc_id), F.lit(slices))).otherwise(F.lit(0))
        )

    rows = rows.repartitionByRange(partitions(spark), key, hashed, slice_)
    order = F.col(doc_id).desc_nulls_last() if keep == "largest" else F.col(doc_id).asc_nulls_last()
    sorted_ = W.partitionBy(key, hashed, slice_).orderBy(F.col(norm), order)
    run = W.partitionBy(key, hashed, slice_, norm)
    first = F.lag(norm).over(sorted_).isNull() | (F.lag(norm).over(sorted_) != F.col(norm))
    rows = (
        rows.withColumn(before, first)
        .withColumn("keep_id", F.coalesce(F.col(best), F.first(doc_id).over(run.orderBy(order))))
        .withColumn("group_size", F.coalesce(F.col(copies), F.count(F.lit(1)).over(run)))
        .withColumn("kept", F.col(before) & F.col(doc_id).eqNullSafe(F.col("keep_id")))
        .withColumn("text_sha256", F.sha2(norm, 256))
    )
    return rows.drop(norm, key, hashed, slice_, copies, best, before)


def _hot_texts(rows: DataFrame, norm: str, hashed: str, doc_id: str, end, tasks: int) -> tuple[DataFrame | None, int]:
    """Texts with more copies than a task should have: hash, SHA-256, copies and the ``doc_id`` that stays.

    More than an Nth of all rows each, so fewer than N: with N four times the number of tasks, the
    table is always small enough to broadcast.
    """
    counts = kept(rows.groupBy(hashed).agg(F.count(F.lit(1)).alias("_n")), "exact-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    parts = tasks * SLICES_A_TASK
    hot = counts.where((F.col("_n") > total / parts) & (F.col("_n") > 1))
    largest = hot.agg(F.max("_n")).first()[0]
    if largest is None:
        return None, 1
    few = rows.join(F.broadcast(hot.select(hashed)), hashed, "left_semi")
    facts = few.groupBy(hashed, F.sha2(norm, 256).alias("_sha")).agg(
        F.count(F.lit(1)).alias("_copies"), end(doc_id).alias("_best")
    )
    return kept(facts, "exact-hot"), max(1, -(-largest * parts // max(total, 1)))
