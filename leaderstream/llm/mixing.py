"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Of all ways to take documents at rates between 0 and ``MOST`` so that every source gives its target of words, the one closest to
taking each document once, in relative entropy, has rates ``exp(m * size)``, held at ``MOST``, with a multiplier ``m`` for
each source. The multipliers minimise the convex dual, whose slope at ``m`` is the words taken at these rates minus the target. Newton
steps sum slope and curvature over all documents, by source and size, in one aggregation each; a step that
leaves the bracket of a source goes to its middle.

Rates become whole copies by size: along the sizes of a source the sum of rates is rounded, which gives each size its copies, and
the words that are then missing or too many are added to or taken from the smallest documents. The copies of a size are
dealt evenly along its documents. The place of a document among those of its size is a sum of two counts
(earlier slices of ids, earlier ids of the slice), so no source and no size meets in one task.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import free_names, kept

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, NULL last, repeating.
WEIGHTS = (1, 2, 3)
#: No target is above this many times its source's size.
MOST = 3
#: Newton steps at most. They end where no source is further than this share of its target from it.
STEPS, CLOSE = 60, 1e-12
#: Where every multiplier lies: at the upper end a single word is enough to be taken ``MOST`` times.
LEAST_MULTIPLIER, MOST_MULTIPLIER = -50.0, log(MOST)
#: Documents with ids from one range of this length, or with hashes of ids that agree in so many bits, are ranked together.
IDS_A_SLICE, SLICE_BITS = 8192, 16
#: Where the rounding starts, between 0 and 1: no fraction that rates are likely to hit.
PHASE = 0.381966011250105


def words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint")


def _targets(sources: DataFrame) -> DataFrame:
    """``source_size`` and weights to targets: shares by weight, cut at ``MOST`` times the size, the rest reshared.

    In the order of size by weight those that are cut come first, so each source is judged by the share
    it would have if all before it were cut. There is a row for each source here, not for documents.
    """
    code_points = W.orderBy(F.col("_source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    by_need = W.orderBy(F.col("source_size") / F.col("_weight"), F.col("_source").asc_nulls_last())
    all_ = W.partitionBy()
    cut = F.col("source_size") * F.lit(float(MOST))
    return (
        sources.withColumn("_place", F.row_number().over(code_points) - 1)
        .withColumn("_weight", F.get(weights, F.col("_place") % len(WEIGHTS)))
        .withColumn("_total", F.sum("source_size").over(all_).cast("double"))
        .withColumn("_left", F.col("_total") - F.sum(cut).over(by_need.rowsBetween(W.unboundedPreceding, 0)) + cut)
        .withColumn("_rest", F.sum("_weight").over(by_need.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_is_cut", cut * F.col("_rest") <= F.col("_weight") * F.col("_left"))
        .withColumn("_cut_size", F.sum(F.when(F.col("_is_cut"), cut).otherwise(0.0)).over(all_))
        .withColumn("_free", F.sum(F.when(F.col("_is_cut"), 0.0).otherwise(F.col("_weight"))).over(all_))
        .withColumn(
            "target",
            F.when(F.col("_is_cut"), cut).otherwise(
                (F.col("_total") - F.col("_cut_size")) * F.col("_weight") / F.col("_free")
            ),
        )
        .select("_source", "source_size", "target")
    )


def _rate(multiplier: Column, size: Column) -> Column:
    return F.least(F.exp(multiplier * size), F.lit(float(MOST)))


def multipliers(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` (``_c_key, source_size, target``) and the multiplier ``_m`` of each source.

    ``sizes`` has ``_n`` documents for each ``_c_key`` and ``_c_size``. A source whose target needs every document at the
    highest rate, or that has no words, has its multiplier at once.
    """
    full = F.col("target") >= F.col("source_size") * MOST
    duals = targets.withColumns(
        {
            "_low": F.lit(LEAST_MULTIPLIER),
            "_high": F.lit(MOST_MULTIPLIER),
            "_m": F.when(full, F.lit(MOST_MULTIPLIER)).otherwise(0.0),
            "_far": F.when(full, 0.0).otherwise(1.0),
        }
    )
    duals = kept(duals, "mixing-dual")
    size, m = F.col("_c_size").cast("double"), F.col("_m")
    rate = _rate(m, size)
    words = F.sum(F.col("_n") * size * rate)
    curvature = F.sum(F.when(rate < MOST, F.col("_n") * size * size * rate).otherwise(0.0))
    slope = F.col("_words") - F.col("target")
    low, high = F.when(slope < 0, m).otherwise(F.col("_low")), F.when(slope > 0, m).otherwise(F.col("_high"))
    newton = m - F.try_divide(slope, F.col("_curvature"))
    inside = newton.isNotNull() & (newton > F.col("_low")) & (newton < F.col("_high"))
    for _ in range(STEPS):
        sums = sizes.join(duals, "_c_key").where("_far > 0").groupBy("_c_key")
        sums = sums.agg(words.alias("_words"), curvature.alias("_curvature"))
        stepped = (
            duals.join(sums, "_c_key", "left")
            .withColumns({"_low": low, "_high": high, "_far": F.when(F.col("_far") > 0, F.abs(slope) / F.col("target")).otherwise(0.0)})
            .withColumn("_far", F.when(F.col("_far") > CLOSE, F.col("_far")).otherwise(0.0))
            .withColumn("_m", F.when(F.col("_far") == 0, m).when(inside, newton).otherwise((F.col("_low") + F.col("_high")) / 2))
        )
        duals = kept(stepped.select(*duals.columns), "mixing-dual")
        # One number: whether any source is still far.
        if not (duals.agg(F.max("_far")).first()[0] or 0) > 0:
            break
    return duals.select("_c_key", "source_size", "target", F.round("_m", 13).alias("_m"))


def _copies(sizes: DataFrame, duals: DataFrame) -> DataFrame:
    """The copies ``_copies`` that the ``_n`` documents of each source and size are taken together."""
    upwards = W.partitionBy("_c_key").orderBy("_c_size")
    before, source = upwards.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("_c_key")
    taken = F.col("_n") * _rate(F.col("_m"), F.col("_c_size").cast("double"))
    whole = lambda total: F.floor(F.coalesce(total, F.lit(0.0)) + PHASE)
    rounded = (
        sizes.join(duals, "_c_key")
        .withColumn("_rates", taken)
        .withColumn(
            "_copies",
            F.least(whole(F.sum("_rates").over(upwards.rowsBetween(W.unboundedPreceding, 0))) - whole(F.sum("_rates").over(before)), F.col("_n") * MOST),
        )
        .withColumn("_gap", F.round("target").cast("bigint") - F.sum(F.col("_copies") * F.col("_c_size")).over(source))
        # Copies that can be added, or taken away, and their words in all smaller documents.
        .withColumn("_room", F.when(F.col("_gap") > 0, F.col("_n") * MOST - F.col("_copies")).otherwise(F.col("_copies")))
        .withColumn("_room_before", F.coalesce(F.sum(F.col("_room") * F.col("_c_size")).over(before), F.lit(0)))
    )
    left = F.abs("_gap") - F.col("_room_before")
    more = F.when((F.col("_c_size") > 0) & (left > 0), F.least(F.floor(left / F.col("_c_size")).cast("bigint"), F.col("_room")))
    mended = F.col("_copies") + F.signum(F.col("_gap").cast("double")).cast("bigint") * F.coalesce(more, F.lit(0))
    return rounded.select("_c_key", "_c_size", "_n", mended.alias("_copies"), "source_size", "target")


def _slice(ids: DataFrame, doc_id: str) -> Column:
    if isinstance(ids.schema[doc_id].dataType, T.IntegralType):
        return F.coalesce(F.floor(F.col(doc_id) / IDS_A_SLICE).cast("bigint"), F.lit(-1))
    return F.shiftright(F.xxhash64(doc_id), 64 - SLICE_BITS).cast("bigint")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All rows and columns of ``docs``, and ``size``, ``source_size``, ``target`` and ``copies``.

    ``size`` counts words (NULL text: 0). Sources are weighed by ``WEIGHTS`` in code point order, NULL last
    and a source like any other; targets add up to the size of the corpus. A document is taken 0 to
    ``MOST`` times; one without words once. The words of a source differ from its target by less than its smallest documents
    that are not all taken or left. Ids are numbers, texts or any other type that orders. Reruns agree: documents of one size
    are in the order of slice of ids, id, text, and rows equal in all of them are alike. Columns of ``docs``
    with these names are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    key, slice_, place, tie = free_names(docs, ["_key", "_slice", "_place", "_tie"])
    c_key, c_size, c_slice, n, total, start = free_names(docs, ["_c_key", "_c_size", "_c_slice", "_all", "_total", "_start"])
    # One text for each source, NULL apart from all others, that joins by plain equality.
    rows = docs.withColumns(
        {
            "size": words(text),
            key: F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),
            slice_: _slice(docs, doc_id),
            tie: F.xxhash64(text),
        }
    )
    cells = kept(
        rows.groupBy(F.col(key).alias("_c_key"), F.col("size").alias("_c_size"), F.col(slice_).alias("_c_slice")).agg(
            F.count(F.lit(1)).alias("_n")
        ),
        "mixing-cells",
    )
    sizes = kept(cells.groupBy("_c_key", "_c_size").agg(F.sum("_n").alias("_n")), "mixing-sizes")
    sources = sizes.groupBy("_c_key").agg(F.sum(F.col("_c_size") * F.col("_n")).alias("source_size"))
    named = sources.withColumn("_source", F.when(F.col("_c_key") != "", F.substr("_c_key", F.lit(2))))
    targets = _targets(named).select(
        F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")).alias("_c_key"), "source_size", "target"
    )
    dealt = _copies(sizes, multipliers(sizes, targets))
    earlier = W.partitionBy("_c_key", "_c_size").orderBy("_c_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    starts = kept(starts.join(dealt, ["_c_key", "_c_size"]), "mixing-starts").select(
        F.col("_c_key").alias(c_key),
        F.col("_c_size").alias(c_size),
        F.col("_c_slice").alias(c_slice),
        F.col("_n").alias(n),
        F.col("_copies").alias(total),
        F.col("_start").alias(start),
        "source_size",
        "target",
    )
    rank = W.partitionBy(key, "size", slice_).orderBy(F.col(doc_id).asc_nulls_first(), tie)
    same = (F.col(key) == F.col(c_key)) & (F.col("size") == F.col(c_size)) & (F.col(slice_) == F.col(c_slice))
    up_to = lambda place: F.expr(f"{place} * `{total}` div `{n}`")
    return (
        rows.join(starts, same)
        .withColumn(place, F.col(start) + F.row_number().over(rank))
        .withColumn("copies", (up_to(f"`{place}`") - up_to(f"(`{place}` - 1)")).cast("int"))
        .drop(key, slice_, place, tie, c_key, c_size, c_slice, n, total, start)
    )


def mix(docs: DataFrame, **names: str) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns as they were."""
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    taken = mixed(docs, **names)
    time = free_names(taken, ["_time"])[0]
    return taken.withColumn(time, times).select(*docs.columns)
