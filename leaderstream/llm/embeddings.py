"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

Vectors are scaled to length 1, where a cosine is a distance. Each of ``TABLES`` tables cuts ``PROJECTIONS`` random directions into
cells of ``WIDTH``; vectors with one label and one cell in all directions of a table share a bucket. Equal vectors are one class first, which counts
as many as it has members. Buckets are compared by matrix products, and a pair counts in the first table that it shares,
so no pair is counted twice and none has to be listed: a bucket hands on numbers of links, and for components a link of each
vector to the least of its part of the bucket.

At the cosine of 0.98 a pair shares no bucket with probability below 1 in 10,000. Large buckets are cut into tiles whose pairs are
compared apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import kept

TABLES, PROJECTIONS, WIDTH = 40, 10, 1.2
#: Vectors of a tile.
TILE = 2_048
_SEED = 20_240_301


def _directions(size: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(_SEED + size)
    return random.standard_normal((size, TABLES * PROJECTIONS)), random.uniform(0, WIDTH, TABLES * PROJECTIONS)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``codes``: the bucket of each table as a number."""
    mix = np.random.default_rng(_SEED).integers(1, 1 << 63, PROJECTIONS, dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        vectors = batch.column(1)
        out: list[np.ndarray | None] = [None] * batch.num_rows
        sizes: dict[int, list[int]] = {}
        values = [np.asarray(v.values, dtype=np.float64) for v in vectors]
        for row, value in enumerate(values):
            sizes.setdefault(len(value), []).append(row)
        for size, rows in sizes.items():
            x = np.stack([values[r] for r in rows])
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            directions, shift = _directions(size)
            cells = np.floor((x @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64)
            cells = cells.reshape(len(rows), TABLES, PROJECTIONS)
            codes = (cells * mix).sum(axis=2, dtype=np.uint64)
            codes = ((codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)
            for row, code in zip(rows, codes.astype(np.int64), strict=True):
                out[row] = code
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "codes"]
        )


def _links(cosine: float):
    def compared(rows: pa.Table) -> pa.Table:
        """Links between the tiles ``left`` and ``right`` of a bucket: their numbers and a spanning part of them."""
        table = rows.column("table")[0].as_py()
        first, second = rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
        tile = rows.column("tile").to_numpy()
        node, weight = rows.column("node").to_numpy(), rows.column("members").to_numpy()
        x = np.stack([np.asarray(v.values, np.float64) for v in rows.column("vector")])
        # Scaled first, so that squares neither overflow nor vanish.
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        codes = np.stack([np.asarray(c.values) for c in rows.column("codes")])[:, :table]
        ones = np.flatnonzero(tile == first)
        others = ones if first == second else np.flatnonzero(tile == second)
        n_links = np.zeros(len(node), np.int64)
        least = node.copy()
        for begin in range(0, len(ones), 512):
            part = ones[begin : begin + 512]
            found, at = np.nonzero(x[part] @ x[others].T >= cosine)
            a, b = part[found], others[at]
            new = a < b if first == second else np.ones(len(a), bool)
            a, b = a[new], b[new]
            if table:
                fresh = np.concatenate(
                    [~(codes[a[k : k + 65536]] == codes[b[k : k + 65536]]).any(axis=1) for k in range(0, len(a), 65536)]
                    or [np.empty(0, bool)]
                )
                counted_a, counted_b = a[fresh], b[fresh]
            else:
                counted_a, counted_b = a, b
            np.add.at(n_links, counted_a, weight[counted_b])
            np.add.at(n_links, counted_b, weight[counted_a])
            for _ in range(3):
                low = np.minimum(least[a], least[b])
                np.minimum.at(least, a, low)
                np.minimum.at(least, b, low)
            # What a few rounds leave unjoined stays as links of its own.
            loose = least[a] != least[b]
            if loose.any():
                extra.append(np.stack([node[a[loose]], node[b[loose]]]))
        pairs = np.concatenate([np.stack([node, least]), *extra], axis=1) if extra else np.stack([node, least])
        extra.clear()
        links = np.concatenate([n_links, np.zeros(pairs.shape[1] - len(node), np.int64)])
        use = (links > 0) | (pairs[0] != pairs[1])
        return pa.table({"node": pairs[0][use], "least": pairs[1][use], "links": links[use]})

    extra: list[np.ndarray] = []
    return compared


def vector_groups(
    vectors: DataFrame,
    cosine: float = 0.98,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept``, a row for each of ``vectors``.

    Vectors of one label and length are linked where their cosine is at least ``cosine``. A vector that is NULL, empty, zero
    or holds a NULL or a number that isn't finite has no links, nor has one with a NULL label or id. Rows with
    equal vectors and labels are linked with each other, also where their ids are the same. Other columns are ignored.
    An empty table gives an empty result.
    """
    id_type = vectors.schema[vec_id].dataType.simpleString()
    doubles = F.col(embedding).cast("array<double>")
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), doubles.alias("vector")
    ).withColumn(
        "sound",
        F.coalesce(
            F.col("label").isNotNull()
            & F.col("vec_id").isNotNull()
            & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("vector", lambda x: x != 0),
            F.lit(False),
        ),
    )
    classes = rows.where("sound").groupBy("label", "vector").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("members")
    )
    classes = kept(classes, "vectors")
    hashed = classes.select("node", "vector").mapInArrow(_hash, f"node {id_type}, codes array<bigint>")
    hashed = kept(hashed, "vector-codes")
    cells = hashed.join(classes.select("node", "label"), "node").select(
        "node", "label", F.posexplode("codes").alias("table", "code")
    )
    buckets = cells.groupBy("label", "table", "code").agg(F.count(F.lit(1)).alias("_n"))
    buckets = kept(buckets.where("_n > 1"), "vector-buckets")
    tiles = F.ceil(F.col("_n") / TILE).cast("int")
    held = cells.join(buckets, ["label", "table", "code"]).withColumn("_tiles", tiles)
    # A vector goes to each pair of tiles that its own is in.
    held = (
        held.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int"))
        .withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        .withColumn("left", F.least("tile", "_with"))
        .withColumn("right", F.greatest("tile", "_with"))
        .select("node", "label", "table", "code", "tile", "left", "right")
    )
    full = held.join(classes.select("node", "vector", "members"), "node").join(hashed, "node")
    found = full.groupBy("label", "table", "code", "left", "right").applyInArrow(
        _links(cosine), f"node {id_type}, least {id_type}, links bigint"
    )
    found = kept(found, "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.select("node", "least"))
    facts = classes.join(counts, "node", "left").join(named, "node", "left")
    facts = kept(
        facts.select(
            "label",
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
            F.lit(True).alias("sound"),
        ),
        "vector-facts",
    )
    return rows.join(facts, ["sound", "label", "vector"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
