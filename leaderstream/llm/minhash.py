"""Near-duplicate texts: minima of many universal hashes, banding, verification, components.

1. Each document becomes a fingerprint of its shingle set, hashes of its bands of minima, and one bit of each minimum.
   Documents with the same set are one class from here on.
2. Classes that share a band meet in its bucket, each with the least class of the bucket: a number of pairs no larger than
   the bucket. Pairs whose minima agree too little for the wanted similarity go; the others are compared
   on their full sets. What is confirmed gives components.
3. Buckets that still hold several components are gone through once more, each in tiles of bounded size. A task compares
   the signatures (8 bits of each minimum) of classes from different components; those with a similar partner come again with their
   full sets, most similar pairs first, until their components have met or no pair is left. So every pair of a bucket is
   either judged, in the first bucket that it shares, or inside one component already, where its link changes nothing. Tasks
   hand on classes and links that join components, never pairs.

A link is missed only where two sets agree in no band: at similarity 0.8, the least that counts, with probability
(1 - 0.8 ** ROWS) ** BANDS, less than 1 in 100,000. Sets are compared as 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import shingle_sets, slices, spread
from .tables import free_names, kept

ROWS, BANDS = 5, 30
#: Classes of a bucket that are compared in one piece.
TILE = 512
_HASHES = ROWS * BANDS
_WORDS = -(-_HASHES // 64)
_SEED = 20_240_229


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms of the universal hashes ``(a * x + b) mod 2 ** 64 >> 32`` of 32-bit numbers."""
    random = np.random.default_rng(_SEED)
    draw = lambda: random.integers(0, 1 << 64, _HASHES, dtype=np.uint64)
    return draw(), draw()


def minima(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The least value of each hash function over each set, sets without members left out."""
    x = hashes >> np.uint64(32)
    starts = begins[:-1][begins[1:] > begins[:-1]]
    out = np.empty((_HASHES, len(starts)), np.uint64)
    room = np.empty(len(x), np.uint64)
    for k, (a, b) in enumerate(zip(*_functions(), strict=True)):
        np.multiply(x, a, out=room)
        np.add(room, b, out=room)
        np.minimum.reduceat(room, starts, out=out[k])
    return (out >> np.uint64(32)).T


def _signatures(width: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield of(part)

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        hashes, begins = shingle_sets(part.column(1), width)
        sizes = np.diff(begins)
        full = np.flatnonzero(sizes)
        prints = np.zeros((2, n), np.uint64)
        bands = np.zeros((n, BANDS), np.int64)
        bits = np.zeros((n, _WORDS), np.int64)
        low = np.zeros((n, _HASHES), np.uint8)
        if len(full):
            starts = begins[:-1][full]
            prints[0, full] = np.add.reduceat(spread(hashes + np.uint64(1)), starts)
            prints[1, full] = np.add.reduceat(spread(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
            least = minima(hashes, begins)
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(full), 1))
            for row in range(ROWS):
                key = spread(key * np.uint64(0x9E3779B97F4A7C15) + least[:, row::ROWS])
            bands[full] = key.view(np.int64)
            low[full] = least & np.uint64(255)
            flags = np.zeros((len(full), 64 * _WORDS), np.uint8)
            flags[:, :_HASHES] = least & np.uint64(1)
            bits[full] = np.packbits(flags, axis=1).view(np.int64)
        lists = lambda x: pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1))
        )
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(sizes.astype(np.int64)),
                pa.array(prints[0].view(np.int64)),
                pa.array(prints[1].view(np.int64)),
                lists(bands),
                lists(bits),
                pa.array([low[row].tobytes() for row in range(n)], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "print1", "print2", "bands", "bits", "low"],
        )

    return signed


def _sets(width: int):
    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                hashes, begins = shingle_sets(part.column(1), width)
                raw = pa.py_buffer(hashes)
                offsets = pa.py_buffer((begins * 8).astype(np.int64))
                sets = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, offsets, raw])
                yield pa.RecordBatch.from_arrays([part.column(0), sets.cast(pa.binary())], names=["node", "shingles"])

    return stored


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets are linked."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(percent: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = [
                _similar(np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64), percent)
                for one, other in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(right, pa.bool_()))

    return links


def _candidates(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a tile pair from different components, in no earlier bucket together, whose signatures agree as often as those of
    linked sets do but for five deviations; and how often they agree."""
    chance = percent / 100
    least = _HASHES * chance - 5 * (_HASHES * chance * (1 - chance)) ** 0.5
    low = np.frombuffer(b"".join(rows.column("low").to_pylist()), np.uint8).reshape(-1, _HASHES)
    bands = np.asarray(rows.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
    component, tile = rows.column("component").to_numpy(), rows.column("tile").to_numpy()
    band = int((bands[0] == rows.column("bucket")[0].as_py()).argmax())
    first, second = rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
    ones = np.flatnonzero(tile == first)
    others = ones if first == second else np.flatnonzero(tile == second)
    found = [(np.empty(0, np.int64),) * 3]
    for at, one in enumerate(ones):
        partners = others[at + 1 :] if first == second else others
        partners = partners[component[partners] != component[one]]
        agree = (low[partners] == low[one]).sum(axis=1)
        close = agree >= least
        partners, agree = partners[close], agree[close]
        new = ~(bands[partners, :band] == bands[one, :band]).any(axis=1)
        found.append((np.full(int(new.sum()), one), partners[new], agree[new]))
    a, b, agree = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b, agree


def _alike(percent: int):
    def alike(rows: pa.Table) -> pa.Table:
        """The classes of a tile pair that have a candidate."""
        a, b, _ = _candidates(rows, percent)
        return rows.select(["bucket", "left", "right", "node"]).take(pa.array(np.union1d(a, b)))

    return alike


def _joining(percent: int):
    def joining(rows: pa.Table) -> pa.Table:
        """Links that join components: the most similar candidates first, none inside a component."""
        a, b, agree = _candidates(rows, percent)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
        component = rows.column("component").to_numpy().copy()
        linked = []
        for k in np.argsort(-agree, kind="stable"):
            x, y = a[k], b[k]
            if component[x] != component[y] and _similar(sets[x], sets[y], percent):
                component[component == component[x]] = component[y]
                linked.append(k)
        node = rows.column("node").combine_chunks()
        take = lambda side: node.take(pa.array(side[linked].astype(np.int64)))
        return pa.table({"a": take(a), "b": take(b)})

    return joining


def _may_link(percent: int) -> Column:
    """Whether the bits of two minima differ no more than those of similar sets do, by six deviations."""
    unlike = (1 - percent / 100) / 2
    most = int(_HASHES * unlike + 6 * (_HASHES * unlike * (1 - unlike)) ** 0.5)
    differ = sum(
        (F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("other_bits", F.lit(k)))) for k in range(_WORDS)),
        F.lit(0),
    )
    return differ <= most


def near_groups(
    docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (least ``doc_id`` reachable) and ``kept``, a row for each of ``docs``.

    Documents are linked where ``100 * intersection >= percent * union`` of their shingle sets. One without words
    (empty or NULL text) has no shingles and no links. Equal rows are linked, both ``kept`` where their ``doc_id`` is the
    least; rows with one ``doc_id`` but different texts are linked too where either is a class's least. A row
    with a NULL ``doc_id`` joins others, and where all of its component are so, its ``component_id`` is NULL and
    it is kept. Other columns are ignored. An empty table gives an empty result.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {id_type}, n_shingles bigint, print1 bigint, print2 bigint, bands array<bigint>, bits array<bigint>"
    signed = kept(source.mapInArrow(_signatures(width), schema + ", low binary"), "minhash")

    same = ["print1", "print2", "n_shingles"]
    classes = signed.where("n_shingles > 0").groupBy(*same)
    classes = kept(
        classes.agg(
            F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("bands", "bits", "low")]
        ),
        "minhash-classes",
    )
    nodes = classes.where(F.col("node").isNotNull())
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("_n"))
    buckets = kept(buckets.where("_n > 1").drop("_n"), "minhash-buckets")
    shared = kept(members.join(buckets, "bucket"), "minhash-shared")

    bits = nodes.select("node", "bits")
    stars = shared.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    stars = stars.join(bits.toDF("a", "bits"), "a").join(bits.toDF("b", "other_bits"), "b")
    stars = kept(stars.where(_may_link(percent)).select("a", "b"), "minhash-pairs")
    links = _verified(source, stars, width, percent, id_type)

    found = components(links)
    placed = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = placed.groupBy("bucket").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("_n")
    )
    open_ = kept(open_.where("_low < _high").select("bucket", "_n"), "minhash-open")
    tiles = open_.withColumn("_tiles", F.ceil(F.col("_n") / TILE).cast("int")).drop("_n")
    rest = placed.join(tiles, "bucket").select("bucket", "node", "component", "_tiles")
    # A class goes to each pair of tiles that its own is in.
    rest = (
        rest.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int"))
        .withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        .select("bucket", F.least("tile", "_with").alias("left"), F.greatest("tile", "_with").alias("right"), "tile", "node", "component")
    )
    rest = kept(rest.join(nodes.select("node", "bands", "low"), "node"), "minhash-rest")
    piece = ["bucket", "left", "right"]
    alike = rest.groupBy(*piece).applyInArrow(_alike(percent), f"bucket bigint, left int, right int, node {id_type}")
    alike = kept(alike, "minhash-alike")
    if not alike.isEmpty():
        sets = _sets_of(source, alike.select("node"), width, id_type)
        again = rest.join(alike, [*piece, "node"]).join(sets, "node")
        joining = again.groupBy(*piece).applyInArrow(_joining(percent), f"a {id_type}, b {id_type}")
        found = components(links.unionAll(kept(joining, "minhash-links")))

    named = classes.select(*same, "node").join(found, "node", "left")
    named = kept(named.select(*same, F.coalesce("component", "node").alias("component_id")), "minhash-named")
    return (
        signed.select("doc_id", *same)
        .join(named, same, "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", "kept")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters: int) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the least ``doc_id``, NULL last, and of several with that
    id the first one read. ``parameters`` are those of ``near_groups``.

    Rows are told apart by a number of their own, so those that share a ``doc_id`` or have none are documents like any other.
    """
    row, member = free_names(docs, ["_row", "_member"])
    rows = kept(docs.withColumn(row, F.monotonically_increasing_id()), "minhash-rows")
    groups = near_groups(rows, doc_id=row, text=text, **parameters)
    groups = kept(groups.select(F.col("doc_id").alias(member), "component_id"), "minhash-groups")
    # Groups of one need no choice.
    several = groups.where(F.col(member) != F.col("component_id")).select("component_id").distinct()
    ids = rows.select(F.col(row).alias(member), F.col(doc_id).alias("_id"))
    members = groups.join(several, "component_id", "left_semi").join(ids, member)
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col(member))
    stays = members.groupBy("component_id").agg(F.min_by(member, order).alias("_stays"))
    gone = members.join(stays, "component_id").where(F.col(member) != F.col("_stays"))
    gone = kept(gone.select(F.col(member).alias(row)), "minhash-gone")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def _sets_of(source: DataFrame, nodes: DataFrame, width: int, id_type: str) -> DataFrame:
    """Shingle sets, made anew, and only for these documents."""
    needed = kept(nodes.distinct().toDF("doc_id"), "minhash-needed")
    texts = source.join(needed, "doc_id", "left_semi").select("doc_id", "text")
    return kept(texts.mapInArrow(_sets(width), f"node {id_type}, shingles binary"), "minhash-sets")


def _verified(source: DataFrame, pairs: DataFrame, width: int, percent: int, id_type: str) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    sets = _sets_of(source, pairs.select("a").unionAll(pairs.select("b")), width, id_type)
    sides = pairs.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "other"), "b")
    sides = sides.select("a", "b", "one", "other")
    links = sides.mapInArrow(_confirmed(percent), f"a {id_type}, b {id_type}")
    return kept(links.distinct(), "minhash-links")
