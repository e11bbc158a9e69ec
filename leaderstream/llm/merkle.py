"""Merkle manifest of a table: a tree over the rows of each group, and one over the groups' roots.

A tree has ``ARITY`` children to a node and is kept as an append log: nodes stand in the order in which they
are completed (postorder), so a subtree is one stretch of the log and its root the last entry. Builders take
aligned blocks of ``ARITY ** HEIGHT`` consecutive leaves, each one subtree, and write that stretch as one row. The roots of
blocks are the leaves of the next round's log, until one block holds a whole tree.

Where a node stands follows from its level and index alone (``positions``): the sizes of all subtrees completed
before it add up. Proofs read the siblings of a leaf at those places. They are opened from the top down: a
block hands what it opened to the blocks below its leaves, so a block needs its own row and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaderstream.operators.numbering import numbered

from .tables import kept

ARITY = 8
#: Levels of a builder above its leaves, of which it takes ``ARITY ** HEIGHT``.
HEIGHT = 4
#: What a leaf digests, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = "array<struct<place:int,others:string>>"


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def positions(level: int, index: np.ndarray, n: int) -> np.ndarray:
    """Place in the log of a tree of ``n`` leaves of the nodes with these indices on ``level``, from 0.

    Before a node stand, on its own and each lower level, all nodes that start before its end, and on each
    higher level those that end before its start.
    """
    index = np.asarray(index, np.int64)
    before = np.full(index.shape, -1, np.int64)
    for k in range(level + 1):
        before += np.minimum((index + 1) * ARITY ** (level - k), -(-n // ARITY**k))
    for k in range(level + 1, height(n) + 1):
        before += index // ARITY ** (k - level)
    return before


def digest_of(parts: list[bytes]) -> bytes:
    """Lower-case hex of the SHA-256 over all parts, which are digests in hex."""
    return sha256(b"".join(parts)).hexdigest().encode()


def block_log(leaves: list[bytes], block: int, n: int, levels: int = HEIGHT) -> np.ndarray:
    """The log of the block's subtree, an entry of 32 bytes for each node."""
    size = ARITY**levels
    begin = int(positions(0, np.array([block * size]), n)[0])
    rows, places, nodes = [], [], leaves
    for level in range(min(levels, height(n)) + 1):
        first = block * size // ARITY**level
        rows += nodes
        places.append(positions(level, np.arange(first, first + len(nodes)), n) - begin)
        nodes = [digest_of(nodes[k : k + ARITY]) for k in range(0, len(nodes), ARITY)]
    log = np.empty((len(rows), 32), np.uint8)
    log[np.concatenate(places)] = np.frombuffer(bytes.fromhex(b"".join(rows).decode()), np.uint8).reshape(-1, 32)
    return log


def block_paths(log: np.ndarray, block: int, leaves: int, n: int, levels: int = HEIGHT) -> list[list[tuple[int, bytes]]]:
    """For each leaf of the block, from its own level to the block's root: its place in the run, and the
    digests of the run's others in order."""
    size = ARITY**levels
    begin = int(positions(0, np.array([block * size]), n)[0])
    paths: list[list[tuple[int, bytes]]] = [[] for _ in range(leaves)]
    for level in range(min(levels, height(n))):
        first = block * size // ARITY**level
        nodes = -(-leaves // ARITY**level)
        at = positions(level, np.arange(first, first + nodes), n) - begin
        texts = [log[k].tobytes().hex().encode() for k in at]
        steps = []
        for k in range(nodes):
            run = texts[k - k % ARITY : k - k % ARITY + ARITY]
            steps.append((k % ARITY, b"".join(run[: k % ARITY] + run[k % ARITY + 1 :])))
        for leaf in range(leaves):
            paths[leaf].append(steps[leaf // ARITY**level])
    return paths


def folded(leaf: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for place, others in path:
        leaf = digest_of([others[: 64 * place], leaf, others[64 * place :]])
    return leaf


def _build(id_type: pa.DataType, levels: int):
    def built(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        block, n = rows.column("block")[0].as_py(), rows.column("n")[0].as_py()
        log = block_log([d.encode() for d in rows.column("digest").to_pylist()], block, n, levels)
        return pa.table(
            {
                "tree": rows.column("tree").slice(0, 1),
                "n": rows.column("n").slice(0, 1),
                "block": rows.column("block").slice(0, 1),
                "top": pa.array([log[-1].tobytes().hex()]),
                "log": pa.array([log.tobytes()], pa.binary()),
                "ids": pa.array([rows.column("id").to_pylist()], pa.list_(id_type)),
                "changed": pa.array([rows.column("changed").to_pylist()], pa.list_(pa.string())),
            }
        )

    return built


def _rounds(nodes: DataFrame, largest: int, purpose: str, levels: int) -> list[DataFrame]:
    """Block rows of every round: the log of one builder each. A tree ends in the round that has all its nodes in one block."""
    field = nodes.schema["id"]
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"tree string, n bigint, block bigint, top string, log binary, ids array<{field.dataType.simpleString()}>, changed array<string>"
    rounds, size = [], ARITY**levels
    while True:
        placed = nodes.withColumn("block", F.expr(f"index div {size}"))
        built = placed.groupBy("tree", "block").applyInArrow(_build(to_arrow_type(field.dataType), levels), schema)
        rounds.append(kept(built, f"{purpose}-{len(rounds)}"))
        if largest <= size:
            return rounds
        largest = -(-largest // size)
        nodes = (
            rounds[-1]
            .where(F.col("n") > size)
            .select(
                "tree",
                F.ceil(F.col("n") / size).cast("bigint").alias("n"),
                F.col("block").alias("index"),
                F.col("top").alias("digest"),
                F.lit(None).cast(field.dataType).alias("id"),
                F.lit(None).cast("string").alias("changed"),
            )
        )


def _steps(path) -> list[tuple[int, bytes]]:
    return [(s["place"], s["others"].encode()) for s in path]


def _open(proofs: bool, levels: int):
    """Leaves of each block: with the path to the root, or with what it proves."""
    block_size = ARITY**levels

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield one(*[c.slice(row, 1) for c in batch.columns])

    def one(tree, n, block, log, ids, changed, subroot, above) -> pa.RecordBatch:
        at, size = block[0].as_py(), n[0].as_py()
        entries = np.frombuffer(log[0].as_buffer(), np.uint8).reshape(-1, 32)
        leaves = min(block_size, size - at * block_size)
        rest = _steps(above[0].as_py())
        paths = [path + rest for path in block_paths(entries, at, leaves, size, levels)]
        same = lambda c: c.take(pa.array(np.zeros(leaves, np.int64)))
        first = {"tree": same(tree), "subroot": same(subroot)}
        own = ids.flatten()
        if not proofs:
            index = pa.array(np.arange(leaves) + at * block_size)
            steps = [[{"place": p, "others": o.decode()} for p, o in path] for path in paths]
            kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))
            return pa.RecordBatch.from_pydict({**first, "index": index, "id": own, "path": pa.array(steps, kind)})
        places = positions(0, np.arange(leaves) + at * block_size, size)
        digests = [entries[k].tobytes().hex() for k in places - places[0]]
        proof = [sha256(b"".join(others for _, others in path)).hexdigest() for path in paths]
        now = [c or d for c, d in zip(changed.flatten().to_pylist(), digests, strict=True)]
        roots = [folded(d.encode(), path).decode() for d, path in zip(now, paths, strict=True)]
        return pa.RecordBatch.from_pydict(
            {**first, "id": own, "leaf": pa.array(digests), "proof_sha256": pa.array(proof), "folded_root": pa.array(roots)}
        )

    return opened


def _opened(rounds: list[DataFrame], roots: DataFrame, levels: int, proofs: bool) -> DataFrame:
    """Leaves of all trees. ``roots`` has ``tree``, ``subroot`` and the path ``above`` of each tree."""
    id_type = rounds[0].schema["ids"].dataType.elementType.simpleString()
    columns = ["tree", "n", "block", "log", "ids", "changed", "subroot", "above"]
    handed, size = None, ARITY**levels
    for number, blocks in reversed(list(enumerate(rounds))):
        whole = blocks.where(F.col("n") <= size).join(roots, "tree").select(*columns)
        if handed is not None:
            parts = blocks.where(F.col("n") > size).join(handed, ["tree", "block"])
            whole = whole.unionByName(parts.select(*columns))
        if proofs and number == 0:
            schema = f"tree string, subroot string, id {id_type}, leaf string, proof_sha256 string, folded_root string"
            return whole.mapInArrow(_open(True, levels), schema)
        schema = f"tree string, subroot string, index bigint, id {id_type}, path {_PATH}"
        handed = whole.mapInArrow(_open(False, levels), schema).withColumnsRenamed({"path": "above", "index": "block"})
    return handed


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    """``-`` for NULL, else the count of UTF-8 bytes, ``:`` and the value, for each of ``FIELDS``."""
    return F.sha2(F.concat(*[_field(fields[name]) for name in FIELDS]), 256)


def tampered(doc_id: str) -> Column:
    """Rows whose text is folded to lower case before they are verified; none with a NULL id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0, F.lit(False))


def manifest(docs: DataFrame, group: str = "lang", levels: int = HEIGHT) -> DataFrame:
    """A row for each of ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    Leaves of a ``group`` (NULL is one) ascend by ``doc_id``, NULL first; rows with equal ids by their digests, so reruns
    agree. A group of one row has its leaf as ``subroot``, one group alone its ``subroot`` as ``root``. ``proof_sha256`` digests
    all siblings from the leaf up to the root. ``folded_root`` is what the row gives with its siblings when its text has been
    tampered with (``tampered``; a NULL or lower-case text is as before), and ``verified`` says whether it is the root. Texts are taken
    whole; other columns are ignored; an empty table gives an empty result. ``levels`` is the height of a builder.
    """
    digests = leaf_digest({name: F.col(name) for name in FIELDS})
    lower = F.translate("text", _A_TO_Z, _A_TO_Z.lower())
    again = leaf_digest({**{name: F.col(name) for name in FIELDS}, "text": lower})
    # One text for each group, NULL apart from all others and before them, that joins by plain equality.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    leaves = docs.select(
        F.col("doc_id").alias("id"),
        tree.alias("tree"),
        digests.alias("digest"),
        F.when(tampered("doc_id"), again).alias("changed"),
    )
    leaves = kept(leaves, "merkle-leaves")
    ordered = [F.col("id").asc_nulls_first(), F.col("digest").asc()]
    nodes = numbered(leaves, ["tree"], ordered, "index", total="n").withColumn("index", F.col("index") - 1)
    nodes = kept(nodes, "merkle-nodes")
    largest = nodes.agg(F.max("n")).first()[0]
    if largest is None:
        schema = "subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return leaves.selectExpr("id AS doc_id", "digest AS leaf").join(docs.sparkSession.createDataFrame([], schema))
    rounds = _rounds(nodes, largest, "merkle-log", levels)
    tops = [r.where(F.col("n") <= ARITY**levels).select("tree", "top") for r in rounds]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)

    # The tree over the groups: its leaves are their roots.
    named = subroots.select(
        F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("changed")
    )
    groups = numbered(named, ["tree"], [F.col("id").asc()], "index", total="n").withColumn("index", F.col("index") - 1)
    groups = kept(groups, "merkle-groups")
    upper = _rounds(groups, groups.agg(F.max("n")).first()[0], "merkle-upper", levels)
    root = upper[-1].select("top").first()[0]
    nothing = F.array().cast(_PATH).alias("above")
    start = upper[-1].select("tree", F.col("top").alias("subroot"), nothing)
    paths = _opened(upper, start, levels, proofs=False).select(F.col("id").alias("tree"), "above")
    above = kept(subroots.withColumnRenamed("top", "subroot").join(paths, "tree"), "merkle-above")

    found = _opened(rounds, above, levels, proofs=True)
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        F.lit(root).alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )
