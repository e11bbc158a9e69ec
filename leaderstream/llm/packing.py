"""Best-fit packing of documents into sequences under several capacities.

A sequence has room for so many tokens, documents and so much attention cost (the square of each piece's
length). Pieces go by falling size to the open sequence that, of all with room in every respect,
is left with the smallest norm of free room.

Tokenising tasks cut documents and hand on only the size of each piece. Pieces are dealt evenly, by
their place and not by any key, into groups that are packed apart; a group is many times larger than a
sequence, so little is lost at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept
from .tokens import crc32_of, encoder

CAPACITY = 2048
#: Documents of a sequence, at most, where queries and stages pack: as many as it has tokens, and every document has one, so
#: this can't run out before the tokens do. Free places have their share in the choice of the sequence.
DOCUMENTS = CAPACITY
#: Attention cost of a sequence, at most, there: that of one piece of ``CAPACITY`` tokens. It can't run out before the tokens
#: do either, and free cost has its share in the choice too.
COST = float(CAPACITY) ** 2
#: Pieces that are packed together.
GROUP = 16_384
#: Texts that are encoded at a time.
_SLICE = 256

_PIECES = "doc_id {id}, piece int, start bigint, length int, ids_crc32 bigint"


def pack(
    lengths: np.ndarray,
    capacity: int,
    most_documents: int | None = None,
    most_cost: float | None = None,
    weights: tuple[float, float, float] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece, by vector best fit with falling sizes.

    ``weights`` of free tokens, documents and cost in the norm; left out, a capacity weighs what a
    piece takes of it on average, and one that is not given weighs nothing. A piece that is
    too large for an empty sequence in any respect raises ``ValueError``. No pieces: empty arrays.
    """
    n = len(lengths)
    sequence, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if n == 0:
        return sequence, offset
    given = (True, most_documents is not None, most_cost is not None)
    room = np.array([capacity, most_documents if given[1] else capacity, most_cost if given[2] else float(capacity) ** 2])
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1) / room
    if need.max() > 1:
        raise ValueError("a piece is larger than a sequence")
    if weights is None:
        weights = tuple(need.mean(axis=0) * given)
    bound = [k for k in range(3) if given[k] or weights[k] > 0]
    need, weight = need[:, bound], np.array([weights[k] for k in bound])
    order = np.lexsort((np.arange(n), -(need @ weight)))
    smallest = np.minimum.accumulate(need[order][::-1], axis=0)[::-1]  # of a piece and all after it

    ids, free, used = np.empty(n, np.int64), np.empty((len(bound), n)), np.empty(n, np.int64)
    open_, made, eps = 0, 0, 1e-12
    for turn, at in enumerate(order):
        want = need[at]
        if turn % 64 == 0 and open_:  # close what no later piece fits
            stays = np.all(free[:, :open_] >= smallest[turn][:, None] - eps, axis=0)
            left = int(stays.sum())
            ids[:left], used[:left], free[:, :left] = ids[:open_][stays], used[:open_][stays], free[:, :open_][:, stays]
            open_ = left
        after = free[:, :open_] - want[:, None]
        norm = weight @ (after * after)
        norm[(after < -eps).any(axis=0)] = np.inf
        best = int(norm.argmin()) if open_ else -1
        if best < 0 or norm[best] == np.inf:
            best, open_ = open_, open_ + 1
            ids[best], free[:, best], used[best] = made, 1.0, 0
            made += 1
        free[:, best] -= want
        sequence[at], offset[at] = ids[best], used[best]
        used[best] += lengths[at]
    return sequence, offset


def _cut(capacity: int, path: str, end_id: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                rows, piece, start, length, crc = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encode.ids(text), np.uint16(end_id))
                    first = (len(ids) - 1) % capacity + 1
                    for k, to in enumerate(range(first, len(ids) + 1, capacity)):
                        begin = max(0, to - capacity) if k else 0
                        rows.append(row)
                        piece.append(k)
                        start.append(begin)
                        length.append(to - begin)
                        crc.append(crc32_of(ids[begin:to]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int32()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return pieces


def packed(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    most_documents: int | None = None,
    most_cost: float | None = None,
) -> DataFrame:
    """A row for each piece of each document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``.

    A document's ids end with ``end_id``, so one that is NULL or empty has a piece of one token. Only documents longer
    than ``capacity`` are cut; their first piece may be shorter than the others. Rows with the same or a
    NULL ``doc_id`` are documents of their own. Other columns are ignored. No documents: no rows.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = _PIECES.format(id=id_type)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pieces = kept(source.mapInArrow(_cut(capacity, tokenizer, end_id), schema), "packing-pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    dealt = pieces.withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))

    def fill(rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_numpy()
        sequence, offset = pack(lengths, capacity, most_documents, most_cost)
        sequence += rows.column("_group").to_numpy() << 32
        rows = rows.drop_columns(["_group"])
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(fill, schema + ", sequence_id bigint, offset bigint")
