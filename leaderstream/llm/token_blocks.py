"""Token ids in compressed blocks, by adaptive context mixing and a range coder.

A block holds whole documents. It starts with no knowledge, has a checksum of its bytes and one of its ids, and
can be read without any other block. Its ids run in lanes, neighbouring stretches that are coded
side by side, one id of each lane in a step, and all lanes learn from each other. The model of a step is
what the steps before have shown:

* order 2: the id that last followed the two ids before, and how often it has been right;
* order 1: the same for the one id before;
* order 0: counts of all ids.

The share of each prediction in the mix is how often it came true so far in the block where both had these standings. An id takes the part of
the range that the mix gives it, in one coding step. A lane's range is one 64-bit number (range asymmetric numeral system): a step
takes 32-bit words off it or puts them back, and the words of all lanes are one stream, in the order of steps, then lanes.
All arithmetic is in whole numbers.

File: rows of a Parquet table, ordered by ``part`` and ``block``, the bytes in ``data``. Layout of a block, little-endian:
``header`` (see ``_HEADER``), ``n_docs`` 32-bit lengths, ``lanes`` 64-bit numbers that the lanes start reading with, and the 32-bit words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaderstream.session import shared_dir

from .tables import partitions
from .tokens import crc32_of, encoder

#: Ids after which a block is closed; one longer document makes a longer block.
BLOCK_IDS = 1 << 21
LANES = 8192
#: Steps of a lane that should at least pay for its last word.
LANE_IDS = 256
#: Words that a worker remembers, see ``tokens.REMEMBERED``; nothing else in these tasks needs much memory.
WORDS = 1_200_000

_MAGIC = b"TIDB"
_VERSION = 3
#: magic, version, vocabulary, ids, documents, lanes, CRC-32 of the ids; then a CRC-32 of these and of what follows.
_HEADER = struct.Struct("<4sHIIIII")
_CRC = struct.Struct("<I")
_ZERO = 20  # bits of the order-0 counts
_MIX = 10  # bits of the shares of the mix
_TOTAL = _ZERO + _MIX  # bits of the range that a step shares out
_PAIRS = 18  # bits of the table of order-2 contexts
_TOP = 12  # highest standing of a prediction
#: Steps at a block's begin after each of which the mix is learned anew; later ones learn it in groups of ``_OFTEN``.
_EARLY, _OFTEN = 16, 8
_U = np.uint64
_32 = _U(32)
_LOW = _U(0xFFFFFFFF)


class _Model:
    """What a step can know: tables, standings and counts. Encoder and decoder call it alike.

    An entry of a table is an id, and in its lowest bits the standing of that prediction. The mix is learned for each
    standing of both predictions together, apart for those that agree on an id. The tables of both orders are one array, order 2
    first, and so are the lanes' places, entries and hits: what is done to them is done in one call.
    """

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.table = np.zeros((1 << _PAIRS) + vocabulary, np.int32)
        # What came true, order 2, order 1 alone or neither, by agreement and standings.
        both = np.arange(512)
        stand2, stand1 = both >> 4 & 15, (both & 15) * (both < 256)
        self.tally = np.stack([stand2, stand1, np.full(512, 2 * _TOP)])
        self.usable = np.stack([stand2 > 0, stand1 > 0]).astype(np.int64) << _MIX
        self.steps, self.came, self.came_true = 0, [], []
        self.counts = np.zeros(vocabulary, np.int64)
        self.seen, self.fresh, self.n_fresh = 0, [], 0
        self.at = np.zeros((2, lanes), np.int64)
        self.prev1, self.hash1 = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
        # A standing after a prediction failed, less the one before; and the same after it came true.
        stand = np.arange(16, dtype=np.int32)
        self.moves = np.concatenate([-((stand + 1) >> 1), (stand < _TOP).astype(np.int32)])
        self._mix()
        self._share()

    def _mix(self) -> None:
        """The part of what came true so far, 15 of 16 at most for both predictions together."""
        part2, part1 = self.tally[:2] * self.usable // self.tally.sum(axis=0)
        known = np.minimum(part2 + part1, (1 << _MIX) - (1 << _MIX - 4))
        self.part2, self.known = np.minimum(part2, known).astype(np.uint32), known.astype(np.uint32)
        self.rest = np.uint32(1 << _MIX) - self.known

    def _share(self) -> None:
        """Counts to parts of 2 ** _ZERO, at least 1 for every id."""
        rest = (1 << _ZERO) - self.vocabulary
        parts = 1 + self.counts * rest // max(self.seen, 1) if self.seen else np.full(
            self.vocabulary, (1 << _ZERO) // self.vocabulary, np.int64
        )
        # What is left over is the last id's.
        parts[-1] += (1 << _ZERO) - parts.sum()
        self.sizes = parts.astype(np.uint32)
        self.begins = (np.cumsum(parts) - parts).astype(np.uint32)
        self._id_at = None

    def id_at(self, place: np.ndarray) -> np.ndarray:
        """The ids whose order-0 parts hold these places, from a table made when it is first asked for."""
        if self._id_at is None:
            self._id_at = np.repeat(np.arange(self.vocabulary, dtype=np.int32), self.sizes)
        return self._id_at.take(place, mode="clip")

    def predict(self) -> None:
        """Guesses of order 2 and 1 for each lane, and the part that the mix leaves to order 0."""
        pair = self.at[0].view(np.uint64)
        np.add(self.hash1, self.prev1, out=pair)
        pair *= _U(0x9E3779B97F4A7C15)
        pair >>= _U(64 - _PAIRS)
        np.multiply(self.prev1, _U(0xC2B2AE3D27D4EB4F), out=self.hash1)
        np.add(self.prev1.view(np.int64), 1 << _PAIRS, out=self.at[1])
        self.entry = self.table.take(self.at, mode="clip")
        self.stand = self.entry & 15
        both = self.stand[0] << 4
        both += self.stand[1]
        np.add(both, 256, out=both, where=self.entry[0] ^ self.entry[1] < 16)
        self.both = both.astype(np.int64)
        self.left = self.rest.take(self.both, mode="clip")

    def meet(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part of the range begins that the mix gives to these ids, and how long it is."""
        self.first = ids.astype(np.int32) << 4
        self.right = self.entry ^ self.first < 16
        begin, size = self.begins.take(ids, mode="clip"), self.sizes.take(ids, mode="clip")
        size *= self.left
        begin *= self.left
        self.hit = hit = (self.right[0] | self.right[1]).nonzero()[0]
        self.second = second = self.right[0].take(hit)
        self.hit_both = both = self.both.take(hit)
        part2, known = self.part2.take(both), self.known.take(both)
        # From the range's end, order 2 if it is right, else order 1; without a part of its own the id has that of order 0.
        start, end = np.where(second, 0, part2), np.where(second, part2, known)
        own = (end > start).nonzero()[0]
        at, start, end = hit.take(own), start.take(own), end.take(own)
        begin[at], size[at] = (1 << _MIX) - end << _ZERO, end - start << _ZERO
        return begin, size

    def guessed(self, hit: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The ids of those lanes whose places are not order 0's."""
        part2 = self.part2.take(self.both.take(hit))
        second = place >= np.uint32(1 << _MIX) - part2 << np.uint32(_ZERO)
        return np.where(second, self.entry[0].take(hit), self.entry[1].take(hit)) >> 4

    def learn(self, ids: np.ndarray) -> None:
        """To be called after ``meet`` with the same ids."""
        self.came.append(self.both)
        self.came_true.append(self.hit_both + np.where(self.second, 0, 512))
        self.steps += 1
        if self.steps <= _EARLY or self.steps % _OFTEN == 0:
            true = np.bincount(np.concatenate(self.came_true), minlength=2 * 512).reshape(2, 512)
            self.tally[:2] += true
            self.tally[2] += np.bincount(np.concatenate(self.came), minlength=512) - true.sum(axis=0)
            self.came, self.came_true = [], []
            self._mix()
        new = np.empty_like(self.entry)
        np.add(self.first, 1, out=new)
        stays = (self.right | (self.stand > 1)).ravel().nonzero()[0]
        entry, right = self.entry.ravel().take(stays), self.right.ravel().take(stays)
        new.ravel()[stays] = entry + self.moves.take((entry & 15) + np.where(right, 16, 0))
        self.table[self.at] = new
        self.prev1 = ids.view(np.uint64)
        self.fresh.append(ids)
        self.n_fresh += len(ids)
        if self.n_fresh >= max(512, self.seen):
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=self.vocabulary)
            self.seen += self.n_fresh
            self.fresh, self.n_fresh = [], 0
            self._share()


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block, and the ids of all but its last lanes."""
    lanes = min(LANES, max(1, -(-n // LANE_IDS)))
    steps = -(-n // lanes) if n else 0
    return (-(-n // steps) if n else 0), steps


def encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Lanes, the number that a reader starts each with, and the words that it takes, from the first step on."""
    lanes, steps = _lanes(len(ids))
    if not lanes:
        return 0, np.empty(0, "<u8"), np.empty(0, "<u4")
    grid = np.zeros(lanes * steps, ids.dtype)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(vocabulary, lanes)
    begins, sizes = np.empty((steps, lanes), np.uint32), np.empty((steps, lanes), np.uint32)
    for step in range(steps):
        now = grid[step].astype(np.int64)
        model.predict()
        begins[step], sizes[step] = model.meet(now)
        model.learn(now)
    # A reader undoes the last step that was coded first, so the steps are coded from the last one on.
    state, words = np.full(lanes, 1 << 32, np.uint64), []
    for step in range(steps - 1, -1, -1):
        size = sizes[step].astype(np.uint64)
        moves = (state >= size << _U(64 - _TOTAL)).nonzero()[0]
        moved = state.take(moves)
        words.append(moved.astype("<u4"))
        state[moves] = moved >> _32
        times = state // size
        state += times * (_U(1 << _TOTAL) - size)
        state += begins[step]
    return lanes, state.astype("<u8"), np.concatenate(words[::-1])


def decode_ids(n: int, vocabulary: int, lanes: int, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``ValueError`` where numbers and words are not those of ``n`` ids."""
    if not n:
        return np.empty(0, np.uint32)
    steps = _lanes(n)[1]
    model = _Model(vocabulary, lanes)
    state, taken = starts.astype(np.uint64), 0
    grid = np.empty((steps, lanes), np.uint32)
    for step in range(steps):
        model.predict()
        place = state.astype(np.uint32)
        place &= np.uint32((1 << _TOTAL) - 1)
        # Where a prediction came true this is beyond the last id's part: there the id is the guess.
        zero = place // model.left
        hit = (zero >= 1 << _ZERO).nonzero()[0]
        now = model.id_at(zero).astype(np.int64)
        now[hit] = model.guessed(hit, place.take(hit))
        begin, size = model.meet(now)
        place -= begin
        state >>= _U(_TOTAL)
        state *= size
        state += place
        moves = (state <= _LOW).nonzero()[0]
        state[moves] = (state.take(moves) << _32) | words[taken : taken + len(moves)]
        taken += len(moves)
        grid[step] = now
        model.learn(now)
    if taken != len(words) or (state != 1 << 32).any():
        raise ValueError("a block's words are not those of its ids")
    return grid.T.reshape(-1)[:n]


def pack_block(documents: list[np.ndarray], vocabulary: int) -> bytes:
    ids = np.concatenate(documents) if documents else np.empty(0, np.int64)
    lanes, starts, words = encode_ids(ids, vocabulary)
    body = np.array([len(d) for d in documents], "<u4").tobytes() + starts.tobytes() + words.tobytes()
    header = _HEADER.pack(_MAGIC, _VERSION, vocabulary, len(ids), len(documents), lanes, crc32_of(ids))
    return header + _CRC.pack(zlib.crc32(body, zlib.crc32(header))) + body


def unpack_block(data: bytes) -> list[np.ndarray]:
    """The ids of each document; ``ValueError`` where the bytes are not those that were written."""
    if len(data) < _HEADER.size + _CRC.size:
        raise ValueError("a block is cut off")
    magic, version, vocabulary, n, documents, lanes, ids_crc = _HEADER.unpack_from(data)
    (crc,) = _CRC.unpack_from(data, _HEADER.size)
    header, body = memoryview(data)[: _HEADER.size], memoryview(data)[_HEADER.size + _CRC.size :]
    if magic != _MAGIC or version != _VERSION or zlib.crc32(body, zlib.crc32(header)) != crc:
        raise ValueError("a block is damaged")
    numbers = np.frombuffer(body, "<u4")
    lengths, starts, words = np.split(numbers, [documents, documents + 2 * lanes])
    ids = decode_ids(n, vocabulary, lanes, np.frombuffer(starts.tobytes(), "<u8"), words).astype("<u4")
    if zlib.crc32(ids) != ids_crc:
        raise ValueError("a block's ids differ from those written")
    return np.split(ids, np.cumsum(lengths.astype(np.int64))[:-1]) if documents else []


_FILE = "part int, block int, part_start bigint, n_docs int, n_ids bigint, doc_ids array<{id}>, data binary"


def _write(path: str, end_id: int, id_type: pa.DataType):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path, WORDS)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, held, n = [], [], 0

        def closed() -> pa.RecordBatch:
            columns = [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([before], pa.int64()),
                pa.array([len(held)], pa.int32()),
                pa.array([n], pa.int64()),
                pa.array([doc_ids], pa.list_(id_type)),
                pa.array([pack_block(held, encode.size)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(
                columns, names=["part", "block", "part_start", "n_docs", "n_ids", "doc_ids", "data"]
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                for doc, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                    ids = np.append(encode.ids(text), np.uint16(end_id))
                    doc_ids.append(doc)
                    held.append(ids)
                    n += len(ids)
                    if n >= BLOCK_IDS:
                        yield closed()
                        block, before = block + 1, before + n
                        doc_ids, held, n = [], [], 0
        if held:
            yield closed()

    return blocks


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Documents in ascending ``doc_id`` order (NULL first; equal ids by hash of their texts) as blocks below ``path``.

    Each document's ids end with ``end_id``; NULL and empty texts have only that. Other columns are ignored. No
    documents: a table without blocks. A task keeps the ids of one block in memory.
    """
    spark = docs.sparkSession
    field = docs.schema[doc_id]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = source.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    )
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[field.dataType.simpleString()]
    schema = _FILE.format(id=field.dataType.simpleString())
    ordered.mapInArrow(_write(tokenizer, end_id, id_type), schema).write.parquet(path)


def _read(id_type: pa.DataType, with_ids: bool):
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, doc_ids, data = (c[row] for c in batch.columns)
                ids = unpack_block(data.as_buffer())
                lengths = np.array([len(d) for d in ids], np.int64)
                columns = {
                    "doc_id": doc_ids.values,
                    "part": pa.array(np.full(len(ids), part.as_py()), pa.int32()),
                    "part_start": pa.array(start.as_py() + np.cumsum(lengths) - lengths),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(d) for d in ids], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([d.tobytes() for d in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return documents


def read_ids(spark, path: str, with_ids: bool = True) -> DataFrame:
    """The documents below ``path``: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and ``ids`` (32-bit numbers).

    All blocks are decoded and checked; without ``with_ids`` the ids stay in the tasks that read them.

    ``start`` counts the ids of all documents before. Parts are as many as the writing tasks, so
    the table of their sizes is small.
    """
    files = spark.read.parquet(path)
    element = files.schema["doc_ids"].dataType.elementType
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[element.simpleString()]
    from pyspark.sql import Window as W

    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    schema = f"doc_id {element.simpleString()}, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint"
    ids = ["ids"] if with_ids else []
    schema += ", ids binary" if with_ids else ""
    read = files.select("part", "part_start", "doc_ids", "data").mapInArrow(_read(id_type, with_ids), schema)
    return read.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32", *ids
    )


def digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Written to a fresh folder below ``spark.checkpoint.dir`` and read back from it."""
    spark = docs.sparkSession
    path = shared_dir(spark, "token-blocks")
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(spark, path, with_ids=False)
