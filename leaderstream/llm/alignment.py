"""Alignment of the tokens that two tokenizers make of the same text, by sparse products over bytes.

Both tokenizers cover the bytes of a text. A token is a row of an incidence matrix, the bytes it covers are the columns of its
ones, so the matrix ``A`` of one tokenizer times the transposed one of the other counts the bytes that two tokens share:
overlap links. Places where tokens of both end cut the text into groups; incidence of tokens and groups, multiplied
alike, gives the links inside groups. Matrices are compressed sparse rows built from lengths alone, products go
row by row (Gustavson): a row of the product adds up the right rows that the ones of the left row name.

Neither vocabulary has a piece that goes on beyond a space, so the ids of a text are those of its words, each with the
space before it, and most words are remembered; texts with other runs of white space are encoded whole. Many texts
lie in one block-diagonal matrix.

Counts over the corpus: a task hands on each slice of documents as one row, with its distinct id pairs and its links as places in
their list. The pairs of all slices are counted, joined with the corpus-wide counts, and come back to their slice. A slice
has bounded bytes but for a longer single text, so its pairs are bounded too, however often they occur.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tables import kept
from .tokens import Encoder, _byte_letters

#: Texts of a slice, and about as many bytes.
TEXTS, BYTES = 4096, 1 << 21
#: Bytes that lie in one matrix, but for longer single texts, and of a stretch of its product.
MATRIX, STRETCH = 1 << 19, 1 << 19
#: Words a worker remembers before it starts anew.
REMEMBERED = 400_000
KINDS = ("overlap", "group", "end")

#: White space that a cut at spaces could part.
_ODD = re.compile(r"^\s| \s|\s |\s$")
#: What stands behind an id: more of its kind, the other kind, a group, nothing.
_MARKS = (",", "|", ";", "")
#: Words that are encoded at a time.
_FEW = 4096


class Csr(NamedTuple):
    """Rows of a sparse matrix: row ``i`` has ``data`` in the columns ``indices``, from ``indptr[i]`` to ``indptr[i + 1]``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray


def gustavson(left: Csr, right: Csr, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product's entries ``(row, column, value)`` by row and column, by adding up rows of ``right``."""
    lengths = np.diff(right.indptr).take(left.indices)
    total = int(lengths.sum())
    row = np.repeat(np.repeat(np.arange(len(left.indptr) - 1), np.diff(left.indptr)), lengths)
    at = np.repeat(right.indptr.take(left.indices) - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(total)
    value = np.repeat(left.data, lengths) * right.data.take(at)
    key = row * columns + right.indices.take(at)
    if total and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if total else np.empty(0, np.int64)
    key = key[new]
    return key // columns, key % columns, (np.add.reduceat(value, new) if total else value)


def covering(lengths: np.ndarray) -> Csr:
    """Tokens of these lengths in a row, by the bytes they cover."""
    ends = np.append(0, np.cumsum(lengths))
    return Csr(ends, np.arange(ends[-1]), np.ones(ends[-1], np.int64))


def covered(lengths: np.ndarray) -> Csr:
    """The same transposed: bytes, by the token that covers each."""
    size = int(lengths.sum())
    return Csr(np.arange(size + 1), np.repeat(np.arange(len(lengths)), lengths), np.ones(size, np.int64))


def overlap_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of two rows of lengths over the same bytes that share bytes, and how many.

    Rows of the product are independent, so it is made in stretches of ``STRETCH`` bytes, each with the tokens of ``b``
    that reach into it.
    """
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    found = [(np.empty(0, np.int64),) * 3]
    first = 0
    while first < len(a):
        begin = int(ends_a[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends_a, begin + STRETCH, side="right")))
        end = int(ends_a[last - 1])
        j = int(np.searchsorted(ends_b, begin, side="right"))
        k = int(np.searchsorted(ends_b, end, side="left")) + 1
        inside = np.minimum(ends_b[j:k], end) - np.maximum(ends_b[j:k] - b[j:k], begin)
        rows, columns, shared = gustavson(covering(a[first:last]), covered(inside), max(1, k - j))
        found.append((rows + first, columns + j, shared))
        first = last
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def end_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the overlap links whose tokens end at the same byte."""
    i, j, _ = overlap_links(a, b)
    together = np.cumsum(a)[i] == np.cumsum(b)[j]
    return i[together], j[together]


def group_of(n: int, lasts: np.ndarray) -> np.ndarray:
    """The group of each of ``n`` tokens, where ``lasts`` are the last ones of the groups."""
    ends = np.zeros(n, np.int64)
    ends[lasts] = 1
    return np.cumsum(ends) - ends


def group_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in the same group, by the product of their incidences with groups."""
    i, j = end_links(a, b)
    ga, gb = group_of(len(a), i), group_of(len(b), j)
    left = Csr(np.arange(len(a) + 1), ga, np.ones(len(a), np.int64))
    # Tokens of a group follow each other, so the transposed incidence needs no sorting.
    sizes = np.bincount(gb, minlength=len(i))
    right = Csr(np.append(0, np.cumsum(sizes)), np.arange(len(b)), np.ones(len(b), np.int64))
    return gustavson(left, right, max(1, len(b)))


class Tokens(NamedTuple):
    """Ids of both kinds for many texts one after the other, and how many each text has."""

    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray


class _Vocabulary:
    """Bytes of each id, end to end."""

    def __init__(self, of_ids: list[bytes]):
        if len(of_ids) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.lengths = np.array([len(x) for x in of_ids])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.all = np.frombuffer(b"".join(of_ids), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a row of ids."""
        lengths = self.lengths.take(ids)
        at = np.repeat(self.begins.take(ids) - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        return self.all.take(at)


class Pair:
    """Two tokenizers over one text: a byte-level vocabulary of the tokenizers library, which gets a space before the text,
    and a piece model of sentencepiece, which adds one itself. Special strings in a text are ordinary text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.tokenizer_a = Encoder(a_path, REMEMBERED)
        self.tokenizer_b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {chr(letter): code for code, letter in ({b: b for b in range(256)} | _byte_letters()).items()}
        vocabulary = self.tokenizer_a.vocabulary()
        of_ids = [b""] * (max(vocabulary.values()) + 1)
        for text, number in vocabulary.items():
            known = all(c in byte for c in text)
            of_ids[number] = bytes(byte[c] for c in text) if known else text.encode()
        self.a = _Vocabulary(of_ids)
        numbers = range(self.tokenizer_b.get_piece_size())
        pieces = [(self.tokenizer_b.id_to_piece(k), self.tokenizer_b.is_byte(k)) for k in numbers]
        self.b = _Vocabulary([bytes([int(p[3:5], 16)]) if single else p.replace("▁", " ").encode() for p, single in pieces])
        # Words can stand alone only where no piece goes on beyond a space.
        self.by_words = not any("▁" in p.lstrip("▁") for p, single in pieces if not single)
        #: Word, with the space before it, to the second kind's ids as 16-bit numbers. The first kind remembers its own.
        self.words: dict[str, bytes] = {}
        #: Each id as text with each of ``_MARKS`` behind it, see ``group_texts``.
        size = max(len(self.a.lengths), len(self.b.lengths))
        self.marked = [f"{number}{mark}" for number in range(size) for mark in _MARKS]

    def pieces(self, texts: list[str]) -> list[bytes]:
        return [array("H", ids).tobytes() for ids in self.tokenizer_b.encode(texts, num_threads=1)]

    def tokens(self, texts: list[str | None]) -> Tokens:
        """None where a text is NULL or empty, or where its ids of either kind don't spell a space and the text."""
        texts = [t or "" for t in texts]
        # Mostly single spaces alone; the pattern is for the others.
        plain = [bool(t) and self.by_words and (" ".join(t.split()) == t or not _ODD.search(t)) for t in texts]
        words = [t.split(" ") if p else () for t, p in zip(texts, plain, strict=True)]
        known = self.words
        new = list(set().union(*words).difference(known))
        for at in range(0, len(new), _FEW):
            known.update(zip(new[at : at + _FEW], self.pieces(new[at : at + _FEW]), strict=True))
        of_a, of_b = self.tokenizer_a.words.__getitem__, known.__getitem__
        a = [b"".join(map(of_a, some)) for some in words]
        b = [b"".join(map(of_b, some)) for some in words]
        for k, (t, p) in enumerate(zip(texts, plain, strict=True)):
            if t and not p:
                a[k], b[k] = self.tokenizer_a.ids(" " + t).tobytes(), self.pieces([t])[0]
        if len(known) > REMEMBERED:
            known.clear()
        n_a, n_b = np.array([len(x) // 2 for x in a]), np.array([len(x) // 2 for x in b])
        tokens = Tokens(_ids(a), n_a, _ids(b), n_b)
        return self._spelled(texts, tokens)

    def _spelled(self, texts: list[str], tokens: Tokens) -> Tokens:
        """Without the tokens of texts that they don't spell."""
        wanted = [(" " + t).encode() if t else b"" for t in texts]
        size = np.array([len(w) for w in wanted])
        right = np.ones(len(texts), bool)
        for ids, n, vocabulary in ((tokens.a, tokens.n_a, self.a), (tokens.b, tokens.n_b, self.b)):
            right &= _sums(vocabulary.lengths.take(ids), n) == size
        same = np.frombuffer(b"".join([w for w, r in zip(wanted, right, strict=True) if r]), np.uint8)
        keep_a, keep_b = np.repeat(right, tokens.n_a), np.repeat(right, tokens.n_b)
        differ = (self.a.spell(tokens.a[keep_a]) != same) | (self.b.spell(tokens.b[keep_b]) != same)
        if differ.any():
            right[np.flatnonzero(right)[_sums(differ, size[right]) > 0]] = False
            keep_a, keep_b = np.repeat(right, tokens.n_a), np.repeat(right, tokens.n_b)
        return Tokens(tokens.a[keep_a], tokens.n_a * right, tokens.b[keep_b], tokens.n_b * right)

    def links(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """End links of all texts, in one block-diagonal product."""
        return end_links(self.a.lengths.take(tokens.a), self.b.lengths.take(tokens.b))

    def group_texts(self, tokens: Tokens, i: np.ndarray, j: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text: ids of both kinds by group."""
        ga, gb = group_of(len(tokens.a), i), group_of(len(tokens.b), j)
        before_b = np.append(0, j + 1)  # tokens of b up to each group
        mark_a, mark_b = np.zeros(len(ga), np.int64), np.zeros(len(gb), np.int64)
        mark_a[i], mark_b[j] = 1, 2
        ends = np.cumsum(tokens.n_b)
        mark_b[ends[tokens.n_b > 0] - 1] = 3
        out = np.empty(len(ga) + len(gb), np.int64)
        out[np.arange(len(ga)) + before_b.take(ga)] = tokens.a * 4 + mark_a
        out[np.arange(len(gb)) + (i + 1).take(gb)] = tokens.b * 4 + mark_b
        parts = list(map(self.marked.__getitem__, out.tolist()))
        cuts = np.append(0, np.cumsum(tokens.n_a + tokens.n_b)).tolist()
        return ["".join(parts[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _ids(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "=u2").astype(np.int64)


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums over stretches of these lengths."""
    ends = np.cumsum(n)
    sums = np.append(0, np.cumsum(values))
    return sums[ends] - sums[ends - n]


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """The tokenizers of this Python worker, with the words remembered from earlier tasks."""
    return Pair(a_path, b_path)


def _slices(batch: pa.RecordBatch, texts: int, most: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        total = np.cumsum(lengths[at : at + texts])
        n = max(1, int(np.searchsorted(total, most, side="right")))
        yield batch.slice(at, n)
        at += n


def _places(pairs: int) -> str:
    """Type of the places in a list of so many pairs."""
    return "<u2" if pairs <= 1 << 16 else "<u4"


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _encode(a_path: str, b_path: str, id_type: pa.DataType):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizers, number = pair(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in _slices(batch, TEXTS, BYTES):
                found = [of(tokenizers, few.column(1).to_pylist()) for few in _slices(part, TEXTS, MATRIX)]
                counts, texts, links = zip(*found, strict=True)
                lists = [pa.array([x], pa.list_(pa.int64())) for x in np.concatenate(counts, axis=1)]
                columns = [
                    pa.array([number], pa.int64()),
                    pa.array([part.column(0).to_pylist()], pa.list_(id_type)),
                    *lists,
                    pa.array([[t for some in texts for t in some]], pa.list_(pa.string())),
                ]
                pairs, at, times = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
                columns += [pa.array([x], pa.list_(pa.int64())) for x in (pairs.astype(np.int64), times)]
                columns.append(pa.array([at.astype(_places(len(pairs))).tobytes()], pa.binary()))
                names = ["slice", "ids", *_COUNTS, "groups_sha256", "pairs", "times", "links"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                number += 1
        pa.default_memory_pool().release_unused()

    def of(tokenizers: Pair, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        tokens = tokenizers.tokens(texts)
        i, j = tokenizers.links(tokens)
        # A group has one link: where its last tokens end.
        n_links = np.diff(np.append(0, np.searchsorted(i, np.cumsum(tokens.n_a))))
        n_groups = np.bincount(np.repeat(np.arange(len(texts)), tokens.n_a)[i], minlength=len(texts))
        digests = [sha256(t.encode()).hexdigest() if t else "" for t in tokenizers.group_texts(tokens, i, j)]
        links = (tokens.a[i] << 16 | tokens.b[j]).astype("<u4")
        return np.array([tokens.n_a, tokens.n_b, n_groups, n_links]), digests, links

    return encoded


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a slice, from its links and the corpus-wide counts of its pairs."""
    for batch in batches:
        for row in range(batch.num_rows):
            columns = {name: batch.column(name).slice(row, 1) for name in batch.schema.names}
            out = {name: columns[name].flatten() for name in ("ids", *_COUNTS, "groups_sha256")}
            counts = columns["counts"].flatten()
            pairs = len(counts)
            links = np.frombuffer(columns["links"][0].as_buffer(), _places(pairs))
            ends = np.cumsum(out["n_links"].to_numpy())
            # The places of links are those of their pairs in ascending order.
            order = np.argsort(counts.field(0).to_numpy()) if pairs else np.empty(0, np.int64)
            for name, field in (("n_best", 2), ("count_sum", 1)):
                value = counts.field(field).to_numpy().astype(np.int64)[order] if pairs else order
                sums = np.append(0, np.cumsum(value.take(links)))
                out[name] = pa.array(np.diff(np.append(0, sums[ends])))
            yield pa.RecordBatch.from_pydict({"doc_id": out.pop("ids"), **out})


def aligned(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A text's tokens are those of a space and the text. One that is NULL or empty, or whose tokens of either kind don't give these
    bytes, has none: counts are 0 and the digest is empty. Links are the pairs of tokens that end together. ``count_sum`` adds up
    over a text's links how many links of all texts have the same two ids; ``n_best`` counts the links whose pair is the most
    frequent of all with its second id, ties included. Ids may repeat or be NULL; other columns are ignored. An empty
    table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType
    lists = ", ".join(f"{n} array<bigint>" for n in _COUNTS)
    schema = f"slice bigint, ids array<{kind.simpleString()}>, {lists}, groups_sha256 array<string>, pairs array<bigint>, times array<bigint>, links binary"
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    slices = kept(source.mapInArrow(_encode(a_path, b_path, to_arrow_type(kind)), schema), "align-slices")
    zipped = F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n")))
    pairs = slices.select("slice", zipped)
    # At most as many rows for a second id as the first vocabulary has ids.
    best = F.max("count").over(W.partitionBy(F.col("pair").bitwiseAND((1 << 16) - 1)))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = kept(counts.withColumn("best", (F.col("count") == best).cast("int")), "align-counts")
    of_slices = pairs.select("slice", "pair").join(counts, "pair").groupBy("slice")
    of_slices = kept(of_slices.agg(F.collect_list(F.struct("pair", "count", "best")).alias("counts")), "align-found")
    longs = ", ".join(f"{n} bigint" for n in _COUNTS)
    out = f"doc_id {kind.simpleString()}, {longs}, groups_sha256 string, n_best bigint, count_sum bigint"
    found = slices.drop("pairs", "times").join(of_slices, "slice", "left").mapInArrow(_digest, out)
    return found.select("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")


def token_links(
    docs: DataFrame, a_path: str, b_path: str, kind: str = "overlap", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ids ``a`` and ``b`` of the tokens of each text, and its links as places ``i`` in ``a`` and ``j`` in ``b``.

    ``kind``: ``overlap`` (tokens share bytes; ``weight`` says how many), ``group`` (same group) or ``end`` (they end together),
    with a ``weight`` of 1. Texts without tokens as in ``aligned`` have empty lists.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}, not {kind!r}")
    id_type = docs.schema[doc_id].dataType
    make = {"overlap": overlap_links, "group": group_links, "end": end_links}[kind]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = pair(a_path, b_path)
        for batch in batches:
            for part in _slices(batch, TEXTS, MATRIX):
                tokens = tokenizers.tokens(part.column(1).to_pylist())
                of_a = np.split(tokens.a, np.cumsum(tokens.n_a)[:-1])
                of_b = np.split(tokens.b, np.cumsum(tokens.n_b)[:-1])
                rows = []
                for a, b in zip(of_a, of_b, strict=True):
                    links = make(tokenizers.a.lengths.take(a), tokenizers.b.lengths.take(b))
                    weight = links[2] if len(links) == 3 else np.ones(len(links[0]), np.int64)
                    rows.append((a, b, links[0], links[1], weight))
                lists = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in range(5)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["doc_id", "a", "b", "i", "j", "weight"])

    lists = ", ".join(f"{n} array<bigint>" for n in ("a", "b", "i", "j", "weight"))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(linked, f"doc_id {id_type.simpleString()}, {lists}")
