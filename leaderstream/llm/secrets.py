"""Secrets in texts: three patterns, and strings that look drawn at random.

Two character Markov models, of random strings and of ordinary identifiers, are trained from all documents, which label themselves: what the patterns
find is random, words of letters are ordinary. A run of key characters that no pattern found is a secret where the
log likelihood ratio of the models says so, by character and in all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns, and the lengths below which a match is dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")
# A run of hexadecimal digits is matched whole or not at all, so its length can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Runs of key characters that the models judge, from the shortest length of a pattern's match on, and words that they learn as ordinary.
LEAST = min(ASSIGN_LEAST, ACCESS_LEAST)
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
ORDINARY = re.compile(r"[A-Za-z][A-Za-z_-]{4,}")
#: Least log likelihood ratio (natural logarithm) of a character, and of a run.
A_CHARACTER, A_RUN = 0.5, 14.0

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
_SIZE = len(_ALPHABET) + 1
_CODE = np.full(256, _SIZE - 1, np.int64)
_CODE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(_SIZE - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what the patterns find, in code points, ascending."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a character follows another, in random (1) and ordinary (0) samples of the documents of a task."""
    counts = np.zeros((2, _SIZE * _SIZE), np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            text = text or ""
            random = [text[a:b] for a, kind, b in base_spans(text) if kind]
            random += [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
            for label, samples in ((1, random), (0, ORDINARY.findall(text))):
                if samples:
                    codes = _codes(" ".join(samples))
                    counts[label] += np.bincount(codes[:-1] * _SIZE + codes[1:], minlength=_SIZE * _SIZE)
    label, pair = np.nonzero(counts)
    columns = [pa.array(label), pa.array(pair), pa.array(counts[label, pair])]
    yield pa.RecordBatch.from_arrays(columns, names=["label", "pair", "n"])


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log likelihood ratio of each character after each other, random against ordinary.

    Counted over every document; a task hands on its sums only. Without samples of a kind its model is even, so an
    empty corpus makes all ratios 0.
    """
    counted = docs.select(text).mapInArrow(_count, "label bigint, pair bigint, n bigint").groupBy("label", "pair").agg(F.sum("n"))
    counts = np.zeros((2, _SIZE, _SIZE))
    for label, pair, n in counted.collect():  # at most twice the square of the alphabet
        counts[label, pair // _SIZE, pair % _SIZE] = n
    # Characters that none follows yet are as even as the whole kind lets them be.
    whole = counts.sum(axis=1, keepdims=True) + 1.0
    chance = (counts + 8 * whole / whole.sum(axis=2, keepdims=True)) / (counts.sum(axis=2, keepdims=True) + 8)
    return np.log(chance[1] / chance[0])


def random_spans(text: str, ratio: np.ndarray, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs that the models call random, or the parts of a run outside what is ``known``, ascending."""
    spans, passed = [], 0
    for m in RUN.finditer(text):
        while passed < len(known) and known[passed][2] <= m.start():
            passed += 1
        for a, b in _outside(*m.span(), islice(known, passed, None)):
            codes = _codes(text[a:b])
            score = float(ratio[codes[:-1], codes[1:]].sum())
            if score >= A_RUN and score >= A_CHARACTER * (b - a - 1):
                spans.append((a, KINDS.index("random"), b))
    return spans


def _outside(a: int, b: int, known: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of ``a`` to ``b`` of at least ``LEAST`` characters that no span of ``known``, ascending, covers."""
    for start, _, end in known:
        if start >= b:
            break
        if start - a >= LEAST:
            yield a, start
        a = max(a, end)
    if b - a >= LEAST:
        yield a, b


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def found(docs: DataFrame, ratio: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_sha256`` and ``spans``, a row for each of ``docs``.

    Whole texts; NULL counts as empty, and both have no spans. Other columns are ignored. An empty table gives an empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, shas, lists = [], [], []
            for value in batch.column(1):
                whole = value.as_py() or ""
                base = base_spans(whole)
                spans = sorted([*base, *random_spans(whole, ratio, base)])
                numbers.append([sum(kind == k for _, kind, _ in spans) for k in range(len(KINDS))])
                shas.append(hashlib.sha256(written(base).encode()).hexdigest())
                lists.append(written(spans))
            counts = np.array(numbers, np.int64).reshape(len(numbers), len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(shas, pa.string()), pa.array(lists, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, schema)
