"""Sets of word shingles as 64-bit hashes, for many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts, and about as many bytes, that are worked on at a time.
TEXTS, BYTES = 256, 1 << 21

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spread(x: np.ndarray) -> np.ndarray:
    """A mixing one-to-one map of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``TEXTS`` rows and, but for longer single texts, ``BYTES`` bytes of text."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        total = np.cumsum(lengths[at : at + TEXTS])
        n = max(1, int(np.searchsorted(total, BYTES, side="right")))
        yield batch.slice(at, n)
        at += n


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text, in order, and the index of its text. NULL counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = len(raw)
    word = ~_SPACE[raw]
    fresh = np.zeros(size + 1, bool)  # a text begins here
    fresh[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | fresh[1:size]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | fresh[1:size]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    room = 1 << max(21, int(size - 1).bit_length())
    powers, inverse = _powers(room)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers[:size], out=sums[1:])
    hashes = spread((sums[ends + 1] - sums[starts]) * inverse[starts])
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and where each text's begin (one more entry than texts).

    A text of fewer words than ``width`` has one shingle of all its words; one without words has none.
    """
    words, text_of = word_hashes(texts)
    n = len(texts)
    counts = np.bincount(text_of, minlength=n)
    first = np.cumsum(counts) - counts
    ends = np.append(words, np.zeros(width, np.uint64))
    has = np.append(text_of, np.full(width, -1))
    keys = spread(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(len(words), np.uint64)
    length = np.zeros(len(words), np.uint64)
    for k in range(width):
        inside = has[k : k + len(words)] == text_of
        total += np.where(inside, ends[k : k + len(words)] * keys[k], np.uint64(0))
        length += inside
    whole = length == width
    short = counts[text_of] < width
    whole |= short & (np.arange(len(words)) == first[text_of])
    hashes, owner = spread(total[whole] + length[whole]), text_of[whole]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n + 1))
