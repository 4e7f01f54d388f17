"""Text in Arrow batches as flat numpy arrays: words, word hashes, shingles.

A block is a slice of a batch with about ``BLOCK`` bytes of text (or one longer document), so memory follows the
block and not the batch. Nulls are empty texts. White space is ``[\\x20\\x09-\\x0D]``, everything else is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: spreads every input bit over all output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _draw(n: int, salt: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U(salt)) * U(0x9E3779B97F4A7C15))


LETTER = _draw(256, 0)
LOWERED = LETTER.copy()
LOWERED[65:91] = LETTER[97:123]
STEP = _draw(64, 1000) | U(1)
_BASE = 0x9E3779B97F4A7C55 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept by the worker."""
    if len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for i, base in enumerate((_BASE, inverse)):
            with np.errstate(over="ignore"):
                out = np.full(n, base, np.uint64)
                out[0] = 1
                _POWERS[i] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the offsets of each text in them."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the place of its first word (one entry more at the end)."""
    solid = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``lower`` folds A-Z."""
    table, out, i = LOWERED if lower else LETTER, np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(max(b - a, BLOCK) + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * power[:b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each place on (places too near the end of the array are left out)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += hashes[i:i + n] * STEP[i]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text its distinct ``k``-word shingles as sorted hashes; fewer words make one shingle, none an empty set."""
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends, lower)
    grams = windows(hashes, k)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        elif b > a:
            yield mix((hashes[a:b] * STEP[:b - a]).sum(keepdims=True) + U(b - a))
        else:
            yield np.empty(0, np.uint64)
