"""Vectorised words and hashes over the UTF-8 bytes of many texts at once.

Texts come as Arrow string arrays; all work is on NumPy arrays over slices of at most ``SLICE`` bytes (a longer text is
a slice of its own), so memory follows the longest single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U = np.uint64
_MULT = int(U(0x9E3779B97F4A7C15))  # odd, so that it has an inverse modulo 2**64
_INV = pow(_MULT, -1, 1 << 64)

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: True for bytes of words: not ASCII white space / letters, digits and all that is not ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_table = np.random.Generator(np.random.PCG64(20260101)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        up, down = np.full(n, U(_MULT)), np.full(n, U(_INV))
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes of the slice, offsets of its texts and the end). Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if texts.null_count:  # what a null slot spans is not defined
        lengths = np.where(np.asarray(texts.is_valid()), np.diff(offsets), 0)
        parts = [data[o : o + k] for o, k in zip(offsets[:-1], lengths, strict=True)]
        data, offsets = np.concatenate(parts) if parts else data, np.concatenate([[0], np.cumsum(lengths)])
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def bounded(batch: pa.RecordBatch, *columns: str, limit: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts in ``columns`` have about ``limit`` bytes at most, or one row: what is made of a part
    is handed on before the next one is looked at."""
    if not batch.num_rows:
        return
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), dtype=np.int64) for c in columns)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def spans(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of ``inside`` that cross no text's border, and each run's text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = inside[data]
    first = on.copy()
    first[1:] &= ~on[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = on[cuts]
    last = on.copy()
    last[:-1] &= ~on[1:]
    ends = cuts[cuts > 0] - 1
    last[ends] = on[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_table[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes in any text and slice."""
    _, down = powers(len(sums))
    return mixed((sums[stops] - sums[starts]) * down[starts])


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words, from the words' hashes; n - 1 fewer than words."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(k, U(n))
    for i in range(n):
        h = mixed(h * U(0x9E3779B97F4A7C15) + words[i : i + k])
    return h


def word_hashes(texts: pa.Array, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice: index of its first text, number of its texts, the hashes of its words (ASCII lower case), and
    where each text's words begin (and the end)."""
    for first, data, offsets in slices(texts):
        data = LOWERED[data]
        starts, stops, owner = spans(data, inside, offsets)
        n = len(offsets) - 1
        yield first, n, span_hash(prefix_hash(data), starts, stops), np.searchsorted(owner, np.arange(n + 1))
