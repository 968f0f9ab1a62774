"""Vectorised text primitives shared by the corpus operators.

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``; ASCII A-Z
are lower-cased.  A word is known by a 64-bit hash: a polynomial over a random
byte table, taken from prefix sums so that one NumPy pass serves a whole Arrow
batch, then mixed.  Memory is bounded by ``BLOCK`` bytes of text at a time (or
the longest single word, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, BLOCK + 1), _powers(_BASE_INV, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def fold(x: np.ndarray) -> int:
    """One signed 64-bit hash of a sequence of distinct hashes in any order."""
    if not len(x):
        return 0
    both = np.array([np.bitwise_xor.reduce(mix(x + U64(7))), np.add.reduce(mix(x))], dtype=U64)
    return int(mix(mix(both[:1]) + both[1:] + U64(len(x)))[0].view(np.int64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return offsets, raw


def _bounds(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of raw; breaks: positions where a word must end."""
    n = len(raw)
    solid = ~_SPACE[raw]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[breaks[breaks < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    inner = breaks[(breaks > 0) & (breaks <= n)] - 1
    after[inner] = False
    return starts, np.flatnonzero(solid & ~after) + 1


def _hash_span(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    global _POW, _INV
    if len(raw) >= len(_POW):
        _POW, _INV = _powers(_BASE, len(raw) + 1), _powers(_BASE_INV, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(_TABLE[_LOWER[raw]] * _POW[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _INV[starts] + (ends - starts).astype(U64))


def _cuts(offsets: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about BLOCK bytes that cut no word; documents may be cut at white space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(end, at + BLOCK)
        if to < end:
            k = int(np.searchsorted(offsets, to, side="right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:  # inside one document
                space = np.flatnonzero(_SPACE[raw[at:to]])
                if len(space):
                    to = at + int(space[-1]) + 1
                else:
                    stop = int(offsets[k + 1])
                    while to < stop and not _SPACE[raw[to]]:
                        to += 1
        yield at, to
        at = to


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): document i has the words hashes[first[i]:first[i + 1]]."""
    offsets, raw = utf8(column)
    n = len(offsets) - 1
    counts, parts = np.zeros(n, dtype=np.int64), []
    for a, b in _cuts(offsets, raw):
        span = raw[a:b]
        lo, hi = np.searchsorted(offsets, a, side="left"), np.searchsorted(offsets, b, side="left")
        starts, ends = _bounds(span, offsets[lo:hi] - a)
        if len(starts):
            parts.append(_hash_span(span, starts, ends))
            owner = np.searchsorted(offsets, starts + a, side="right") - 1
            counts += np.bincount(owner, minlength=n)[:n]
    first = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(counts, out=first[1:])
    return first, np.concatenate(parts) if parts else np.zeros(0, dtype=U64)


def shingles(first: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes) of every n-word shingle in order; with fewer words, the whole sequence is one."""
    counts = np.diff(first)
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_first = np.zeros(len(first), dtype=np.int64)
    np.cumsum(size, out=out_first[1:])
    total = int(out_first[-1])
    if not total:
        return out_first, np.zeros(0, dtype=U64)
    owner = np.repeat(np.arange(len(counts)), size)
    at = np.arange(total, dtype=np.int64) - out_first[owner] + first[owner]
    out = np.zeros(total, dtype=U64)
    for k in range(n):
        inside = at + k < first[owner + 1]
        term = mix(hashes[np.minimum(at + k, len(hashes) - 1)] + U64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
        out = np.where(inside, mix(out ^ term), out)
    return out_first, out


def distinct(first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, ascending."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[keep], o[keep]
    out = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(o, minlength=n), out=out[1:])
    return out, h


def list_array(first: np.ndarray, values: np.ndarray) -> pa.Array:
    """An Arrow list<int64> column over flat values."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
