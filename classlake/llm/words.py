"""Words of whole text columns as numpy arrays, one Arrow batch at a time.

A text is taken as its UTF-8 bytes; a null text is empty.  A word's identity is
a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK = 1 << 20  # bytes hashed at once

#: Lower-cased A-Z, then anything but the ASCII characters that are neither digit nor letter.
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
#: Anything but blank, tab, line feed, vertical tab, form feed and carriage return.
VISIBLE = np.array([c not in b" \t\n\v\f\r" for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

_VALUE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base, and their inverses."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        steps = np.full((2, size), U(1))
        steps[0, 1:], steps[1, 1:] = U(_BASE), U(pow(_BASE, -1, 2**64))
        _powers = tuple(np.cumprod(steps, axis=1, dtype=U))
    return _powers


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def runs(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes, one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, off: np.ndarray, kind: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, first word of each document and the total).

    Bytes are read in blocks that end where no word does go on, so memory beside
    the words themselves does not grow with a document's length.
    """
    found, starts, at, n = [], [], 0, len(raw)
    bounds = off[1:-1]
    while at < n:
        end = min(n, at + BLOCK)
        while end < n and kind[raw[end]] and kind[raw[end - 1]]:
            step = raw[end:end + 4096]
            stop = np.flatnonzero(~kind[step])
            end += int(stop[0]) if len(stop) else len(step)
        part = LOWER[raw[at:end]]
        inside = kind[part]
        edge = np.empty(len(part) + 1, bool)
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        lo, hi = np.searchsorted(bounds, (at, end))
        cuts = np.unique(bounds[lo:hi]) - at
        cuts = cuts[(cuts > 0) & (cuts < len(part))]
        cuts = cuts[inside[cuts] & inside[cuts - 1]]  # two documents meet inside a run
        marks = np.flatnonzero(edge)
        if len(cuts):
            marks = np.sort(np.concatenate([marks, cuts, cuts]))
        s, e = marks[::2], marks[1::2]
        power, inverse = powers(len(part))
        total = np.zeros(len(part) + 1, U)
        np.cumsum(_VALUE[part] * power[:len(part)], out=total[1:])
        found.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U)))
        starts.append(s + at)
        at = end
    if not found:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(starts), off)


_SPREAD = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | U(1)


def grams(hashes: np.ndarray, first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams in order, first of each document and the total).

    With ``short``, a document of fewer words, but not none, has one gram of all its words.
    """
    count = np.diff(first)
    size = np.maximum(count - n + 1, 0)
    if short:
        size = np.where((count > 0) & (size == 0), 1, size)
    start = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(start[-1]) - np.repeat(start[:-1] - first[:-1], size)
    if short and len(hashes):
        last = np.repeat(first[1:], size)
        value = np.zeros(len(at), U)
        for k in range(n):
            here = at + k
            value += np.where(here < last, hashes[np.minimum(here, len(hashes) - 1)], U(0)) * _SPREAD[k]
    else:
        value = np.zeros(len(at), U)
        for k in range(n):
            value += hashes[at + k] * _SPREAD[k] if len(at) else U(0)
    return mix(value), start
