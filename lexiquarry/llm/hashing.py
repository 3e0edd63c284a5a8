"""Vectorised hashing of byte strings and word sequences, and content-defined anchors (numpy)."""

from __future__ import annotations

import functools

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = np.uint64(pow(int(_B), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, _B))))
        down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, inv))))
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n, kept for the worker's life in steps of two."""
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of values[i:j] * B**position, modulo 2**64."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end), independent of the position."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive values."""
    m = len(values) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values)
    _, down = powers(m)
    return mix((sums[k:] - sums[:m]) * down)


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no ASCII white space."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~WHITE[buf]
    d = np.diff(inside)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(buf.astype(np.uint64) + np.uint64(1)), starts, ends)


def sliding_argmin(g: np.ndarray, w: int) -> np.ndarray:
    """Position of the least value (leftmost at ties) of each window of w values.

    The upper 40 bits are compared and the position breaks ties, so equal contents choose equal
    offsets wherever they stand.
    """
    m = len(g) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    assert len(g) < 1 << 24
    key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    pad = -len(key) % w
    if pad:
        key = np.concatenate((key, np.full(pad, np.uint64(2**64 - 1))))
    rows = key.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & low).astype(np.int64)


#: Windows that are looked at together; longer inputs go through in overlapping pieces.
PIECE = 1 << 18


def anchors(values: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Assign every window of ``length`` values to one anchor.

    values: of several documents, one after another, which begin at ``offsets`` (and at its last entry the
    values end). A window belongs to the position of its least k-gram. Returns, for runs of
    consecutive windows with one anchor: anchor hash, anchor position, first and last window start.
    A run ends at a document's end and where a piece ends.
    """
    found = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    for base in range(0, max(0, len(values) - length + 1), PIECE):
        part = values[base : base + PIECE + length - 1]
        m = len(part) - length + 1
        g = gram_hash(part, k)
        where = sliding_argmin(g, length - k + 1)
        own = slice(np.searchsorted(offsets, base, "right") - 1, np.searchsorted(offsets, base + m, "left") + 1)
        begin, end = np.clip(offsets[own][:-1] - base, 0, m), offsets[own][1:] - base
        starts = np.flatnonzero(np.arange(length, m + length, dtype=np.int32) <= np.repeat(end, np.diff(np.append(begin, m))))
        if not len(starts):
            continue
        at = where[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        found.append((g[at[first]], at[first] + base, starts[first] + base, starts[last] + base))
    return tuple(np.concatenate(x) for x in zip(*found))
