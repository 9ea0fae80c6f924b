"""Vectorised hashes over UTF-8 bytes: rolling windows, whitespace words, word shingles.

All polynomial hashes are taken modulo 2**64 over per-byte random values; a sum of prefixes gives any
window in a few operations, so a text is hashed without a Python loop over its bytes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
STEP = 0x9E3779B97F4A7C15
BASE = 0xD1342543DE82EF95
_inverse = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(seed * 7919)) * U(STEP))


_bytes = seeds(256, 1)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for the worker's life up to the longest text seen."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, b in enumerate((BASE, _inverse)):
            p = np.full(size, b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefixes(raw: np.ndarray) -> np.ndarray:
    """Prefix sums s with s[0] = 0; the hash of raw[i:j] is (s[j] - s[i]) * BASE**-i."""
    out = np.zeros(len(raw) + 1, U)
    np.cumsum(_bytes[raw] * _grown(len(raw) + 1)[0][:-1], out=out[1:])
    return out


def spans(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte spans [start, end)."""
    return mix((s[end] - s[start]) * _grown(len(s))[1][start])


def windows(s: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all windows of k bytes; empty if the text is shorter."""
    n = len(s) - 1 - k + 1
    if n <= 0:
        return np.zeros(0, U)
    return mix((s[k:] - s[:n]) * _grown(len(s))[1][:n])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and n + 1 word offsets.

    A word is a run of bytes other than space and 0x09 to 0x0D; texts are cut at their offsets.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    solid = ~_blank[raw]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    head[first] = solid[first]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:]
    last = first = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    tail[last] = solid[last]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    s = prefixes(_lower[raw])
    return spans(s, start, end) ^ mix((end - start).astype(U)), np.searchsorted(start, offsets)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text, and n + 1 offsets.

    A text of one to k - 1 words has one shingle, all its words; a text without words has none.
    """
    count = np.diff(at)
    full = np.maximum(count - k + 1, 0)
    runs = np.where(full > 0, full, (count > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(int(offs[-1]), U)
    if not len(out):
        return out, offs
    where = np.repeat(at[:-1] - offs[:-1], runs) + np.arange(len(out))
    size = np.repeat(np.minimum(count, k), runs)
    weight = seeds(k, 3) | U(1)
    for j in range(k):
        on = j < size
        out[on] += h[where[on] + j] * weight[j]
    return mix(out ^ mix(size.astype(U))), offs
