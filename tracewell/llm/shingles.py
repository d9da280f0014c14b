"""Word shingles and MinHash signatures of whole texts, by numpy passes over the bytes of an Arrow column.

Words are what ASCII white space separates. A word's hash is a polynomial over its bytes, modulo 2**64 and mixed; a
shingle's hash combines those of its words. Texts of fewer words than a shingle have one shingle, all their words.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


_held: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; one pair of arrays is kept, as long as most texts need."""
    if len(_held[0]) >= n:
        return _held[0], _held[1]
    out = []
    with np.errstate(over="ignore"):
        for b in (_BASE, _INVERSE):
            p = np.full(n, np.uint64(b), np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
    if n <= 1 << 20:
        _held[:] = out
    return out[0], out[1]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes of several texts, and the first word of each text (and the end)."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    ends = ~space
    ends[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] |= ~space[inner]
    ends[inner - 1] |= ~space[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words."""
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(1 << max(12, int(len(raw)).bit_length()))
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
        return mix64((total[end] - total[start]) * down[start])


def _factors(size: int) -> np.ndarray:
    return mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of several texts, in order, and the first of each text (and the end)."""
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        factors = _factors(size)
        padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
        every = np.zeros(len(hashes), np.uint64)
        for k in range(size):
            every += padded[k : k + len(hashes)] * factors[k]
        for t in np.flatnonzero((n > 0) & (n < size)):
            every[first[t]] = (hashes[first[t] : first[t + 1]] * factors[: n[t]]).sum(dtype=np.uint64)
    at = np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    return mix64(every[at]), bounds


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted different shingles of each text."""
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def signatures(hashes: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """(texts, count) MinHash values of 32 bits; all ones for texts without shingles."""
    out = np.full((len(bounds) - 1, count), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out
    starts = bounds[:-1][full]
    seeds = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        for k in range(count):
            v = hashes * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1]
            out[full, k] = (np.minimum.reduceat(v, starts) >> np.uint64(32)).astype(np.uint32)
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) bucket numbers as int64."""
    x = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (x * _factors(rows)[None, None, :]).sum(axis=2, dtype=np.uint64)
        return mix64(h + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F)).view(np.int64)
