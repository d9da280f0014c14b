"""Minimal perfect hash over 64-bit keys, as cascaded bit arrays with rank (the construction published as BBHash).

Each level hashes the keys left into `gamma` bits a key; keys alone on their bit stay there, the others go to the next
level. A key's slot is the rank of its bit over all levels. Some 4 bits a key; slots of non-members are arbitrary, so
callers compare what the slot holds.
"""

from __future__ import annotations

import struct

import numpy as np

from .common import mix64

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct uint64 keys; empty key sets are allowed."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]], n: int):
        self.levels, self.n = levels, n
        self.ranks = []
        base = 0
        for _, _, bits in levels:
            words = bits.reshape(-1, 8)
            counts = _POP[words].sum(axis=1, dtype=np.int64)
            before = np.concatenate([[0], np.cumsum(counts)[:-1]]) + base
            self.ranks.append(before)
            base += int(counts.sum())

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
        return (mix64(keys ^ seed) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> MinimalPerfectHash:
        keys = np.asarray(keys, np.uint64)
        n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("keys of a minimal perfect hash must be distinct")
        levels, left = [], keys
        while len(left):
            size = max(64, (int(len(left) * gamma) + 63) // 64 * 64)
            at = cls._places(left, len(levels), size)
            hits = np.bincount(at, minlength=size)
            alone = hits == 1
            levels.append((len(levels), size, np.packbits(alone, bitorder="little")))
            left = left[~alone[at]]
        return cls(levels, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level holds the key's bit, which proves a non-member."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for (level, size, bits), before in zip(self.levels, self.ranks, strict=True):
            if not len(rest):
                break
            at = self._places(keys[rest], level, size)
            here = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            at, who = at[here], rest[here]
            word = at >> 6
            full = bits.reshape(-1, 8)[word]
            byte = (at >> 3) & 7
            rank = before[word] + (_POP[full] * (np.arange(8)[None, :] < byte[:, None])).sum(axis=1)
            part = bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)
            out[who] = rank + _POP[part]
            rest = rest[~here]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<QI", self.n, len(self.levels))
        return head + b"".join(struct.pack("<IQ", k, size) + bits.tobytes() for k, size, bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        n, count = struct.unpack_from("<QI", data, 0)
        at, levels = 12, []
        for _ in range(count):
            k, size = struct.unpack_from("<IQ", data, at)
            at += 12
            levels.append((k, size, np.frombuffer(data, np.uint8, size // 8, at)))
            at += size // 8
        return cls(levels, n)
