"""Operator 4, byte-level BPE encoding and decoding with the ranks of a vocabulary file.

A pre-token (a match of the splitting pattern) is resolved in two tiers. A minimal perfect hash over the vocabulary gives
the slot of the whole pre-token; if the slot's bytes are the pre-token's, its rank is the only id. Otherwise its bytes
become a linked list, a heap holds the ranks of adjacent pairs, and the lowest rank (then the leftmost pair) merges first
until no pair is in the vocabulary. Workers keep a bounded memo of what they have resolved.

Defined cases: null text is empty and has no ids (the digest of the empty string); every byte sequence decodes to itself;
texts of any length are encoded whole; extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import lean, quiet_threads
from .mphf import MinimalPerfectHash
from .pretokens import Splitter

#: Pre-tokens that a worker remembers; beyond that it starts anew.
MEMO_WORDS = 300_000


class BytePairCodec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, Splitter(pattern)
        self.tokens = {i: b for b, i in ranks.items()}
        words = list(ranks)
        keys = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        self.mph = MinimalPerfectHash.build(keys)
        self.slot_words: list[bytes] = [b""] * len(words)
        self.slot_ids = np.zeros(len(words), np.int64)
        for w, at in zip(words, self.mph.slots(keys), strict=True):
            self.slot_words[at], self.slot_ids[at] = w, ranks[w]
        self.memo: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairCodec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that isn't in the vocabulary."""
        n, ranks = len(word), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each byte
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != stop:
                continue  # one of the two parts has changed since
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def resolve(self, words: list[str]) -> None:
        """Put the ids of new pre-tokens into the memo."""
        raw = [w.encode() for w in words]
        at = self.mph.slots(np.array([xxhash.xxh3_64_intdigest(b) for b in raw], np.uint64))
        for w, b, s in zip(words, raw, at.tolist(), strict=True):
            self.memo[w] = (int(self.slot_ids[s]),) if s >= 0 and self.slot_words[s] == b else tuple(self.merge(b))

    def encode_batch(self, texts: Iterable[str]) -> list[list[int]]:
        parts = [self.split(t) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        if new := {w for p in parts for w in p if w not in memo}:
            self.resolve(list(new))
        return [[i for w in p for i in memo[w]] for p in parts]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    quiet_threads()
    return BytePairCodec.from_file(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            ids = own.encode_batch(t or "" for t in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return lean(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of rows of (doc_id, ids); null ids decode to no bytes."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            out = [own.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return lean(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode, and return the digests of both; a task holds the ids of a few rows only."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            texts = batch.column(1).to_pylist()
            for first in range(0, len(texts), 64):
                for ids in own.encode_batch(t or "" for t in texts[first : first + 64]):
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return lean(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
