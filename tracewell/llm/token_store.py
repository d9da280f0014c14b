"""Operator 7, token ids as raw binary shards with keyed access.

A shard is a `.bin` file (eight bytes of head: b"TWID", version, bytes of an id, two of padding; then ids, little endian,
document after document in ascending doc_id order) and a `.idx` file: a minimal perfect hash of the document keys, and for
each slot a 32-bit fingerprint of its key, the first id and the number of rows with that key. One lookup is one slot, one
comparison of fingerprints and one ranged read, whatever the shard holds. Shards follow each other in doc_id order; their
bounds are quantiles of doc_id, each document weighing as much as its characters. Files are written under a name of the attempt and then moved,
so that tasks can be lost or run twice.

Defined cases: null and empty texts are stored as the end id alone; a null doc_id is the key of the smallest long and comes
first; rows that repeat a doc_id lie next to each other under one key and are all returned; an empty table has no shards;
extra columns are ignored. Ids take two bytes where the vocabulary has 65,536 entries at most, else four.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, lean, mix64, scratch
from .mphf import MinimalPerfectHash
from .wordpieces import id_bytes, id_width

#: Characters that a shard is meant to hold, and shards at most: the driver knows a bound and a size of each, larger tables
#: get larger shards, which are written and read as streams.
SHARD_CHARS, MOST_SHARDS = 32_000_000, 65_536
#: Draws of each shard's characters from which the quantiles are estimated.
DRAWS = 64
_NULL = np.iinfo(np.int64).min
_HEAD = struct.Struct("<4sBBxx")


def _keys(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(np.uint64))


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype("<u4")


def shard_bounds(docs: DataFrame) -> list[int]:
    """Largest doc_id of each shard but the last; every shard has some SHARD_CHARS characters, however the doc_ids lie.

    A document of c characters counts c / unit times, rounded up or down by a hash, so that draws follow the characters.
    """
    rows = lean(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), (F.coalesce(F.length("text"), F.lit(0)) + 1).alias("chars"))
    chars = rows.agg(F.sum("chars")).first()[0]
    shards = min(MOST_SHARDS, -(-(chars or 0) // SHARD_CHARS))
    if shards < 2:
        return []
    unit = chars / (shards * DRAWS)
    draws = F.floor(F.col("chars") / F.lit(unit) + F.pmod(F.xxhash64("id", "chars"), F.lit(1 << 20)) / F.lit(1 << 20)).cast("int")
    drawn = rows.filter("id IS NOT NULL").select("id", draws.alias("n")).filter("n > 0").select("id", F.explode(F.sequence(F.lit(1), "n")))
    found = drawn.agg(F.percentile_approx("id", [i / shards for i in range(1, shards)], 20 * shards + 1000).alias("bounds")).first()["bounds"]
    return sorted(set(found or []))


class ShardWriter:
    """One pair of files; documents come in ascending order of their keys."""

    def __init__(self, uri: str, shard: int, id_size: int):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path, recursive=True)
        self.name, self.attempt = f"{self.path}/shard-{shard:08d}", uuid.uuid4().hex
        self.out = self.fs.open_output_stream(f"{self.name}.bin.{self.attempt}")
        self.out.write(_HEAD.pack(b"TWID", 1, id_size))
        self.id_size, self.ids, self.sizes = id_size, [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.out.write(raw)
        self.ids.append(_NULL if doc_id is None else doc_id)
        self.sizes.append(len(raw) // self.id_size)

    def close(self) -> int:
        self.out.close()
        ids, sizes = np.array(self.ids, np.int64), np.array(self.sizes, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        own, first, rows = np.unique(ids, return_index=True, return_counts=True)
        keys = _keys(own)
        mph = MinimalPerfectHash.build(keys)
        at = mph.slots(keys)
        prints, begin, count = np.empty(len(own), "<u4"), np.empty(len(own), "<i8"), np.empty(len(own), "<i8")
        prints[at], begin[at], count[at] = _prints(keys), first, rows
        parts = [mph.to_bytes(), prints.tobytes(), begin.tobytes(), count.tobytes(), starts.astype("<i8").tobytes()]
        with self.fs.open_output_stream(f"{self.name}.idx.{self.attempt}") as f:
            f.write(struct.pack("<5Q", *map(len, parts)) + b"".join(parts))
        for kind in ("bin", "idx"):
            self.fs.move(f"{self.name}.{kind}.{self.attempt}", f"{self.name}.{kind}")
        return int(starts[-1])


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, uri: str, shard: int):
        files, path = filesystem(uri)
        with files.open_input_file(f"{path}/shard-{shard:08d}.idx") as f:
            data = f.read()
        sizes, at, parts = struct.unpack_from("<5Q", data), 40, []
        for n in sizes:
            parts.append(data[at : at + n])
            at += n
        self.mph = MinimalPerfectHash.from_bytes(parts[0])
        self.prints, self.begin, self.count, self.starts = (np.frombuffer(p, t) for p, t in zip(parts[1:], ("<u4", "<i8", "<i8", "<i8"), strict=True))
        self.file = files.open_input_file(f"{path}/shard-{shard:08d}.bin")
        _, _, self.id_size = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))

    def get(self, ids: np.ndarray) -> Iterator[list[tuple[int, np.ndarray]]]:
        """For each key its rows as (first id in the shard, ids as <u4); an empty list for keys that aren't there."""
        keys = _keys(ids)
        at = self.mph.slots(keys)
        good = at >= 0
        good[good] = self.prints[at[good]] == _prints(keys)[good]
        for slot, ok in zip(at.tolist(), good.tolist(), strict=True):
            rows = []
            for k in range(int(self.begin[slot]), int(self.begin[slot] + self.count[slot])) if ok else ():
                a, b = int(self.starts[k]), int(self.starts[k + 1])
                raw = self.file.read_at((b - a) * self.id_size, _HEAD.size + a * self.id_size)
                rows.append((a, np.frombuffer(raw, f"<u{self.id_size}").astype("<u4")))
            yield rows

    def close(self) -> None:
        self.file.close()


def _shard_of(bounds: np.ndarray, column: pa.Array) -> np.ndarray:
    ids = column.fill_null(int(_NULL)).to_numpy(zero_copy_only=False)
    return np.searchsorted(bounds, ids, side="left").astype(np.int32)


def write_store(docs: DataFrame, uri: str, path: str, pattern: str, end_id: int, bounds: list[int]) -> dict[int, int]:
    """Write every document to the shards below `uri`; the ids of each shard."""
    cuts, shards, size = np.array(bounds, np.int64), len(bounds) + 1, max(id_width(path), 2 if end_id < 65536 else 4)

    def encode(batches):
        own, zip_ = id_bytes(path, pattern, size), zstandard.ZstdCompressor(level=1)
        end = int(end_id).to_bytes(size, "little")
        for batch in batches:
            raw = [zip_.compress(own.encode(t) + end) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(cuts, batch.column(0))), batch.column(0), pa.array(raw, pa.binary())], ["shard", "doc_id", "ids"])

    def write(batches):
        unzip, now, shard = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            found = []
            for k, doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != shard:
                    if now:
                        found.append((shard, now.close()))
                    now, shard = ShardWriter(uri, k, size), k
                now.add(doc_id, unzip.decompress(raw))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64()), strict=True)], ["shard", "n"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([now.close()], pa.int64())], ["shard", "n"])

    encoded = lean(docs, "doc_id", "text").mapInArrow(encode, "shard int, doc_id long, ids binary")
    placed = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id")
    return {r["shard"]: r["n"] for r in placed.mapInArrow(write, "shard int, n long").collect()}  # a row for each shard


def read_store(keys: DataFrame, uri: str, sizes: dict[int, int], bounds: list[int]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored row of the keys, by way of the index."""
    cuts, shards = np.array(bounds, np.int64), len(bounds) + 1
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(cuts, batch.column(0))), batch.column(0)], ["shard", "doc_id"])

    def read(batches):
        reader, shard, last = None, None, ()
        for batch in batches:
            rows = []
            of, ids = batch.column(0).to_numpy(), batch.column(1).fill_null(int(_NULL)).to_numpy(zero_copy_only=False)
            for k in np.unique(of):
                if k != shard:
                    if reader:
                        reader.close()
                    reader, shard = ShardReader(uri, int(k)), k
                own = ids[of == k]
                own = own[np.concatenate([[(k, own[0]) != last], own[1:] != own[:-1]])]  # sorted: each key once
                for doc_id, entries in zip(own.tolist(), reader.get(own), strict=True):
                    for start, x in entries:
                        rows.append((None if doc_id == _NULL else doc_id, before[int(k)] + start, len(x), zlib.crc32(x.tobytes())))
                if len(ids):
                    last = (k, ids[of == k][-1])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = lean(keys, "doc_id").mapInArrow(place, "shard int, doc_id long").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(spark: SparkSession, docs: DataFrame, path: str, pattern: str, end_id: int = 2, uri: str | None = None) -> DataFrame:
    """Write the store (below the shared folder unless `uri` names a place), then read every document back from it."""
    uri = uri or scratch(spark, "token-store")
    bounds = shard_bounds(docs)
    return read_store(docs, uri, write_store(docs, uri, path, pattern, end_id, bounds), bounds)
