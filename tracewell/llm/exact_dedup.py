"""Operator 1, exact deduplication.

Texts are equal when they are identical after each run of ASCII white space becomes one space; null counts as empty.
The digests of the history are kept as an index: for each shard of the digest space a minimal perfect hash whose slots
hold the full 32-byte digest, the locator of the row that stays (its doc_id) and the number of rows seen. A new batch is
first reduced to its distinct digests; each is looked up and compared byte for byte. Members are repeats of what the
history keeps; non-members form groups of their own. No row of a group but its pre-aggregated digest is ever gathered, so
a digest that a third of all rows share costs one row for each task.

Defined cases: null and empty texts are one group; a null doc_id never stays while the group has another (it sorts last);
keep_id is null, and its rows are marked as kept, only where a group has no other; rows repeated with the same doc_id are all
returned, kept only where doc_id equals the group's smallest; empty tables give empty results; extra columns are ignored,
whatever their names. `keep_first` leaves exactly one row of each text, also where doc_ids repeat or are null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chosen_rows, lean, saved, step
from .mphf import MinimalPerfectHash

SPACES = "[\\x20\\x09-\\x0D]+"

#: Distinct digests that one shard of the index is meant to hold (some 10 MB as slots).
SHARD_KEYS = 100_000

_INDEX = "shard int, mph binary, digests binary, winners binary, counts binary, named binary"
_GROUPS = "digest binary, keep_id long, group_size long, named long"


def digest(text: str = "text"):
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " "), 256))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return lean(docs, "doc_id", "text").select("doc_id", digest().alias("digest"))


def distinct_digests(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each digest: shard, smallest doc_id (the largest long if all are null), row count and rows with a doc_id; summed in each task before the shuffle."""
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    found = rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named"))
    return found.select(shard.alias("shard"), "digest", F.coalesce("winner", F.lit(2**63 - 1)).alias("winner"), "n", "named")


def _key(digests: np.ndarray) -> np.ndarray:
    """The 64-bit keys of an (n, 32) array of digests."""
    return digests.view("<u8")[:, 0] ^ (digests.view("<u8")[:, 1] * np.uint64(0x9E3779B97F4A7C15))


def _slots(digests: np.ndarray) -> MinimalPerfectHash:
    return MinimalPerfectHash.build(_key(digests))


def _index_shard(part: pd.DataFrame) -> pd.DataFrame:
    digests = np.frombuffer(b"".join(part["digest"]), np.uint8).reshape(-1, 32).copy()
    mph = _slots(digests)
    at = mph.slots(_key(digests))
    out = np.empty_like(digests)
    winners, counts, named = (np.empty(len(digests), "<i8") for _ in range(3))
    out[at], winners[at], counts[at], named[at] = digests, part["winner"], part["n"], part["named"]
    slots = [x.tobytes() for x in (out, winners, counts, named)]
    return pd.DataFrame([[int(part["shard"].iloc[0]), mph.to_bytes(), *slots]], columns=["shard", "mph", "digests", "winners", "counts", "named"])


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of (doc_id, digest) rows, one row for each shard that has any."""
    return distinct_digests(history, shards).groupBy("shard").applyInPandas(_index_shard, _INDEX)


def _merge_shard(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Groups of one shard: the history's, enlarged by the repeats found in the batch, and those of non-members."""
    fresh = np.frombuffer(b"".join(new["digest"]), np.uint8).reshape(-1, 32).copy()
    ids, n, with_id = (new[c].to_numpy(np.int64) for c in ("winner", "n", "named"))
    if len(index):
        row = index.iloc[0]
        mph = MinimalPerfectHash.from_bytes(row["mph"])
        digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winners, counts, named = (np.frombuffer(row[c], "<i8").copy() for c in ("winners", "counts", "named"))
        at = mph.slots(_key(fresh)) if len(fresh) else np.zeros(0, np.int64)
        member = at >= 0
        member[member] = (digests[at[member]] == fresh[member]).all(axis=1)
        # a member repeats what the history keeps; the smaller locator wins if batches come out of order
        winners[at[member]] = np.minimum(winners[at[member]], ids[member])
        counts[at[member]] += n[member]
        named[at[member]] += with_id[member]
    else:
        digests, member = np.zeros((0, 32), np.uint8), np.zeros(len(fresh), bool)
        winners = counts = named = np.zeros(0, "i8")
    every = np.concatenate([digests, fresh[~member]])
    columns = {c: np.concatenate([old, own[~member]]) for c, old, own in (("keep_id", winners, ids), ("group_size", counts, n), ("named", named, with_id))}
    return pd.DataFrame({"digest": [bytes(x) for x in every], **columns})


def groups_of(batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size) of everything in the index or the batch."""
    new = distinct_digests(batch, shards)
    found = new.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_merge_shard, _GROUPS)
    return found.select("digest", F.when(F.col("named") > 0, F.col("keep_id")).alias("keep_id"), "group_size")


def groups(rows: DataFrame, shards: int | None = None) -> DataFrame:
    """(digest, keep_id, group_size) of saved (doc_id, digest) rows.

    The rows up to the middle of the doc_id range are the history, the others the batch that is looked up in its index.
    """
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    pivot = (low + high) // 2 if low is not None else 0
    shards = shards or max(1, -(-n // SHARD_KEYS), 16)
    old = F.coalesce(F.col("doc_id") <= F.lit(pivot), F.lit(False))
    with step(rows.sparkSession):
        index = saved(build_index(rows.filter(old), shards), "digest-index")
        return saved(groups_of(rows.filter(~old), index, shards), "digest-groups", keep=True)


def decisions(rows: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of (doc_id, digest) rows, given their groups."""
    return rows.join(found, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each document, dropped ones too."""
    rows = saved(keyed(docs), "digests")
    return decisions(rows, groups(rows))


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each text, with all its columns: that with the smallest doc_id, or one of those that have it."""
    with step(spark):
        rows = saved(keyed(docs), "digests")
        found = groups(rows)
        decided = saved(decisions(rows, found).select("doc_id", "kept"), "kept", keep=True)
        winners = saved(found.select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep_id")), "winners", keep=True)

    def choose(odd: DataFrame) -> DataFrame:
        held = odd.withColumn("__digest", digest()).join(winners, "__digest")
        return held.filter(F.col("doc_id").eqNullSafe(F.col("__keep_id"))).dropDuplicates(["__digest"])

    return chosen_rows(docs, decided, choose)
