"""Operator 5, n-gram Jaccard join with Bayesian pruning of candidates.

Texts with the same set of word 5-grams form a class and are joined as one. Of each class a MinHash signature is banded, and
classes that share a bucket are candidates. Buckets with the same members are judged once. The pairs of a bucket are
compared value by value in stages: a pair is dropped once the posterior probability (uniform prior) that its similarity
reaches the threshold falls below a tolerance. What is left is verified on the shingle sets themselves. A pair that shares
several buckets counts in the smallest alone. Where the buckets that tie some classes together have more pairs in all than
these classes themselves (dense groups of near copies, whose members meet again and again), the pairs of classes are judged
instead, each once; classes that mere chains of buckets tie together are never compared with each other for that. Large
groups are dealt into blocks, and the blocks are joined pairwise, so no task holds more than two blocks; tasks return for
each class its number of links and one tie to its local component, never the pairs.

A row results for each document: doc_id, class_id (the smallest doc_id that chains of links reach), n_links (other
documents with a similarity of the threshold or more, copies included) and kept (doc_id is class_id); class_size is left to
a count over class_id.

Defined cases: null text is empty; a text without words has links to nothing and is its own class; a text of fewer than
five words has its words as the one shingle; rows that repeat a doc_id count as documents each; a row with a null doc_id is
a document like others, but names its class only if no other does, and that name is null; empty tables give empty results;
extra columns are ignored; texts are read whole. `keep_one_of_each` leaves one row of each class, also where doc_ids repeat
or are null, and every row without words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import chosen_rows, give_back, lean, mapped, saved, step, text_slices
from .components import components, local_roots
from .shingles import band_hashes, distinct, shingle_hashes, signatures, word_hashes, words_of

#: Words of a shingle, the threshold as a fraction, and the posterior below which a pair is dropped.
WORDS, THRESHOLD, TOLERANCE = 5, (4, 5), 1e-6


@dataclass(frozen=True)
class Banding:
    """Bands of a signature, values in each, and after how many values candidates are judged."""

    bands: int
    rows: int
    stages: tuple[int, ...]


#: At a similarity of 0.8 all bands miss with a probability of (1 - 0.8**4)**24 = 3e-6.
DOCUMENTS = Banding(24, 4, (16, 32, 64, 96))
#: Classes and shingles of a block, and of a task that takes whole small groups, about.
BLOCK, BLOCK_SHINGLES, TASK, TASK_SHINGLES = 512, 1 << 18, 2048, 1 << 19
#: Classes of a group up to which its pairs are judged together with those of other groups.
SMALL = 48

_SKETCH = "doc_id long, node long, key binary, n int, sig binary"
_GROUP = "struct<group: long, m: long, n: long>"


def least_matches(stages: tuple[int, ...], threshold: float = THRESHOLD[0] / THRESHOLD[1], tolerance: float = TOLERANCE) -> list[int]:
    """For each stage of n values, the fewest equal ones with which a pair may still reach the threshold: the posterior of
    that is P(Binomial(n + 1, threshold) <= m) after m matches under a uniform prior."""
    out = []
    for n in stages:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _key(shingles: bytes) -> bytes:
    """16 bytes that name a set of shingles."""
    return hashlib.blake2b(shingles, digest_size=16).digest()


@F.pandas_udf(BinaryType())
def set_key(texts: pd.Series) -> pd.Series:
    """The key of each text's set of shingles."""
    out = []
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        start, end, first = words_of(raw, np.array([0, len(raw)]))
        (own,) = distinct(*shingle_hashes(word_hashes(raw, start, end), first, WORDS))
        out.append(_key(own.tobytes()))
    return pd.Series(out, dtype=object)


def sketch_slice(raw: np.ndarray, offsets: np.ndarray, values: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Key of the shingle set, number of shingles and signature of each text."""
    start, end, first = words_of(raw, offsets)
    hashes, bounds = shingle_hashes(word_hashes(raw, start, end), first, WORDS)
    sets = distinct(hashes, bounds)
    keys = [_key(s.tobytes()) for s in sets]
    return keys, np.array([len(s) for s in sets], np.int32), signatures(hashes, bounds, values)


def sketches(docs: DataFrame, banding: Banding = DOCUMENTS) -> DataFrame:
    """(doc_id, node, key, n, sig) of (doc_id, text) rows; `node` is a number for the key."""
    values = banding.bands * banding.rows

    def run(batches):
        for batch in batches:
            for at, n, raw, offsets in text_slices(batch, "text"):
                keys, sizes, sig = sketch_slice(raw, offsets, values)
                nodes = np.frombuffer(b"".join(keys), np.int64)[::2]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(nodes), pa.array(keys, pa.binary()), pa.array(sizes), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "node", "key", "n", "sig"])

    return mapped(docs, run, _SKETCH, "sketches")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles) of the texts of (doc_id, text) rows: their nodes and sorted 64-bit hashes."""

    def run(batches):
        for batch in batches:
            for _, _, raw, offsets in text_slices(batch, "text"):
                start, end, first = words_of(raw, offsets)
                sets = [s.tobytes() for s in distinct(*shingle_hashes(word_hashes(raw, start, end), first, WORDS))]
                nodes = np.frombuffer(b"".join(map(_key, sets)), np.int64)[::2]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, shingles binary")


def bucket_rows(classes: DataFrame, banding: Banding) -> DataFrame:
    """(bucket, id, n): the buckets of every class (id, n, sig)."""
    bands, per = banding.bands, banding.rows

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, bands * per)
            ids, n = (np.repeat(batch.column(k).to_numpy(), bands) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(band_hashes(sig, bands, per).ravel()), pa.array(ids), pa.array(n)], ["bucket", "id", "n"])

    return mapped(classes.filter("n > 0").select("id", "n", "sig"), run, "bucket long, id long, n int", "bands")


def shared_members(rows: DataFrame, keep: int = 1, repeats: bool = True) -> DataFrame:
    """(bucket, id, n, least): the different ids of (bucket, id, n) rows in buckets that hold several, and the smallest there.

    What repeats goes first, so that nothing has to be grouped above the join and a bucket of very many ids can be split there.
    """
    with step(rows.sparkSession):
        if repeats:
            rows = saved(rows.distinct(), "bucket-rows")
        with step(rows.sparkSession):
            least = rows.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("top")).filter("least < top").select("bucket", "least")
            least = saved(least, "shared-buckets", keep=True)
        return saved(rows.join(least, "bucket").select("bucket", "id", "n", "least"), "bucket-members", keep)


def candidate_groups(members: DataFrame, whole: bool = True) -> DataFrame:
    """(id, own, leasts): the groups (group, m members, n shingles) in which each id of (bucket, id, n, least) rows meets others, and their smallest ids.

    With `whole`, classes that many buckets tie together may be one group; with few bands that saves nothing.
    """
    with step(members.sparkSession):
        if whole:
            tied = components(members.select(F.col("id").alias("a"), F.col("least").alias("b")))
        with step(members.sparkSession):
            mark = lambda seed: F.bit_xor(F.xxhash64("id", F.lit(seed)))
            buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight"), F.min("least").alias("least"), mark(1).alias("x"), mark(2).alias("y"))
            once = buckets.groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket"), F.min("weight").alias("weight"), F.min("least").alias("least")).select("bucket", "m", "weight", "least")
            of = members.drop("least").join(once, "bucket").groupBy("id").agg(F.min("n").alias("n"), F.collect_list(F.struct(F.col("bucket").alias("group"), "m", F.col("weight").alias("n"), "least")).alias("own"))  # one for each band at most
            plain = F.transform("own", lambda g: F.struct(g["group"].alias("group"), g["m"].alias("m"), g["n"].alias("n"))).cast(f"array<{_GROUP}>")
            if not whole:
                return saved(of.select("id", plain.alias("own"), F.transform("own", lambda g: g["least"]).alias("leasts")), "candidates", keep=2)
            of = saved(of.join(tied.withColumnRenamed("node", "id"), "id"), "tied-classes", keep=True)
        met = F.aggregate("own", F.lit(0).cast("long"), lambda total, g: total + g["m"])
        sizes = of.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight"), F.sum(met).alias("met"))
        one = F.array(F.struct(F.col("label").alias("group"), "m", F.col("weight").alias("n")).cast(_GROUP))
        found = of.join(sizes, "label").select("id", F.when(F.col("m") * F.col("m") <= F.col("met"), one).otherwise(plain).alias("own"), F.transform("own", lambda g: g["least"]).alias("leasts"), (F.col("m") * F.col("m") <= F.col("met")).alias("one"), "label")
        found = found.select("id", "own", F.when(F.col("one"), F.array("label")).otherwise(F.col("leasts")).alias("leasts"))
        return saved(found, "candidates", keep=True)


def compare(sig_a: np.ndarray, sig_b: np.ndarray | None, stages: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of a, rows of b) that survive all stages; within a, each pair once, if b is None."""
    other = sig_a if sig_b is None else sig_b
    if not stages:  # nothing to judge by
        return np.nonzero(np.triu(np.ones((len(sig_a), len(sig_a)), bool), 1) if sig_b is None else np.ones((len(sig_a), len(sig_b)), bool))
    done, alive = 0, None
    for n, least in zip(stages, least_matches(stages), strict=True):
        if alive is None:
            same = np.zeros((len(sig_a), len(other)), np.uint8)
            for k in range(n):
                same += sig_a[:, k][:, None] == other[:, k][None, :]
            keep = same >= least
            if sig_b is None:
                keep &= np.triu(np.ones_like(keep, bool), 1)
            alive = np.nonzero(keep)
            matches = same[alive].astype(np.int16)
        else:
            i, j = alive
            for at in range(0, len(i), 1 << 18):
                part = slice(at, at + (1 << 18))
                matches[part] += (sig_a[i[part], done:n] == other[j[part], done:n]).sum(axis=1, dtype=np.int16)
            keep = matches >= least
            alive, matches = (i[keep], j[keep]), matches[keep]
        done = n
    return alive


def verify(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs reach the threshold, exactly; pairs come in order of i."""
    other = sets_a if sets_b is None else sets_b
    if not len(i):
        return np.zeros(0, bool)
    every = sets_a if sets_b is None else sets_a + sets_b
    names, place = np.unique(np.concatenate(every), return_inverse=True)
    cuts = np.cumsum([0, *map(len, every)])
    local = [place[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    local_b = local if sets_b is None else local[len(sets_a) :]
    size_b = np.array([len(s) for s in other])
    mark, good = np.zeros(len(names), bool), np.zeros(len(i), bool)
    up, down = THRESHOLD
    bounds = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own, partners = local[i[a]], j[a:b]
        mark[own] = True
        both = np.add.reduceat(mark[np.concatenate([local_b[p] for p in partners])].astype(np.int64), np.cumsum([0, *size_b[partners][:-1]]))
        mark[own] = False
        good[a:b] = down * both >= up * (len(own) + size_b[partners] - both)
    return good


def common(codes: np.ndarray, cuts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many values the sets i and j of each pair share; set k is codes[cuts[k]:cuts[k + 1]], without repeats."""
    sizes, out = np.diff(cuts), np.zeros(len(i), np.int64)
    if not len(codes):
        return out
    _, codes = np.unique(codes, return_inverse=True)
    width = int(codes.max()) + 1
    bounds = np.cumsum(sizes[i] + sizes[j])
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + (1 << 21), side="right")))
        keys = []
        for side in (i[at:to], j[at:to]):
            n = sizes[side]
            first = np.cumsum(n) - n
            keys.append(np.repeat(np.arange(len(side)) * width, n) + codes[np.repeat(cuts[side] - first, n) + np.arange(n.sum())])
        keys = np.sort(np.concatenate(keys))
        out[at:to] = np.bincount(keys[1:][keys[1:] == keys[:-1]] // width, minlength=to - at)
        at = to
    return out


def judged(sig_a: np.ndarray, sig_b: np.ndarray, i: np.ndarray, j: np.ndarray, stages: tuple[int, ...]) -> np.ndarray:
    """Positions of the pairs that survive all stages."""
    left, matches, done = np.arange(len(i)), np.zeros(len(i), np.int16), 0
    for n, least in zip(stages, least_matches(stages) if stages else (), strict=True):
        for at in range(0, len(left), 1 << 18):
            part = slice(at, at + (1 << 18))
            matches[part] += (sig_a[i[left[part]], done:n] == sig_b[j[left[part]], done:n]).sum(axis=1, dtype=np.int16)
        keep = matches >= least
        left, matches, done = left[keep], matches[keep], n
    return left


def _packed(arrays) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(arrays), np.concatenate([[0], np.cumsum([len(x) for x in arrays])])


def _tally(ids: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Links and local component of each id, given positions of linked pairs."""
    links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    order = np.argsort(ids, kind="stable")  # roots are smallest ids
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    root = local_roots(len(ids), back[i], back[j])[back]
    return pd.DataFrame({"id": ids, "links": links.astype(np.int64), "root": ids[order][root]})


def _met(rows: list[pd.DataFrame], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs share a group of a smaller number than the one at hand; rows of all halves count on."""
    groups = [np.asarray(g)[np.asarray(g) < own] for x in rows for g, own in zip(x["groups"], x["group"], strict=True)]
    codes, cuts = _packed(groups)
    found = np.zeros(len(i), bool)
    maybe = np.flatnonzero((np.diff(cuts)[i] > 0) & (np.diff(cuts)[j] > 0))
    found[maybe] = common(codes, cuts, i[maybe], j[maybe]) > 0
    return found


def _small_groups(rows: pd.DataFrame, stages: tuple[int, ...], word: str) -> pd.DataFrame:
    """All pairs of many groups at once."""
    rows = rows.sort_values(["group", "id"], kind="stable")
    group = rows["group"].to_numpy()
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    after = np.repeat(np.append(start[1:], len(group)), np.diff(np.append(start, len(group)))) - np.arange(len(group)) - 1
    i = np.repeat(np.arange(len(group)), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    codes, cuts = _packed([np.frombuffer(s, word) for s in rows["shingles"]])
    n, (up, down) = np.diff(cuts), THRESHOLD
    fit = down * np.minimum(n[i], n[j]) >= up * np.maximum(n[i], n[j])  # else the threshold is out of reach
    i, j = i[fit], j[fit]
    if stages:
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(len(rows), -1)
        left = judged(sig, sig, i, j, stages)
        i, j = i[left], j[left]
    fresh = ~_met([rows], i, j)
    i, j = i[fresh], j[fresh]
    both = common(codes, cuts, i, j)
    good = down * both >= up * (n[i] + n[j] - both)
    return _tally(rows["id"].to_numpy(), rows["size"].to_numpy(), i[good], j[good])


def _large_group(halves: list[pd.DataFrame], stages: tuple[int, ...], word: str) -> pd.DataFrame:
    """The pairs within one block, or between two."""
    a, b = halves[0], halves[1] if len(halves) > 1 else None
    ids, weight = (np.concatenate([x[c] for x in halves]) for c in ("id", "size"))
    sig = [np.frombuffer(b"".join(x["sig"]), np.uint32).reshape(len(x), -1) if stages else np.zeros((len(x), 0), np.uint32) for x in halves]
    sets = [[np.frombuffer(s, word) for s in x["shingles"]] for x in halves]
    i, j = compare(sig[0], sig[1] if b is not None else None, stages)
    shift = 0 if b is None else len(a)
    fresh = ~_met(halves, i, j + shift)
    i, j = i[fresh], j[fresh]
    good = verify(sets[0], sets[1] if b is not None else None, i, j)
    return _tally(ids, weight, i[good], j[good] + shift)


def _links(part: pd.DataFrame, stages: tuple[int, ...], word: str) -> pd.DataFrame:
    """Links and local component of the classes of one task: whole groups, or two blocks of a large one."""
    if part["left"].iloc[0] != part["right"].iloc[0]:
        out = [_large_group([part[part["block"] == part[side]] for side in ("left", "right")], stages, word)]
    else:
        size = part.groupby("group")["id"].transform("size")
        out = [_large_group([rows.sort_values("id", kind="stable")], stages, word) for _, rows in part[size > SMALL].groupby("group", sort=False)]
        if (size <= SMALL).any():
            out.append(_small_groups(part[size <= SMALL], stages, word))
    give_back()
    return pd.concat(out)


def _compared(held: DataFrame, small, large, stages: tuple[int, ...], word: str) -> DataFrame:
    """(id, links, root) of the classes of (id, own, size, sig, shingles) rows, by task."""
    held = held.withColumns({"groups": F.transform("own", lambda g: g["group"]), "visits": F.concat(small, large)})
    places = F.array_distinct(F.transform("visits", lambda v: F.struct(v["task"].alias("task"), v["left"].alias("left"), v["right"].alias("right"), v["small"].alias("small"))))
    held = held.withColumn("place", F.explode(places)).select("id", "groups", "size", "sig", "shingles", "place.*", F.filter("visits", lambda v: (v["task"] == F.col("place.task")) & (v["left"] == F.col("place.left")) & (v["right"] == F.col("place.right")) & (v["small"] == F.col("place.small"))).alias("here"))
    held = held.select("task", "left", "right", "small", "id", "groups", "size", "sig", "shingles", F.transform("here", lambda v: v["group"]).alias("group"), F.transform("here", lambda v: v["block"]).alias("block"))
    return held.groupBy("task", "left", "right", "small").applyInPandas(lambda part: _links(part.explode(["group", "block"], ignore_index=True).astype({"group": "int64", "block": "int32"}), stages, word), "id long, links long, root long")


def similar_classes(members: DataFrame, fetch: Callable[[DataFrame], DataFrame], stages: tuple[int, ...] = (), word: str = "<u8", whole: bool = True, rounds: int = 1) -> DataFrame:
    """(id, links, label) of the classes with links to others, given their shared buckets (bucket, id, n, least).

    `fetch` gives a table (id, size, sig, shingles) of (id) rows, shingles being of the type `word`; without stages every
    pair of a group is verified and `sig` plays no part. `links` counts rows of other classes; `label` is the smallest id of the component of links.
    With several rounds, groups are compared in as many shares, one after another, and a pair that meets in two of them counts in both.
    """
    with step(members.sparkSession):
        groups = candidate_groups(members, whole)
        n, weight = groups.agg(F.count(F.lit(1)), F.sum(F.element_at("own", 1)["n"] / F.element_at("own", 1)["m"])).first()
        tasks = max(1, -(-n // TASK), int((weight or 0) // TASK_SHINGLES))
        keys = F.col("leasts") if "leasts" in groups.columns else F.transform("own", lambda g: g["group"])
        groups = groups.select("id", F.zip_with("own", keys, lambda g, k: F.struct(g["group"].alias("group"), g["m"].alias("m"), g["n"].alias("n"), k.alias("least"))).alias("own"))
        sets, kept = fetch(groups.select("id")), None
        # a class goes once to each task it has groups in: groups with the same smallest class share a task, blocks of large ones have their own
        blocks = lambda g: F.greatest(F.ceil(g["m"] / BLOCK), F.ceil(g["n"] / BLOCK_SHINGLES)).cast("int")
        block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        small = F.transform(F.filter("own", lambda g: blocks(g) == 1), lambda g: F.struct(F.pmod(F.xxhash64(g["least"]), F.lit(tasks)).alias("task"), F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(True).alias("small"), g["group"].alias("group"), F.lit(0).alias("block")))
        pair = lambda g, k: F.struct(F.xxhash64(g["group"], F.least(block(blocks(g)), k), F.greatest(block(blocks(g)), k)).alias("task"), F.least(block(blocks(g)), k).alias("left"), F.greatest(block(blocks(g)), k).alias("right"), F.lit(False).alias("small"), g["group"].alias("group"), block(blocks(g)).alias("block"))
        large = F.flatten(F.transform(F.filter("own", lambda g: blocks(g) > 1), lambda g: F.transform(F.sequence(F.lit(0), blocks(g) - 1), lambda k: pair(g, k))))
        for share in range(rounds):
            own = groups if rounds == 1 else groups.withColumn("own", F.filter("own", lambda g: F.pmod(F.hash(g["least"]), F.lit(rounds)) == share)).filter(F.size("own") > 0)
            found = _compared(own.join(sets, "id"), small, large, stages, word)
            with step(members.sparkSession):
                found = saved(found, "links", keep=True)
            kept = found if kept is None else kept.unionByName(found)
        labels = components(kept.select(F.col("id").alias("a"), F.col("root").alias("b")))
        total = kept.groupBy("id").agg(F.sum("links").alias("links")).filter("links > 0")
        found = total.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "links", F.coalesce("label", "id").alias("label"))
        return saved(found, "similar-classes", keep=True)


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n) of every row, and (key, label, class_id, n_links) of every key with words."""
    rows = lean(docs, "doc_id", "text")
    with step(docs.sparkSession):
        sketched = sketches(rows)
        classes = sketched.filter("n > 0").groupBy("key").agg(F.first("node").alias("id"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        classes = saved(classes, "classes")
        def fetch(ids: DataFrame) -> DataFrame:
            """The shingles of each class come from the text of its smallest doc_id, or one without."""
            wanted = classes.join(ids, "id").select("id", "least", "size", "sig")
            texts = rows.join(wanted.select("least").distinct().hint("shuffle_hash"), rows["doc_id"].eqNullSafe(F.col("least")), "left_semi")
            sets = shingle_sets(texts).groupBy("id").agg(F.first("shingles").alias("shingles"))
            return wanted.drop("least").join(sets, "id")

        found = similar_classes(shared_members(bucket_rows(classes, DOCUMENTS), repeats=False), fetch, DOCUMENTS.stages)
        of = classes.select("key", "id", "size", "least").join(found, "id", "left").select("key", "size", "least", F.coalesce("label", "id").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
        names = of.groupBy("label").agg(F.min("least").alias("class_id"))
        known = saved(of.join(names, "label").select("key", "label", "class_id", (F.col("links") + F.col("size") - 1).alias("n_links")), "near-classes", keep=True)
        return saved(sketched.select("doc_id", "key", "n"), "document-keys", keep=True), known


def ngram_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and kept of every document."""
    rows, known = near_copies(docs)
    out = rows.join(known, "key", "left")
    out = out.select("doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns, and every row without words."""
    rows, known = near_copies(docs)
    kept = rows.join(known, "key", "left").select("doc_id", "n", "label", (F.col("n").eqNullSafe(F.lit(0)) | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))

    def choose(odd: DataFrame) -> DataFrame:
        found = odd.withColumn("__key", set_key(F.col("text"))).join(known.select(F.col("key").alias("__key"), F.col("label").alias("__label"), F.col("class_id").alias("__class")), "__key", "left")
        wordless = found.filter("__label IS NULL")
        return found.filter(F.col("__label").isNotNull() & F.col("doc_id").eqNullSafe(F.col("__class"))).dropDuplicates(["__label"]).unionByName(wordless)

    return chosen_rows(docs, kept.select("doc_id", "kept"), choose)
