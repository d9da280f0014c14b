"""Operator 12, approximate nearest neighbours by inner product, with a forest of hash prefixes.

Each of TREES trees gives a vector a long hash string. A digit is the closest of the AXES axes, with its sign, of a random
rotation (6 bits); a string has more digits than it takes to tell all vectors apart at random. So that the largest inner
product is the smallest angle, vectors are scaled to the largest norm and get one more component that fills them up to length 1.
Of a tree, the sorted strings are its index. Vectors are dealt into blocks of bounded size by a hash; each block has the forest
of its own vectors, made where they are read from strings that depend on the vector alone. So a vector moves once in a pass, not
once a tree, and what a query finds in all blocks is what it would find in one forest.

A query descends in each tree to the vectors with the longest common prefix, an interval of the sorted array. It then ascends in
all trees at once: one digit less at a time, until the intervals hold EFFORT * n**POWER vectors in sum (n different vectors in
all; with no digit left that is every vector). The first pass over the blocks counts the intervals at each length, the second
reads the chosen ones, all of them, and computes inner products in double precision; what falls below the best that a query has
found so far is not returned. The second pass reads some blocks first, and the scores found there hold for the others, so a query
gets about as many rows from all blocks as from the square root of their number. Every vector is indexed, and no interval is
cut. EFFORT and POWER hold the recall of 20 among isotropic vectors, the hardest, over 0.9 from a few hundred to some 10**5 (see
the tests); where vectors have close neighbours, less would do.

Equal vectors are one in the index (told by 128-bit digests of their components) and bring the k + 1 smallest of their vec_ids,
which is all that k results can need. Vectors travel in 4 bytes a component where these hold them exactly.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors meet only vectors of
their own length; a query never meets rows of its own vec_id; rows that repeat a vector or a vec_id are candidates each for
itself, and a vec_id that repeats among the queries is asked once with each different vector; a null vec_id takes no part; with
fewer candidates than k all are returned; equal scores go by vec_id; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, mapped, saved, step
from .topk import usable

#: Trees, axes of a digit and its bits (axis and sign).
TREES, AXES, BITS = 40, 32, 6
#: Candidates at which the ascent ends: EFFORT * n**POWER.
EFFORT, POWER = 6.3, 0.7
#: Vectors of a block at most, bytes of their doubles at most, and vectors below which a block isn't split for idle cores.
BLOCK, BLOCK_BYTES, LEAST_BLOCK = 65_536, 1 << 25, 4096
#: Vectors from which an interval of a block is multiplied as a matrix, not pair by pair, and queries that read a block at once.
SEGMENT, QUERIES = 128, 2048
#: Vectors that are hashed together, and pairs that are scored together.
SLICE, PAIRS = 256, 65_536

UNIT = ["dim", "block", "part", "asks"]
_KEYED = "digest binary, dim int, vec_id long, norm double, vector binary"
_ASKED = "vid long, dim int, codes binary, vector binary"
_HITS = "vid long, found long, least long, score double"


class Plan:
    """Of the vectors of one length: how many there are, their largest norm, digits of a string, the target, and how they are dealt.

    `segment` is the number of digits from which on an interval is small.
    """

    def __init__(self, n: int, norm: float, dim: int = 1, cores: int = 1):
        levels = next(x for x in range(1, 11) if 64**x >= n or x == 10)
        self.n, self.norm, self.digits = n, norm, min(10, levels + 1)
        self.segment = next(x for x in range(1, self.digits + 1) if n / 64**x <= SEGMENT / 2 or x == self.digits)
        self.target = EFFORT * n**POWER
        self.blocks = max(-(-n // max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))), min(cores, -(-n // LEAST_BLOCK)))
        self.first = int(np.ceil(np.sqrt(self.blocks)))  # blocks of the first round
        self.parts = -(-cores // self.first) if n > LEAST_BLOCK else 1  # groups of queries there, so that all cores have work


@cache
def axes(dim: int, digits: int) -> np.ndarray:
    """The axes of all digits of all trees, (dim + 1) x (TREES * digits * AXES)."""
    r, out = np.random.default_rng(dim), []
    for _ in range(TREES * digits):
        x = r.normal(size=(dim + 1, max(dim + 1, AXES)))
        out.append((np.linalg.qr(x)[0] if dim + 1 >= AXES else x)[:, :AXES])
    return np.concatenate(out, axis=1).astype(np.float32)


def codes_of(x: np.ndarray, plan: Plan, query: bool) -> np.ndarray:
    """The hash strings of vectors, (rows, TREES), as integers of `digits` digits."""
    kind = np.int32 if BITS * plan.digits < 31 else np.int64
    out, all_axes = np.empty((len(x), TREES), kind), axes(x.shape[1], plan.digits)
    place = np.int64(1) << BITS * np.arange(plan.digits - 1, -1, -1, dtype=np.int64)
    lot = np.zeros((SLICE, x.shape[1] + 1), np.float32)  # always of one shape, so that a vector's string doesn't depend on the others
    for at in range(0, len(x), SLICE):
        own = x[at : at + SLICE]
        size = np.sqrt((own**2).sum(axis=1))
        lot[:] = 0
        lot[: len(own), :-1] = own / (size if query else np.full(len(own), plan.norm))[:, None]
        lot[: len(own), -1] = 0 if query else np.sqrt(np.maximum(0, 1 - (size / plan.norm) ** 2))
        y = (lot @ all_axes)[: len(own)].reshape(len(own), TREES, plan.digits, AXES)
        far = np.abs(y).argmax(axis=3)
        digit = 2 * far + (np.take_along_axis(y, far[..., None], axis=3)[..., 0] > 0)
        out[at : at + SLICE] = digit.astype(np.int64) @ place
    return out


def _keyed(batches):
    """Vectors as bytes, 4 for each component where these hold it and else 8, with digests that tell them apart."""
    names = [c.split()[0] for c in _KEYED.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        dims = batch.column(1).to_numpy()
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False) + 0.0  # of both zeros one
        ends = np.cumsum(dims, dtype=np.int64)
        starts = ends - dims
        with np.errstate(over="ignore"):
            narrow = flat.astype(np.float32)
            norms = np.sqrt(np.add.reduceat(flat**2, starts))
        fits = np.logical_and.reduceat(narrow == flat, starts)
        vectors = [(narrow if f else flat)[a:b].tobytes() for f, a, b in zip(fits.tolist(), starts.tolist(), ends.tolist(), strict=True)]
        digests = [blake2b(v, digest_size=16, salt=int(d).to_bytes(16, "little")).digest() for v, d in zip(vectors, dims, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(1), batch.column(0), pa.array(norms), pa.array(vectors, pa.binary())], names)


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors, in doubles, of their bytes."""
    items = column.to_pylist()
    out, wide = np.empty((len(items), dim)), np.array([len(v) > 4 * dim for v in items], bool)
    for own, kind in ((wide, np.float64), (~wide, np.float32)):
        out[own] = np.frombuffer(b"".join([v for v, w in zip(items, own.tolist(), strict=True) if w]), kind).reshape(-1, dim)
    return out


def _strings(batches, plans: dict[int, Plan]):
    """The strings of queries in all trees."""
    for batch in batches:
        dims = batch.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == dim))
            codes = codes_of(_matrix(own.column(2), dim), plans[dim], True)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), own.column(2)], [c.split()[0] for c in _ASKED.split(", ")])
    give_back()


class Forest:
    """The vectors of one block, and of each tree their order and their sorted strings."""

    def __init__(self, dim: int, plan: Plan, table: pa.Table):
        self.dim, self.plan = dim, plan
        self.x = _matrix(table.column("vector"), dim)
        self.vids, self.least = (table.column(c).to_numpy() for c in ("vid", "least"))
        codes = codes_of(self.x, plan, False)
        self.orders = [np.argsort(codes[:, t], kind="stable").astype(np.int32) for t in range(TREES)]
        self.codes = [codes[order, t] for t, order in enumerate(self.orders)]
        self.longest = float(np.sqrt((self.x**2).sum(axis=1).max()))

    def interval(self, tree: int, asked: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings that share `level` digits with the asked ones begin and end in the sorted array."""
        low = BITS * (self.plan.digits - level)
        first = (asked.astype(np.int64) >> low) << low
        codes = self.codes[tree]
        last = first + (np.int64(1) << low) - 1
        return np.searchsorted(codes, first.astype(codes.dtype)), np.searchsorted(codes, last.astype(codes.dtype), "right")


def _asked_codes(table: pa.Table, plan: Plan) -> np.ndarray:
    kind = np.int32 if BITS * plan.digits < 31 else np.int64
    return np.frombuffer(b"".join(table.column("codes").to_pylist()), kind).reshape(-1, TREES)


def _visits(batches, plans: dict[int, Plan]):
    """(forest, queries): the forest of each unit, whose vectors come first, with about QUERIES of its queries at a time."""
    unit, vectors, forest, held, n = None, [], None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).cast(pa.int64()).to_numpy() for k in range(len(UNIT))], axis=1)
        cuts = np.concatenate([[0], 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)), [len(keys)]]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            *own, asks = keys[a].tolist()
            if own != unit:
                if held and forest:
                    yield forest, pa.Table.from_batches(held)
                unit, vectors, forest, held, n = own, [], None, [], 0
            if not asks:
                vectors.append(batch.slice(a, b - a))
                continue
            if vectors:
                forest, vectors = Forest(own[0], plans[own[0]], pa.Table.from_batches(vectors)), []
            held.append(batch.slice(a, b - a))
            n += b - a
            if n >= QUERIES:
                if forest:
                    yield forest, pa.Table.from_batches(held)
                held, n = [], 0
    if held and forest:
        yield forest, pa.Table.from_batches(held)
    give_back()


def _counts(batches, plans: dict[int, Plan]):
    """(vid, level, n): how many strings of a block share `level` digits with a query, in all trees."""
    for forest, table in _visits(batches, plans):
        vid, codes = table.column("vid").to_numpy(), _asked_codes(table, forest.plan)
        for level in range(1, forest.plan.digits + 1):
            n = np.zeros(len(vid), np.int64)
            for tree in range(TREES):
                a, b = forest.interval(tree, codes[:, tree], level)
                n += b - a
            has = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(vid[has]), pa.array(np.full(has.sum(), level, np.int32)), pa.array(n[has])], ["vid", "level", "n"])


class Best:
    """The k best vectors of a block for each of some queries, ties to the smaller `least`; scores don't depend on the others."""

    def __init__(self, q: np.ndarray, forest: Forest, floor: np.ndarray, k: int):
        self.q, self.forest, self.floor, self.k = q, forest, floor, k
        self.slack = max(1e-12, 1e-15 * forest.dim) * np.sqrt((q**2).sum(axis=1)) * forest.longest
        self.i, self.j, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple] = []

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """Score pairs of queries and vectors; those under a query's floor go."""
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            score = (self.q[a] * self.forest.x[b]).sum(axis=1)
            keep = score >= self.floor[a]
            self.new.append((a[keep], b[keep], score[keep]))

    def matrix(self, who: np.ndarray, rows: np.ndarray) -> None:
        """Compare some queries with some vectors, all with all."""
        for at in range(0, len(rows), 8192):
            own = rows[at : at + 8192]
            x = self.forest.x[own]
            for first in range(0, len(who), 256):
                some = who[first : first + 256]
                rough = self.q[some] @ x.T
                cut = self.floor[some]
                bare = np.flatnonzero(np.isneginf(cut))
                if len(bare) and len(own) > self.k:
                    cut = cut.copy()
                    cut[bare] = np.partition(rough[bare], len(own) - self.k, axis=1)[:, len(own) - self.k]
                i, j = np.nonzero(rough >= (cut - self.slack[some])[:, None])
                self.pairs(some[i], own[j])

    def settle(self) -> None:
        """Keep the best of what has been found, and raise floors."""
        if not sum(len(n[0]) for n in self.new):
            return
        i, j, score = (np.concatenate([old, *[n[c] for n in self.new]]) for c, old in enumerate((self.i, self.j, self.score)))
        self.new = []
        _, once = np.unique(i * len(self.forest.vids) + j, return_index=True)
        i, j, score = i[once], j[once], score[once]
        order = np.lexsort((self.forest.vids[j], self.forest.least[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        keep = nth < self.k
        self.i, self.j, self.score = i[keep], j[keep], score[keep]
        last = nth == self.k - 1
        self.floor[i[last]] = np.maximum(self.floor[i[last]], score[last])


def _scores(batches, plans: dict[int, Plan], k: int):
    """The best of each query among the vectors of its intervals in one block."""
    for forest, table in _visits(batches, plans):
        vid, level, codes = table.column("vid").to_numpy(), table.column("level").to_numpy(), _asked_codes(table, forest.plan)
        best = Best(_matrix(table.column("vector"), forest.dim), forest, table.column("floor").to_numpy().copy(), k)
        n = len(forest.vids)
        short = level < Plan(n, 1.0).segment
        best.matrix(np.flatnonzero(level == 0), np.arange(n))  # without digits, all vectors
        best.settle()
        below = np.flatnonzero(level > 0)
        for tree in range(TREES):
            order = forest.orders[tree]
            a, b = forest.interval(tree, codes[below, tree], level[below].astype(np.int64))
            large = (b > a) & (short[below] | (b - a > SEGMENT))
            at = np.flatnonzero((b > a) & ~large)
            sizes = (b - a)[at]
            for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS)) + 1):
                own, size = at[some], sizes[some]
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                best.pairs(np.repeat(below[own], size), order[np.repeat(a[own], size) + within])
            at = np.flatnonzero(large)
            at = at[np.lexsort((b[at], a[at]))]
            new = np.flatnonzero((np.diff(a[at]) != 0) | (np.diff(b[at]) != 0)) + 1
            for own in np.split(at, new):
                if len(own):
                    best.matrix(below[own], order[a[own[0]] : b[own[0]]])
            best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(vid[best.i]), pa.array(forest.vids[best.j]), pa.array(forest.least[best.j]), pa.array(best.score)], ["vid", "found", "least", "score"])


def distinct_vectors(rows: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame]:
    """(digest, vec_id, n) of the rows, n being copies; (vid, digest, dim, least, norm, vector, ids, asks) of the different vectors.

    ids are the k + 1 smallest vec_ids and their copies; asks tells whether a query has the vector. Only the last join moves vectors.
    """
    keyed = rows.select("vec_id", "dim", "embedding").mapInArrow(_keyed, _KEYED)
    pairs = saved(keyed.groupBy("digest", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n")), "vectors-by-id")
    first = pairs.withColumn("nth", F.row_number().over(W.partitionBy("digest").orderBy("vec_id"))).filter(F.col("nth") <= k + 1)
    lists = first.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))  # k + 1 at most
    asks = pairs.filter(F.col("vec_id") % every == 0).groupBy("digest").agg(F.lit(True).alias("asks"))
    lists = lists.join(asks, "digest", "left").select("digest", F.col("ids")[0]["vec_id"].alias("vec_id"), "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    # rows that repeat the smallest vec_id of a vector bring it more than once
    whole = keyed.join(lists, ["digest", "vec_id"]).groupBy("digest", "vec_id").agg(*[F.first(c).alias(c) for c in ("dim", "norm", "vector", "ids", "asks")])
    return pairs, saved(whole.select(F.monotonically_increasing_id().alias("vid"), "digest", "dim", F.col("vec_id").alias("least"), "norm", "vector", "ids", "asks"), "distinct-vectors", keep=True)


def _planned(plans: dict[int, Plan], what: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for d, p in plans.items() for x in (d, getattr(p, what))]), F.col("dim"))


def _dealt(vectors: DataFrame, asked: DataFrame, plans: dict[int, Plan], turn: int | None = None) -> DataFrame:
    """The vectors of each block with the queries that visit it: of all blocks, or those of the first round or of the others."""
    begin, end = F.lit(0) if turn != 1 else _planned(plans, "first"), _planned(plans, "first" if turn == 0 else "blocks")
    parts = _planned(plans, "parts") if turn == 0 else F.lit(1)
    numbers = lambda low, n: F.explode(F.sequence(low, n - 1))
    none = lambda kind: F.lit(None).cast(kind)
    block = F.pmod(F.xxhash64("vid"), _planned(plans, "blocks")).cast("int")
    own = vectors.withColumn("block", block).filter((F.col("block") >= begin) & (F.col("block") < end)).withColumn("part", numbers(F.lit(0), parts))
    own = own.select("dim", "block", "part", F.lit(0).alias("asks"), "vid", "least", "vector", none("binary").alias("codes"), none("int").alias("level"), none("double").alias("floor"))
    wanted = asked.filter(begin < end).withColumn("block", numbers(begin, end)).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vid"), parts).cast("int"))
    wanted = wanted.select("dim", "block", "part", F.lit(1).alias("asks"), "vid", none("long").alias("least"), "vector", "codes", "level", "floor")
    units = sum(p.blocks if turn is None else p.first * p.parts if turn == 0 else p.blocks - p.first for p in plans.values())
    count = min(3 * units, max(3 * cores_of(vectors.sparkSession), units))  # so that few tasks have two units while others have none
    return own.unionByName(wanted).repartition(count, *UNIT[:3]).sortWithinPartitions(*UNIT)


def cores_of(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def levels_of(vectors: DataFrame, asked: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """(vid, level): the digits that candidates share with each query where its ascent ends."""
    rows = _dealt(vectors, asked.withColumns({"level": F.lit(None).cast("int"), "floor": F.lit(None).cast("double")}), plans)
    sums = rows.mapInArrow(lambda batches: _counts(batches, plans), "vid long, level int, n long").groupBy("vid", "level").agg(F.sum("n").alias("n"))
    enough = asked.select("vid", "dim").join(sums, "vid", "left").groupBy("vid").agg(F.max(F.when(F.col("n") >= _planned(plans, "target"), F.col("level"))).alias("level"))
    return enough.select("vid", F.coalesce("level", F.lit(0)).alias("level"))


def neighbours(spark: SparkSession, embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score; queries are the rows whose vec_id is divisible by `every`."""
    rows = usable(embeddings).filter(F.exists("embedding", lambda x: x != 0))
    with step(spark):
        with step(spark):  # shuffles of a pass go when it ends
            pairs, vectors = distinct_vectors(rows, k, every)
            queries = saved(pairs.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "digest").join(vectors.select("vid", "digest"), "digest").select("query_id", "vid"), "queries", keep=True)
        plans = {r["dim"]: Plan(r["n"], r["norm"], r["dim"], cores_of(spark)) for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).collect()}  # one for each length
        if not plans:
            return saved(queries.select("query_id", F.lit(1).alias("rank"), F.col("vid").alias("vec_id"), F.lit(0.0).alias("score")), "neighbours", keep=True)
        data = vectors.select("vid", "dim", "least", "vector")
        asked = mapped(vectors.filter("asks").select("vid", "dim", "vector"), lambda batches: _strings(batches, plans), _ASKED, "asked")
        with step(spark):
            levels = saved(levels_of(data, asked, plans), "levels", keep=True)
        visits = saved(asked.join(levels, "vid").withColumn("floor", F.lit(float("-inf"))), "visits")
        order = W.partitionBy("vid").orderBy(F.col("score").desc(), "least", "found")
        best = None
        for turn in (0, 1) if any(p.first < p.blocks for p in plans.values()) else (0,):
            with step(spark):
                if best is not None:
                    floors = best.groupBy("vid").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("least_score"))
                    visits = visits.join(floors, "vid", "left").withColumn("floor", F.coalesce("least_score", "floor")).drop("least_score")
                hits = _dealt(data, visits, plans, turn).mapInArrow(lambda batches: _scores(batches, plans, k + 1), _HITS)
                hits = hits if best is None else hits.unionByName(best)
                best = saved(hits.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).drop("nth"), "best", keep=True)
        lists = best.select("vid", "found", "score").join(vectors.select(F.col("vid").alias("found"), "ids"), "found")
        lists = saved(lists.select("vid", "score", F.explode("ids").alias("id")).select("vid", "score", F.col("id.vec_id").alias("vec_id"), F.col("id.n").alias("n")), "listed")
        found = queries.join(lists, "vid").filter("query_id <> vec_id").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        rank = F.row_number().over(W.partitionBy("query_id", "vid").orderBy(F.col("score").desc(), "vec_id"))
        return saved(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours", keep=True)
