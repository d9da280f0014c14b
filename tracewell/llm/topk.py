"""Operator 2, exact top-k search by inner product with ball trees.

Vectors become integers, floor(64 * x). Cells of space, from median splits of a bounded sample (SAMPLE), deal the candidates
into shards; a cell of many vectors is split by a hash, so shards have a bounded size whatever repeats. Each shard has a ball
tree. A node's bound for a query is the inner product with its centre plus its radius times the query's norm, and a slack for
what rounding may lose. Queries are dealt into blocks of bounded size. In a tree, a block visits nodes in the order of their
bounds; at each node, inner or leaf, the queries whose current k-th score is above the bound leave, and every leaf raises
that score.

Shards share it too: blocks visit shards in rounds, first the one with the largest bound at its root, then a few more, then
all others, and before each round the k-th scores found so far in all shards drop the pairs of blocks and shards that can't
matter, before any vector moves. A round sends each tree once, followed by the blocks that visit it. What shards return is at
most k rows for a query, and only those that can still be among its k best. Ties go to smaller vec_id.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, neither as query nor candidate;
vectors meet only vectors of their own length; a query never meets rows of its own vec_id; other rows that repeat a vector
or a vec_id are candidates each for itself, and a vec_id that repeats among the queries is asked once with each different
vector; a null vec_id takes no part; with fewer candidates than k all are returned; extra columns are ignored. Sums must
fit a long.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, saved, step, tune

#: Candidates of a shard, queries of a block and candidates of a leaf, about.
SHARD, BLOCK, LEAF = 8192, 1024, 256
#: Vectors from which the cells are made, and of these at least in a cell.
SAMPLE, LEAST_IN_CELL = 16_384, 64
#: Roots of shards that are compared with a block at once, and shards that a block visits in each round but the last.
PACK, VISITS = 1024, (1, 4)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, embedding) of the vectors that take part, as doubles."""
    rows = lean(rows, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).withColumn("dim", F.size("embedding"))


def integers(vectors) -> np.ndarray:
    return np.floor(64.0 * np.array(list(map(np.asarray, vectors)), np.float64)).astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


class Cells:
    """Median splits along the widest axis of a sample, in heap order; an axis of -1 sends all to the left."""

    def __init__(self, sample: np.ndarray, cells: int):
        depth = max(0, int(np.ceil(np.log2(max(1, min(cells, len(sample) // LEAST_IN_CELL))))))
        self.axes, self.cuts = np.full(2**depth - 1, -1), np.zeros(2**depth - 1)
        todo = [(0, sample)]
        while todo:
            node, own = todo.pop()
            if node >= len(self.axes):
                continue
            if len(own) and own.shape[1]:
                self.axes[node] = axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.cuts[node] = np.median(own[:, axis])
                right = own[:, axis] > self.cuts[node]
                todo += [(2 * node + 1, own[~right]), (2 * node + 2, own[right])]

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range((len(self.axes) + 1).bit_length() - 1):
            axis = self.axes[node]
            node = 2 * node + 1 + ((axis >= 0) & (x[np.arange(len(x)), np.maximum(axis, 0)] > self.cuts[node]) if x.shape[1] else 0)
        return node - len(self.axes)


def upper_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball, a number that no inner product with an integer vector in the ball exceeds; -inf for empty balls.

    Rounding, also that of long integers to doubles and of the radii, moves the sums by less than the slack.
    """
    exact = q.astype(np.float64)
    norms = np.sqrt((exact**2).sum(axis=1))
    sizes = np.sqrt((centres**2).sum(axis=1)) + np.maximum(radii, 0)
    up = exact @ centres.T + norms[:, None] * radii[None, :]
    up += norms[:, None] * sizes[None, :] * ((q.shape[1] + 16) * 2.0**-50) + 2.0**-20
    up[:, radii < 0] = -np.inf
    return up


class BallTree:
    """Nodes in heap order over a permutation of the rows; leaves hold `LEAF` rows at most."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
        pieces = []
        self.centres, self.radii = np.zeros((2 ** (depth + 1) - 1, x.shape[1])), np.full(2 ** (depth + 1) - 1, -1.0)

        def grow(node: int, level: int, rows: np.ndarray) -> None:
            own = x[rows].astype(np.float64)
            if len(rows):
                self.centres[node] = own.mean(axis=0)
                self.radii[node] = np.sqrt(((own - self.centres[node]) ** 2).sum(axis=1).max()) * (1 + 1e-12)
            if level == depth:
                pieces.append(rows)
                return
            half = len(rows) // 2
            if x.shape[1] and len(rows):
                along = own[:, np.argmax(own.max(axis=0) - own.min(axis=0))]
                rows = rows[np.argpartition(along, half)] if half else rows
            grow(2 * node + 1, level + 1, rows[:half])
            grow(2 * node + 2, level + 1, rows[half:])

        grow(0, 0, np.arange(len(x)))
        self.first = 2**depth - 1
        self.leaves = [(ids[p], narrow(x[p])) for p in pieces]
        self.largest = int(np.abs(x).max()) if x.size else 0

    def bounds(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return upper_bounds(q, self.centres[nodes], self.radii[nodes])


def best_of(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each owner: larger scores first, then smaller ids."""
    order = np.lexsort((ids, -score, owner))
    start = np.flatnonzero(np.concatenate([[True], owner[order][1:] != owner[order][:-1]])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def raised(floor: np.ndarray, top: tuple, k: int) -> np.ndarray:
    """The floors after `top`, rows in the order of best_of: a query with k rows needs at least the score of its last."""
    n = np.bincount(top[0], minlength=len(floor))
    full, last = n >= k, np.cumsum(n) - 1
    out = floor.copy()
    out[full] = np.maximum(out[full], top[1][last[full]])
    return out


def search(tree: BallTree, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, visited: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, score, candidate id) of the k best of each query among those with a score of at least its floor.

    Nodes wait in the order of their largest bound; `visited` gets (leaf, queries) of every leaf that is read.
    """
    top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    small = q.shape[1] * max(1, tree.largest) * max(1, int(np.abs(q).max()) if q.size else 1) < 2**52  # doubles are exact
    asked = q.astype(np.float64 if small else np.int64)
    waiting: list = []

    def wait(node: int, who: np.ndarray, up: np.ndarray) -> None:
        open_ = up >= floor[who]
        if open_.any():
            heapq.heappush(waiting, (-float(up[open_].max()), node, who[open_], up[open_]))

    if len(q):
        wait(0, np.arange(len(q)), tree.bounds(q, [0])[:, 0])
    while waiting:
        _, node, who, up = heapq.heappop(waiting)
        open_ = up >= floor[who]  # floors have risen since
        who, up = who[open_], up[open_]
        if not len(who):
            continue
        if node < tree.first:
            children = [2 * node + 1, 2 * node + 2]
            both = np.minimum(tree.bounds(q[who], children), up[:, None])
            for child, own in zip(children, both.T, strict=True):
                wait(child, who, own)
            continue
        ids, x = tree.leaves[node - tree.first]
        if visited is not None:
            visited.append((node - tree.first, len(who)))
        scores = asked[who] @ x.astype(asked.dtype).T
        i, j = np.nonzero((scores >= floor[who][:, None]) & (ids[None, :] != qids[who][:, None]))
        found = [np.concatenate(c) for c in zip(top, (who[i], scores[i, j].astype(np.int64), ids[j]), strict=True)]
        keep = best_of(*found, k)
        top = tuple(c[keep] for c in found)
        floor = raised(floor, top, k)
    return top


_TREE, _BLOCKS = "dim int, shard long, root binary, tree binary", "dim int, block int, queries binary"
_HITS = "query_id long, variant int, vec_id long, score long"
_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _tree(part: pd.DataFrame) -> pd.DataFrame:
    ids = part["vec_id"].to_numpy(np.int64)
    tree = BallTree(ids, integers(part["embedding"]).reshape(len(ids), -1))
    return pd.DataFrame([[part["dim"].iloc[0], part["shard"].iloc[0], pickle.dumps((tree.centres[0], tree.radii[0])), pickle.dumps(tree)]], columns=["dim", "shard", "root", "tree"])


def _block(part: pd.DataFrame) -> pd.DataFrame:
    """Different (vec_id, vector) pairs of a block, numbered where a vec_id has several vectors, with their floors and best rows."""
    ids = part["vec_id"].to_numpy(np.int64)
    x = integers(part["embedding"]).reshape(len(ids), -1)
    both = np.unique(np.c_[ids, x], axis=0)
    ids, x = both[:, 0], both[:, 1:]
    variant = np.arange(len(ids)) - np.searchsorted(ids, ids)
    data = pickle.dumps((ids, variant, narrow(x), np.full(len(ids), -np.inf), _NONE))
    return pd.DataFrame([[part["dim"].iloc[0], part["block"].iloc[0], data]], columns=["dim", "block", "queries"])


def _pack(part: pd.DataFrame) -> pd.DataFrame:
    centres, radii = zip(*map(pickle.loads, part["root"]), strict=True)
    return pd.DataFrame([[part["dim"].iloc[0], pickle.dumps((part["shard"].to_numpy(), np.array(centres), np.array(radii)))]], columns=["dim", "roots"])


def _open_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks and the shards whose roots are above the floor of some query."""
    for part in batches:
        for r in part.itertuples(index=False):
            (_, _, q, floor, _), (shards, centres, radii) = pickle.loads(r.queries), pickle.loads(r.roots)
            up = upper_bounds(q, centres, radii)
            good = (up >= floor[:, None]).any(axis=0)
            yield pd.DataFrame({"dim": r.dim, "block": r.block, "shard": shards[good], "bound": up.max(axis=0)[good]})


def _visits(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Each tree comes before the blocks that visit it."""
    tree, now = None, None
    for part in batches:
        for r in part.itertuples(index=False):
            if r.kind == 0:
                tree, now = pickle.loads(r.data), (r.dim, r.shard)
                continue
            assert now == (r.dim, r.shard)
            ids, variant, q, floor, _ = pickle.loads(r.data)
            yield pd.DataFrame([[r.dim, r.block, pickle.dumps(search(tree, ids, q.astype(np.int64), floor, k))]], columns=["dim", "block", "hits"])


def _merged(part: pd.DataFrame, k: int) -> pd.DataFrame:
    """A block with what its visits of one round found."""
    ids, variant, q, floor, top = pickle.loads(part["queries"].dropna().iloc[0])
    found = [np.concatenate(c) for c in zip(top, *map(pickle.loads, part["hits"].dropna()), strict=True)]
    keep = best_of(*found, k)
    top = tuple(c[keep] for c in found)
    return pd.DataFrame([[part["dim"].iloc[0], part["block"].iloc[0], pickle.dumps((ids, variant, q, raised(floor, top, k), top))]], columns=["dim", "block", "queries"])


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        for r in part.itertuples(index=False):
            ids, variant, _, _, top = pickle.loads(r.queries)
            own = top if r.hits is None else pickle.loads(r.hits)
            yield pd.DataFrame({"query_id": ids[own[0]], "variant": variant[own[0]].astype(np.int32), "vec_id": own[2], "score": own[1]})


def shards_of(rows: DataFrame, n: int) -> DataFrame:
    """(vec_id, dim, embedding, shard) of every candidate."""
    drawn: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
        drawn.setdefault(r["dim"], []).append(r["embedding"])
    cells = {dim: Cells(integers(v).reshape(len(v), -1), -(-n // SHARD)) for dim, v in drawn.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            cell = np.zeros(len(part), np.int64)
            for dim, at in part.groupby("dim").indices.items():
                if dim in cells:
                    cell[at] = cells[dim].of(integers(part["embedding"].iloc[at]).reshape(len(at), -1))
            yield part.assign(cell=cell)

    placed = saved(rows.mapInPandas(place, "vec_id long, embedding array<double>, dim int, cell long"), "placed-vectors", keep=True)
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("parts"))
    deal = F.pmod(F.xxhash64("vec_id", F.hash("embedding")), F.col("parts"))
    return placed.join(parts, ["dim", "cell"]).select("vec_id", "dim", "embedding", (F.col("cell") * (1 << 32) + deal).alias("shard"))


def top_k(spark: SparkSession, embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score; queries are the rows whose vec_id is divisible by `every`."""
    rows = usable(embeddings)
    n = rows.count()
    blocks = max(1, -(-n // every // BLOCK))
    with step(spark):
        trees = saved(shards_of(rows, n).groupBy("dim", "shard").applyInPandas(_tree, _TREE), "ball-trees")
        packs = F.pmod(F.xxhash64("shard"), F.lit(max(1, -(-trees.count() // PACK))))
        roots = saved(trees.groupBy("dim", packs.alias("pack")).applyInPandas(_pack, "dim int, roots binary"), "roots")
        asked = rows.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        waiting = saved(asked.groupBy("dim", "block").applyInPandas(_block, _BLOCKS), "blocks")
        done = None
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # rows here are whole shards and blocks
        try:
            for visits in (*VISITS, None):
                pairs = waiting.join(roots, "dim").mapInPandas(_open_pairs, "dim int, block int, shard long, bound double")
                pairs = pairs if done is None else pairs.join(done, ["dim", "block", "shard"], "left_anti")
                if visits:
                    first = W.partitionBy("dim", "block").orderBy(F.col("bound").desc(), "shard")
                    pairs = pairs.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= visits)
                pairs = saved(pairs.select("dim", "block", "shard"), "visits")
                done = pairs if done is None else done.unionByName(pairs)
                of = trees.join(pairs.select("dim", "shard").distinct(), ["dim", "shard"]).select("dim", "shard", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("block"), F.col("tree").alias("data"))
                work = of.unionByName(pairs.join(waiting, ["dim", "block"]).select("dim", "shard", F.lit(1).alias("kind"), "block", F.col("queries").alias("data")))
                work = work.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "block")
                found = saved(work.mapInPandas(lambda batches: _visits(batches, k), "dim int, block int, hits binary"), "found")
                if visits:
                    state = waiting.select("*", F.lit(None).cast("binary").alias("hits")).unionByName(found.select("dim", "block", F.lit(None).cast("binary").alias("queries"), "hits"))
                    waiting = saved(state.groupBy("dim", "block").applyInPandas(lambda part: _merged(part, k), _BLOCKS), "blocks")
            every_ = waiting.select("queries", F.lit(None).cast("binary").alias("hits")).unionByName(found.join(waiting, ["dim", "block"]).select("queries", "hits"))
            hits = saved(every_.mapInPandas(_unpacked, _HITS), "hits", keep=True)
        finally:
            tune(spark)
    w = W.partitionBy("query_id", "variant").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
