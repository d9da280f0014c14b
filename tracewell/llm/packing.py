"""Operator 6, best-fit packing of documents into sequences of a fixed number of tokens.

A document is its ids and one end id. Only documents longer than a sequence are cut, from the end, so that the first piece
may be shorter and all others fill a sequence. Packing works on the histogram of piece lengths, which has as many entries
as a sequence has tokens at most, whatever the size of the corpus: the configuration linear program is solved by
multiplicative weights on the lengths, a knapsack dynamic program pricing the best configuration in each round; its
solution is rounded and what that leaves goes best fit, longest first, into open and new sequences. A piece finds its place
by its rank among the pieces of its length: ranks are counted in each task, and only counts for (task, length) are summed.

Defined cases: null and empty texts are the end id alone; texts of any length are cut, never shortened; repeated rows are
packed each for itself; an empty table has no pieces; extra columns are ignored; a null doc_id is carried along.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, lean, mapped, saved
from .wordpieces import id_bytes

#: Rounds of multiplicative weights at most, and the step of their exponents.
ROUNDS, ETA = 800, 0.05

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % size or size
    return [(0, min(first, n)), *((at, size) for at in range(first, n, size))] if n else []


def pieces(docs: DataFrame, path: str, pattern: str, size: int, end_id: int) -> DataFrame:
    """Every piece with the checksum of its ids and its rank among those of its length in its task."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        own, part, seen = id_bytes(path, pattern), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = own.encode(text) + end
                for k, (start, length) in enumerate(cut(len(raw) // 4, size)):
                    rows.append((doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])
        id_bytes.cache_clear()  # the worker stays for other tasks
        del own
        give_back()

    return mapped(lean(docs, "doc_id", "text"), run, _PIECES, "pieces")


def _price(value: np.ndarray, size: int) -> Counter:
    """The configuration of largest value: an unbounded knapsack over lengths 1..size; value[l] <= 0 is not for use."""
    best, take = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    gain = np.where(value[1:] > 0, value[1:], -np.inf)
    for room in range(1, size + 1):
        total = gain[:room] + best[room - 1 :: -1] if room < size else gain + best[size - 1 :: -1]
        k = int(total.argmax())
        if total[k] > best[room - 1]:
            best[room], take[room] = total[k], k + 1
        else:
            best[room] = best[room - 1]
    found, room = Counter(), size
    while room > 0:
        if take[room]:
            found[int(take[room])] += 1
            room -= int(take[room])
        else:
            room -= 1
    return found


def fractional(histogram: dict[int, int], size: int, rounds: int = ROUNDS, eta: float = ETA) -> dict[tuple, float]:
    """Configuration -> times it is used, in a solution of the linear program that covers what `rounds` rounds reach."""
    need = np.zeros(size + 1)
    for length, n in histogram.items():
        need[length] = n
    bound = float((need * np.arange(size + 1)).sum()) / size
    # the price of a length starts at its share of a sequence, a little more for long ones: short ones fill gaps later
    price = (np.arange(size + 1) / size) ** 1.05
    weight, covered, spent = np.where(need > 0, price, 0.0), np.zeros(size + 1), 0.0
    used: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        left = need - covered
        if spent >= bound or not (left > 1e-9).any():
            break
        config = _price(np.where(left > 1e-9, weight, 0.0), size)
        if not config:
            break
        step = min(max(bound / rounds, 1.0), *(left[k] / m for k, m in config.items()))
        used[tuple(sorted(config.items(), reverse=True))] += step
        spent += step
        for k, m in config.items():
            covered[k] += m * step
        # lengths behind the share of the bound that is spent gain weight, those ahead lose it
        behind = np.where(need > 0, spent / bound - covered / np.maximum(need, 1e-9), 0.0)
        weight = np.where(need > 0, price * np.exp(eta * behind), 0.0)
    return used


def rounded(histogram: dict[int, int], used: dict[tuple, float], size: int) -> list[tuple[tuple, int]]:
    """(configuration, sequences) that hold every piece exactly once."""
    left = Counter(histogram)
    open_: dict[int, Counter] = defaultdict(Counter)  # room -> configurations with that room

    def put(config: tuple, times: int) -> None:
        open_[size - sum(k * m for k, m in config)][config] += times

    for config, x in sorted(used.items(), key=lambda c: -c[1]):
        # whole parts first; what is left of a configuration is rounded up while its pieces are there
        times = min([math.floor(x + 1e-9), *(left[k] // m for k, m in config)])
        if times > 0:
            put(config, times)
            left.subtract({k: m * times for k, m in config})
    for config, x in sorted(used.items(), key=lambda c: -(c[1] % 1)):
        if x % 1 > 1e-9 and all(left[k] >= m for k, m in config):
            put(config, 1)
            left.subtract(dict(config))
    for length in sorted((k for k, n in left.items() if n > 0), reverse=True):
        n = left[length]
        for room in range(length, size + 1):  # best fit: the tightest room first
            if n <= 0:
                break
            if room == size or not open_.get(room):
                continue
            each = room // length
            for config in list(open_[room]):
                if n < 1:
                    break
                have = open_[room][config]
                full, rest = min(have, n // each), n % each
                moves = [(full, each)] if full else []
                if full < have and n - full * each > 0 and rest:
                    moves.append((1, rest))
                for times, m in moves:
                    grown = Counter(dict(config))
                    grown[length] += m
                    open_[room][config] -= times
                    put(tuple(sorted(grown.items(), reverse=True)), times)
                    n -= times * m
                if not open_[room][config]:
                    del open_[room][config]
        each = size // length
        if n >= each:
            put(((length, each),), n // each)
        if n % each:
            put(((length, n % each),), 1)
    return [(c, t) for room in sorted(open_) for c, t in sorted(open_[room].items()) if t > 0]


def places(plan: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length, in order of (length, first rank), where its pieces go."""
    taken: Counter = Counter()
    rows, base = [], 0
    for config, times in plan:
        at = 0
        for length, m in config:
            rows.append((length, taken[length], base, m, at))
            taken[length] += m * times
            at += m * length
        base += times
    rows.sort()
    out = np.array(rows, np.int64).reshape(-1, 5)
    return {k: out[:, i] for i, k in enumerate(("length", "first", "sequence", "each", "offset"))}


def best_fit_packing(spark: SparkSession, docs: DataFrame, path: str, pattern: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece with its sequence and its place there."""
    found = pieces(docs, path, pattern, size, end_id)
    counts = saved(found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    plan = places(rounded(histogram, fractional(histogram, size), size))
    shift = 1 << 44
    keys = plan["length"] * shift + plan["first"]
    before = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def run(batches):
        for batch in batches:
            t = pa.table(batch)
            length, rank = t["length"].to_numpy(), t["before"].to_numpy() + t["local"].to_numpy()
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            nth = rank - plan["first"][at]
            t = t.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            t = t.append_column("sequence_id", pa.array(plan["sequence"][at] + nth // plan["each"][at], pa.int64()))
            t = t.append_column("offset", pa.array(plan["offset"][at] + nth % plan["each"][at] * length, pa.int64()))
            yield from t.to_batches()

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return found.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "local", "before").mapInArrow(run, out)
