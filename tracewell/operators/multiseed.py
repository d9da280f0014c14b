"""Searches upstream of many targets at once, within budgets (GRA2, GRA7, GRA9, ENR14).

A node keeps the targets that have reached it as bits: one row for each (node, word), a word being 63 targets, instead of one for
each (target, node). What a hop finds is merged by bitwise or, so what moves is the new bits of nodes, packed; the same aggregate
takes off what has been seen.

Budgets end a search early in a fixed order: a target's rows are kept by hop, then by name, up to `limit_rows`; the edges that all
targets may follow in sum up to `max_edges`; physical sources may stop it. What is cut is listed, so nothing goes missing unsaid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialized, spread

#: Targets in a word of bits; the sign stays unused.
WORD = 63


def _numbered(seeds: DataFrame) -> DataFrame:
    """(seed, number): dense numbers from 0, by partitions whose sizes the driver sums."""
    rows = materialized(seeds.filter("seed IS NOT NULL").select("seed").distinct().withColumn("at", F.monotonically_increasing_id()), "seeds")
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one for each partition
    starts, total = {}, 0
    for r in sizes:
        starts[r["part"]], total = total, total + r["n"]
    if not starts:
        return rows.select("seed", F.col("at").alias("number"))
    start = F.element_at(F.create_map(*[F.lit(x) for p in starts.items() for x in p]), part)
    return rows.select("seed", (start + F.col("at").bitwiseAND((1 << 33) - 1)).alias("number"))


def bit_reach(edges: DataFrame, seeds: DataFrame, max_hops: int = 10, near: str = "target", far: str = "source") -> tuple[DataFrame, DataFrame]:
    """(node, word, bits, hop): the targets that first reach each node at each hop; and (seed, number): target n is bit n % 63 of word n // 63."""
    steps = materialized(edges.select(F.col(near).alias("near"), F.col(far).alias("far")).filter("near IS NOT NULL AND far IS NOT NULL"), "steps")
    with spread(steps):
        # many edges between the same two nodes change no bits, so only what is kept for all hops is made distinct
        kept = steps.repartition("near").distinct().sortWithinPartitions("near").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return _hops(kept, materialized(_numbered(seeds), "seed-numbers"), max_hops)
        finally:
            kept.unpersist()


def _hops(steps: DataFrame, numbers: DataFrame, max_hops: int) -> tuple[DataFrame, DataFrame]:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % WORD).cast("int"))
    front = numbers.groupBy(F.col("seed").alias("node"), F.floor(F.col("number") / WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))
    front = materialized(front, "bits")
    every, seen, hop, none = front.withColumn("hop", F.lit(0)), front, 0, F.lit(None).cast("long")
    while hop < max_hops and not front.isEmpty():
        hop += 1
        new = steps.join(front, steps["near"] == front["node"]).select(F.col("far").alias("node"), "word", "bits", none.alias("had"))
        # one aggregate merges what the hop finds and what earlier hops had
        both = new.unionByName(seen.select("node", "word", none.alias("bits"), F.col("bits").alias("had"))).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("had").alias("had"))
        fresh = both.select("node", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("bits")).filter("bits <> 0")
        front = materialized(fresh, "bits")
        seen = seen.unionByName(front)
        every = every.unionByName(front.withColumn("hop", F.lit(hop)))
    return every, numbers


def expanded(found: DataFrame, numbers: DataFrame) -> DataFrame:
    """(seed, node, hop) of (node, word, bits, hop)."""
    listed = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.call_function("getbit", "bits", k) == 1)
    one = found.withColumn("k", F.explode(listed)).select("node", "hop", (F.col("word") * WORD + F.col("k")).alias("number"))
    return one.join(numbers, "number").select("seed", "node", "hop")


def reached_by(found: DataFrame) -> DataFrame:
    """(node, n_seeds, least_hop): how many targets reach each node, without listing them."""
    return found.groupBy("node").agg(F.sum(F.bit_count("bits")).alias("n_seeds"), F.min("hop").alias("least_hop"))


def reach_sizes(found: DataFrame, numbers: DataFrame) -> DataFrame:
    """(seed, hop, n): how many nodes each target reaches at each hop; bits are counted by place before the shuffle."""
    places = [F.sum(F.call_function("getbit", "bits", F.lit(k)).cast("long")).alias(f"n{k}") for k in range(WORD)]
    counts = found.groupBy("word", "hop").agg(*places)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("n")) for k in range(WORD)]))
    rows = counts.select("word", "hop", each.alias("p")).filter("p.n > 0").select((F.col("word") * WORD + F.col("p.k")).alias("number"), "hop", F.col("p.n").alias("n"))
    return rows.join(numbers, "number").select("seed", "hop", "n")


@dataclass
class Budgets:
    """None is no limit. `physical` is a condition on the column node at which a search stops."""

    limit_rows: int | None = None
    max_edges: int | None = None
    max_hops: int = 10
    physical: F.Column | None = None


def budgeted(edges: DataFrame, seeds: DataFrame, budgets: Budgets, near: str = "target", far: str = "source") -> tuple[DataFrame, DataFrame]:
    """(seed, node, hop) within the budgets, and (seed, node, hop, reason): what they cut.

    Reasons: ROWS, the target had its rows; EDGES, a hop for which the rest of the edge budget was too small isn't begun, and
    its nodes are listed; HOPS, one hop too far; STOP, what a physical source would lead to. A cut node leads no further.
    """
    steps = materialized(edges.select(F.col(near).alias("near"), F.col(far).alias("far")).filter("near IS NOT NULL AND far IS NOT NULL").distinct(), "steps")
    front = materialized(seeds.filter("seed IS NOT NULL").select("seed", F.col("seed").alias("node")).distinct(), "front")
    kept, gone, seen, spent, hop = front.withColumn("hop", F.lit(0)), None, front, 0, 0
    used = front.groupBy("seed").agg(F.count(F.lit(1)).alias("used"))

    def cut(rows: DataFrame, reason: str) -> None:
        nonlocal gone
        own = rows.select("seed", "node", F.lit(hop).alias("hop"), F.lit(reason).alias("reason"))
        gone = own if gone is None else gone.unionByName(own)

    while not front.isEmpty():
        hop += 1
        stops = F.coalesce(budgets.physical, F.lit(False)) if budgets.physical is not None else F.lit(False)
        followed = materialized(front.withColumn("stop", stops).join(steps, front["node"] == steps["near"]).select("seed", F.col("far").alias("node"), "stop"), "followed")
        new = followed.groupBy("seed", "node").agg(F.bool_and("stop").alias("stop")).join(seen, ["seed", "node"], "left_anti")
        new = materialized(new, "front")
        if budgets.physical is not None:
            cut(new.filter("stop"), "STOP")
        new = new.filter("NOT stop").select("seed", "node")
        if hop > budgets.max_hops:
            cut(new, "HOPS")
            break
        n = followed.filter("NOT stop").count() if budgets.max_edges is not None else 0
        if budgets.max_edges is not None and spent + n > budgets.max_edges:
            cut(new, "EDGES")
            break
        spent += n
        if budgets.limit_rows is not None:
            # distinct names of one hop and target are ranked; what is over the limit in any case goes before the shuffle
            place = F.row_number().over(_by_name())
            ranked = new.withColumn("place", place).join(used, "seed", "left").withColumn("fits", F.col("place") + F.coalesce("used", F.lit(0)) <= budgets.limit_rows)
            ranked = materialized(ranked, "ranked")
            cut(ranked.filter("NOT fits"), "ROWS")
            new = ranked.filter("fits").select("seed", "node")
        front = materialized(new, "front")
        seen, kept = seen.unionByName(front), kept.unionByName(front.withColumn("hop", F.lit(hop)))
        if budgets.limit_rows is not None:
            used = materialized(kept.groupBy("seed").agg(F.count(F.lit(1)).alias("used")), "used")
    if gone is None:
        gone = front.select("seed", "node", F.lit(0).alias("hop"), F.lit("").alias("reason")).filter("false")
    # a node cut in one way may be reached in another later
    return kept, gone.join(kept.select("seed", "node"), ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.min(F.struct("hop", "reason")).alias("c")).select("seed", "node", "c.hop", "c.reason")


def _by_name():
    from pyspark.sql import Window

    return Window.partitionBy("seed").orderBy("node")
