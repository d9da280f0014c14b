"""Bits of many targets against plain searches, and budgets whose cuts account for every missing row."""

import contextlib
import random

from pyspark.sql import functions as F

from tracewell.operators import multiseed


def hops(pairs, seeds):
    out = {}
    for s in seeds:
        front, seen, hop = {s}, {s}, 0
        while front:
            out.update({(s, n): hop for n in front})
            front = {b for a, b in pairs if a in front} - seen
            seen |= front
            hop += 1
    return out


def test_bits_equal_plain_searches(spark):
    r = random.Random(4)
    pairs = {(f"n{r.randint(0, 90)}", f"n{r.randint(0, 90)}") for _ in range(110)} | {("n1", "n1"), ("n2", "n1"), ("n1", "n2")}
    seeds = [f"n{k}" for k in range(80)] + ["absent"]
    df = spark.createDataFrame([*pairs, (None, "n1"), ("n1", None)], "target string, source string").repartition(3)
    found, numbers = multiseed.bit_reach(df, spark.createDataFrame([(s,) for s in [*seeds, "n3", None]], "seed string").repartition(3), 100)
    want = hops(pairs, seeds)
    got = multiseed.expanded(found, numbers).collect()
    assert len(got) == len(want) and {(x["seed"], x["node"]): x["hop"] for x in got} == want
    assert {(x["node"], x["n_seeds"]) for x in multiseed.reached_by(found).collect()} == {(n, sum(k[1] == n for k in want)) for n in {k[1] for k in want}}
    assert {(x["seed"], x["hop"]): x["n"] for x in multiseed.reach_sizes(found, numbers).collect()} == {(s, h): sum(k[0] == s and v == h for k, v in want.items()) for s, h in {(k[0], v) for k, v in want.items()}}


def test_budgets_tell_what_they_cut(spark):
    pairs = [("a", "b1"), ("a", "b2"), ("a", "DWH.P"), ("b1", "c1"), ("b2", "c2"), ("c1", "d"), ("DWH.P", "e"), ("z", "c1")]
    df, seeds = spark.createDataFrame(pairs, "target string, source string"), spark.createDataFrame([("a",), ("z",)], "seed string")

    def run(**limits):
        kept, gone = multiseed.budgeted(df, seeds, multiseed.Budgets(**limits))
        return {(r["seed"], r["node"]) for r in kept.collect()}, {(r["seed"], r["node"], r["hop"], r["reason"]) for r in gone.collect()}

    every = {(s, n) for s, n in hops(pairs, ["a", "z"])}
    assert run() == (every, set())
    assert run(physical=F.col("node").startswith("DWH.")) == (every - {("a", "e")}, {("a", "e", 2, "STOP")})
    assert run(max_hops=1) == ({k for k, h in hops(pairs, ["a", "z"]).items() if h <= 1}, {("a", "c1", 2, "HOPS"), ("a", "c2", 2, "HOPS"), ("a", "e", 2, "HOPS"), ("z", "d", 2, "HOPS")})
    kept, gone = run(limit_rows=3)
    assert kept == {("a", "a"), ("a", "DWH.P"), ("a", "b1"), ("z", "z"), ("z", "c1"), ("z", "d")} and gone == {("a", "b2", 1, "ROWS"), ("a", "e", 2, "ROWS"), ("a", "c1", 2, "ROWS")}
    kept, gone = run(max_edges=5)
    assert {h for _, _, h, _ in gone} == {2} and {x for _, _, _, x in gone} == {"EDGES"} and len(kept) == 6


def test_bits_of_many_equal_edges_are_shuffled_into_parts_by_rows(spark, monkeypatch):
    from tracewell import storage

    set_to, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    real = storage.spread.__wrapped__

    @storage.contextmanager
    def small(table, rows=100):
        with contextlib.contextmanager(real)(table, rows):
            set_to.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
            yield

    monkeypatch.setattr(multiseed, "spread", small)
    edges = spark.createDataFrame([(f"a{k % 5}", f"b{k % 3}") for k in range(1000)] + [("b0", "a0"), ("b1", "c")], "target string, source string")
    found, numbers = multiseed.bit_reach(edges, spark.createDataFrame([("a0",), ("a1",), ("b1",)], "seed string"))
    got = {tuple(r) for r in multiseed.expanded(found, numbers).collect()}
    want = {("a0", "a0", 0), ("a1", "a1", 0), ("b1", "b1", 0), ("b1", "c", 1)}
    want |= {(a, f"b{k}", 1) for a in ("a0", "a1") for k in range(3)} | {(a, "c", 2) for a in ("a0", "a1")} | {("a1", "a0", 2)}
    assert got == want
    assert set_to == [11] and spark.conf.get("spark.sql.shuffle.partitions") == before
