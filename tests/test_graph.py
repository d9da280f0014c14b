"""Graph operators on literal graphs: diamond, cycle, self-loop, hop bound, base names."""

import random

import pytest

from tracewell.operators import graph
from tracewell.operators import rows as rows_


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "target string, source string")


def seeds(spark, *names, column="seed"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_diamond_keeps_the_smallest_hop(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"))
    assert rows(graph.reach(e, seeds(spark, "a")), "node", "hop") == [("a", 0), ("b", 1), ("c", 1), ("d", 1)]
    assert rows(graph.closure(e), "node", "ancestor") == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("c", "d")]


def test_cycles_end_and_are_their_own_ancestors(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("c", "c"), (None, "x"), ("y", None))
    assert rows(graph.reach(e, seeds(spark, "a", "c")), "seed", "node", "hop") == [("a", "a", 0), ("a", "b", 1), ("c", "c", 0)]
    assert rows(graph.closure(e), "node", "ancestor") == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")]
    assert rows(graph.paths(e, seeds(spark, "a")), "node", "depth") == [("a", 0), ("b", 1)]


def test_closure_writes_no_pairs_of_last_sources(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "tracewell"
    before = set(shared.glob("closure-*"))
    r = random.Random(7)
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("v", "a"), ("v", "b"), *[("c", f"x{k}") for k in range(300)], *[(r.choice("abcv"), f"y{k % 9}") for k in range(40)], *[("y1", "y2"), ("y2", "y1"), ("y1", "y1")]]
    want = {(t, s) for t, s in pairs}
    while more := {(n, s) for n, a in want for t, s in pairs if t == a} - want:
        want |= more
    got = rows(graph.closure(edges(spark, *pairs, *pairs)), "node", "ancestor")
    assert got == sorted(want)
    assert rows(graph.closure(edges(spark, *pairs), seeds(spark, "v", "y1", column="node")), "node", "ancestor") == sorted(p for p in want if p[0] in ("v", "y1"))
    made = set(shared.glob("closure-*")) - before
    assert sum(spark.read.parquet(str(m)).count() for m in made if list(m.glob("*.parquet"))) < 3 * 300 < len(want)


def test_hop_bound_and_empty_graph(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"))
    assert rows(graph.reach(e, seeds(spark, "a"), 2), "node") == [("a",), ("b",), ("c",)]
    none = spark.createDataFrame([], "target string, source string")
    assert rows(graph.reach(none, seeds(spark, "a")), "node") == [("a",)]
    assert graph.closure(none).count() == 0
    assert graph.reach(e, spark.createDataFrame([], "seed string")).count() == 0


def test_layers_bottom_up(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"))
    assert rows(graph.bottom_up(e), "node", "layer") == [("a", 2), ("b", 1), ("c", 0)]


def test_terminals_and_tree(spark):
    e = edges(spark, ("A", "b"), ("B", "c"))
    hops = graph.hop_map(e, seeds(spark, "a", column="target_table"))
    assert rows(graph.terminal_sources(e, hops), "table") == [("C",)]
    assert rows(graph.upstream_tree(e, hops), "table", "parent") == [("A", "B"), ("B", "C")]


def test_trace_falls_back_to_base_names(spark):
    columns = "row_seq long, source_file string, xpath string, transformation_type string, current_node string, parent_input_object string, source_object string, source_column string, target_column string, formula string, filter_expression string, join_expression string, join_left_object string, join_left_column string, join_right_object string, join_right_column string"
    n = "<NULL>"
    data = [
        (1, "f", "1", "Mapping", "V1", "#P", n, "X", "T", n, n, n, n, n, n, n),  # #P.X is no target: every *.X is meant
        (2, "f", "2", "Mapping", "P", "Q", n, "Y", "X", n, n, n, n, n, n, n),
        (3, "f", "3", "Mapping", "R", "S", n, "Z", "X", "SUM(\"Q.Y\")", n, n, n, n, n, n),
        (4, "f", "4", "Mapping", "Q", "B", n, "W", "Y", n, n, n, n, n, n, n),
    ]
    df = spark.createDataFrame(data, columns)
    got = rows(graph.column_trace(df, seeds(spark, "V1.T", column="target")), "row_seq", "trace_depth", "trace_reason", "trace_match")
    assert got == [(1, 0, "STRUCTURAL", "EXACT"), (2, 1, "STRUCTURAL", "PARENT"), (3, 1, "FORMULA", "PARENT"), (4, 2, "STRUCTURAL", "PARENT")]
    assert rows(graph.column_trace(df, seeds(spark, "X", column="target"), 0), "row_seq", "trace_match") == [(2, "BASE"), (3, "BASE")]


def test_trace_resolves_only_what_it_reaches(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "tracewell"
    columns = "row_seq long, source_file string, xpath string, transformation_type string, current_node string, parent_input_object string, source_object string, source_column string, target_column string, formula string, filter_expression string, join_expression string, join_left_object string, join_left_column string, join_right_object string, join_right_column string"
    n = "<NULL>"
    row = lambda k, node, source: (k, "f", node, "Mapping", node, source, n, f"T{source}", f"T{node.strip()}", n, n, n, n, n, n, n)
    data = [row(1, "A", "B"), row(2, "B", "C"), row(9, "B", "C"), row(3, "B ", "D"), *[row(100 + k, f"X{k}", f"Y{k}") for k in range(300)]]
    df = spark.createDataFrame(data, columns)
    before = set(shared.glob("trace-terms-*"))
    got = rows(graph.column_trace(df, seeds(spark, "A.TA", column="target")), "row_seq", "trace_depth", "trace_match")
    assert got == [(1, 0, "EXACT"), (2, 1, "PARENT"), (3, 1, "PARENT")]  # of equal rows the first
    made = set(shared.glob("trace-terms-*")) - before
    assert made and sum(spark.read.parquet(str(m)).count() for m in made) < 10


def test_cluster_collapse(spark):
    e = spark.createDataFrame([("s", "m1"), ("s", "m2"), ("m1", "t"), ("c", "t")], "src string, tgt string")
    m = spark.createDataFrame([("m1", "c"), ("m2", "c")], "member string, cluster string")
    assert rows(graph.collapse_clusters(e, m), "src", "tgt") == [("c", "t"), ("s", "c")]


def test_layers_of_long_chains_and_cycles(spark):
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(55)] + [("n9", "n9")], "target string, source string")
    assert {r["node"]: r["layer"] for r in graph.bottom_up(chain).collect()} == {f"n{i}": i for i in range(56)}
    with pytest.raises(ValueError, match="cycle"):
        graph.bottom_up(spark.createDataFrame([("a", "b"), ("b", "a")], "target string, source string"))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_concepts_lose_no_pair(spark):
    r = random.Random(3)
    terms = {"Customer Name", "Custommer Name", "ustomer Name", "Order", "Orders", "Order Key", "Border Key", "", "Xcustomer Name"}
    for _ in range(60):
        base = "".join(r.choice("abcde ") for _ in range(r.randint(5, 48)))
        for _ in range(4):
            t = list(base)
            for _ in range(r.randint(0, 5)):
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 1)] = r.choice(["", "x", "y"])
            terms.add("".join(t))
    terms = sorted(terms)
    want = {(a, b) for a in terms for b in terms if a < b and 1 - edit_distance(a, b) / max(len(a), len(b)) >= 0.88}
    got = {tuple(x) for x in rows_.similar_concepts(spark.createDataFrame([(t,) for t in terms], "concept string")).collect()}
    assert got == want and any(max(map(len, p)) > 25 for p in want) and any(a[0] != b[0] for a, b in want)


def test_singular_terms_and_synonyms(spark):
    found = spark.createDataFrame([("Order", ["ORD"]), ("Orders", ["ORDS", "ORD"]), ("Glass", ["GLASS"])], "concept string, names array<string>")
    single = rows_.singular_concepts(found)
    assert {r["concept"]: r["names"] for r in single.collect()} == {"Order": ["ORD", "ORDS"], "Glass": ["GLASS"]}
    assert {tuple(r) for r in rows_.synonyms(single).collect()} == {("Order", "ORD"), ("Order", "ORDS"), ("Order", "order"), ("Glass", "GLASS"), ("Glass", "glass")}


def test_terms_are_made_of_distinct_names(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "tracewell"
    before = set(shared.glob("names-*"))
    df = spark.createDataFrame([("CUST_NBR", "ord_qty", "x")] * 500, "current_node string, target_column string, source_column string")
    assert {r["concept"]: r["names"] for r in rows_.concepts(df).collect()} == {rows_.concepts(df).first()["concept"]: ["ord_qty"]}
    made = set(shared.glob("names-*")) - before
    assert made and all(spark.read.parquet(str(m)).count() == 3 for m in made)
