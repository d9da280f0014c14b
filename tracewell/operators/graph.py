"""Graph operators over lineage edges, as frontier loops of joins.

An edge table is partitioned by the column that is followed and kept that way: a hop shuffles the frontier, and what it has
reached against the visited nodes, never the edges. Every hop's frontier and the set of visited nodes are written to the shared folder: lineage stays short, and a lost executor
costs its tasks. The driver only learns whether a frontier is empty.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import tokens
from ..functions import scalars as S
from ..storage import materialized
from .cycles import condensed, fed_layers


def dependency_edges(rows: DataFrame, qualified: bool = False) -> DataFrame:
    """Distinct (target, source) column names of rows that have both (GRA16, FLT3)."""
    if qualified:
        target, source = S.qualified_column(["current_node"], "target_column"), S.qualified_column(["parent_input_object", "source_object"], "source_column")
        target, source = F.nullif(target, F.lit("")), F.nullif(source, F.lit(""))
    else:
        target, source = S.present("target_column"), S.present("source_column")
    return rows.select(target.alias("target"), source.alias("source")).filter("target IS NOT NULL AND source IS NOT NULL").distinct()


def _followed(edges: DataFrame, near: str, far: str) -> DataFrame:
    """Distinct (near, far), partitioned by `near` for all hops."""
    return edges.select(F.col(near).alias("near"), F.col(far).alias("far")).filter("near IS NOT NULL AND far IS NOT NULL").distinct().repartition("near").persist(StorageLevel.MEMORY_AND_DISK)


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int = 10, near: str = "target", far: str = "source", name: str = "front") -> DataFrame:
    """(seed, node, hop): nodes that each seed reaches, at their smallest distance; the seed itself at 0.

    `seeds` has the column `seed`. Cycles end where a node has been visited for the same seed. `name` is that of the tables it writes.
    """
    steps = _followed(edges, near, far)
    try:
        front = materialized(seeds.filter("seed IS NOT NULL").select("seed", F.col("seed").alias("node")).distinct(), name)
        parts = [front.withColumn("hop", F.lit(0))]
        seen = front
        for hop in range(1, max_hops + 1):
            new = front.join(steps, front["node"] == steps["near"]).select("seed", F.col("far").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti")
            front = materialized(new, name)
            if front.isEmpty():
                break
            parts.append(front.withColumn("hop", F.lit(hop)))
            seen = seen.unionByName(front)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    finally:
        steps.unpersist()


def hop_map(edges: DataFrame, targets: DataFrame, max_hops: int = 10) -> DataFrame:
    """(target_table, table, hop) upstream of each target (GRA7); `targets` has the column target_table. Names compare upper-cased."""
    upper = edges.select(F.upper("target").alias("target"), F.upper("source").alias("source"))
    found = reach(upper, targets.select(F.upper("target_table").alias("seed")), max_hops)
    return found.select(F.col("seed").alias("target_table"), F.col("node").alias("table"), "hop")


def terminal_sources(edges: DataFrame, hops: DataFrame) -> DataFrame:
    """(target_table, table): reached tables that nothing feeds."""
    fed = edges.select(F.upper("target").alias("table")).distinct()
    return hops.filter("hop > 0").join(fed, "table", "left_anti").select("target_table", "table")


def upstream_tree(edges: DataFrame, hops: DataFrame) -> DataFrame:
    """(target_table, table, parent): the edges between reached tables, `parent` feeding `table`."""
    upper = edges.select(F.upper("target").alias("table"), F.upper("source").alias("parent")).distinct()
    own = hops.select("target_table", "table").join(upper, "table")
    return own.join(hops.select("target_table", F.col("table").alias("parent")), ["target_table", "parent"], "left_semi").select("target_table", "table", "parent")


def spotlight(edges: DataFrame, nodes: DataFrame, direction: str = "both", max_hops: int = 50) -> DataFrame:
    """(seed, node, side, hop) along paths up, down or both ways (GRA10)."""
    seeds, parts = nodes.select(F.col(nodes.columns[0]).alias("seed")), []
    if direction in ("up", "both"):
        parts.append(reach(edges, seeds, max_hops).withColumn("side", F.lit("up")))
    if direction in ("down", "both"):
        parts.append(reach(edges, seeds, max_hops, "source", "target").withColumn("side", F.lit("down")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("seed", "node", "side", "hop")


def _described(edges: DataFrame) -> DataFrame:
    """Distinct (near, far, sole, last): whether `near` alone takes from `far`, and whether nothing feeds `far`."""
    known = edges.select(F.col("target").alias("near"), F.col("source").alias("far")).filter("near IS NOT NULL AND far IS NOT NULL")
    fed = known.select(F.col("near").alias("far")).distinct().withColumn("fed", F.lit(True))
    # the rows of one `far` lie together for all three: distinct, count and join
    counted = known.repartition("far").distinct().withColumn("takers", F.count(F.lit(1)).over(Window.partitionBy("far")))
    return counted.join(fed, "far", "left").select("near", "far", (F.col("takers") == 1).alias("sole"), F.col("fed").isNull().alias("last"))


def closure(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, ancestor): everything upstream of each node (GRA3, SET5); a node is its own ancestor only on a cycle.

    Semi-naive: each round extends only what the last one found. `nodes` (column node) bounds it to some nodes.
    What one node alone takes from is found once, through that node, so only the others are compared with what is known.
    Rounds follow the edges to what is itself fed; the last edges are joined once, at the end.
    """
    steps = materialized(_described(edges), "steps")
    start = steps.select(F.col("near").alias("node"), F.col("far").alias("ancestor"), "sole", "last")
    if nodes is not None:
        start = start.join(nodes.select("node").distinct(), "node", "left_semi")
        start = materialized(start, "closure")
    inner = steps.filter("NOT last").select("near", "far", "sole").repartition("near").sortWithinPartitions("near").persist(StorageLevel.MEMORY_AND_DISK)

    def extended(pairs: DataFrame, by: DataFrame) -> DataFrame:
        # from a node to itself and on lies an edge, known from the start
        return pairs.join(by, pairs["ancestor"] == by["near"]).filter("node <> near").select("node", F.col("far").alias("ancestor"), "sole")

    try:
        front = start.filter("NOT last").select("node", "ancestor")
        every, seen = front, start.filter("NOT last AND NOT sole").select("node", "ancestor")
        while True:  # ends, as every round adds pairs
            found = materialized(extended(front, inner), "closure")
            new = materialized(found.filter("NOT sole").select("node", "ancestor").distinct().join(seen, ["node", "ancestor"], "left_anti"), "closure")
            front, seen = found.filter("sole").select("node", "ancestor").unionByName(new), seen.unionByName(new)
            if front.isEmpty():
                break
            every = every.unionByName(front)
    finally:
        inner.unpersist()
    final, ends = steps.filter("last").select("near", "far", "sole"), start.filter("last")
    alone = extended(every, final.filter("sole")).select("node", "ancestor").unionByName(ends.filter("sole").select("node", "ancestor"))
    others = extended(every, final.filter("NOT sole")).select("node", "ancestor").unionByName(ends.filter("NOT sole").select("node", "ancestor")).distinct()
    return every.unionByName(alone).unionByName(others)


def paths(edges: DataFrame, seeds: DataFrame, max_depth: int = 10, near: str = "target", far: str = "source") -> DataFrame:
    """(seed, node, depth, path): every path from each seed, ending before a node that is on it already (GRA8)."""
    steps = _followed(edges, near, far)
    try:
        front = materialized(seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path")).distinct(), "paths")
        out = front.withColumn("depth", F.lit(0))
        for depth in range(1, max_depth + 1):
            new = front.join(steps, front["node"] == steps["near"]).filter(~F.array_contains("path", F.col("far")))
            front = materialized(new.select("seed", F.col("far").alias("node"), F.array_append("path", F.col("far")).alias("path")), "paths")
            if front.isEmpty():
                break
            out = out.unionByName(front.withColumn("depth", F.lit(depth)))
        return out.select("seed", "node", "depth", "path")
    finally:
        steps.unpersist()


def trace_target():
    """The qualified target column of a row."""
    return S.qualified_column(["current_node", "target_object", "target_node"], "target_column")


def trace_rows(rows: DataFrame) -> DataFrame:
    """Rows with tgt_q and the qualified columns src_q, jl_q and jr_q that they come from."""
    own = {} if "tgt_q" in rows.columns else {"tgt_q": trace_target()}
    return rows.withColumns(own | {
        "src_q": S.qualified_column(["parent_input_object", "source_object", "source_node"], "source_column"),
        "jl_q": S.qualified_column(["join_left_object"], "join_left_column"),
        "jr_q": S.qualified_column(["join_right_object"], "join_right_column"),
    })


def _base(x):
    return S.trimmed(F.substring_index(x, ".", -1))


def _resolved(terms: DataFrame, goals: DataFrame, bases: DataFrame) -> DataFrame:
    """(requested, goal, how) of (requested, term): the goal of a term's name, or else every one with its base name.

    Only base names of terms without a goal of their own meet the goals, and only those that some goal has.
    """
    found = materialized(terms.join(goals, terms["term"] == goals["goal"], "left").select("requested", "term", F.col("goal").isNotNull().alias("exact")), "trace-terms")
    hit = found.filter("exact").select("requested", F.col("term").alias("goal"), F.lit("EXACT").alias("how"))
    open_ = found.filter("NOT exact").select("requested", _base(F.col("term")).alias("b")).distinct().join(bases, "b", "left_semi")
    open_ = materialized(open_, "trace-bases")
    if open_.isEmpty():
        return hit
    return hit.unionByName(open_.join(goals.withColumn("b", _base(F.col("goal"))), "b").select("requested", "goal", F.lit("BASE").alias("how")))


def _named(rows: DataFrame) -> DataFrame | None:
    """(near, far): the known columns that formula, filter and join expression of each target name; None if they name nothing."""
    texts = [F.when(~F.col(c).isin("", tokens.NULL), F.col(c)) for c in ("formula", "filter_expression", "join_expression")]
    said = rows.select(F.col("tgt_q").alias("near"), F.explode(F.array_distinct(F.filter(F.array(*texts), lambda x: x.isNotNull()))).alias("expression"))
    listed = materialized(said.select("expression").distinct().select("expression", F.explode(S.references("expression")).alias("token")), "trace-names")
    if listed.isEmpty():
        return None
    # names of the rows are made distinct only where an expression has their base name
    wanted = materialized(listed.select("token", _base(F.col("token")).alias("b")).distinct(), "trace-wanted")
    known = rows.select(F.explode(F.array("tgt_q", *_PARENTS)).alias("full")).filter("full <> ''").withColumn("b", _base(F.col("full")))
    known = materialized(known.join(wanted.select("b").distinct(), "b", "left_semi").distinct(), "trace-known")
    exact = wanted.join(known, wanted["token"] == known["full"], "left_semi").select("token", F.col("token").alias("far"))
    fallback = wanted.join(known, wanted["token"] == known["full"], "left_anti").join(known, "b").select("token", F.col("full").alias("far"))
    leads = materialized(listed.join(exact.unionByName(fallback), "token").select("expression", "far").distinct(), "trace-leads")
    return said.join(leads, "expression").select("near", "far")


#: What a row comes from directly, of `trace_rows`.
_PARENTS = ("src_q", "jl_q", "jr_q")


def column_trace(rows: DataFrame, targets: DataFrame, max_hops: int = 9999) -> DataFrame:
    """Every row upstream of the requested columns, once for each of them, with trace_* columns (GRA1-2, JN15).

    `targets` has the column target. A term stands for the target column of that name, or else for every one with its base
    name. Parents are the source, the join columns, and the identifiers of formula, filter and join expression that name
    a known column. trace_depth is the smallest number of hops; trace_match tells exact terms from base names.

    A hop resolves the terms that the last one has reached, no others. Rows whose identity is theirs alone, by a digest of it,
    are given out as they are; only the others are compared.
    """
    for c in ("target_object", "target_node", "source_node"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    given, key = rows.columns, [c for c in tokens.ROW_KEY if c in rows.columns]
    rows = trace_rows(materialized(rows.withColumns({"tgt_q": trace_target(), "__key": F.xxhash64(*key)}), "trace-rows"))
    direct = rows.select(F.col("tgt_q").alias("near"), F.explode_outer(F.filter(F.array(*_PARENTS), lambda t: t != "")).alias("far"))
    named = _named(rows)
    steps = (direct if named is None else direct.unionByName(named)).filter("near <> ''").repartition("near").distinct().sortWithinPartitions("near").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        goals = steps.select(F.col("near").alias("goal")).distinct()
        bases = materialized(goals.select(_base(F.col("goal")).alias("b")).distinct(), "trace-goal-bases")
        first = _resolved(targets.select(F.col("target").alias("requested"), S.unquoted("target").alias("term")).distinct(), goals, bases)
        front = materialized(first.groupBy("requested", F.col("goal").alias("node")).agg(F.min("how").alias("trace_match")), "front")
        depth, seen, hop = front.withColumn("trace_depth", F.lit(0)), front.select("requested", "node"), 0
        while hop < max_hops and not front.isEmpty():
            hop += 1
            terms = steps.join(front, steps["near"] == front["node"]).filter("far IS NOT NULL").select("requested", F.col("far").alias("term")).distinct()
            new = _resolved(terms, goals, bases).select("requested", F.col("goal").alias("node")).distinct()
            front = materialized(new.join(seen, ["requested", "node"], "left_anti"), "front")
            seen = seen.unionByName(front)
            depth = depth.unionByName(front.select("requested", "node", F.lit("PARENT").alias("trace_match"), F.lit(hop).alias("trace_depth")))
    finally:
        steps.unpersist()
    shared = materialized(rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__key"), "trace-shared")
    reason = F.when(~S.is_missing("formula"), "FORMULA").when(~S.is_missing("filter_expression"), "FILTER").when(~S.is_missing("join_expression"), "JOIN").otherwise("STRUCTURAL")
    parents_text = F.array_join(F.filter(F.array(*_PARENTS), lambda p: p != ""), ";")

    def traced(some: DataFrame) -> DataFrame:
        out = depth.join(some, F.col("node") == F.col("tgt_q"))
        return out.select("requested", F.col("node").alias("trace_target"), "trace_depth", parents_text.alias("trace_parents"), reason.alias("trace_reason"), "trace_match", *given)

    if shared.isEmpty():
        return traced(rows)
    out = traced(rows.join(shared, "__key", "left_semi"))
    whole = F.struct("trace_depth", *([] if "row_seq" not in out.columns else ["row_seq"]), *[c for c in out.columns if c not in ("trace_depth", "row_seq")])
    kept = out.groupBy("requested", *key).agg(F.min(whole).alias("r")).select(*[F.col(f"r.{c}") for c in out.columns])
    return traced(rows.join(shared, "__key", "left_anti")).unionByName(kept)


def trace_summary(trace: DataFrame) -> DataFrame:
    """Rows, nodes, sources and depth for each traced target (AGG2)."""
    return trace.groupBy("trace_target").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("current_node").alias("nodes"), F.countDistinct("source_column").alias("sources"), F.max("trace_depth").alias("max_depth"))


def collapse_clusters(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges out of hidden members go; edges into them lead to their cluster, once each (GRA11). `edges` (src, tgt), `members` (member, cluster)."""
    own = members.groupBy("member").agg(F.min("cluster").alias("cluster"))
    left = edges.join(own, edges["src"] == own["member"], "left_anti")
    left = left.join(own, left["tgt"] == own["member"], "left").select("src", F.coalesce("cluster", "tgt").alias("tgt"))
    return left.filter("src <> tgt").distinct()


def layers(hops: DataFrame) -> DataFrame:
    """Nodes with their layer, the farthest source first (GRA12)."""
    top = hops.groupBy("target_table").agg(F.max("hop").alias("top"))
    return hops.join(top, "target_table").select("target_table", "table", (F.col("top") - F.col("hop")).alias("layer"))


def bottom_up(edges: DataFrame, cycles: str = "error") -> DataFrame:
    """(node, layer): the longest way down to a source, so that whatever feeds a node comes before it (SRT6).

    A round follows only what the last one reached. On a cycle no order exists: a ValueError, or with `cycles="condense"` one
    layer for all that feed each other. An edge from a node to itself doesn't count.
    """
    found = condensed(edges)
    if cycles == "error" and found.rings:
        raise ValueError("the edges have a cycle")
    return found.nodes.join(fed_layers(found.edges), "component", "left").select("node", F.coalesce("layer", F.lit(0)).alias("layer"))


def barycentres(edges: DataFrame, positions: DataFrame, passes: int = 4) -> DataFrame:
    """(node, position): each pass moves nodes to the mean position of their neighbours, up and down in turn (WIN6)."""
    now = positions.select("node", F.col("position").cast("double").alias("position"))
    for n in range(passes):
        near, far = ("target", "source") if n % 2 == 0 else ("source", "target")
        mean = edges.select(F.col(near).alias("node"), F.col(far).alias("other")).join(now.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.avg("position").alias("mean"))
        now = materialized(now.join(mean, "node", "left").select("node", F.coalesce("mean", "position").alias("position")), "positions")
    return now
