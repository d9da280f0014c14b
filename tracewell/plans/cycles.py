"""Queries of cyclic graphs: the fixture's levels with edges that lead back, rings and edges from a node to itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cycles, graph
from . import fixtures as X
from .catalogue import QUERIES, SQL

#: Orders that feed their customer and are fed by it, regions fed by what they feed, rings of seven parts over a path each, loops.
CYCLIC = """
SELECT 'CV_CUST_' || o_custkey AS target, 'ATV_ORD_' || o_orderkey AS source FROM $orders
UNION SELECT 'ATV_ORD_' || o_orderkey, 'CV_CUST_' || o_custkey FROM $orders WHERE o_orderkey % 9 = 0
UNION SELECT 'ANV_NATION_' || c_nationkey, 'CV_CUST_' || c_custkey FROM $customer
UNION SELECT 'CV_REGION_' || n_regionkey, 'ANV_NATION_' || n_nationkey FROM $nation
UNION SELECT 'ANV_NATION_' || n_nationkey, 'CV_REGION_' || n_regionkey FROM $nation WHERE n_nationkey % 4 = 0
UNION SELECT 'P_' || p_partkey, 'P_' || CASE WHEN p_partkey % 7 = 6 THEN p_partkey - 6 ELSE p_partkey + 1 END FROM $part WHERE p_partkey % 14 < 7
UNION SELECT 'P_' || p_partkey, 'P_' || (p_partkey - 1) FROM $part WHERE p_partkey % 14 >= 7
UNION SELECT 'P_' || p_partkey, 'P_' || p_partkey FROM $part WHERE p_partkey % 14 = 9
"""

_PLAIN = f"WITH RECURSIVE e AS ({X.plain(CYCLIC)}), r AS (SELECT target AS node, source AS ancestor FROM e UNION SELECT r.node, e.source FROM r JOIN e ON e.target = r.ancestor)"
#: The component of every node by its smallest member.
_OF = ", n AS (SELECT target AS node FROM e UNION SELECT source FROM e), k AS (SELECT n.node, least(n.node, coalesce(min(b.node), n.node)) AS component, coalesce(bool_or(b.node IS NOT NULL), false) AS cyclic FROM n LEFT JOIN r a ON a.node = n.node LEFT JOIN r b ON b.node = a.ancestor AND b.ancestor = n.node GROUP BY n.node)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.build(spark, sf_dir, CYCLIC)


def _put(name: str, sql: str):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(edges(spark, sf_dir))
        SQL[name] = _PLAIN + sql
        return f

    return put


@_put("cycle_components", _OF + " SELECT k.node, k.component, s.size, k.cyclic FROM k JOIN (SELECT component, count(*) AS size FROM k GROUP BY component) s USING (component)")
def _(df):
    return cycles.components(df)


@_put("cycle_broken_edges", _OF + " SELECT e.target, e.source FROM e JOIN k a ON a.node = e.target JOIN k b ON b.node = e.source WHERE a.component = b.component")
def _(df):
    return cycles.broken_edges(df)


@_put("cyclic_closure", " SELECT node, ancestor FROM r")
def _(df):
    return cycles.ancestors(cycles.reachability(df))


@_put("cyclic_layers", _OF + """, ce AS (SELECT DISTINCT a.component AS t, b.component AS s FROM e JOIN k a ON a.node = e.target JOIN k b ON b.node = e.source WHERE a.component <> b.component),
l AS (SELECT component AS c, 0 AS layer FROM k UNION SELECT ce.t, l.layer + 1 FROM l JOIN ce ON ce.s = l.c), m AS (SELECT c, max(layer) AS layer FROM l GROUP BY c) SELECT k.node, CAST(m.layer AS INTEGER) AS layer FROM k JOIN m ON m.c = k.component""")
def _(df):
    return graph.bottom_up(df, "condense")


@_put("reachability_pairs", """, p AS (SELECT source AS node, target AS ancestor FROM e UNION SELECT target, source FROM e UNION SELECT 'CV_REGION_' || (length(source) % 5), source FROM e)
SELECT p.node, p.ancestor, r.node IS NOT NULL AS reached FROM p LEFT JOIN r ON r.node = p.node AND r.ancestor = p.ancestor""")
def _(df):
    pair = lambda node, ancestor: F.struct(F.col(node).alias("node"), F.col(ancestor).alias("ancestor"))
    region = F.concat(F.lit("CV_REGION_"), (F.length("source") % 5).cast("string"))
    pairs = df.withColumn("region", region).select(F.explode(F.array(pair("source", "target"), pair("target", "source"), pair("region", "source"))).alias("p"))
    return cycles.reaches(cycles.reachability(df), pairs.select("p.node", "p.ancestor").distinct())


#: Parts renamed to the first of their ten, and those to the first of the ten before, three tens at a time; other kinds tie nothing.
RENAMES = """
SELECT CASE WHEN p_partkey % 4 = 3 THEN 'Mapping' ELSE 'Rename' END AS transformation_type, 'N' || p_partkey AS source_column, 'N' || (p_partkey - p_partkey % 10) AS target_column FROM $part WHERE p_partkey % 10 <> 0
UNION ALL SELECT 'Rename', 'N' || p_partkey, 'N' || (p_partkey - 10) FROM $part WHERE p_partkey % 10 = 0 AND p_partkey % 30 <> 0
UNION ALL SELECT 'Rename', 'N' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '<NULL>' ELSE '' END FROM $part WHERE p_partkey % 7 = 0
"""
QUERIES["rename_synonyms"] = lambda spark, sf_dir: cycles.rename_synonyms(X.build(spark, sf_dir, RENAMES))
SQL["rename_synonyms"] = f"""WITH RECURSIVE d AS ({X.plain(RENAMES)}), t AS (SELECT target_column AS a, source_column AS b FROM d WHERE transformation_type = 'Rename' AND target_column NOT IN ('', '<NULL>')), e AS (SELECT a, b FROM t UNION SELECT b, a FROM t),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), k AS (SELECT a AS name, least(a, min(b)) AS concept FROM r GROUP BY a) SELECT name, concept, count(*) OVER (PARTITION BY concept) AS size FROM k"""
