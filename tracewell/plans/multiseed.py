"""Searches upstream of all customers, nations and regions of the fixture at once, whole and within budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import multiseed
from .catalogue import register

_EDGES = "+ e AS (SELECT DISTINCT current_node AS t, source_object AS s FROM lineage)"
_REACH = _EDGES + ", r AS (SELECT DISTINCT t AS seed, t AS node, 0 AS hop FROM e WHERE t LIKE '{}' UNION SELECT r.seed, e.s, r.hop + 1 FROM r JOIN e ON e.t = r.node WHERE r.hop < 10), h AS (SELECT seed, node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY ALL)"


def _search(df: DataFrame, like: str) -> tuple[DataFrame, DataFrame]:
    edges = df.select(F.col("current_node").alias("target"), F.col("source_object").alias("source"))
    return multiseed.bit_reach(edges, edges.filter(F.col("target").like(like)).select(F.col("target").alias("seed")).distinct())


@register("hop_map_customers", "lineage", _REACH.format("CV~_CUST~_%").replace("%'", "%' ESCAPE '~'") + " SELECT seed, node, hop FROM h", True)
def _(df):
    return multiseed.expanded(*_search(df, r"CV\_CUST\_%"))


@register("reach_sizes_nations", "lineage", _REACH.format("ANV~_NATION~_%").replace("%'", "%' ESCAPE '~'") + " SELECT seed, hop, count(*) AS n FROM h GROUP BY ALL", True)
def _(df):
    return multiseed.reach_sizes(*_search(df, r"ANV\_NATION\_%"))


@register("reached_by_views", "lineage", _REACH.format("%V~_%").replace("%V~_%'", "%V~_%' ESCAPE '~'") + " SELECT node, count(*) AS n_seeds, min(hop) AS least_hop FROM h GROUP BY node", True)
def _(df):
    return multiseed.reached_by(_search(df, r"%V\_%")[0])


#: Regions and, level by level as the fixture has four, what fits of each by name into 40 rows a region; what doesn't leads no further.
_CUT = _EDGES + """, k0 AS (SELECT DISTINCT t AS seed, t AS node FROM e WHERE t LIKE 'CV~_REGION~_%' ESCAPE '~')""" + "".join(f"""
, a{n} AS (SELECT seed, node, 1 AS one FROM k0 {" ".join(f"UNION ALL SELECT seed, node, 1 FROM k{m}" for m in range(1, n))}),
n{n} AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY node) AS place FROM (SELECT DISTINCT k{n - 1}.seed, e.s AS node FROM k{n - 1} JOIN e ON e.t = k{n - 1}.node WHERE (k{n - 1}.seed, e.s) NOT IN (SELECT (seed, node) FROM a{n}))),
f{n} AS (SELECT n{n}.*, place + used <= 40 AS fits FROM n{n} JOIN (SELECT seed, count(*) AS used FROM a{n} GROUP BY seed) USING (seed)), k{n} AS (SELECT seed, node FROM f{n} WHERE fits)""" for n in range(1, 5)) + """
, k AS (SELECT seed, node, 0 AS hop FROM k0 UNION ALL SELECT seed, node, 1 FROM k1 UNION ALL SELECT seed, node, 2 FROM k2 UNION ALL SELECT seed, node, 3 FROM k3 UNION ALL SELECT seed, node, 4 FROM k4),
g AS (SELECT seed, node, min(hop) AS hop FROM (SELECT seed, node, 1 AS hop FROM f1 WHERE NOT fits UNION ALL SELECT seed, node, 2 FROM f2 WHERE NOT fits UNION ALL SELECT seed, node, 3 FROM f3 WHERE NOT fits UNION ALL SELECT seed, node, 4 FROM f4 WHERE NOT fits) WHERE (seed, node) NOT IN (SELECT (seed, node) FROM k) GROUP BY ALL)"""


def _budgeted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = df.select(F.col("current_node").alias("target"), F.col("source_object").alias("source"))
    seeds = edges.filter(F.col("target").like(r"CV\_REGION\_%")).select(F.col("target").alias("seed"))
    return multiseed.budgeted(edges, seeds, multiseed.Budgets(limit_rows=40))


@register("budgeted_trace", "lineage", _CUT + " SELECT seed, node, hop FROM k")
def _(df):
    return _budgeted(df)[0]


@register("budgeted_trace_cut", "lineage", _CUT + " SELECT seed, node, hop, 'ROWS' AS reason FROM g")
def _(df):
    return _budgeted(df)[1]
