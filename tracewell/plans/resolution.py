"""Catalog fallback and name resolution inside extraction, over views made from customers and their orders.

A calculation view for each customer: a mapping for each order, a third of them without a source, and a calculated measure for
each, whose formula names columns of the view itself, of another object, of several, of none known, or no column at all. The
catalog knows the views of every second customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, resolve
from ..sources import shred
from ..storage import materialized
from . import fixtures as X
from .catalogue import QUERIES, SQL

CATALOG = """
SELECT 'DWH' AS schema_name, 'VC' || c_custkey AS view_name, 'COL' || n AS column_name, n AS position FROM $customer CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3)) AS v(n)) AS v WHERE c_custkey % 2 = 0
UNION ALL SELECT 'SRC', 'BASE', 'X' || c_custkey, c_custkey FROM $customer WHERE c_custkey % 5 <> 0
"""

_FORMULA = """CASE o_orderkey % 4 WHEN 0 THEN '1 + 2' WHEN 1 THEN '"COL1" + "COL2"' WHEN 2 THEN concat('"X', o_custkey, '" * "COL9"') ELSE '"COL3" / 7' END"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content), a view for each customer with orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    mapping = """concat('<mapping targetName="T', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '"/>' ELSE concat('" sourceName="S', o_orderkey, '"/>') END)"""
    measure = f"""concat('<measure id="M', o_orderkey, '"><formula>', replace({_FORMULA}, '"', '&quot;'), '</formula></measure>')"""
    per = orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.expr(mapping)), "").alias("maps"), F.array_join(F.collect_list(F.expr(measure)), "").alias("measures"))  # of one customer
    xml = F.concat(F.lit('<Calculation:scenario xmlns:Calculation="urn:calc" id="DWH.VC'), F.col("o_custkey").cast("string"), F.lit('"><calculationViews><projectionNode id="N"><viewNode>'), "maps", F.lit("</viewNode></projectionNode></calculationViews><calculatedMeasures>"), "measures", F.lit("</calculatedMeasures></Calculation:scenario>"))
    return per.select(F.concat(F.lit("vc_"), F.col("o_custkey").cast("string")).alias("path"), xml.cast("binary").alias("content"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = materialized(extract.scalars_of(shred.elements(shred.shred(documents(spark, sf_dir)))), "elements")
    return extract.union_all(extract.node_mappings(c), extract.calculated_measures(c))


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.registered_dependencies(_rows(spark, sf_dir), X.build(spark, sf_dir, CATALOG))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved_identifiers(_rows(spark, sf_dir), X.build(spark, sf_dir, CATALOG))


QUERIES["xml_registered_dependencies"] = registered
SQL["xml_registered_dependencies"] = """
WITH o AS (SELECT o_orderkey AS k, 'DWH.VC' || o_custkey AS node, o_custkey AS c FROM orders), n AS (SELECT unnest([1, 2, 3]) AS n)
SELECT 'T' || k AS target, 'S' || k AS source, node AS current_node, 'MAPPING' AS origin FROM o WHERE k % 3 <> 0
UNION ALL SELECT 'T' || k, 'COL' || n, node, 'CATALOG' FROM o, n WHERE k % 3 = 0 AND c % 2 = 0
UNION ALL SELECT 'M' || k, 'COL' || n, node, 'CATALOG' FROM o, n WHERE k % 4 = 0 AND c % 2 = 0
UNION ALL SELECT 'M' || k, unnest(CASE k % 4 WHEN 1 THEN ['COL1', 'COL2'] WHEN 2 THEN ['X' || c, 'COL9'] ELSE ['COL3'] END), node, 'FORMULA' FROM o WHERE k % 4 <> 0
"""
QUERIES["xml_resolved_identifiers"] = resolved
SQL["xml_resolved_identifiers"] = """
WITH o AS (SELECT 'M' || o_orderkey AS target_column, 'DWH.VC' || o_custkey AS current_node, o_custkey AS c, unnest(CASE o_orderkey % 4 WHEN 1 THEN ['COL1', 'COL2'] WHEN 2 THEN ['X' || o_custkey, 'COL9'] ELSE ['COL3'] END) AS identifier FROM orders WHERE o_orderkey % 4 <> 0)
SELECT current_node, target_column, identifier, CASE WHEN identifier LIKE 'X%' AND c % 5 <> 0 THEN 'SRC.BASE' WHEN identifier IN ('COL1', 'COL2', 'COL3') AND c % 2 = 0 THEN current_node END AS object,
  CASE WHEN identifier LIKE 'X%' THEN CASE WHEN c % 5 <> 0 THEN 'UNIQUE' ELSE 'UNKNOWN' END WHEN identifier = 'COL9' THEN 'UNKNOWN' WHEN c % 2 = 0 THEN 'OWN' ELSE 'AMBIGUOUS' END AS how FROM o
"""
