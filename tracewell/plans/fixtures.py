"""Lineage tables derived from the driver's star schema, by SQL that Spark and other engines read alike.

`$name` stands for a table of the input.
"""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame, SparkSession

_ROW = "row_seq, source_file, xpath, current_node, parent_input_object, source_object, source_column, target_column, node_output_columns, transformation_type, formula, filter_expression, join_expression, join_left_object, join_left_column, join_right_object, join_right_column"

#: Region views over nation views over customers over orders over line items, with gaps, joins and shared dimensions.
LINEAGE = """
SELECT CAST(n_nationkey AS BIGINT) AS row_seq, 'region.xml' AS source_file, '/r/' || n_nationkey AS xpath, 'CV_REGION_' || n_regionkey AS current_node, 'ANV_NATION_' || n_nationkey AS parent_input_object,
  'ANV_NATION_' || n_nationkey AS source_object, 'N_NAME' AS source_column, 'N_NAME' AS target_column, 'N_NAME,N_KEY' AS node_output_columns, 'Mapping' AS transformation_type, '<NULL>' AS formula,
  '<NULL>' AS filter_expression, '<NULL>' AS join_expression, '<NULL>' AS join_left_object, '<NULL>' AS join_left_column, '<NULL>' AS join_right_object, '<NULL>' AS join_right_column FROM $nation
UNION ALL
SELECT 1000 + c_custkey, 'nation_' || c_nationkey || '.xml', '/n/' || (c_custkey % 40), 'ANV_NATION_' || c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN '<NULL>' ELSE 'CV_CUST_' || c_custkey END,
  CASE WHEN c_custkey % 7 = 0 THEN 'DIM_SEG_' || c_mktsegment ELSE 'CV_CUST_' || c_custkey END, CASE WHEN c_custkey % 11 = 0 THEN '<NULL>' WHEN c_custkey % 5 = 0 THEN '' ELSE 'C_ACCTBAL' END, 'C' || (c_custkey % 13),
  CASE WHEN c_custkey % 2 = 0 THEN 'C1,C2, C3' ELSE '' END, CASE WHEN c_custkey % 7 = 0 THEN 'Shared_Dimension' WHEN c_custkey % 4 = 0 THEN 'Filter' ELSE 'Rename' END, '<NULL>', 'C_MKTSEGMENT = ''' || c_mktsegment || '''', '<NULL>',
  '<NULL>', '<NULL>', '<NULL>', '<NULL>' FROM $customer
UNION ALL
SELECT 100000000 + c_custkey, 'seg.xml', '/s/' || (c_custkey % 40), 'DIM_SEG_' || c_mktsegment, '<NULL>', 'DWH.SEG', 'S', 'C' || (c_custkey % 17), '', 'Source_Table', '<NULL>', '<NULL>', '<NULL>', '<NULL>', '<NULL>', '<NULL>', '<NULL>' FROM $customer WHERE c_custkey % 10 = 0
UNION ALL
SELECT 1000000000 + o_orderkey, 'cust.xml', '/o/' || (o_orderkey % 900), 'CV_CUST_' || o_custkey, 'ATV_ORD_' || o_orderkey, 'ATV_ORD_' || o_orderkey, 'O_TOTALPRICE', 'O_TOTALPRICE', 'O_TOTALPRICE', 'Aggregation', 'SUM("O_TOTALPRICE")',
  'O_ORDERSTATUS = ''' || o_orderstatus || '''', CASE WHEN o_orderkey % 5 = 0 THEN 'A.K = B.K' ELSE '<NULL>' END, CASE WHEN o_orderkey % 5 = 0 THEN 'A' ELSE '<NULL>' END, CASE WHEN o_orderkey % 5 = 0 THEN 'K' ELSE '<NULL>' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'B' ELSE '<NULL>' END, CASE WHEN o_orderkey % 10 = 0 THEN 'K' ELSE '<NULL>' END FROM $orders
UNION ALL
SELECT 5000000000 + l_orderkey * 10 + l_linenumber, 'ord.xml', '/l/' || (l_orderkey % 500), 'ATV_ORD_' || l_orderkey, 'DWH.LI_' || l_orderkey || '_' || l_linenumber, 'DWH.LI_' || l_orderkey || '_' || l_linenumber, 'L_EXTENDEDPRICE', 'REVENUE', 'REVENUE',
  'Calculated_Column', '"L_EXTENDEDPRICE" * (1 - "L_DISCOUNT")', 'L_RETURNFLAG = ''' || l_returnflag || ''' AND L_QUANTITY >= 10', '<NULL>', '<NULL>', '<NULL>', '<NULL>', '<NULL>' FROM $lineitem
"""

#: The same levels with columns that line up, for column traces.
TRACE = """
SELECT CAST(n_nationkey AS BIGINT) AS row_seq, 'region.xml' AS source_file, '/r' AS xpath, 'CV_REGION_' || n_regionkey AS current_node, '<NULL>' AS parent_input_object, '<NULL>' AS source_object, '<NULL>' AS source_column, 'AMOUNT' AS target_column,
  'Calculated_Column' AS transformation_type, '"ANV_NATION_' || n_nationkey || '.BALANCE" * 2' AS formula, '<NULL>' AS filter_expression, '<NULL>' AS join_expression, '<NULL>' AS join_left_object, '<NULL>' AS join_left_column, '<NULL>' AS join_right_object, '<NULL>' AS join_right_column FROM $nation
UNION ALL
SELECT 1000 + c_custkey, 'nation.xml', '/n/' || c_custkey, 'ANV_NATION_' || c_nationkey, 'CV_CUST_' || c_custkey, 'CV_CUST_' || c_custkey, 'ACCTBAL', 'BALANCE', 'Rename', '<NULL>', '<NULL>', '<NULL>', '<NULL>', '<NULL>', '<NULL>', '<NULL>' FROM $customer WHERE c_custkey IN (SELECT o_custkey FROM $orders WHERE o_orderkey IN (SELECT l_orderkey FROM $lineitem))
UNION ALL
SELECT 1000000000 + o_orderkey, 'cust.xml', '/o/' || o_orderkey, 'CV_CUST_' || o_custkey, '<NULL>', '<NULL>', '<NULL>', 'ACCTBAL', 'Join', '<NULL>', '<NULL>', '<NULL>', 'ATV_ORD_' || o_orderkey, 'TOTAL', '<NULL>', '<NULL>' FROM $orders WHERE o_orderkey IN (SELECT l_orderkey FROM $lineitem)
UNION ALL
SELECT 5000000000 + l_orderkey * 10 + l_linenumber, 'ord.xml', '/l/' || l_linenumber, 'ATV_ORD_' || l_orderkey, 'DWH.LI_' || l_orderkey || '_' || l_linenumber, '<NULL>', 'L_EXTENDEDPRICE', 'TOTAL', 'Mapping', '<NULL>', '<NULL>', '<NULL>', '<NULL>', '<NULL>', '<NULL>', '<NULL>' FROM $lineitem
"""

#: Rows with every kind of gap that enrichment closes.
GAPS = """
SELECT CAST(p_partkey AS BIGINT) AS row_seq, 'part.xml' AS source_file, '/p/' || p_partkey AS xpath, CASE WHEN p_partkey % 3 = 0 THEN 'DWH.V' || (p_size % 5) ELSE 'VIEW_' || (p_size % 7) END AS current_node,
  CASE WHEN p_partkey % 4 = 0 THEN '#SRC.T' || (p_size % 3) WHEN p_partkey % 4 = 1 THEN 'VIEW_' || (p_size % 7) WHEN p_partkey % 4 = 2 THEN '<NULL>' ELSE 'A.B, C.D' END AS parent_input_object,
  CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN '<NULL>' ELSE 'DWH.V' || (p_partkey % 5) END AS source_object,
  CASE WHEN p_partkey % 6 = 0 THEN '*' WHEN p_partkey % 6 = 1 THEN '' WHEN p_partkey % 6 = 2 THEN '<NULL>' ELSE 'S' || p_size END AS source_column,
  CASE WHEN p_partkey % 7 = 0 THEN '*' WHEN p_partkey % 7 = 1 THEN '<NULL>' ELSE 'T' || p_size END AS target_column, CASE WHEN p_partkey % 9 = 0 THEN 'Source_Table' ELSE 'Mapping' END AS transformation_type,
  CASE WHEN p_partkey % 8 = 0 THEN '' ELSE 'C1,C2' END AS node_output_columns, '<NULL>' AS target_object FROM $part
"""

CATALOG_COLUMNS = "SELECT 'DWH' AS schema_name, 'V' || (n_nationkey % 5) AS view_name, 'COL' || n_nationkey AS column_name, n_nationkey AS position FROM $nation"
DEPENDENCIES = "SELECT 'DWH' AS schema_name, 'V' || (s_suppkey % 5) AS name, 'SRC' AS base_schema, 'T' || s_suppkey AS base_object, 'TABLE' AS base_type, '1' AS dependency_type, s_suppkey AS position FROM $supplier WHERE s_suppkey % 5 <> 4"

#: Records of an ETL repository: customers' tables from orders, a mart from those, with joins, filters and SQL transforms.
JOBS = """
SELECT CAST(o_orderkey AS BIGINT) AS row_seq, 'COLUMN_MAPPING' AS record_type, 'JOB_' || (o_orderkey % 5) AS job_name, 'WF_' || o_orderstatus AS workflow_name, 'DF_' || substr(o_orderpriority, 1, 1) || '_' || (o_custkey % 3) AS dataflow_name,
  'DWH.CUST_' || o_custkey AS target_object, 'TOTAL' AS target_column, CASE WHEN o_orderkey % 4 = 0 THEN 'SAP.ORD_' || o_orderkey WHEN o_orderkey % 4 = 1 THEN 'FILE:/in/' || o_orderkey || '.csv' ELSE 'STG.ORD_' || o_orderkey END AS source_object,
  'O_TOTALPRICE' AS source_column, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'nvl(O_TOTALPRICE, 0)' END AS formula, CASE WHEN o_orderstatus = 'F' THEN 'DIRECT_SOURCE' ELSE 'FUNCTION' END AS transformation_type,
  '' AS transform_name, '' AS join_condition, '' AS where_condition FROM $orders
UNION ALL
SELECT 1000000000 + c_custkey, 'COLUMN_MAPPING', 'JOB_M', 'WF_M', 'DF_M' || (c_nationkey % 4), 'MART.NATION_' || c_nationkey, 'TOTAL', 'DWH.CUST_' || c_custkey, 'TOTAL', 'SUM(TOTAL) / 2', 'AGGREGATION', '', '', '' FROM $customer
UNION ALL
SELECT 2000000000 + n_nationkey, 'COLUMN_MAPPING', 'JOB_R', 'WF_R', 'DF_R', 'MART.REGION_' || n_regionkey, 'TOTAL', 'MART.NATION_' || n_nationkey, 'TOTAL', 'CASE WHEN TOTAL > 0 THEN ROUND(NVL(TOTAL, 0), 2) ELSE 0 END', 'CASE', '', '', '' FROM $nation
UNION ALL
SELECT 3000000000 + n_nationkey, 'SQL_TRANSFORM', 'JOB_S', 'WF_S', 'DF_S' || (n_nationkey % 3), 'MART.NATION_' || n_nationkey, 'X', '', 'X', '', 'SQL_CUSTOM', 'TF_' || (n_nationkey % 6), '', '' FROM $nation
UNION ALL
SELECT 4000000000 + n_nationkey, 'JOIN', 'JOB_M', 'WF_M', 'DF_M' || (n_nationkey % 4), '', '', '', '', '', '', '', 'A.K = B.K' || (n_nationkey % 8), '' FROM $nation
UNION ALL
SELECT 5000000000 + n_nationkey, 'FILTER', 'JOB_M', 'WF_M', 'DF_M' || (n_nationkey % 4), 'MART.NATION_' || n_nationkey, '', '', '', '', '', '', '', 'N > ' || n_nationkey FROM $nation
UNION ALL
SELECT 6000000000 + n_nationkey, 'PROJECTION', 'JOB_M', 'WF_M', 'DF_M', 'MART.NATION_' || n_nationkey, 'P', '', '', '', '', '', '', '' FROM $nation
"""

#: Expressions with known parts, and some from the data.
EXPRESSIONS = """
SELECT * FROM (VALUES (1, '"A" + 1'), (2, 'TRIM("A")'), (3, 'SUM("A")'), (4, 'SUBSTR("A",1,2)'), (5, 'A = ''x'' AND B >= 1.5'), (6, '<NULL>'), (7, ''), (8, 'CASE WHEN "S.T.C" IN (1, 2) THEN UPPER(x.y) ELSE ''a b'' END'), (9, 'nvl(a, round(b, 2)) <> 0 or c like ''%z''')) AS v(id, expr)
UNION ALL
SELECT 100 + p_partkey, 'NVL("' || p_brand || '.' || p_type || '", ' || p_size || ') * P_RETAILPRICE' FROM $part
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def plain(sql: str) -> str:
    """The SQL over tables of their own names."""
    return Template(sql).substitute({t: t for t in TABLES})


def build(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the Parquet tables below `sf_dir`."""
    used = [t for t in TABLES if f"${t}" in sql]
    for t in used:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"tracewell_{t}")
    return spark.sql(Template(sql).substitute({t: f"tracewell_{t}" for t in used}))
