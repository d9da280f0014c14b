"""Round trips of an ETL repository: XML made from the tables, its records, and the SQL that gives the same from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import repository
from .catalogue import QUERIES, SQL

#: A dataflow for each nation: two SQL transforms with a target each, a query that joins, filters, groups and orders, a union,
#: a script, custom SQL and a call. %s is the nation's key.
FLOW = """<Repo><DIJob name="J%s"><DIWorkflow name="W%s"><DIDataflow name="D%s">
<DIDatabaseTableSource ownerName="S" tableName="A%s"/><DIFileSource fileName="f%s.csv"/><DIR3DataflowCall name="R%s"/>
<DITransformCall name="Q1"><sql_text>SELECT * FROM X.T%s</sql_text><DIOutputView name="V1"/></DITransformCall>
<DITransformCall name="Q2"><sql_text>SELECT * FROM X.U%s JOIN X.Z ON 1 = 1</sql_text><DIOutputView name="V2"/></DITransformCall>
<DITransformCall name="Q3"><DIQuery name="Y"><DITableSpec name="A%s"/><DIJoin joinType="left" condition="A.K = B.K AND A.L = B.M"/><DIWhere expr="A.K &gt; %s"/><DIGroupBy columns="K"/><DIOrderBy columns="L"/><DIUnnest columns="N"/></DIQuery><DIOutputView name="V3"/></DITransformCall>
<DIUnion name="N"><DIInputView name="V1"/><DIInputView name="V3"/><DIColumn name="C%s"/><DIOutputView name="V4"/></DIUnion>
<DIScript name="P">$G = 1 + %s; H = upper(x);<DIInputView name="V4"/><DIOutputView name="V5"/></DIScript>
<DICustomSQL name="M" sql="SELECT 1 FROM X.M%s"><DIOutputView name="V6"/></DICustomSQL>
<DIDatabaseTableTarget ownerName="S" tableName="E%s"><DIInputView name="V5"/><DIInputView name="V6"/></DIDatabaseTableTarget>
<DIDatabaseTableTarget ownerName="S" tableName="F%s"><DIInputView name="v2"/></DIDatabaseTableTarget></DIDataflow></DIWorkflow></DIJob></Repo>"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content), a document for each nation."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    xml = F.replace(F.lit(FLOW), F.lit("%s"), F.col("n_nationkey").cast("string"))
    return nation.select(F.concat(F.lit("repo-"), "n_nationkey").alias("path"), xml.cast("binary").alias("content"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.records(repository.elements(documents(spark, sf_dir)))


def _register(name: str, kinds: tuple[str, ...], columns: tuple[str, ...], rows: list[tuple]) -> None:
    """`rows` are SQL expressions of n, the nation's key as text, for the columns after record_type."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _records(spark, sf_dir).filter(F.col("record_type").isin(*kinds)).select("record_type", *columns)

    QUERIES[name] = query
    parts = [f"SELECT {', '.join(f'{v} AS {c}' for c, v in zip(('record_type', *columns), r, strict=True))} FROM k" for r in rows]
    SQL[name] = "WITH k AS (SELECT CAST(n_nationkey AS VARCHAR) AS n FROM nation) " + " UNION ALL ".join(parts)


_E, _F, _D = "'S.E' || n", "'S.F' || n", "'D' || n"
_register("repository_routes", ("COLUMN_MAPPING", "SQL_TRANSFORM", "ABAP_CALL", "SQL_CUSTOM"), ("source_object", "target_object", "job_name", "dataflow_name"), [
    ("'COLUMN_MAPPING'", "'S.A' || n", _E, "'J' || n", _D), ("'SQL_TRANSFORM'", f"'SQL:' || {_D} || '|Q1'", _E, "'J' || n", _D), ("'SQL_TRANSFORM'", f"'SQL:' || {_D} || '|Q2'", _F, "'J' || n", _D),
    ("'SQL_TRANSFORM'", "'X.T' || n", f"'SQL:' || {_D} || '|Q1'", "NULL", _D), ("'SQL_TRANSFORM'", "'X.U' || n", f"'SQL:' || {_D} || '|Q2'", "NULL", _D), ("'SQL_TRANSFORM'", "'X.Z'", f"'SQL:' || {_D} || '|Q2'", "NULL", _D),
    ("'ABAP_CALL'", "'R' || n", _D, "'J' || n", _D), ("'SQL_CUSTOM'", "'X.M' || n", _E, "'J' || n", _D),
])
_register("repository_joins", ("JOIN", "JOIN_KEY_MAPPING"), ("join_type", "join_condition", "source_object", "source_column", "target_object", "target_column", "transform_name", "workflow_name"), [
    ("'JOIN'", "'LEFT'", "'A.K = B.K AND A.L = B.M'", "NULL", "NULL", _E, "NULL", "'Q3'", "'W' || n"),
    ("'JOIN_KEY_MAPPING'", "'LEFT'", "'A.K = B.K AND A.L = B.M'", "'A'", "'K'", "'B'", "'K'", "'Q3'", "'W' || n"), ("'JOIN_KEY_MAPPING'", "'LEFT'", "'A.K = B.K AND A.L = B.M'", "'A'", "'L'", "'B'", "'M'", "'Q3'", "'W' || n"),
])
_register("repository_clauses", ("FILTER", "GROUP_BY", "ORDER_BY", "UNNEST"), ("where_condition", "expression_text", "target_object", "transform_name"), [
    ("'FILTER'", "'A.K > ' || n", "NULL", _E, "'Q3'"), ("'GROUP_BY'", "NULL", "'K'", _E, "'Q3'"), ("'ORDER_BY'", "NULL", "'L'", _E, "'Q3'"), ("'UNNEST'", "NULL", "'N'", _E, "'Q3'"),
])
_register("repository_columns", ("UNION_COLUMN_MAPPING", "SCRIPT_COLUMN_MAPPING"), ("source_object", "source_column", "target_object", "target_column", "formula", "transform_name"), [
    ("'UNION_COLUMN_MAPPING'", "'V1'", "'C' || n", _E, "'C' || n", "NULL", "'N'"), ("'UNION_COLUMN_MAPPING'", "'V3'", "'C' || n", _E, "'C' || n", "NULL", "'N'"),
    ("'SCRIPT_COLUMN_MAPPING'", "NULL", "NULL", _E, "'G'", "'1 + ' || n", "'P'"), ("'SCRIPT_COLUMN_MAPPING'", "NULL", "NULL", _E, "'H'", "'upper(x)'", "'P'"),
])
