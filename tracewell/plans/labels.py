"""Queries of the small scalars, contexts and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, jobs, rows
from .catalogue import QUERIES, SQL, register


@register("table_level_rows", "jobs", "SELECT DISTINCT source_object, target_object, job_name, workflow_name, dataflow_name FROM jobs WHERE trim(source_object) <> '' AND trim(target_object) <> ''")
def _(df):
    return jobs.table_rows(df)


@register("first_contexts", "jobs", """SELECT upper(trim(target_object)) AS "table", arg_min(job_name, row_seq) AS job_name, arg_min(workflow_name, row_seq) AS workflow_name, arg_min(dataflow_name, row_seq) AS dataflow_name
FROM jobs WHERE trim(target_object) <> '' GROUP BY 1""")
def _(df):
    return jobs.first_context(df)


@register("qualified_names", "gaps", "SELECT row_seq, concat_ws('.', nullif(nullif(trim(source_object), ''), '<NULL>'), nullif(nullif(trim(source_column), ''), '<NULL>')) AS name FROM gaps")
def _(df):
    return df.select("row_seq", S.qualified("source_object", "source_column").alias("name"))


@register("short_labels", "jobs", r"""+ l AS (SELECT row_seq, list_last(string_split_regex(source_object || '_' || repeat('x', CAST(row_seq % 30 AS INTEGER)), '[.|/]')) AS n FROM jobs)
SELECT row_seq, CASE WHEN len(n) > 22 THEN n[1:21] || '…' ELSE n END AS label FROM l""")
def _(df):
    long = F.concat("source_object", F.lit("_"), F.repeat(F.lit("x"), (F.col("row_seq") % 30).cast("int")))
    return df.select("row_seq", S.short_label(long).alias("label"))


@register("mapping_badges", "jobs", r"""SELECT row_seq, CASE WHEN transformation_type LIKE 'SQL%' THEN 'SQL' WHEN transformation_type LIKE 'CASE%' THEN 'Case' WHEN transformation_type = 'DIRECT_SOURCE' OR trim(formula) = '' THEN 'direct'
WHEN regexp_full_match(trim(formula), '(''[^'']*''|[0-9.]+)') THEN 'const' ELSE 'formula' END AS badge FROM jobs""")
def _(df):
    return df.select("row_seq", S.mapping_badge("transformation_type", F.col("transformation_type") == "DIRECT_SOURCE", "formula").alias("badge"))


@register("safe_names", "jobs", "SELECT row_seq, regexp_replace(source_object, '[^A-Za-z0-9_.-]', '_', 'g') AS file_name, substr(regexp_replace(source_object, '[^A-Za-z0-9_]', '_', 'g'), 1, 28) || '_T' AS sheet FROM jobs")
def _(df):
    return df.select("row_seq", S.safe_name("source_object").alias("file_name"), S.sheet_name("source_object", "_T").alias("sheet"))


@register("elapsed_texts", "jobs", "SELECT row_seq, (row_seq % 100000) // 60 || 'm ' || (row_seq % 100000) % 60 || 's' AS elapsed FROM jobs")
def _(df):
    return df.select("row_seq", S.elapsed(F.col("row_seq") % 100000).alias("elapsed"))


@register("column_labels", "lineage", """SELECT row_seq, coalesce(source_column, '') || ' → ' || coalesce(target_column, '') AS label,
CASE WHEN len(x) > 58 THEN x[1:57] || '…' ELSE x END AS expression FROM (SELECT *, repeat(formula, 1 + CAST(row_seq % 4 AS INTEGER)) AS x FROM lineage)""")
def _(df):
    shown = S.column_label("source_column", "target_column", F.repeat("formula", (1 + F.col("row_seq") % 4).cast("int")))
    return df.select("row_seq", shown.alias("c")).select("row_seq", "c.*")


@register("unescaped_names", "jobs", "SELECT row_seq, '<b>' || source_object || ' & é' AS name FROM jobs")
def _(df):
    return df.select("row_seq", S.unescaped(F.concat(F.lit("&lt;b&gt;"), "source_object", F.lit(" &amp; &#233;"))).alias("name"))


@register("output_texts", "gaps", """+ o AS (SELECT current_node, list_sort(list(DISTINCT target_column)) AS c FROM gaps GROUP BY 1)
SELECT current_node, array_to_string(c[1:3], ',') || CASE WHEN len(c) > 3 THEN ',...(+' || (len(c) - 3) || ')' ELSE '' END AS outputs, CAST(len(c) AS VARCHAR) AS n FROM o""")
def _(df):
    found = df.groupBy("current_node").agg(F.collect_set("target_column").alias("c"))
    return found.select("current_node", S.outputs_text("c", most=3).alias("outputs"), S.outputs_text("c", "count").alias("n"))


def _similar_terms(spark: SparkSession, sf_dir: str):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("concept")).unionByName(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("concept")))
    return rows.similar_concepts(names.filter("concept IS NOT NULL").distinct(), 0.8)


QUERIES["similar_terms"] = _similar_terms
SQL["similar_terms"] = """WITH t AS (SELECT p_name AS c FROM part WHERE p_name IS NOT NULL UNION SELECT n_name FROM nation WHERE n_name IS NOT NULL)
SELECT a.c AS concept, b.c AS other FROM t a JOIN t b ON a.c < b.c AND 1 - levenshtein(a.c, b.c) / greatest(len(a.c), len(b.c)) >= 0.8"""


_EDGES_SQL = "+ e AS (SELECT current_node AS t, source_object AS s FROM lineage WHERE current_node LIKE 'ANV%' OR current_node LIKE 'CV_REGION%'), p AS (SELECT node, CAST(length(node) + ascii(right(node, 1)) AS DOUBLE) AS position FROM (SELECT t AS node FROM e UNION SELECT s FROM e))"


@register("barycentres", "lineage", _EDGES_SQL + """, a AS (SELECT p.node, coalesce(m.x, p.position) AS position FROM p LEFT JOIN (SELECT e.t AS node, avg(p.position) AS x FROM e JOIN p ON p.node = e.s GROUP BY e.t) m ON m.node = p.node)
SELECT a.node, round(coalesce(m.x, a.position), 6) AS position FROM a LEFT JOIN (SELECT e.s AS node, avg(a.position) AS x FROM e JOIN a ON a.node = e.t GROUP BY e.s) m ON m.node = a.node""")
def _(df):
    edges = df.filter("current_node LIKE 'ANV%' OR current_node LIKE 'CV_REGION%'").select(F.col("current_node").alias("target"), F.col("source_object").alias("source"))
    nodes = edges.select(F.explode(F.array("target", "source")).alias("node")).distinct()
    placed = nodes.withColumn("position", (F.length("node") + F.ascii(F.right("node", F.lit(1)))).cast("double"))
    return graph.barycentres(edges, placed, 2).select("node", F.round("position", 6).alias("position"))
