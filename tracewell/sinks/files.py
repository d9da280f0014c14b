"""Results as files: Parquet, CSV and JSON, written by the executors (SNK1-12, SNK14-16).

Workbooks need a library that isn't here; each sheet is a table of its own name instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tokens
from ..functions import scalars as S
from ..operators import graph, jobs, quality, rows

#: Rows that a workbook's sheet takes at most. A fixed value of the format.
SHEET_ROWS = 1_000_000
#: The columns of a column-lineage file, and of the record view with their headings. Fixed values.
COLUMN_FILE = ("source_object", "source_column", "target_object", "target_column", "formula", "transformation_type", "job_name", "workflow_name", "dataflow_name")
RECORD_VIEW = {"source": "Source", "source_hop": "Source Hop", "target": "Target", "target_hop": "Target Hop", "is_source": "Final Source", "job_name": "Job", "workflow_name": "Workflow", "dataflow_name": "Dataflow"}


def choose_format(n: int | None, prefer: str = "xlsx", most: int = SHEET_ROWS) -> str:
    """The preferred format, unless a table is too long for a sheet (SNK1)."""
    prefer = prefer.lower()
    return prefer if n is None or n <= most else "csv" if prefer == "csv" else "parquet"


def _flat(df: DataFrame, sep: str = ";") -> DataFrame:
    """Lists joined and maps or structs as JSON, so that every column fits a text file."""
    return df.select(*[
        F.concat_ws(sep, f.name).alias(f.name) if f.dataType.simpleString() == "array<string>" else F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("array", "map", "struct")) else F.col(f.name)
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str, sep: str = ",", bom: bool = False) -> None:
    """A folder of CSV files with headers; text fields are quoted where they need it."""
    df = _flat(df)
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").options(header=True, sep=sep, quote='"', escape='"').csv(path)


def export(df: DataFrame, path: str, prefer: str = "parquet", sep: str = ",") -> str:
    """Write in the format that fits; the format (SNK2). The rows are counted only where a limit may bite."""
    kind = choose_format(df.limit(SHEET_ROWS + 1).count() if prefer == "xlsx" else None, prefer)
    kind = "csv" if kind == "xlsx" else kind  # no workbook library here
    write_csv(df, path, sep) if kind == "csv" else df.write.mode("overwrite").parquet(path)
    return kind


def handoff(df: DataFrame, path: str, kind: str = "parquet") -> str | None:
    """All columns as text, nulls as the null token (SNK3); None for no rows."""
    if df.isEmpty():
        return None
    text = _flat(df).select(*[F.coalesce(F.col(c).cast("string"), F.lit(tokens.NULL)).alias(c) for c in df.columns])
    return export(text, path, kind)


def workbook(path: str, **sheets: DataFrame) -> None:
    """Each sheet as CSV below `path`."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}")


def lineage_workbook(df: DataFrame, path: str) -> None:
    """Rows, view lookup and completed rows (SNK4)."""
    workbook(path, LINEAGE_RAW=df, ANV_LOOKUP=rows.view_lookup(df), ANV_COMPLETED_LINEAGE=rows.completed_views(df))


def lint_report(df: DataFrame, path: str) -> bool:
    """Gaps, if there are any (SNK5)."""
    gaps = quality.lint(df)
    if gaps.isEmpty():
        return False
    write_csv(gaps, path)
    return True


def traced_subset(df: DataFrame, targets: DataFrame, path: str) -> None:
    """Traced rows and their summary (SNK6)."""
    trace = graph.column_trace(df, targets)
    workbook(path, TRACE_ROWS=trace, TRACE_SUMMARY=graph.trace_summary(trace))


def concepts(df: DataFrame, path: str) -> None:
    """Concepts with their names, and the ontology that lists them without relations (SNK7)."""
    found = rows.concepts(df)
    found.write.mode("overwrite").json(f"{path}/concepts")
    found.select("concept", F.array().cast("array<string>").alias("relations")).write.mode("overwrite").json(f"{path}/ontology")


def by_level(df: DataFrame, path: str, level: str = "full", sep: str = ",") -> None:
    """Column-level, table-level or all records (SNK8)."""
    write_csv({"column": jobs.column_rows, "table": jobs.table_rows}.get(level, lambda x: x)(df), path, sep)


def results(df: DataFrame, path: str) -> None:
    """Records by kind, and the summary as JSON (SNK9)."""
    workbook(path, All_Rows=df, Column_Mappings=jobs.records_of(df, "COLUMN_MAPPING"), Projections=jobs.records_of(df, "PROJECTION"), Query_Level=jobs.records_of(df, "JOIN", "FILTER", "GROUP_BY", "ORDER_BY", "UNNEST"))
    jobs.extraction_summary(df).write.mode("overwrite").json(f"{path}/extraction_summary")


def target_columns(df: DataFrame, path: str) -> None:
    """Column records of all results (SNK10)."""
    write_csv(jobs.column_rows(df), path)


def target_tables(records: DataFrame, path: str) -> None:
    """Edges with hops and context (SNK11)."""
    write_csv(records.select("target_table", "target", "source", "target_hop", "source_hop", "job_name", "workflow_name", "dataflow_name"), path)


def target_workbook(df: DataFrame, records: DataFrame, summary: DataFrame, path: str) -> None:
    """A summary, and a folder of columns and of paths partitioned by target (SNK12, PRJ19)."""
    write_csv(summary, f"{path}/Summary")
    named = jobs.in_display_order(jobs.path_records(records)).withColumn("sheet", S.sheet_name("target_table", "_Tbl"))
    named.write.mode("overwrite").partitionBy("sheet").options(header=True).csv(f"{path}/Tables")
    write_csv(jobs.column_rows(df), f"{path}/Columns")


def graph_dataset(records: DataFrame, path: str) -> None:
    """The data of a graph view as JSON lines: edges, node types and contexts (SNK14)."""
    merged = jobs.merged_edges(records)
    for name, df in (("edges", records), ("nodes", jobs.node_types(records)), ("contexts", jobs.node_context(merged))):
        df.write.mode("overwrite").json(f"{path}/{name}")


def column_file(df: DataFrame, path: str) -> None:
    """Nine columns of the column records (SNK15)."""
    write_csv(jobs.column_rows(df).select(*COLUMN_FILE), path)


def record_view(records: DataFrame, path: str) -> None:
    """Eight columns of the edge records under their headings (SNK16)."""
    write_csv(records.select(*[F.col(c).alias(h) for c, h in RECORD_VIEW.items()]), path, bom=True)
