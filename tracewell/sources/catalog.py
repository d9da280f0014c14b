"""Catalog exports and cached results as CSV (SRC4-6, SRC9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialized

# Fixed layouts.
VIEW_COLUMNS = "SCHEMA_NAME string, VIEW_NAME string, COLUMN_NAME string, POSITION int, DATA_TYPE_NAME string, LENGTH int, SCALE int, IS_NULLABLE string"
DEPENDENCIES = "BASE_SCHEMA_NAME string, BASE_OBJECT_NAME string, BASE_OBJECT_TYPE string, DEPENDENT_SCHEMA_NAME string, DEPENDENT_OBJECT_NAME string, DEPENDENT_OBJECT_TYPE string, DEPENDENCY_TYPE int"


def _read(spark: SparkSession, path: str, schema: str | None, sep: str = ",") -> DataFrame:
    """The rows with the text of those that don't fit the schema as `_malformed`, which is null for the others.

    All columns are parsed, so that what fits doesn't depend on the query.
    """
    options = {"header": True, "columnPruning": False, "sep": sep, "quote": '"', "escape": "\\", "encoding": "UTF-8"}
    if schema is None:
        schema = ", ".join(f"`{c}` string" for c in spark.read.options(**options).csv(path).columns)
    return spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed").schema(f"{schema}, _malformed string").csv(path)


def _csv(spark: SparkSession, path: str, schema: str | None, sep: str = ",") -> DataFrame:
    return _read(spark, path, schema, sep).filter("_malformed IS NULL").drop("_malformed")


def malformed(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """(path, line): the lines that a reader of this module leaves aside, since they don't fit its schema."""
    read = materialized(_read(spark, path, schema, sep).select(F.input_file_name().alias("path"), "*"), "catalog")
    return read.filter("_malformed IS NOT NULL").select("path", F.col("_malformed").alias("line"))


def view_columns(spark: SparkSession, path: str) -> DataFrame:
    """(schema_name, view_name, column_name, position)."""
    return _csv(spark, path, VIEW_COLUMNS).selectExpr("SCHEMA_NAME AS schema_name", "VIEW_NAME AS view_name", "COLUMN_NAME AS column_name", "POSITION AS position")


def dependencies(spark: SparkSession, path: str) -> DataFrame:
    """(schema_name, name, base_schema, base_object, base_type, dependency_type, position); the position is the base's name."""
    return _csv(spark, path, DEPENDENCIES).selectExpr(
        "DEPENDENT_SCHEMA_NAME AS schema_name", "DEPENDENT_OBJECT_NAME AS name", "BASE_SCHEMA_NAME AS base_schema", "BASE_OBJECT_NAME AS base_object",
        "BASE_OBJECT_TYPE AS base_type", "cast(DEPENDENCY_TYPE AS string) AS dependency_type", "concat_ws('.', BASE_SCHEMA_NAME, BASE_OBJECT_NAME) AS position",
    )


def cached_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows of an earlier export, all as text."""
    return _csv(spark, path, None, sep)
