"""Enrichment of lineage rows from a catalog of view columns and object dependencies (ENR1-9).

catalog columns: (schema_name, view_name, column_name, position); dependencies: (schema_name, name, base_schema, base_object,
base_type, dependency_type, position). Every step is a join or an expression and may run again without effect on its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tokens
from ..functions import scalars as S


def _text(c: str) -> Column:
    return F.coalesce(S.trimmed(c), F.lit(""))


def _split(x: Column) -> tuple[Column, Column]:
    """Upper-cased schema ('' without one) and name, split at the first dot."""
    x = F.upper(x)
    dot = F.contains(x, F.lit("."))
    return F.when(dot, F.substring_index(x, ".", 1)).otherwise(""), F.when(dot, F.regexp_replace(x, r"^[^.]*\.", "")).otherwise(x)


def _tagged(tag: str) -> Column:
    return F.concat(F.coalesce("transformation_type", F.lit("")), F.lit(tag))


def catalog_lists(columns: DataFrame) -> DataFrame:
    """(schema, name, cols) with the columns in order (SRC4, SRC6)."""
    listed = columns.groupBy(F.upper("schema_name").alias("c_schema"), F.upper("view_name").alias("c_name"))
    return listed.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda s: s["column_name"]).alias("cols"))


def star_expansion(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows with a star or blank on a side become one row for each catalog column of their node (ENR1, JN4)."""
    open_ = _text("source_column").isin("*", "") | _text("target_column").isin("*", "")
    schema, name = _split(_text("current_node"))
    wide = rows.filter(open_).join(catalog_lists(columns), (schema == F.col("c_schema")) & (name == F.col("c_name")), "left")
    hit = F.col("cols").isNotNull()
    new = wide.filter(hit).withColumn("__c", F.explode("cols"))
    new = new.withColumns({
        "source_column": F.when(_text("source_column") == "*", F.col("__c")).otherwise(F.col("source_column")),
        "target_column": F.when(_text("target_column") == "*", F.col("__c")).otherwise(F.col("target_column")),
        "transformation_type": _tagged("|StarExpanded"),
    })
    return rows.filter(~open_).unionByName(wide.filter(~hit).select(*rows.columns)).unionByName(new.select(*rows.columns))


def first_dependency(dependencies: DataFrame) -> DataFrame:
    """(d_schema, d_name, d_source): the first base object of each object (WIN2, JN6)."""
    found = dependencies.groupBy(F.upper("schema_name").alias("d_schema"), F.upper("name").alias("d_name"))
    return found.agg(F.min_by(F.concat_ws(".", "base_schema", "base_object"), F.col("position")).alias("d_source"))


def source_inference(rows: DataFrame, dependencies: DataFrame) -> DataFrame:
    """A missing source object from the parent, the node itself, or its first dependency (ENR2)."""
    parent = S.trimmed(F.regexp_replace(_text("parent_input_object"), r"^#\s*", ""))
    parent = F.coalesce(F.element_at(F.split(F.trim(F.substring_index(parent, ",", 1)), r"\s+"), 1), F.lit(""))
    parent = F.when(parent != tokens.NULL, parent).otherwise("")
    schema, name = _split(_text("current_node"))
    out = rows.join(first_dependency(dependencies), (schema == F.col("d_schema")) & (name == F.col("d_name")), "left")
    gap = S.is_missing("source_object")
    how = F.when(gap & (parent != "") & (parent != _text("current_node")), "|ParentInputSource").when(gap & (parent != ""), "|SelfInputSource").when(gap & F.col("d_source").isNotNull(), "|SourceInferred")
    source = F.when(how == "|ParentInputSource", parent).when(how == "|SelfInputSource", _text("current_node")).when(how == "|SourceInferred", F.col("d_source")).otherwise(F.col("source_object"))
    return out.withColumns({"source_object": source, "transformation_type": F.when(how.isNull(), F.col("transformation_type")).otherwise(F.concat(F.coalesce("transformation_type", F.lit("")), how))}).select(*rows.columns)


def target_recovery(rows: DataFrame) -> DataFrame:
    """The node as the target object where that is missing (ENR3)."""
    if "target_object" not in rows.columns:
        rows = rows.withColumn("target_object", F.lit(None).cast("string"))
    gap = S.is_missing("target_object") & (_text("current_node") != "")
    return rows.withColumns({"target_object": F.when(gap, _text("current_node")).otherwise(F.col("target_object")), "transformation_type": F.when(gap, _tagged("|TargetRecovered")).otherwise(F.col("transformation_type"))})


def carry_forward(rows: DataFrame) -> DataFrame:
    """Where a node has exactly one source object, a missing source column is the target column (ENR4, AGG16)."""
    source = S.present("source_object")
    single = rows.filter(_text("current_node") != "").groupBy(_text("current_node").alias("__node")).agg(F.min(source).alias("a"), F.max(source).alias("b")).filter("a = b").select("__node")
    out = rows.join(single, _text("current_node") == F.col("__node"), "left")
    go = F.col("__node").isNotNull() & (_text("target_column") != "") & S.is_missing("source_column")
    return out.withColumns({"transformation_type": F.when(go, _tagged("|CarryForward")).otherwise(F.col("transformation_type")), "source_column": F.when(go, _text("target_column")).otherwise(F.col("source_column"))}).select(*rows.columns)


def null_classification(rows: DataFrame) -> DataFrame:
    """Missing columns by what is known about them (ENR5)."""
    dotted = lambda c: F.contains(_text(c), F.lit("."))
    source = F.when(S.is_missing("source_column"), F.when(dotted("source_object"), tokens.NULL_XML).otherwise(tokens.NULL_INFERRED)).otherwise(F.col("source_column"))
    target = F.when(S.is_missing("target_column"), F.when(dotted("current_node"), tokens.NULL_DERIVED).otherwise(tokens.NULL_UNKNOWN)).otherwise(F.col("target_column"))
    return rows.withColumns({"source_column": source, "target_column": target})


def source_table_expansion(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Star rows of source tables gain one row for each column of the source object; the originals stay (ENR6, JN5)."""
    source = _text("source_object")
    star = _text("transformation_type").startswith("Source_Table") & F.contains(source, F.lit(".")) & ((_text("source_column") == "*") | (_text("source_column") == F.concat(source, F.lit(".*"))))
    schema, name = _split(source)
    new = rows.filter(star).join(catalog_lists(columns), (schema == F.col("c_schema")) & (name == F.col("c_name"))).withColumn("__c", F.explode("cols"))
    new = new.withColumns({"target_column": F.when(F.coalesce("target_column", F.lit("")).isin("", "*"), F.col("__c")).otherwise(F.col("target_column")), "source_column": F.col("__c"), "transformation_type": F.concat(_text("transformation_type"), F.lit("_Expanded"))})
    return rows.unionByName(new.select(*rows.columns))


def output_fill(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Missing output lists from the catalog (ENR7; after it no row is left for a later fallback, ENR8)."""
    schema, name = _split(_text("current_node"))
    out = rows.join(catalog_lists(columns), (schema == F.col("c_schema")) & (name == F.col("c_name")), "left")
    gap = F.coalesce("node_output_columns", F.lit("")).isin("", tokens.NULL) & F.col("cols").isNotNull()
    return out.withColumn("node_output_columns", F.when(gap, F.concat_ws(",", "cols")).otherwise(F.col("node_output_columns"))).select(*rows.columns)


def runtime_dependencies(rows: DataFrame, dependencies: DataFrame) -> DataFrame:
    """New rows: the base objects of every qualified node or source object (ENR9, JN7, FLT13)."""
    named = rows.select(F.explode(F.array("current_node", "source_object")).alias("v")).select(_text("v").alias("v")).filter(F.contains("v", F.lit("."))).distinct()
    schema, name = _split(F.col("v"))
    named = named.select(F.trim(schema).alias("s"), F.trim(name).alias("n")).distinct()
    found = named.join(dependencies, (F.col("s") == F.upper("schema_name")) & (F.col("n") == F.upper("name"))).select("s", "n", "base_schema", "base_object", "base_type", "dependency_type").distinct()
    own, null = F.concat_ws(".", "s", "n"), F.lit(tokens.NULL)
    return found.select(
        own.alias("current_node"), F.lit(1).alias("hierarchy_level"), F.lit(tokens.RUNTIME_FILE).alias("source_file"), own.alias("parent_input_object"), F.concat_ws(".", "base_schema", "base_object").alias("source_object"),
        null.alias("source_column"), F.lit("*").alias("target_column"), F.lit("Runtime_Dependency").alias("transformation_type"), F.format_string("type=%s; dependency=%s", "base_type", "dependency_type").alias("formula"),
        null.alias("filter_expression"), null.alias("join_name"), null.alias("join_expression"), null.alias("join_left_object"), null.alias("join_left_column"), null.alias("join_right_object"), null.alias("join_right_column"), null.alias("xpath"),
    )


def enrich(rows: DataFrame, columns: DataFrame, dependencies: DataFrame) -> DataFrame:
    """All tiers in order."""
    out = null_classification(carry_forward(target_recovery(source_inference(star_expansion(rows, columns), dependencies))))
    return output_fill(source_table_expansion(out, columns), columns)
