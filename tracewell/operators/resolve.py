"""Names of expressions and mappings against the catalog (SRC6 with EXT4 and EXT6).

The reader of a view knows a column by name only. Where a mapping has no source, or a formula names no column, what its target
depends on is every column that the catalog has for the node's own view; where a formula names columns, the catalog tells which
object they belong to. Expressions and names are made distinct before they meet the catalog, and the catalog's index by column
name holds one row for each name, so a name that all views have joins once and not with each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .enrich import _split, catalog_lists

#: Types of rows that register what their target depends on: by their source, or by their formula. Fixed values.
BY_SOURCE, BY_FORMULA = ("Node_Mapping",), ("Calculated_Measure",)


def _named(rows: DataFrame) -> DataFrame:
    """(expression, identifier): the identifiers of each different formula."""
    formulas = rows.filter(~S.is_missing("formula")).select(F.col("formula").alias("expression")).distinct()
    return formulas.select("expression", F.explode(S.identifiers("expression")).alias("identifier"))


def registered_dependencies(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(target, source, current_node, origin), distinct: what targets of node mappings and calculated measures depend on.

    Origin is MAPPING, FORMULA or CATALOG. `columns` is the catalog (schema_name, view_name, column_name, position). A node
    without a schema, or unknown to the catalog, falls back on nothing; names compare in upper case.
    """
    kept = rows.filter(F.col("transformation_type").isin(*BY_SOURCE, *BY_FORMULA) & ~S.is_missing("target_column"))
    kept = kept.select("current_node", S.trimmed("target_column").alias("target"), "transformation_type", S.present("source_column").alias("source"), "formula").distinct()
    mapped = kept.filter(F.col("transformation_type").isin(*BY_SOURCE))
    direct = mapped.filter("source IS NOT NULL").select("target", "source", "current_node", F.lit("MAPPING").alias("origin"))
    calculated = kept.filter(F.col("transformation_type").isin(*BY_FORMULA)).drop("source")
    named = _named(kept)
    tokens_ = calculated.join(named, calculated["formula"] == named["expression"]).select("target", F.col("identifier").alias("source"), "current_node", F.lit("FORMULA").alias("origin"))
    nameless = calculated.join(named, calculated["formula"] == named["expression"], "left_anti")
    open_ = mapped.filter("source IS NULL").select("target", "current_node").unionByName(nameless.select("target", "current_node")).filter(F.contains("current_node", F.lit(".")))
    schema, name = _split(F.col("current_node"))
    fallback = open_.join(catalog_lists(columns), (schema == F.col("c_schema")) & (name == F.col("c_name"))).select("target", F.explode("cols").alias("source"), "current_node", F.lit("CATALOG").alias("origin"))
    return direct.unionByName(tokens_).unionByName(fallback).distinct()


def resolved_identifiers(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(current_node, target_column, identifier, object, how): the catalog object of each column that a formula names.

    How: OWN, of the node's own view; INPUT, of the row's parent or source object; UNIQUE, of the only object that has such a
    column; else AMBIGUOUS or UNKNOWN, without an object.
    """
    kept = rows.filter(~S.is_missing("formula")).select("current_node", "parent_input_object", "source_object", "target_column", "formula").distinct()
    named = _named(kept)
    asked = kept.join(named, kept["formula"] == named["expression"]).select("current_node", "parent_input_object", "source_object", "target_column", "identifier").distinct()
    held = columns.select(F.upper("schema_name").alias("c_schema"), F.upper("view_name").alias("c_name"), F.upper("column_name").alias("c_column")).distinct()
    # distinct (object, name) pairs meet the catalog, rows meet what those have found
    places = asked.select("identifier", F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.regexp_replace(S.trimmed(F.coalesce(c, F.lit(""))), "^#", "").alias("of")) for k, c in enumerate(("current_node", "parent_input_object", "source_object"))])).alias("p"))
    places = places.select("identifier", F.col("p.of").alias("of")).filter(F.contains("of", F.lit("."))).distinct()
    schema, name = _split(F.col("of"))
    found = places.join(held, (schema == F.col("c_schema")) & (name == F.col("c_name")) & (F.upper("identifier") == F.col("c_column"))).select("identifier", "of", F.concat_ws(".", "c_schema", "c_name").alias("object"))
    alone = held.groupBy("c_column").agg(F.count(F.lit(1)).alias("holders"), F.min(F.concat_ws(".", "c_schema", "c_name")).alias("any"))
    out = asked
    for k, c in enumerate(("current_node", "parent_input_object", "source_object")):
        of = found.select(F.col("identifier").alias(f"i{k}"), F.col("of").alias(f"of{k}"), F.col("object").alias(f"object{k}"))
        own = F.regexp_replace(S.trimmed(F.coalesce(c, F.lit(""))), "^#", "")
        out = out.join(of, (F.col("identifier") == F.col(f"i{k}")) & (own == F.col(f"of{k}")), "left")
    out = out.join(alone, F.upper("identifier") == F.col("c_column"), "left")
    how = F.when(F.col("object0").isNotNull(), "OWN").when(F.coalesce("object1", "object2").isNotNull(), "INPUT").when(F.col("holders") == 1, "UNIQUE").when(F.col("holders") > 1, "AMBIGUOUS").otherwise("UNKNOWN")
    thing = F.coalesce("object0", "object1", "object2", F.when(F.col("holders") == 1, F.col("any")))
    return out.select("current_node", "target_column", "identifier", thing.alias("object"), how.alias("how")).distinct()
