"""The lineage row: one fixed schema, all emitters project onto it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed names: the model's core, then its extensions.
CORE = (
    "current_node", "hierarchy_level:int", "source_file", "parent_input_object", "source_object", "source_column", "target_column",
    "label", "node_output_columns", "transformation_type", "formula", "filter_expression", "join_name", "join_expression",
    "join_left_object", "join_left_column", "join_right_object", "join_right_column", "xpath",
)
EXTENSIONS = (
    "lineage_level", "target_node", "source_node", "target_object", "description", "aggregation_type", "engine_aggregation",
    "measure_type", "calculated_measure_type", "datatype", "expression_language", "length", "scale", "join_node_id", "join_type",
    "join_operator", "join_cardinality", "join_language_column", "join_populated_side", "join_populated_fields",
    "join_populated_fields_left", "join_populated_fields_right", "scenario:map<string,string>", "data_source_id", "data_source_type",
    "data_source_resource_uri", "data_source_object", "dimension:map<string,string>", "dimension_default_description",
    "dimension_comments", "dimension_activated_at", "dimension_changed_at", "attribute_key", "attribute_hidden", "attribute_order",
    "attribute_description_column", "weight_transform:double", "weight_filter:double", "rollup_levels", "rollup_aggregation",
    "lld_score:double", "lid_score:double",
)

_KINDS = {"int": T.IntegerType(), "double": T.DoubleType(), "map<string,string>": T.MapType(T.StringType(), T.StringType())}
LINEAGE = T.StructType(
    [T.StructField("row_seq", T.LongType())]
    + [T.StructField(name, _KINDS.get(kind, T.StringType())) for name, _, kind in (f.partition(":") for f in CORE + EXTENSIONS)]
)


def conform(df: DataFrame) -> DataFrame:
    """`df` with exactly the columns of LINEAGE; those it lacks are null, others go."""
    own = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{own[f.name]}`") if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in LINEAGE.fields])


def union_all(*parts: DataFrame) -> DataFrame:
    """Bag union by name; columns that a part lacks are null (SET1)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
