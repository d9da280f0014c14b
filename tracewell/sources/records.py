"""Records of job lineage: one schema for whatever a repository export gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed names.
RECORD_COLUMNS = (
    "record_type", "source_object", "source_column", "target_object", "target_column", "formula", "formula_clean", "expression_text",
    "transformation_type", "transformation_category", "functions_used", "formula_type", "formula_complexity", "formula_category",
    "formula_risk", "has_aggregation", "has_conditional", "nesting_depth", "transform_name", "job_name", "workflow_name", "dataflow_name",
    "join_type", "join_left_object", "join_left_column", "join_right_object", "join_right_column", "join_condition", "where_condition",
)


def conform(df: DataFrame) -> DataFrame:
    """row_seq and every record column as text; those that are absent are null."""
    seq = F.col("row_seq").cast("long") if "row_seq" in df.columns else F.monotonically_increasing_id()
    return df.select(seq.alias("row_seq"), *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in RECORD_COLUMNS])
