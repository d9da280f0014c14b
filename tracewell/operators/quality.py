"""Checks and profiles of lineage rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tokens
from ..functions import scalars as S

#: Types of rows that need no source column. Fixed values.
SOURCELESS = ("Filter", "Join", "Runtime_Dependency", "Source_Table")
#: Columns that make a row informative. Fixed values.
INFORMATIVE = ("transformation_type", "current_node", "parent_input_object", "source_object", "source_column", "target_column", "formula", "filter_expression", "join_expression")
#: Columns that a handoff must have, and the weight that each broken rule costs. Fixed values.
REQUIRED = ("current_node", "source_object", "source_column", "target_column", "transformation_type", "formula", "filter_expression", "join_expression", "join_left_object", "join_left_column", "join_right_object", "join_right_column")
RULE_WEIGHTS = {"missing_required_columns": 30, "mapping_without_source": 20, "empty_filter_expression": 10, "join_incomplete_side": 15, "star_unexpanded": 10, "bad_column_name": 5, "duplicate_rows": 5, "cycle_detected": 5}
IGNORED_RULES, PASS_SCORE = ("cycle_detected",), 85
HINT = "The target has no source and isn't among its node's outputs; look at the mappings of projections, unions and aggregations."


def lint(rows: DataFrame) -> DataFrame:
    """Targets without a source that their node doesn't output (FLT2)."""
    kind, outputs = S.trimmed(F.coalesce("transformation_type", F.lit(""))), F.coalesce(S.trimmed("node_output_columns"), F.lit(""))
    listed = F.transform(F.split(outputs, ","), S.trimmed)
    target = S.present("target_column")
    bad = target.isNotNull() & ~kind.isin(*SOURCELESS) & S.is_missing("source_column") & ~(F.array_contains(listed, target) & (outputs != ""))
    shown = lambda c: F.when(c == "", tokens.NULL).otherwise(c)
    return rows.filter(bad).select("current_node", target.alias("target_column"), F.lit(tokens.NULL).alias("source_column"), shown(kind).alias("transformation_type"), "parent_input_object", shown(outputs).alias("node_output_columns"), "source_file", "xpath", F.lit(HINT).alias("hint"))


def null_profile(rows: DataFrame, columns=None) -> DataFrame:
    """(column, nulls, not_nulls, null_pct) over all rows; blank counts as null, tokens don't (AGG6). One pass, no shuffle of rows."""
    columns = list(columns or [c for c, t in rows.dtypes if t == "string"])
    empty = lambda c: F.count_if(S.trimmed(F.coalesce(F.col(c), F.lit(""))) == "")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[empty(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])
    out = counts.select("n", F.explode(pairs).alias("p")).select("n", "p.column", "p.nulls")
    pct = F.when(F.col("n") > 0, F.round(100.0 * F.col("nulls") / F.col("n"), 2)).otherwise(0.0)
    return out.select("column", "nulls", (F.col("n") - F.col("nulls")).alias("not_nulls"), pct.alias("null_pct"))


def file_utilisation(rows: DataFrame, columns=INFORMATIVE, most: int = 100, least: int = 1) -> DataFrame:
    """For the files with most rows: rows, informative rows and null percentages (AGG7, SRT4)."""
    blank = {c: S.trimmed(F.coalesce(F.col(c), F.lit(""))) == "" for c in columns}
    full = ~F.lit(True)
    for b in blank.values():
        full = full | ~b
    found = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(full).alias("informative"), *[F.round(100.0 * F.count_if(b) / F.count(F.lit(1)), 2).alias(f"{c}_null_pct") for c, b in blank.items()])
    return found.filter(F.col("rows") >= least).orderBy(F.desc("rows"), "source_file").limit(most)


def validation(rows: DataFrame) -> DataFrame:
    """(rule, findings, weight, score, status): each broken rule costs its weight once (ENR12; declared rules, our predicates)."""
    absent = [c for c in REQUIRED if c not in rows.columns]
    kind = F.coalesce("transformation_type", F.lit(""))
    key = [c for c in tokens.ROW_KEY if c in rows.columns]
    tests = {
        "mapping_without_source": kind.contains("Mapping") & S.is_missing("source_column"),
        "empty_filter_expression": (kind == "Filter") & S.is_missing("filter_expression"),
        "join_incomplete_side": S.is_missing("join_left_column") != S.is_missing("join_right_column"),
        "star_unexpanded": (F.trim("source_column") == "*") | F.col("source_column").endswith(".*"),
        "bad_column_name": S.present("target_column").rlike(r"[\s,;]"),
    }
    counts = rows.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(r) for r, t in tests.items()])
    repeats = rows.groupBy(*key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    both = counts.withColumn("k", F.lit(1)).join(repeats.withColumn("k", F.lit(1)), "k")  # one row each
    both = both.withColumn("missing_required_columns", F.lit(len(absent)).cast("long"))
    rules = [r for r in RULE_WEIGHTS if r not in IGNORED_RULES]
    listed = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("findings"), F.lit(RULE_WEIGHTS[r]).alias("weight")) for r in rules])).alias("x")
    score = F.lit(100)
    for r in rules:
        score = score - F.when(F.col(r) > 0, RULE_WEIGHTS[r]).otherwise(0)
    out = both.select(score.alias("score"), listed).select("x.rule", "x.findings", "x.weight", "score")
    return out.withColumn("status", F.when(F.col("score") >= PASS_SCORE, "PASS").otherwise("FAIL"))
