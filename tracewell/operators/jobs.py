"""Job lineage: table edges, paths, column detail and summaries over records of an ETL repository.

`rows` are records with the columns of `sources.records.RECORD_COLUMNS`; results are keyed by target_table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tokens
from ..functions import scalars as S

_NO_DATAFLOW = "(no dataflow)"


def _text(c: str) -> Column:
    return F.coalesce(S.trimmed(c), F.lit(""))


def column_rows(rows: DataFrame) -> DataFrame:
    """Records that describe a column (FLT9)."""
    return rows.filter(F.col("record_type").isin(*tokens.COLUMN_RECORDS))


def table_rows(rows: DataFrame) -> DataFrame:
    """Distinct table-level records (FLT10; our reading: source and target objects with their context)."""
    named = rows.filter((_text("source_object") != "") & (_text("target_object") != ""))
    return named.select("source_object", "target_object", "job_name", "workflow_name", "dataflow_name").distinct()


def records_of(rows: DataFrame, *kinds: str) -> DataFrame:
    """Records of some types (FLT6)."""
    return rows.filter(F.col("record_type").isin(*kinds))


def text_filter(rows: DataFrame, needle: str) -> DataFrame:
    """Records that hold the text in one of five fields, in any case (FLT7)."""
    if not needle:
        return rows
    hit = F.lit(False)
    for c in ("source_object", "source_column", "target_object", "target_column", "formula"):
        hit = hit | F.contains(F.upper(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.upper()))
    return rows.filter(hit)


def table_edges(rows: DataFrame) -> DataFrame:
    """Distinct (target, source) tables of column records."""
    return column_rows(rows).select(_text("target_object").alias("target"), _text("source_object").alias("source")).filter("target <> '' AND source <> '' AND target <> source").distinct()


def table_context(rows: DataFrame) -> DataFrame:
    """(table, job_name, workflow_name, dataflow_name): everything a target is written by, `;`-joined (AGG11-12)."""
    names = ("job_name", "workflow_name", "dataflow_name")
    found = rows.filter(_text("target_object") != "").groupBy(F.upper(_text("target_object")).alias("table"))
    return found.agg(*[F.array_join(F.array_sort(F.collect_set(F.nullif(_text(c), F.lit("")))), ";").alias(c) for c in names])


def targets_of_job(rows: DataFrame, job: str) -> DataFrame:
    """(target_table): what a job writes, without SQL transforms' own names (GRA9)."""
    own = rows.filter(F.upper("job_name") == job.upper()).select(F.upper(_text("target_object")).alias("target_table"))
    return own.filter("target_table <> '' AND NOT startswith(target_table, 'SQL:')").distinct()


def first_context(rows: DataFrame) -> DataFrame:
    """(table, job_name, workflow_name, dataflow_name) of each target's first record (WIN3)."""
    found = rows.filter(_text("target_object") != "").groupBy(F.upper(_text("target_object")).alias("table")).agg(F.min(F.struct("row_seq", "job_name", "workflow_name", "dataflow_name")).alias("r"))
    return found.select("table", "r.job_name", "r.workflow_name", "r.dataflow_name")


def edge_records(tree: DataFrame, hops: DataFrame, context: DataFrame, terminals: DataFrame) -> DataFrame:
    """Edges with hops, context and whether the source is final (PRJ10, JN9). Unknown hops are null."""
    at = lambda name, hop: hops.select("target_table", F.upper("table").alias(name), F.col("hop").alias(hop))
    out = tree.select("target_table", F.upper("table").alias("target"), F.upper("parent").alias("source"))
    out = out.join(at("target", "target_hop"), ["target_table", "target"], "left").join(at("source", "source_hop"), ["target_table", "source"], "left")
    final = terminals.select("target_table", F.upper("table").alias("source"), F.lit(True).alias("is_source")).distinct()
    out = out.join(final, ["target_table", "source"], "left").join(context.withColumnRenamed("table", "target"), "target", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select("target_table", "target", "source", "target_hop", "source_hop", F.coalesce("is_source", F.lit(False)).alias("is_source"), empty("job_name"), empty("workflow_name"), empty("dataflow_name"))


def path_records(records: DataFrame) -> DataFrame:
    """One line of text for each edge with the kinds of its ends, and a rank for display (PRJ11, SRT3)."""
    target = F.when(F.col("target_hop") == 0, "TARGET").otherwise("INTERMEDIATE")
    source = F.when(F.col("is_source"), "FINAL SOURCE").otherwise("INTERMEDIATE")
    text = S.path_text("source", "target", "dataflow_name", "job_name")
    rank = F.when(source == "FINAL SOURCE", 2).otherwise(1)
    return records.select("target_table", text.alias("lineage_path"), "target", target.alias("target_type"), "target_hop", "source", source.alias("source_type"), "source_hop", "job_name", "workflow_name", "dataflow_name", rank.alias("source_rank"))


def in_display_order(paths: DataFrame) -> DataFrame:
    """Sorted for a sheet (SRT3)."""
    return paths.orderBy("target_table", "target_hop", "source_hop", "source_rank", "target", "source")


def sql_edges(rows: DataFrame, records: DataFrame, hops: DataFrame) -> DataFrame:
    """Edges from SQL transforms to known targets that no record has yet, by simple or compound name (JN10, WIN4, GRA14)."""
    flow = F.coalesce(F.nullif(_text("dataflow_name"), F.lit("")), F.lit("SQL"))
    name = F.coalesce(F.nullif(_text("transform_name"), F.lit("")), flow)
    own = rows.filter((F.col("record_type") == "SQL_TRANSFORM") & (_text("target_object") != ""))
    own = own.select("row_seq", name.alias("transform"), F.upper(_text("target_object")).alias("target"), flow.alias("flow"), "job_name", "workflow_name")
    first = own.groupBy("transform", "target").agg(F.min(F.struct("row_seq", "flow", "job_name", "workflow_name")).alias("r"))
    first = first.select(F.concat(F.lit("SQL:"), "transform").alias("source"), "target", F.col("r.flow").alias("dataflow_name"), "r.job_name", "r.workflow_name")
    simple = F.when(F.contains("source", F.lit("|")), F.concat(F.lit("SQL:"), F.element_at(F.split("source", r"\|"), -1))).otherwise(F.col("source"))
    known = records.filter(F.col("source").startswith("SQL:")).select(F.explode(F.array("source", simple)).alias("source"), "target").distinct()
    upper = F.upper("source")
    missing = first.withColumn("k", upper).join(known.select(upper.alias("k"), "target").distinct(), ["k", "target"], "left_anti").drop("k")
    at = hops.select("target_table", F.upper("table").alias("target"), "hop")
    out = missing.join(at, "target")
    return out.select("target_table", "target", "source", F.col("hop").alias("target_hop"), (F.col("hop") + 1).alias("source_hop"), F.lit(False).alias("is_source"), "job_name", "workflow_name", "dataflow_name")


def merged_edges(records: DataFrame) -> DataFrame:
    """One row for each (source, target) with the jobs, workflows and dataflows of all of them (AGG11)."""
    parts = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), S.trimmed)
    union = lambda c: F.array_sort(F.array_except(F.array_distinct(F.flatten(F.collect_set(parts(c)))), F.array(F.lit("")))).alias(c)
    return records.groupBy("source", "target").agg(union("job_name"), union("workflow_name"), union("dataflow_name"))


def node_context(merged: DataFrame) -> DataFrame:
    """(node, jobs, dataflows, multi_job) over both ends of every edge (AGG12)."""
    ends = merged.select(F.explode(F.array("source", "target")).alias("node"), "job_name", "dataflow_name")
    both = ends.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("job_name")))).alias("jobs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("dataflow_name")))).alias("dataflows"))
    return both.withColumn("multi_job", F.size("jobs") > 1)


def node_types(records: DataFrame) -> DataFrame:
    """(node, type) of every node (PRJ12)."""
    target = records.select(F.col("target").alias("node"), (F.col("target_hop") == 0).alias("t"), F.lit(False).alias("s"))
    source = records.select(F.col("source").alias("node"), F.lit(False).alias("t"), F.col("is_source").alias("s"))
    flags = target.unionByName(source).groupBy("node").agg(F.max("t").alias("t"), F.max("s").alias("s"))
    return flags.select("node", S.node_type("node", F.coalesce("t", F.lit(False)), F.coalesce("s", F.lit(False))).alias("type"))


def tab_summary(records: DataFrame) -> DataFrame:
    """Records, farthest hop and final sources by kind for each target (AGG10)."""
    final = lambda p: F.count_if(F.col("is_source") & F.upper("source").startswith(p))
    return records.groupBy("target_table").agg(F.count(F.lit(1)).alias("records"), F.max("source_hop").alias("max_hop"), final("SAP.").alias("sap"), final("FILE:").alias("files"), final("EXCEL:").alias("excel"))


def target_summary(rows: DataFrame, terminals: DataFrame, hops: DataFrame) -> DataFrame:
    """Column records and final sources of each target (AGG13)."""
    own = column_rows(rows).select(F.upper(_text("target_object")).alias("table"))
    n = hops.select("target_table", "table").join(own, "table").groupBy("target_table").agg(F.count(F.lit(1)).alias("total_rows"))
    t = terminals.groupBy("target_table").agg(F.countDistinct("table").alias("terminal_sources"))
    out = hops.select("target_table").distinct().join(n, "target_table", "left").join(t, "target_table", "left")
    return out.na.fill(0, ["total_rows", "terminal_sources"])


def resolved_targets(rows: DataFrame, hops: DataFrame) -> DataFrame:
    """Records with `canonical`: the reached table of the target's full or else bare name; others go (JN13, FLT11)."""
    full = hops.select(F.upper("table").alias("k"), F.upper("table").alias("canonical"), F.lit(0).alias("p"))
    bare = hops.select(F.element_at(F.split(F.upper("table"), r"\."), -1).alias("k"), F.upper("table").alias("canonical"), F.lit(1).alias("p"))
    known = full.unionByName(bare).groupBy("k").agg(F.min(F.struct("p", "canonical")).alias("r")).select("k", "r.canonical")
    name = F.upper(_text("target_object"))
    out = rows.withColumn("__k", name).join(known.withColumnRenamed("k", "__k"), "__k", "left").withColumn("__b", F.element_at(F.split("__k", r"\."), -1))
    out = out.join(known.select(F.col("k").alias("__b"), F.col("canonical").alias("__c")), "__b", "left")
    return out.withColumn("canonical", F.coalesce("canonical", "__c")).drop("__k", "__b", "__c").filter("canonical IS NOT NULL")


def column_data(rows: DataFrame, hops: DataFrame, context: DataFrame) -> DataFrame:
    """For each reached target and dataflow its mappings, joins and filters; stubs for targets without any (AGG14, JN11-12)."""
    flow = F.coalesce(F.nullif(F.col("dataflow_name"), F.lit("")), F.lit(_NO_DATAFLOW))
    own = resolved_targets(column_rows(rows), hops).withColumn("df", flow)
    direct = F.coalesce((F.col("transformation_type") == "DIRECT_SOURCE") | (F.col("transformation_category") == "PASS_THROUGH"), F.lit(False))
    kind = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("transformation_type", "formula_type", "formula_category")], F.lit(""))
    formula = F.coalesce(F.nullif(_text("formula"), F.lit("")), _text("expression_text"))
    maps = own.groupBy(F.col("canonical").alias("target"), "df").agg(
        F.min(F.struct("row_seq", F.coalesce("job_name", F.lit("")).alias("job"), F.coalesce("workflow_name", F.lit("")).alias("wf"))).alias("c"),
        F.transform(F.array_sort(F.collect_list(F.struct("row_seq", "source_column", "target_column", formula.alias("formula"), direct.alias("direct"), kind.alias("kind"), "functions_used", "source_object"))), lambda m: m.dropFields("row_seq")).alias("mappings"),
    )
    joins = rows.filter(F.col("record_type").isin("JOIN", "JOIN_KEY_MAPPING")).withColumn("df", flow).groupBy("df")
    joins = joins.agg(F.array_sort(F.collect_set(F.struct("join_type", "join_left_object", "join_right_object", "join_left_column", "join_right_column", "join_condition"))).alias("joins"))
    filters = resolved_targets(rows.filter((F.col("record_type") == "FILTER") & (F.coalesce("where_condition", F.lit("")) != "")), hops).withColumn("df", flow)
    filters = filters.groupBy(F.col("canonical").alias("target"), "df").agg(F.array_sort(F.collect_set("where_condition")).alias("filters"))
    out = maps.join(joins, "df", "left").join(filters, ["target", "df"], "left").select("target", "df", "c.job", "c.wf", "mappings", "joins", "filters")
    seen = hops.select(F.upper("table").alias("target")).distinct().join(maps.select("target").distinct(), "target", "left_anti").join(context.withColumnRenamed("table", "target"), "target")
    stubs = seen.select("target", F.explode(F.split("dataflow_name", ";")).alias("df"), F.col("job_name").alias("job"), F.col("workflow_name").alias("wf")).withColumn("df", F.trim("df")).filter("df <> ''")
    return out.unionByName(stubs, allowMissingColumns=True)


def in_badge_order(column_detail: DataFrame) -> DataFrame:
    """Mappings of each target column, direct ones first (AGG17)."""
    flat = column_detail.select("target", "df", F.explode("mappings").alias("m")).select("target", "df", "m.*")
    return flat.withColumn("badge", S.mapping_badge("kind", "direct", "formula")).orderBy("target", "target_column", F.desc("direct"), "df")


def extraction_summary(rows: DataFrame) -> DataFrame:
    """One row of counts and coverage (AGG9)."""
    kind = F.col("record_type")
    mapped, projected = F.count_if(kind == "COLUMN_MAPPING"), F.count_if(kind == "PROJECTION")
    coverage = F.when(projected > 0, F.round(100.0 * mapped / projected, 2)).otherwise(0.0)
    return rows.agg(F.count(F.lit(1)).alias("total_rows"), mapped.alias("column_mappings"), projected.alias("projections"), F.count_if(kind.isin("JOIN", "FILTER", "GROUP_BY", "ORDER_BY", "UNNEST")).alias("query_level"), F.countDistinct("source_object").alias("source_objects"), F.countDistinct("target_object").alias("target_objects"), F.countDistinct("job_name").alias("jobs"), coverage.alias("coverage_pct"))


def field_search(rows: DataFrame, needle: str) -> DataFrame:
    """Edges whose source or target column holds the text, numbered in order of first sight (FLT8, WIN5)."""
    from .etl import surrogate_keys

    hit = lambda c: F.contains(F.upper(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.upper()))
    found = column_rows(rows).filter(hit("source_column") | hit("target_column")).groupBy("source_object", "target_object").agg(F.min("row_seq").alias("first_seen"))
    return surrogate_keys(found, ["first_seen"], 1, "number")


def flow_groups(records: DataFrame) -> DataFrame:
    """(label, target_table, records): results grouped by dataflow, or by bare table without one (GRA15)."""
    label = F.coalesce(F.nullif(S.trimmed(F.substring_index("dataflow_name", ";", 1)), F.lit("")), F.element_at(F.split("target_table", r"\."), -1))
    return records.groupBy(label.alias("label"), "target_table").agg(F.count(F.lit(1)).alias("records"))


def column_siblings(rows: DataFrame, table: str, column: str) -> DataFrame:
    """Records that write a column of a table given by its full or bare name (JN16): two equi filters, once each."""
    own = column_rows(rows).filter(F.upper("target_column") == column.upper())
    full = F.upper(_text("target_object"))
    return own.filter((full == table.upper()) | (F.element_at(F.split(full, r"\."), -1) == table.upper().rsplit(".", 1)[-1]))


def field_evolution(rows: DataFrame, targets: DataFrame, max_depth: int = 10) -> DataFrame:
    """Every path of a column upstream through tables, with the formula of each step (GRA13)."""
    from .graph import paths

    own = column_rows(rows).select(F.concat_ws(".", F.upper(_text("target_object")), F.upper(_text("target_column"))).alias("target"), F.concat_ws(".", F.upper(_text("source_object")), F.upper(_text("source_column"))).alias("source"), F.coalesce("formula", F.lit("")).alias("formula"), "row_seq")
    steps = own.filter("target <> source").groupBy("target", "source").agg(F.min(F.struct("row_seq", "formula")).alias("r")).select("target", "source", "r.formula")
    found = paths(steps, targets.select(F.upper("target").alias("seed")), max_depth)
    last = F.element_at("path", -2)
    out = found.filter("depth > 0").withColumn("target", last).join(steps.withColumnRenamed("source", "node"), ["target", "node"])
    return out.select("seed", "node", "depth", F.array_join("path", " <- ").alias("path"), "formula")
