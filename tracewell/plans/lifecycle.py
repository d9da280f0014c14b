"""Whole runs: a folder of views to lineage rows, and targets or jobs to their upstream picture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, extract, graph, jobs, rows
from ..schema import conform, union_all
from ..sources import shred
from ..sources.documents import read_documents
from ..storage import materialized


@dataclass(frozen=True)
class Options:
    """Switches of a run over views."""

    strict: bool = False
    propagate_filters: bool = True
    filter_factor: float = 1.0
    roll_up: bool = False
    merge_parallel: str | None = None  # "mean", "max" or "sum"
    least_transform: float = 0.35
    least_filter: float = 0.25
    pull_through: bool = True


def read_views(spark: SparkSession, path: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lineage rows of the documents at `path`, and the documents that give none with the reason."""
    shredded = materialized(shred.shred(read_documents(spark, path, recursive)), "shredded")
    return extract.extract(shred.elements(shredded)), shred.bad_documents(shredded)


def analyse(found: DataFrame, columns: DataFrame | None = None, dependencies: DataFrame | None = None, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Rows deduplicated, weighed, propagated, filtered, scored, pulled through and enriched, in this order."""
    out = rows.with_weights(rows.first_of_each(conform(found)), options.strict)
    if options.propagate_filters:
        out = rows.filter_propagation(out, options.filter_factor)
    if options.roll_up:
        out = rows.parent_rollup(out)
    if options.merge_parallel:
        out = rows.merge_parallel(out, options.merge_parallel)
    out = rows.with_scores(rows.semantic_layer(out, options.least_transform, options.least_filter), options.strict)
    out = materialized(conform(out), "analysed")
    if options.pull_through:
        out = rows.first_of_each(conform(union_all(out, rows.pullthrough(out))))
    if columns is not None and dependencies is not None:
        out = rows.first_of_each(conform(enrich.enrich(materialized(out, "analysed"), columns, dependencies)))
        out = materialized(out, "enriched")
        out = rows.first_of_each(conform(union_all(out, enrich.runtime_dependencies(out, dependencies))))
    return out


def trace_tables(records: DataFrame, targets: DataFrame, max_hops: int = 10) -> dict[str, DataFrame]:
    """The upstream picture of the targets (column target_table), all keyed by it."""
    edges = materialized(jobs.table_edges(records), "table-edges")
    hops = materialized(graph.hop_map(edges, targets, max_hops), "hops")
    terminals, tree, context = graph.terminal_sources(edges, hops), graph.upstream_tree(edges, hops), jobs.table_context(records)
    found = jobs.edge_records(tree, hops, context, terminals)
    found = materialized(found.unionByName(jobs.sql_edges(records, found, hops)), "edge-records")
    sql = records.filter("record_type = 'SQL_TRANSFORM'")
    return {
        "hop_map": hops, "upstream_tree": tree, "terminal_sources": terminals, "table_context": hops.select("target_table", "table").join(context, "table"), "edges": found,
        "sql_members": sql.filter(F.col("target_object").startswith("SQL:")).select(F.col("target_object").alias("sql_key"), F.col("source_object").alias("member")).distinct(),
        "sql_queries": sql.filter(F.col("source_object").startswith("SQL:")).select(F.col("source_object").alias("sql_key"), *(["expression_text"] if "expression_text" in records.columns else [])).distinct(),
        "rows": jobs.resolved_targets(jobs.column_rows(records), hops), "summary": jobs.target_summary(records, terminals, hops),
    }


def trace_job(records: DataFrame, job: str, max_hops: int = 10) -> dict[str, DataFrame]:
    """The same for every table that a job writes (GRA9)."""
    return trace_tables(records, jobs.targets_of_job(records, job), max_hops)
