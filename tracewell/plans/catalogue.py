"""The registered queries and, for each, the SQL that another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tokens
from ..functions import scalars as S
from ..operators import enrich, graph, jobs, quality, rows
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_NAMED = {"lineage": X.LINEAGE, "trace": X.TRACE, "gaps": X.GAPS, "cat": X.CATALOG_COLUMNS, "deps": X.DEPENDENCIES, "jobs": X.JOBS, "exprs": X.EXPRESSIONS}
KEYWORDS = ", ".join(f"'{k}'" for k in tokens.KEYWORDS)
#: Pieces of SQL that several queries share.
IDENTIFIERS = rf"""list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(t, '"([^"]+)"', 1),
  list_filter(regexp_extract_all(t, '\b([A-Za-z_][A-Za-z0-9_.]*)\b', 1), lambda k: upper(k) NOT IN ({KEYWORDS}))), lambda k: trim(list_last(string_split(k, '.')))), lambda k: k <> '')))"""


def fixture(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: X.build(spark, sf_dir, _NAMED[name])


def register(name: str, uses: str, sql: str | None = None, recursive: bool = False):
    """Register a function of the named fixtures; `sql` follows common table expressions of theirs."""
    names = uses.split()

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[fixture(n)(spark, sf_dir) for n in names])
        if sql:
            ctes = ",\n".join(f"{n} AS ({X.plain(_NAMED[n])})" for n in names)
            own = sql.strip()
            SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{', ' if own.startswith('+') else ' '}{own.removeprefix('+')}"
        return f

    return put


def _edges(df: DataFrame) -> DataFrame:
    return df.select(F.col("current_node").alias("target"), F.col("source_object").alias("source"))


def _seeds(df: DataFrame, column: str, *names: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")


HOPS = """+ e AS (SELECT DISTINCT current_node AS t, source_object AS s FROM lineage), r AS (SELECT 'CV_REGION_0' AS n, 0 AS hop UNION SELECT e.s, r.hop + 1 FROM r JOIN e ON e.t = r.n WHERE r.hop < 10),
h AS (SELECT n, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY n)"""


@register("hop_map_region", "lineage", HOPS + " SELECT 'CV_REGION_0' AS target_table, n AS \"table\", hop FROM h", True)
def _(df):
    return graph.hop_map(_edges(df), _seeds(df, "target_table", "CV_REGION_0"))


@register("terminal_sources", "lineage", HOPS + " SELECT 'CV_REGION_0' AS target_table, n AS \"table\" FROM h WHERE hop > 0 AND n NOT IN (SELECT t FROM e)", True)
def _(df):
    edges = _edges(df)
    return graph.terminal_sources(edges, graph.hop_map(edges, _seeds(df, "target_table", "CV_REGION_0")))


@register("upstream_tree", "lineage", HOPS + " SELECT 'CV_REGION_0' AS target_table, t AS \"table\", s AS parent FROM e WHERE t IN (SELECT n FROM h) AND s IN (SELECT n FROM h)", True)
def _(df):
    edges = _edges(df)
    return graph.upstream_tree(edges, graph.hop_map(edges, _seeds(df, "target_table", "CV_REGION_0")))


@register("layers", "lineage", HOPS + " SELECT 'CV_REGION_0' AS target_table, n AS \"table\", (SELECT max(hop) FROM h) - hop AS layer FROM h", True)
def _(df):
    return graph.layers(graph.hop_map(_edges(df), _seeds(df, "target_table", "CV_REGION_0")))


@register("downstream_impact", "lineage", """+ e AS (SELECT DISTINCT current_node AS t, source_object AS s FROM lineage), r AS (SELECT 'DIM_SEG_BUILDING' AS seed, 'DIM_SEG_BUILDING' AS n, 0 AS hop UNION ALL SELECT 'CV_CUST_7', 'CV_CUST_7', 0 UNION SELECT r.seed, e.t, r.hop + 1 FROM r JOIN e ON e.s = r.n WHERE r.hop < 50)
SELECT seed, n AS node, 'down' AS side, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY ALL""", True)  # fmt: skip
def _(df):
    return graph.spotlight(_edges(df), _seeds(df, "seed", "DIM_SEG_BUILDING", "CV_CUST_7"), "down")


@register("path_spotlight", "lineage", """+ e AS (SELECT DISTINCT current_node AS t, source_object AS s FROM lineage), u AS (SELECT 'CV_CUST_7' AS n, 0 AS hop UNION SELECT e.s, u.hop + 1 FROM u JOIN e ON e.t = u.n WHERE u.hop < 50),
d AS (SELECT 'CV_CUST_7' AS n, 0 AS hop UNION SELECT e.t, d.hop + 1 FROM d JOIN e ON e.s = d.n WHERE d.hop < 50)
SELECT 'CV_CUST_7' AS seed, n AS node, 'up' AS side, CAST(min(hop) AS INTEGER) AS hop FROM u GROUP BY n UNION ALL SELECT 'CV_CUST_7', n, 'down', CAST(min(hop) AS INTEGER) FROM d GROUP BY n""", True)  # fmt: skip
def _(df):
    return graph.spotlight(_edges(df), _seeds(df, "seed", "CV_CUST_7"), "both")


@register("transitive_closure", "lineage", """+ e AS (SELECT DISTINCT current_node AS t, source_object AS s FROM lineage),
r AS (SELECT t AS node, s AS ancestor FROM e UNION SELECT r.node, e.s FROM r JOIN e ON e.t = r.ancestor) SELECT node, ancestor FROM r""", True)  # fmt: skip
def _(df):
    return graph.closure(_edges(df))


@register("column_closure", "lineage", """+ e AS (SELECT DISTINCT trim(target_column) AS t, trim(source_column) AS s FROM lineage WHERE trim(target_column) NOT IN ('', '<NULL>') AND trim(source_column) NOT IN ('', '<NULL>')),
r AS (SELECT t AS node, s AS ancestor FROM e UNION SELECT r.node, e.s FROM r JOIN e ON e.t = r.ancestor) SELECT node, ancestor FROM r""", True)  # fmt: skip
def _(df):
    return graph.closure(graph.dependency_edges(df))


@register("dependency_graph", "lineage", "SELECT DISTINCT trim(target_column) AS target, trim(source_column) AS source FROM lineage WHERE trim(target_column) NOT IN ('', '<NULL>') AND trim(source_column) NOT IN ('', '<NULL>')")
def _(df):
    return graph.dependency_edges(df)


@register("bottom_up_layers", "lineage", """+ e AS (SELECT DISTINCT current_node AS t, source_object AS s FROM lineage), r AS (SELECT s AS n, 0 AS layer FROM e UNION SELECT e.t, r.layer + 1 FROM r JOIN e ON e.s = r.n)
SELECT n AS node, CAST(max(layer) AS INTEGER) AS layer FROM r GROUP BY n""", True)  # fmt: skip
def _(df):
    return graph.bottom_up(_edges(df))


@register("column_trace", "trace", """SELECT DISTINCT * FROM (SELECT 'CV_REGION_0.AMOUNT' AS trace_target, 0 AS trace_depth, row_seq FROM trace WHERE current_node = 'CV_REGION_0'
UNION ALL SELECT b.current_node || '.BALANCE', 1, b.row_seq FROM trace b JOIN trace a ON a.current_node = 'CV_REGION_0' AND b.current_node = replace(split_part(a.formula, '.', 1), '"', '')
UNION ALL SELECT c.current_node || '.ACCTBAL', 2, c.row_seq FROM trace c JOIN trace b ON c.current_node = b.parent_input_object JOIN trace a ON a.current_node = 'CV_REGION_0' AND b.current_node = replace(split_part(a.formula, '.', 1), '"', '')
UNION ALL SELECT d.current_node || '.TOTAL', 3, d.row_seq FROM trace d JOIN trace c ON d.current_node = c.join_left_object JOIN trace b ON c.current_node = b.parent_input_object JOIN trace a ON a.current_node = 'CV_REGION_0' AND b.current_node = replace(split_part(a.formula, '.', 1), '"', ''))""")  # fmt: skip
def _(df):
    return graph.column_trace(df, _seeds(df, "target", "CV_REGION_0.AMOUNT")).select("trace_target", "trace_depth", "row_seq")


#: Everything upstream of every region's amount, level by level as the fixture has them.
_TRACED = """+ a AS (SELECT * FROM trace WHERE current_node LIKE 'CV_REGION%'),
l1 AS (SELECT a.current_node || '.AMOUNT' AS requested, b.* FROM trace b JOIN a ON b.current_node = replace(split_part(a.formula, '.', 1), '"', '')),
l2 AS (SELECT l1.requested, c.* FROM trace c JOIN l1 ON c.current_node = l1.parent_input_object), l3 AS (SELECT l2.requested, d.* FROM trace d JOIN l2 ON d.current_node = l2.join_left_object),
u AS (SELECT DISTINCT * FROM (SELECT current_node || '.AMOUNT' AS requested, current_node || '.AMOUNT' AS trace_target, 0 AS trace_depth, row_seq, current_node, source_column FROM a
UNION ALL SELECT requested, current_node || '.BALANCE', 1, row_seq, current_node, source_column FROM l1 UNION ALL SELECT requested, current_node || '.ACCTBAL', 2, row_seq, current_node, source_column FROM l2
UNION ALL SELECT requested, current_node || '.TOTAL', 3, row_seq, current_node, source_column FROM l3))"""


def _region_trace(df: DataFrame) -> DataFrame:
    return graph.column_trace(df, df.filter("current_node LIKE 'CV_REGION%'").select(F.concat("current_node", F.lit(".AMOUNT")).alias("target")).distinct())


@register("column_trace_targets", "trace", _TRACED + " SELECT requested, trace_target, trace_depth, row_seq FROM u")
def _(df):
    return _region_trace(df).select("requested", "trace_target", "trace_depth", "row_seq")


@register("trace_summary", "trace", _TRACED + " SELECT trace_target, count(*) AS rows, count(DISTINCT current_node) AS nodes, count(DISTINCT source_column) AS sources, max(trace_depth) AS max_depth FROM u GROUP BY trace_target")
def _(df):
    return graph.trace_summary(_region_trace(df))


@register("row_dedupe", "lineage", f"""SELECT row_seq, source_object FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(tokens.ROW_KEY)} ORDER BY row_seq) AS n FROM lineage) WHERE n = 1""")
def _(df):
    return rows.first_of_each(df).select("row_seq", "source_object")


@register("expression_tokens", "exprs", rf"SELECT id, {IDENTIFIERS} AS identifiers FROM (SELECT id, CASE WHEN trim(expr) = '<NULL>' THEN '' ELSE regexp_replace(expr, '''[^'']*''', ' ', 'g') END AS t FROM exprs)")
def _(df):
    return df.select("id", S.identifiers("expr").alias("identifiers"))


_COUNTS = rf"""+ c AS (SELECT id, expr, len({IDENTIFIERS}) AS cols, len(regexp_extract_all(expr, '(''[^'']*''|\b\d+(?:\.\d+)?\b)')) AS consts, len(regexp_extract_all(expr, '\b[A-Za-z_][A-Za-z0-9_]*\s*\(')) AS funcs,
len(regexp_extract_all(expr, '(?i)(=|<>|>=|<=|\bIN\b|\bLIKE\b|\bAND\b|\bOR\b)')) AS preds, len(regexp_extract_all(expr, '(?i)\b({'|'.join(tokens.NEUTRAL_FUNCTIONS)})\b\s*\(')) AS neutral
FROM (SELECT id, expr, CASE WHEN trim(expr) = '<NULL>' THEN '' ELSE regexp_replace(expr, '''[^'']*''', ' ', 'g') END AS t FROM exprs))"""


@register("expression_components", "exprs", _COUNTS + " SELECT id, CAST(cols AS INTEGER) AS cols, CAST(consts AS INTEGER) AS consts, CAST(funcs AS INTEGER) AS funcs, CAST(preds AS INTEGER) AS preds FROM c")
def _(df):
    return df.select("id", S.expression_counts("expr").alias("c")).select("id", "c.*")


@register("expression_weights", "exprs", _COUNTS + " SELECT id, round(CASE WHEN cols + consts + greatest(funcs - neutral, 0) + preds > 0 THEN cols / (cols + consts + greatest(funcs - neutral, 0) + preds) ELSE 0.0 END, 6) AS weight FROM c")
def _(df):
    return df.select("id", F.round(S.weight("expr"), 6).alias("weight"))


@register("formula_semantics", "jobs", r"""SELECT row_seq, formula LIKE '%SUM(%' AS has_aggregation, regexp_matches(formula, '(?i)\b(CASE|NVL)\b') AS has_conditional FROM jobs WHERE record_type = 'COLUMN_MAPPING'""")
def _(df):
    own = df.filter("record_type = 'COLUMN_MAPPING'").withColumn("s", S.formula_semantics("formula"))
    return own.select("row_seq", "s.has_aggregation", "s.has_conditional")


@register("complex_formulas", "jobs", r"SELECT DISTINCT formula FROM jobs WHERE formula LIKE 'SUM(%' OR formula LIKE 'CASE%' OR formula LIKE 'nvl(%'")
def _(df):
    own = df.withColumn("s", S.formula_semantics("formula"))
    return own.filter(S.is_complex("s.complexity", "s.nesting_depth", "s.has_aggregation", "s.has_conditional", "s.risk")).select("formula").distinct()


#: The weight of every different formula and filter from its parts, then of each row.
_WEIGHTED = rf"""+ x AS (SELECT formula AS expr FROM lineage UNION SELECT filter_expression FROM lineage),
xc AS (SELECT expr, len({IDENTIFIERS}) AS cols, len(regexp_extract_all(expr, '(''[^'']*''|\b\d+(?:\.\d+)?\b)')) AS consts, len(regexp_extract_all(expr, '\b[A-Za-z_][A-Za-z0-9_]*\s*\(')) AS funcs,
len(regexp_extract_all(expr, '(?i)(=|<>|>=|<=|\bIN\b|\bLIKE\b|\bAND\b|\bOR\b)')) AS preds, len(regexp_extract_all(expr, '(?i)\b({'|'.join(tokens.NEUTRAL_FUNCTIONS)})\b\s*\(')) AS neutral
FROM (SELECT expr, CASE WHEN trim(expr) = '<NULL>' THEN '' ELSE regexp_replace(expr, '''[^'']*''', ' ', 'g') END AS t FROM x)),
xw AS (SELECT expr, CASE WHEN cols + consts + greatest(funcs - neutral, 0) + preds > 0 THEN cols / (cols + consts + greatest(funcs - neutral, 0) + preds) ELSE 0.0 END AS wx FROM xc),
w AS (SELECT l.*, coalesce(a.wx, 0) AS wt, coalesce(b.wx, 0) AS wf0 FROM lineage l LEFT JOIN xw a ON a.expr = l.formula LEFT JOIN xw b ON b.expr = l.filter_expression)"""


@register("row_weights", "lineage", _WEIGHTED + " SELECT row_seq, round(wt, 6) AS weight_transform, round(greatest(wf0, 0.5), 6) AS weight_filter FROM w")
def _(df):
    return rows.with_weights(df).select("row_seq", F.round("weight_transform", 6).alias("weight_transform"), F.round("weight_filter", 6).alias("weight_filter"))


@register("row_weights_strict", "lineage", _WEIGHTED + " SELECT row_seq, round(wt, 6) AS weight_transform, round(CASE WHEN join_left_column <> '<NULL>' OR join_right_column <> '<NULL>' THEN greatest(wf0, 0.5) ELSE wf0 END, 6) AS weight_filter FROM w")
def _(df):
    return rows.with_weights(df, strict=True).select("row_seq", F.round("weight_transform", 6).alias("weight_transform"), F.round("weight_filter", 6).alias("weight_filter"))


@register("semantic_filter", "lineage", _WEIGHTED + " SELECT row_seq FROM w WHERE wt >= 0.35 OR (CASE WHEN join_left_column <> '<NULL>' OR join_right_column <> '<NULL>' THEN greatest(wf0, 0.5) ELSE wf0 END) >= 0.3")
def _(df):
    return rows.semantic_layer(rows.with_weights(df, strict=True), 0.35, 0.3).select("row_seq")


@register("filter_propagation", "lineage", """+ f AS (SELECT row_seq, transformation_type AS kind, source_column AS source FROM lineage UNION ALL SELECT row_seq, 'Filter_Propagation', unnest(CASE WHEN filter_expression LIKE 'L_RET%' THEN ['L_RETURNFLAG', 'L_QUANTITY'] ELSE [split_part(filter_expression, ' ', 1)] END) FROM lineage WHERE filter_expression <> '<NULL>')
SELECT kind, source, count(*) AS n FROM f GROUP BY ALL""")  # fmt: skip
def _(df):
    out = rows.filter_propagation(rows.with_weights(df))
    return out.groupBy(F.col("transformation_type").alias("kind"), F.col("source_column").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@register("parent_rollup", "lineage", "SELECT row_seq, current_node AS target_node, source_object AS source_node FROM lineage")
def _(df):
    return rows.parent_rollup(df).filter("transformation_type = 'Parent_Rollup'").select("row_seq", "target_node", "source_node")


for _mode, _how in (("mean", "avg"), ("max", "max"), ("sum", "sum")):

    @register(f"parallel_edges_{_mode}", "lineage", _WEIGHTED + f" SELECT current_node, target_column, source_column, min(row_seq) AS row_seq, round({_how}(wt), 6) AS weight_transform, round({_how}(greatest(wf0, 0.5)), 6) AS weight_filter FROM w GROUP BY ALL")
    def _(df, mode=_mode):
        return rows.merge_parallel(rows.with_weights(df), mode).select("current_node", "target_column", "source_column", "row_seq", F.round("weight_transform", 6).alias("weight_transform"), F.round("weight_filter", 6).alias("weight_filter"))


_SCORES = """, s AS (SELECT current_node, sum(CASE WHEN source_column <> '' THEN wt + greatest(wf0, 0.5) ELSE 0 END) AS a, sum(wt + greatest(wf0, 0.5)) AS b FROM w GROUP BY current_node)"""


@register("node_scores", "lineage", _WEIGHTED + _SCORES + " SELECT current_node, round(a / greatest(a + b, 1e-9), 6) AS lld_score, round(a / greatest(a + b, 1e-9), 6) AS lid_score FROM s")
def _(df):
    return rows.node_scores(rows.with_weights(df)).select("current_node", F.round("lld_score", 6).alias("lld_score"), F.round("lid_score", 6).alias("lid_score"))


@register("scored_rows", "lineage", _WEIGHTED + _SCORES + " SELECT w.row_seq, round(a / greatest(a + b, 1e-9), 6) AS lld_score FROM w JOIN s USING (current_node)")
def _(df):
    return rows.with_scores(rows.with_weights(df)).select("row_seq", F.round("lld_score", 6).alias("lld_score"))


@register("lint_gaps", "lineage", """SELECT row_seq FROM lineage WHERE target_column NOT IN ('', '<NULL>') AND transformation_type NOT IN ('Filter', 'Join', 'Runtime_Dependency', 'Source_Table') AND trim(source_column) IN ('', '<NULL>')
AND NOT list_contains(list_transform(string_split(node_output_columns, ','), lambda c: trim(c)), target_column)""")  # fmt: skip
def _(df):
    return quality.lint(df.withColumn("xpath", F.col("row_seq").cast("string"))).select(F.col("xpath").cast("long").alias("row_seq"))


@register("null_profile", "lineage", "SELECT 'source_column' AS \"column\", count(*) FILTER (trim(source_column) = '') AS nulls, count(*) FILTER (trim(source_column) <> '') AS not_nulls, round(100.0 * count(*) FILTER (trim(source_column) = '') / count(*), 2) AS null_pct FROM lineage UNION ALL SELECT 'node_output_columns', count(*) FILTER (trim(node_output_columns) = ''), count(*) FILTER (trim(node_output_columns) <> ''), round(100.0 * count(*) FILTER (trim(node_output_columns) = '') / count(*), 2) FROM lineage")
def _(df):
    return quality.null_profile(df, ["source_column", "node_output_columns"])


@register("file_utilisation", "lineage", "SELECT source_file, count(*) AS rows, count(*) AS informative, round(100.0 * count(*) FILTER (trim(source_column) = '') / count(*), 2) AS source_column_null_pct FROM lineage GROUP BY source_file ORDER BY rows DESC, source_file LIMIT 100")
def _(df):
    return quality.file_utilisation(df).select("source_file", "rows", "informative", "source_column_null_pct")


@register("validation_score", "lineage", f"""+ k AS (SELECT count(*) AS n FROM lineage), d AS (SELECT count(*) AS n FROM (SELECT DISTINCT {', '.join(tokens.ROW_KEY)} FROM lineage)),
r AS (SELECT 'missing_required_columns' AS rule, 0 AS findings, 30 AS weight UNION ALL SELECT 'mapping_without_source', (SELECT count(*) FROM lineage WHERE transformation_type LIKE '%Mapping%' AND source_column IN ('', '<NULL>')), 20
UNION ALL SELECT 'empty_filter_expression', (SELECT count(*) FROM lineage WHERE transformation_type = 'Filter' AND filter_expression = '<NULL>'), 10
UNION ALL SELECT 'join_incomplete_side', (SELECT count(*) FROM lineage WHERE (join_left_column = '<NULL>') <> (join_right_column = '<NULL>')), 15
UNION ALL SELECT 'star_unexpanded', (SELECT count(*) FROM lineage WHERE source_column = '*'), 10 UNION ALL SELECT 'bad_column_name', 0, 5 UNION ALL SELECT 'duplicate_rows', (SELECT k.n - d.n FROM k, d), 5)
SELECT rule, CAST(findings AS BIGINT) AS findings, weight, CAST(100 - (SELECT sum(weight) FROM r WHERE findings > 0) AS INTEGER) AS score, CASE WHEN 100 - (SELECT sum(weight) FROM r WHERE findings > 0) >= 85 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")  # fmt: skip
def _(df):
    return quality.validation(df)


_LOOKUP = """+ l AS (SELECT current_node AS anv_name, coalesce(string_agg(DISTINCT source_object, ',' ORDER BY source_object), '') AS inferred_parents, count(DISTINCT target_column) AS column_count,
CASE WHEN count(DISTINCT source_object) > 1 THEN 'Y' ELSE 'N' END AS star_join_flag, CASE WHEN bool_or(transformation_type = 'Shared_Dimension') THEN 'Y' ELSE 'N' END AS shared_dimension_flag FROM lineage WHERE current_node LIKE 'ANV~_%' ESCAPE '~' GROUP BY 1)"""


@register("anv_lookup", "lineage", _LOOKUP + " SELECT * FROM l")
def _(df):
    return rows.view_lookup(df)


@register("anv_completed", "lineage", _LOOKUP + " SELECT row_seq, CASE WHEN anv_name IS NOT NULL AND parent_input_object = '<NULL>' THEN inferred_parents ELSE parent_input_object END AS parent_input_object FROM lineage LEFT JOIN l ON current_node = anv_name")
def _(df):
    return rows.completed_views(df).select("row_seq", "parent_input_object")


@register("view_outputs", "lineage", "SELECT current_node AS view, target_column AS \"column\", bool_or(source_column NOT IN ('', '<NULL>')) AS explicit FROM lineage GROUP BY ALL")
def _(df):
    return rows.view_outputs(df)


@register("pullthrough", "lineage", """+ o AS (SELECT current_node AS v, target_column AS c, bool_or(source_column NOT IN ('', '<NULL>')) AS x FROM lineage GROUP BY ALL), k AS (SELECT DISTINCT current_node AS v, source_object AS d FROM lineage WHERE transformation_type = 'Shared_Dimension')
SELECT k.v AS current_node, k.d AS source_object, a.c AS target_column FROM k JOIN o a ON a.v = k.v AND NOT a.x JOIN o b ON b.v = k.d AND b.c = a.c""")  # fmt: skip
def _(df):
    return rows.pullthrough(df).select("current_node", "source_object", "target_column")


@register("output_columns", "lineage", "SELECT current_node AS node, list_sort(list_distinct(flatten(list(list_filter(list_transform(string_split(node_output_columns, ','), lambda c: trim(c)), lambda c: c <> ''))))) AS columns FROM lineage WHERE node_output_columns <> '' GROUP BY current_node")
def _(df):
    return rows.output_sets(df)


@register("node_expansion", "lineage", "SELECT row_seq, trim(unnest(list_distinct(list_transform(string_split((SELECT string_agg(DISTINCT i.node_output_columns, ',') FROM lineage i WHERE i.current_node = o.current_node AND i.node_output_columns <> ''), ','), lambda c: trim(c))))) AS target_column FROM lineage o")
def _(df):
    rolled = rows.parent_rollup(df)
    return rows.node_rows_to_columns(rolled).filter("transformation_type = 'Parent_Rollup_Expanded'").select("row_seq", "target_column")


@register("node_target_expansion", "lineage", "SELECT row_seq, trim(unnest(string_split(node_output_columns, ','))) AS target_column FROM lineage WHERE row_seq % 2 = 0 AND node_output_columns <> '' UNION ALL SELECT row_seq, target_column FROM lineage WHERE row_seq % 2 = 1 UNION ALL SELECT row_seq, current_node FROM lineage WHERE row_seq % 2 = 0 AND node_output_columns = ''")
def _(df):
    own = df.withColumn("target_column", F.when(F.col("row_seq") % 2 == 0, F.col("current_node")).otherwise(F.col("target_column")))
    return rows.node_targets_to_columns(own).select("row_seq", "target_column")


@register("lineage_intent", "lineage", "SELECT transformation_type, CASE WHEN transformation_type = 'Calculated_Column' THEN 'DERIVED' WHEN transformation_type = 'Aggregation' THEN 'AGGREGATED' WHEN transformation_type = 'Filter' THEN 'FILTERED' WHEN transformation_type = 'Mapping' THEN 'DIRECT_SOURCE' ELSE 'UNKNOWN' END AS intent, count(*) AS n FROM lineage GROUP BY ALL")
def _(df):
    return df.groupBy("transformation_type", S.intent("transformation_type", F.lit(None).cast("string")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@register("concepts", "lineage", r"""+ n AS (SELECT DISTINCT unnest([current_node, target_column, source_column]) AS name FROM lineage),
t AS (SELECT name, list_filter(string_split_regex(trim(regexp_replace(ltrim(regexp_replace(name, '([A-Z])', ' \1', 'g')), '[^A-Za-z0-9]+', ' ', 'g')), '\s+'), lambda w: len(w) >= 3) AS w FROM n),
c AS (SELECT array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' ') AS concept, name FROM t) SELECT concept, list_sort(list_distinct(list(name))) AS names FROM c WHERE concept <> '' GROUP BY concept""")  # fmt: skip
def _(df):
    return rows.concepts(df)


@register("predicate_compose", "lineage", """+ p AS (SELECT row_seq, ['EQ', 'NE', 'NL', 'LE', 'GE', 'LT', 'GT', ''][CAST(row_seq % 8 AS INTEGER) + 1] AS op, ['true', 'false', ''][CAST(row_seq % 3 AS INTEGER) + 1] AS inc, CASE WHEN row_seq % 7 = 0 THEN '' ELSE 'V' || row_seq END AS v FROM lineage)
SELECT row_seq, CASE WHEN v = '' THEN '' WHEN op = 'EQ' THEN 'A = ''' || v || '''' WHEN op = 'NE' THEN 'A <> ''' || v || '''' WHEN op = 'NL' THEN 'A NOT LIKE ''' || v || '''' WHEN op = 'LE' THEN 'A <= ''' || v || '''' WHEN op = 'GE' THEN 'A >= ''' || v || '''' WHEN op = 'LT' THEN 'A < ''' || v || '''' WHEN op = 'GT' THEN 'A > ''' || v || ''''
WHEN inc = 'false' THEN 'A <> ''' || v || '''' ELSE 'A = ''' || v || '''' END AS predicate FROM p""")  # fmt: skip
def _(df):
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("row_seq") % n + 1).cast("int"))
    value = F.when(F.col("row_seq") % 7 == 0, "").otherwise(F.concat(F.lit("V"), F.col("row_seq").cast("string")))
    return df.select("row_seq", S.predicate(F.lit("A"), pick(8, "EQ", "NE", "NL", "LE", "GE", "LT", "GT", ""), pick(3, "true", "false", ""), value).alias("predicate"))


@register("entity_normalise", "gaps", r"SELECT row_seq, CASE WHEN row_seq % 10 = 0 THEN NULL ELSE 'S' || (row_seq % 3) || '.O' || row_seq END AS object FROM gaps")
def _(df):
    seq, third = F.col("row_seq").cast("string"), (F.col("row_seq") % 3).cast("string")
    raw = F.when(F.col("row_seq") % 10 == 0, "<NULL>").when(F.col("row_seq") % 2 == 0, F.concat(F.lit('#//"X"."S'), third, F.lit('"."O'), seq, F.lit('"'))).otherwise(F.concat(F.lit("#//S"), third, F.lit(".O"), seq))
    return df.select("row_seq", S.entity_object(raw).alias("object"))


# --- enrichment ------------------------------------------------------------------------------------------------------

_CLEAN = """+ b AS (SELECT *, trim(current_node) AS node, CASE WHEN contains(current_node, '.') THEN upper(current_node) ELSE '.' || upper(current_node) END AS k FROM gaps),
c AS (SELECT upper(schema_name || '.' || view_name) AS ck, list(column_name ORDER BY position) AS cols FROM cat GROUP BY 1)"""


@register("star_expansion", "gaps cat", _CLEAN + """, o AS (SELECT b.*, c.cols FROM b LEFT JOIN c ON c.ck = b.k AND (b.source_column IN ('*', '') OR b.target_column IN ('*', '')))
SELECT row_seq, source_column, target_column, transformation_type FROM o WHERE cols IS NULL
UNION ALL SELECT row_seq, CASE WHEN source_column = '*' THEN x ELSE source_column END, CASE WHEN target_column = '*' THEN x ELSE target_column END, transformation_type || '|StarExpanded' FROM (SELECT *, unnest(cols) AS x FROM o WHERE cols IS NOT NULL)""")  # fmt: skip
def _(df, cat):
    return enrich.star_expansion(df, cat).select("row_seq", "source_column", "target_column", "transformation_type")


_INFERRED = """+ p AS (SELECT *, CASE WHEN parent_input_object = '<NULL>' THEN '' ELSE split_part(ltrim(parent_input_object, '#'), ',', 1) END AS par, source_object IN ('', '<NULL>') AS gap FROM gaps),
d AS (SELECT upper(schema_name || '.' || name) AS k, arg_min(base_schema || '.' || base_object, position) AS src FROM deps GROUP BY 1),
i AS (SELECT p.* EXCLUDE (source_object, transformation_type), CASE WHEN gap AND par <> '' AND par <> current_node THEN par WHEN gap AND par <> '' THEN current_node WHEN gap AND src IS NOT NULL THEN src ELSE source_object END AS source_object,
transformation_type || CASE WHEN gap AND par <> '' AND par <> current_node THEN '|ParentInputSource' WHEN gap AND par <> '' THEN '|SelfInputSource' WHEN gap AND src IS NOT NULL THEN '|SourceInferred' ELSE '' END AS transformation_type FROM p LEFT JOIN d ON d.k = upper(current_node))"""


@register("source_inference", "gaps deps", _INFERRED + " SELECT row_seq, source_object, transformation_type FROM i")
def _(df, deps):
    return enrich.source_inference(df, deps).select("row_seq", "source_object", "transformation_type")


@register("target_recovery", "gaps", "SELECT row_seq, current_node AS target_object, transformation_type || '|TargetRecovered' AS transformation_type FROM gaps")
def _(df):
    return enrich.target_recovery(df).select("row_seq", "target_object", "transformation_type")


@register("carry_forward", "gaps", """+ s AS (SELECT current_node FROM gaps GROUP BY 1 HAVING count(DISTINCT nullif(nullif(source_object, ''), '<NULL>')) = 1)
SELECT row_seq, CASE WHEN current_node IN (SELECT current_node FROM s) AND source_column IN ('', '<NULL>') THEN target_column ELSE source_column END AS source_column FROM gaps""")  # fmt: skip
def _(df):
    return enrich.carry_forward(df).select("row_seq", "source_column")


@register("null_classification", "gaps", """SELECT row_seq, CASE WHEN source_column IN ('', '<NULL>') THEN CASE WHEN contains(source_object, '.') THEN '<NULL_XML>' ELSE '<NULL_INFERRED>' END ELSE source_column END AS source_column,
CASE WHEN target_column = '<NULL>' THEN CASE WHEN contains(current_node, '.') THEN '<NULL_DERIVED>' ELSE '<NULL_UNKNOWN>' END ELSE target_column END AS target_column FROM gaps""")  # fmt: skip
def _(df):
    return enrich.null_classification(df).select("row_seq", "source_column", "target_column")


@register("source_table_expansion", "gaps cat", _CLEAN + """ SELECT row_seq, source_column, target_column, transformation_type FROM gaps UNION ALL
SELECT row_seq, x, CASE WHEN target_column IN ('', '*') THEN x ELSE target_column END, transformation_type || '_Expanded' FROM (SELECT g.*, unnest(cols) AS x FROM gaps g JOIN c ON c.ck = upper(g.source_object) WHERE transformation_type = 'Source_Table' AND source_column = '*' AND contains(source_object, '.'))""")  # fmt: skip
def _(df, cat):
    return enrich.source_table_expansion(df, cat).select("row_seq", "source_column", "target_column", "transformation_type")


@register("output_fill", "gaps cat", _CLEAN + " SELECT row_seq, CASE WHEN node_output_columns = '' AND cols IS NOT NULL THEN array_to_string(cols, ',') ELSE node_output_columns END AS node_output_columns FROM b LEFT JOIN c ON ck = k")
def _(df, cat):
    return enrich.output_fill(df, cat).select("row_seq", "node_output_columns")


@register("runtime_dependencies", "gaps deps", """+ n AS (SELECT DISTINCT upper(unnest([current_node, source_object])) AS k FROM gaps) SELECT DISTINCT k AS current_node, base_schema || '.' || base_object AS source_object, 'type=' || base_type || '; dependency=' || dependency_type AS formula
FROM n JOIN deps ON k = upper(schema_name || '.' || name)""")  # fmt: skip
def _(df, deps):
    return enrich.runtime_dependencies(df, deps).select("current_node", "source_object", "formula")


@register("enriched_rows", "gaps cat deps")
def _(df, cat, deps):
    return enrich.enrich(df, cat, deps)


# --- job lineage -----------------------------------------------------------------------------------------------------


def _job_parts(df: DataFrame, *targets: str):
    edges = jobs.table_edges(df)
    hops = graph.hop_map(edges, _seeds(df, "target_table", *targets))
    return edges, hops, graph.terminal_sources(edges, hops), graph.upstream_tree(edges, hops), jobs.table_context(df)


def _records(df: DataFrame, *targets: str) -> DataFrame:
    _, hops, terminals, tree, context = _job_parts(df, *targets)
    return jobs.edge_records(tree, hops, context, terminals)


_JOB = """+ e AS (SELECT DISTINCT upper(target_object) AS t, upper(source_object) AS s FROM jobs WHERE record_type IN ('COLUMN_MAPPING', 'SQL_TRANSFORM') AND target_object <> '' AND source_object <> ''),
r AS (SELECT 'MART.REGION_0' AS g, 'MART.REGION_0' AS n, 0 AS hop UNION ALL SELECT 'MART.NATION_3', 'MART.NATION_3', 0 UNION SELECT r.g, e.s, r.hop + 1 FROM r JOIN e ON e.t = r.n WHERE r.hop < 10),
h AS (SELECT g, n, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY g, n), z AS (SELECT g, n FROM h WHERE hop > 0 AND n NOT IN (SELECT t FROM e)),
x AS (SELECT upper(target_object) AS n, string_agg(DISTINCT job_name, ';' ORDER BY job_name) AS job_name, string_agg(DISTINCT workflow_name, ';' ORDER BY workflow_name) AS workflow_name, string_agg(DISTINCT dataflow_name, ';' ORDER BY dataflow_name) AS dataflow_name FROM jobs WHERE target_object <> '' GROUP BY 1),
k AS (SELECT a.g AS target_table, e.t AS target, e.s AS source, a.hop AS target_hop, b.hop AS source_hop, (a.g, e.s) IN (SELECT (g, n) FROM z) AS is_source, coalesce(x.job_name, '') AS job_name, coalesce(x.workflow_name, '') AS workflow_name, coalesce(x.dataflow_name, '') AS dataflow_name
FROM e JOIN h a ON a.n = e.t JOIN h b ON b.n = e.s AND b.g = a.g LEFT JOIN x ON x.n = e.t)"""
_TARGETS = ("MART.REGION_0", "MART.NATION_3")


@register("upstream_tables_job", "jobs", _JOB + " SELECT g AS target_table, n AS \"table\", hop FROM h", True)
def _(df):
    return _job_parts(df, *_TARGETS)[1]


@register("table_edge_records", "jobs", _JOB + " SELECT * FROM k", True)
def _(df):
    return _records(df, *_TARGETS)


@register("path_records", "jobs", _JOB + """ SELECT target_table, source || '  -->  ' || target || '  (via ' || split_part(dataflow_name, ';', 1) || ' | ' || split_part(job_name, ';', 1) || ')' AS lineage_path, CASE WHEN target_hop = 0 THEN 'TARGET' ELSE 'INTERMEDIATE' END AS target_type, CASE WHEN is_source THEN 'FINAL SOURCE' ELSE 'INTERMEDIATE' END AS source_type FROM k""", True)
def _(df):
    return jobs.in_display_order(jobs.path_records(_records(df, *_TARGETS))).select("target_table", "lineage_path", "target_type", "source_type")


@register("edge_merge_jobs", "jobs", _JOB + " SELECT source, target, list_sort(list_distinct(flatten(list(string_split(job_name, ';'))))) AS job_name, list_sort(list_distinct(flatten(list(string_split(workflow_name, ';'))))) AS workflow_name, list_sort(list_distinct(flatten(list(string_split(dataflow_name, ';'))))) AS dataflow_name FROM k GROUP BY source, target", True)
def _(df):
    return jobs.merged_edges(_records(df, *_TARGETS))


@register("multi_job_nodes", "jobs", _JOB + ", m AS (SELECT unnest([source, target]) AS node, string_split(job_name, ';') AS j FROM k) SELECT node, CAST(len(list_distinct(flatten(list(j)))) AS INTEGER) AS jobs, len(list_distinct(flatten(list(j)))) > 1 AS multi_job FROM m GROUP BY node", True)
def _(df):
    return jobs.node_context(jobs.merged_edges(_records(df, *_TARGETS))).select("node", F.size("jobs").alias("jobs"), "multi_job")


@register("node_types", "jobs", _JOB + """, m AS (SELECT target AS n, target_hop = 0 AS t, false AS s FROM k UNION ALL SELECT source, false, is_source FROM k), o AS (SELECT n, bool_or(t) AS t, bool_or(s) AS s FROM m GROUP BY n)
SELECT n AS node, CASE WHEN t THEN 'tgt' WHEN n LIKE 'SAP.%' THEN 'sap' WHEN n LIKE 'FILE:%' THEN 'file' WHEN s THEN 'src' ELSE 'xfm' END AS type FROM o""", True)  # fmt: skip
def _(df):
    return jobs.node_types(_records(df, *_TARGETS))


@register("tab_summary", "jobs", _JOB + " SELECT target_table, count(*) AS records, max(source_hop) AS max_hop, count(*) FILTER (is_source AND source LIKE 'SAP.%') AS sap, count(*) FILTER (is_source AND source LIKE 'FILE:%') AS files, count(*) FILTER (is_source AND source LIKE 'EXCEL:%') AS excel FROM k GROUP BY target_table", True)
def _(df):
    return jobs.tab_summary(_records(df, *_TARGETS))


@register("target_summary", "jobs", _JOB + " SELECT h.g AS target_table, (SELECT count(*) FROM jobs j JOIN h i ON i.n = upper(j.target_object) AND i.g = h.g WHERE record_type IN ('COLUMN_MAPPING', 'SQL_TRANSFORM')) AS total_rows, (SELECT count(DISTINCT n) FROM z WHERE z.g = h.g) AS terminal_sources FROM h GROUP BY h.g", True)
def _(df):
    _, hops, terminals, _, _ = _job_parts(df, *_TARGETS)
    return jobs.target_summary(df, terminals, hops)


@register("sql_transform_edges", "jobs", _JOB + """, q AS (SELECT transform_name, upper(target_object) AS t, arg_min(dataflow_name, row_seq) AS dataflow_name FROM jobs WHERE record_type = 'SQL_TRANSFORM' GROUP BY 1, 2)
SELECT h.g AS target_table, q.t AS target, 'SQL:' || transform_name AS source, hop AS target_hop, hop + 1 AS source_hop, dataflow_name FROM q JOIN h ON h.n = q.t""", True)  # fmt: skip
def _(df):
    _, hops, terminals, tree, context = _job_parts(df, *_TARGETS)
    return jobs.sql_edges(df, jobs.edge_records(tree, hops, context, terminals), hops).select("target_table", "target", "source", "target_hop", "source_hop", "dataflow_name")


@register("flow_groups", "jobs", _JOB + " SELECT split_part(dataflow_name, ';', 1) AS label, target_table, count(*) AS records FROM k GROUP BY ALL", True)
def _(df):
    return jobs.flow_groups(_records(df, *_TARGETS))


@register("sql_cluster_collapse", "jobs", """+ e AS (SELECT DISTINCT source_object AS src, target_object AS tgt FROM jobs WHERE record_type = 'COLUMN_MAPPING'), m AS (SELECT DISTINCT target_object AS member, 'CLUSTER_' || substr(dataflow_name, 4, 1) AS c FROM jobs WHERE target_object LIKE 'DWH.CUST%'), o AS (SELECT member, min(c) AS c FROM m GROUP BY member)
SELECT DISTINCT src, coalesce(o.c, tgt) AS tgt FROM e LEFT JOIN o ON o.member = tgt WHERE src NOT IN (SELECT member FROM o) AND src <> coalesce(o.c, tgt)""")  # fmt: skip
def _(df):
    own = df.filter("record_type = 'COLUMN_MAPPING'")
    members = df.filter("target_object LIKE 'DWH.CUST%'").select(F.col("target_object").alias("member"), F.concat(F.lit("CLUSTER_"), F.substring("dataflow_name", 4, 1)).alias("cluster")).distinct()
    return graph.collapse_clusters(own.select(F.col("source_object").alias("src"), F.col("target_object").alias("tgt")).distinct(), members)


@register("extraction_summary", "jobs", "SELECT count(*) AS total_rows, count(*) FILTER (record_type = 'COLUMN_MAPPING') AS column_mappings, count(*) FILTER (record_type = 'PROJECTION') AS projections, count(*) FILTER (record_type IN ('JOIN', 'FILTER')) AS query_level, count(DISTINCT source_object) AS source_objects, count(DISTINCT target_object) AS target_objects, count(DISTINCT job_name) AS jobs, round(100.0 * count(*) FILTER (record_type = 'COLUMN_MAPPING') / count(*) FILTER (record_type = 'PROJECTION'), 2) AS coverage_pct FROM jobs")
def _(df):
    return jobs.extraction_summary(df)


@register("column_text_filter", "jobs", "SELECT row_seq FROM jobs WHERE contains(upper(source_object), 'CUST_1') OR contains(upper(source_column), 'CUST_1') OR contains(upper(target_object), 'CUST_1') OR contains(upper(target_column), 'CUST_1') OR contains(upper(formula), 'CUST_1')")
def _(df):
    return jobs.text_filter(df, "cust_1").select("row_seq")


@register("field_search", "jobs", "SELECT source_object, target_object, min(row_seq) AS first_seen, row_number() OVER (ORDER BY min(row_seq)) AS number FROM jobs WHERE record_type = 'COLUMN_MAPPING' AND contains(source_column, 'O_TOTAL') GROUP BY ALL")
def _(df):
    return jobs.field_search(df, "o_total")


@register("record_types", "jobs", "SELECT record_type, count(*) AS n FROM jobs WHERE record_type IN ('JOIN', 'FILTER', 'PROJECTION') GROUP BY ALL")
def _(df):
    return jobs.records_of(df, "JOIN", "FILTER", "PROJECTION").groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))


@register("column_siblings", "jobs", "SELECT row_seq FROM jobs WHERE record_type IN ('COLUMN_MAPPING', 'SQL_TRANSFORM') AND target_object = 'MART.NATION_3' AND target_column = 'TOTAL'")
def _(df):
    return jobs.column_siblings(df, "nation_3", "total").select("row_seq")


def _wide(df: DataFrame) -> DataFrame:
    from ..sources.records import conform

    return conform(df)


@register("column_data", "jobs", """+ m AS (SELECT target_object AS target, dataflow_name AS df, count(*) AS mappings FROM jobs WHERE record_type IN ('COLUMN_MAPPING', 'SQL_TRANSFORM') AND target_object IN ('MART.NATION_3', 'MART.NATION_4') GROUP BY ALL)
SELECT target, df, CAST(mappings AS INTEGER) AS mappings, coalesce((SELECT CAST(count(DISTINCT join_condition) AS INTEGER) FROM jobs j WHERE record_type = 'JOIN' AND j.dataflow_name = m.df), 0) AS joins, coalesce((SELECT CAST(count(DISTINCT where_condition) AS INTEGER) FROM jobs j WHERE record_type = 'FILTER' AND j.dataflow_name = m.df AND j.target_object = m.target), 0) AS filters FROM m""")  # fmt: skip
def _(df):
    hops = df.sparkSession.createDataFrame([("MART.NATION_3", "MART.NATION_3", 0), ("MART.NATION_4", "MART.NATION_4", 0)], "target_table string, table string, hop int")
    out = jobs.column_data(_wide(df), hops, jobs.table_context(df))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).alias(c)
    return out.select("target", "df", size("mappings"), size("joins"), size("filters"))


@register("field_evolution", "jobs", """+ s AS (SELECT upper(target_object || '.' || target_column) AS t, upper(source_object || '.' || source_column) AS s, arg_min(formula, row_seq) AS formula FROM jobs WHERE record_type = 'COLUMN_MAPPING' GROUP BY 1, 2),
r AS (SELECT 'MART.REGION_2.TOTAL' AS node, 0 AS depth, 'MART.REGION_2.TOTAL' AS path, '' AS formula UNION ALL SELECT s.s, r.depth + 1, r.path || ' <- ' || s.s, s.formula FROM r JOIN s ON s.t = r.node WHERE r.depth < 10)
SELECT 'MART.REGION_2.TOTAL' AS seed, node, depth, path, formula FROM r WHERE depth > 0""", True)  # fmt: skip
def _(df):
    return jobs.field_evolution(df, _seeds(df, "target", "MART.REGION_2.TOTAL"))


@register("job_trace", "jobs", """+ e AS (SELECT DISTINCT upper(target_object) AS t, upper(source_object) AS s FROM jobs WHERE record_type IN ('COLUMN_MAPPING', 'SQL_TRANSFORM') AND target_object <> '' AND source_object <> ''),
r AS (SELECT DISTINCT upper(target_object) AS g, upper(target_object) AS n, 0 AS hop FROM jobs WHERE job_name = 'JOB_R' UNION SELECT r.g, e.s, r.hop + 1 FROM r JOIN e ON e.t = r.n WHERE r.hop < 10)
SELECT g AS target_table, n AS "table", CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY ALL""", True)  # fmt: skip
def _(df):
    return graph.hop_map(jobs.table_edges(df), jobs.targets_of_job(df, "job_r"))


@register("similar_concepts", "lineage")
def _(df):
    return rows.similar_concepts(rows.concepts(df))


@register("concept_synonyms", "lineage")
def _(df):
    return rows.synonyms(rows.singular_concepts(rows.concepts(df)))
