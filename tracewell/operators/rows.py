"""Operators over lineage rows: identity, weights, propagation, scores, views and node expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tokens
from ..functions import scalars as S
from ..storage import materialized


def first_of_each(rows: DataFrame, key=tokens.ROW_KEY, order: str = "row_seq") -> DataFrame:
    """The first row of each key by `order` (WIN1, SET2). Null and the null token are different values here.

    Aggregated as a minimum of whole rows, so a key that many rows share is reduced in each task before the shuffle.
    """
    key = [c for c in key if c in rows.columns]
    whole = F.struct(order, *[c for c in rows.columns if c != order])
    if any(t.startswith("map") for _, t in rows.dtypes):  # maps have no order: rank instead
        return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(order))).filter("__n = 1").drop("__n")
    return rows.groupBy(*key).agg(F.min(whole).alias("__r")).select(*[F.col(f"__r.`{c}`") for c in rows.columns])


def expression_weights(rows: DataFrame, *columns: str, neutral=tokens.NEUTRAL_FUNCTIONS) -> DataFrame:
    """(expression, weight) of the different expressions in some columns: rows share few of them."""
    found = rows.select(F.explode(F.array(*columns)).alias("expression")).filter("expression IS NOT NULL").distinct()
    return found.select("expression", S.weight("expression", neutral).alias("weight"))


def with_weights(rows: DataFrame, strict: bool = False, joins_count: bool = True, neutral=tokens.NEUTRAL_FUNCTIONS) -> DataFrame:
    """weight_transform and weight_filter (ENR10). A row with a join column has a filter weight of 0.5 at least; unless
    `strict`, a null token counts as one, as every extracted row carries it."""
    known = materialized(expression_weights(rows, "formula", "filter_expression", neutral=neutral), "weights")
    out = rows.drop("weight_transform", "weight_filter")
    for column, name in (("formula", "weight_transform"), ("filter_expression", "weight_filter")):
        own = known.select(F.col("expression").alias("__e"), F.col("weight").alias(name))
        out = out.join(own, F.col(column) == F.col("__e"), "left").drop("__e").withColumn(name, F.coalesce(name, F.lit(0.0)))
    if joins_count:
        has = (lambda c: ~S.is_missing(c)) if strict else (lambda c: F.coalesce(F.col(c), F.lit("")) != "")
        joined = F.when(has("join_left_column") | has("join_right_column"), F.greatest("weight_filter", F.lit(0.5)))
        out = out.withColumn("weight_filter", joined.otherwise(F.col("weight_filter")))
    return out


def semantic_layer(rows: DataFrame, least_transform: float = 0.35, least_filter: float = 0.25) -> DataFrame:
    """Rows with enough evidence on one side (FLT1); a missing weight is 0."""
    return rows.filter((F.coalesce("weight_transform", F.lit(0.0)) >= least_transform) | (F.coalesce("weight_filter", F.lit(0.0)) >= least_filter))


def filter_propagation(rows: DataFrame, factor: float = 1.0) -> DataFrame:
    """The rows, and for each identifier of a filter one more with it as the source (GRA4)."""
    extra = rows.filter(S.trimmed(F.coalesce("target_column", F.lit(""))) != "").withColumn("source_column", F.explode(S.identifiers("filter_expression")))
    extra = extra.withColumn("transformation_type", F.lit("Filter_Propagation")).withColumn("weight_filter", F.greatest(F.coalesce("weight_filter", F.lit(0.0)) * factor, F.lit(0.0)))
    return rows.unionByName(extra)


def parent_rollup(rows: DataFrame, levels=("table",), aggregation: str = "max") -> DataFrame:
    """The rows, and for each with a node and a source object one node-level row (AGG18, ENR11)."""
    node, source = S.trimmed(F.coalesce("current_node", F.lit(""))), S.trimmed(F.coalesce("source_object", F.lit("")))
    extra = rows.filter((node != "") & (source != "")).withColumns({
        "transformation_type": F.lit("Parent_Rollup"), "lineage_level": F.lit("NODE"), "target_node": node, "source_node": source, "target_column": F.lit(""),
        "source_column": F.lit(""), "rollup_levels": F.lit(",".join(levels)), "rollup_aggregation": F.lit(aggregation),
    })
    return rows.unionByName(extra, allowMissingColumns=True)


def merge_parallel(rows: DataFrame, mode: str = "weighted_mean") -> DataFrame:
    """One row for each (node, target, source): the first, with the weights' sum, max or mean (AGG3)."""
    how = {"sum": F.sum, "max": F.max}.get(mode, F.avg)
    key = ["current_node", "target_column", "source_column"]
    other = [c for c in rows.columns if c not in {*key, "row_seq", "weight_transform", "weight_filter"}]
    found = rows.groupBy(*key).agg(
        F.min(F.struct("row_seq", *other)).alias("r"),
        how(F.coalesce("weight_transform", F.lit(0.0))).alias("weight_transform"),
        how(F.coalesce("weight_filter", F.lit(0.0))).alias("weight_filter"),
    )
    return found.select(*[F.col(c) if c in {*key, "weight_transform", "weight_filter"} else F.col(f"r.{c}") for c in rows.columns])


def node_scores(rows: DataFrame, strict: bool = False, epsilon: float = 1e-9) -> DataFrame:
    """current_node, lld_score and lid_score: the share of weight that rows with a source carry (AGG4)."""
    total = F.coalesce("weight_transform", F.lit(0.0)) + F.coalesce("weight_filter", F.lit(0.0))
    has = (lambda c: ~S.is_missing(c)) if strict else (lambda c: F.coalesce(F.col(c), F.lit("")) != "")
    side = lambda c: F.sum(F.when(has(c), total).otherwise(0.0))
    node = S.trimmed("current_node")
    sums = rows.filter(node != "").groupBy(node.alias("current_node")).agg(side("source_column").alias("s"), side("target_column").alias("t"))
    score = F.col("s") / F.greatest(F.col("s") + F.col("t"), F.lit(epsilon))
    return sums.select("current_node", score.alias("lld_score"), score.alias("lid_score"))


def with_scores(rows: DataFrame, strict: bool = False) -> DataFrame:
    """The rows with their node's scores; 0 where the node is blank."""
    scores = node_scores(rows, strict).withColumnRenamed("current_node", "__node")
    kept = rows.drop("lld_score", "lid_score").join(scores, S.trimmed("current_node") == F.col("__node"), "left").drop("__node")
    return kept.na.fill(0.0, ["lld_score", "lid_score"])


def view_outputs(rows: DataFrame) -> DataFrame:
    """(view, column, explicit): outputs of each view, and whether a row names a source for it (AGG8)."""
    named = rows.select(S.trimmed("current_node").alias("view"), S.present("target_column").alias("column"), (~S.is_missing("source_column")).alias("own"))
    return named.filter("view <> '' AND column IS NOT NULL").groupBy("view", "column").agg(F.max("own").alias("explicit"))


def pullthrough(rows: DataFrame) -> DataFrame:
    """New rows: columns that a view shares with a dimension it is joined to and has no source for (JN8, ENR15, SET3-4)."""
    links = rows.filter(F.col("transformation_type") == "Shared_Dimension").select(S.trimmed("current_node").alias("view"), S.trimmed("source_object").alias("dimension"))
    links = links.filter("view <> '' AND dimension <> ''").distinct()
    outputs = view_outputs(rows)
    theirs = outputs.select(F.col("view").alias("dimension"), "column")
    found = links.join(outputs.filter("NOT explicit"), "view").join(theirs, ["dimension", "column"])
    null = F.lit(tokens.NULL)
    return found.select(
        F.col("view").alias("current_node"), F.lit(1).alias("hierarchy_level"), F.lit(tokens.PULLTHROUGH_FILE).alias("source_file"), F.col("dimension").alias("parent_input_object"),
        F.col("dimension").alias("source_object"), F.col("column").alias("source_column"), F.col("column").alias("target_column"), F.col("column").alias("node_output_columns"),
        F.lit("Shared_Dimension_Pullthrough").alias("transformation_type"), F.lit("pullthrough=true").alias("formula"), null.alias("filter_expression"), null.alias("join_name"),
        null.alias("join_expression"), null.alias("join_left_object"), null.alias("join_left_column"), null.alias("join_right_object"), null.alias("join_right_column"), null.alias("xpath"),
    )


def output_sets(rows: DataFrame) -> DataFrame:
    """(node, columns) with all output columns of each node (AGG15)."""
    listed = rows.select(S.trimmed("current_node").alias("node"), F.explode(F.split(S.present("node_output_columns"), ",")).alias("c"))
    return listed.filter("node <> ''").select("node", S.trimmed("c").alias("c")).filter("c <> ''").groupBy("node").agg(F.array_sort(F.collect_set("c")).alias("columns"))


def node_rows_to_columns(rows: DataFrame) -> DataFrame:
    """Node-level rows as one row for each output column of their target node; other rows as they are (GRA5)."""
    level = F.coalesce(F.col("lineage_level"), F.lit(""))
    node = rows.filter(level == "NODE").join(output_sets(rows).withColumnRenamed("node", "__n"), F.col("target_node") == F.col("__n")).withColumn("__c", F.explode("columns"))
    node = node.withColumns({"lineage_level": F.lit("COLUMN"), "target_column": F.col("__c"), "source_column": F.col("__c"), "transformation_type": F.lit("Parent_Rollup_Expanded")})
    return rows.filter(level != "NODE").unionByName(node.select(*rows.columns))


def node_targets_to_columns(rows: DataFrame) -> DataFrame:
    """Rows whose target is their own node as one row for each output column; other rows as they are (GRA6)."""
    listed = F.filter(F.transform(F.split(F.coalesce("node_output_columns", F.lit("")), ","), S.trimmed), lambda c: c != "")
    own = (S.trimmed(F.coalesce("target_column", F.lit(""))) == S.trimmed(F.coalesce("current_node", F.lit("")))) & (S.trimmed(F.coalesce("target_column", F.lit(""))) != "") & (S.trimmed(F.coalesce("node_output_columns", F.lit(""))) != "")
    wide = rows.filter(own).withColumn("target_column", F.explode(listed))
    return rows.filter(~own).unionByName(wide)


def view_lookup(rows: DataFrame, prefix: str = "ANV_") -> DataFrame:
    """For each analytic view its sources, number of targets and flags (AGG1, FLT5)."""
    source = F.when((F.col("source_object") != "") & (F.col("source_object") != tokens.NULL), F.col("source_object"))
    found = rows.filter(F.col("current_node").startswith(prefix)).groupBy(F.col("current_node").alias("anv_name")).agg(
        F.array_sort(F.collect_set(source)).alias("s"), F.countDistinct("target_column").alias("column_count"), F.max(F.col("transformation_type") == "Shared_Dimension").alias("shared")
    )
    flag = lambda c: F.when(c, "Y").otherwise("N")
    return found.select("anv_name", F.concat_ws(",", "s").alias("inferred_parents"), "column_count", flag(F.size("s") > 1).alias("star_join_flag"), flag(F.coalesce("shared", F.lit(False))).alias("shared_dimension_flag"))


def completed_views(rows: DataFrame, prefix: str = "ANV_") -> DataFrame:
    """The rows with the lookup's parents where an analytic view names none (JN1)."""
    known = view_lookup(rows, prefix).select("anv_name", "inferred_parents", "star_join_flag")
    out = rows.join(known, F.col("current_node") == F.col("anv_name"), "left")
    gap = F.col("current_node").startswith(prefix) & (F.col("parent_input_object") == tokens.NULL)
    return out.withColumn("parent_input_object", F.when(gap, F.col("inferred_parents")).otherwise(F.col("parent_input_object")))


def concepts(rows: DataFrame) -> DataFrame:
    """(concept, names): business terms and the technical names behind them (AGG5)."""
    names = rows.select(F.explode(F.array("current_node", "target_column", "source_column")).alias("name")).filter("name IS NOT NULL AND name <> ''")
    names = materialized(names.distinct(), "names")  # else the filter below would make the terms of every row's names first
    return names.select(S.concept("name").alias("concept"), "name").filter("concept <> ''").groupBy("concept").agg(F.array_sort(F.collect_set("name")).alias("names"))


def _without_one(x):
    """The text without each of its characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))


def similar_concepts(found: DataFrame, threshold: float = 0.88) -> DataFrame:
    """(concept, other): terms so alike that they may be one (ENR13), by edit distance over the longer one's length.

    No pair is lost. A longer term of n letters allows k = (1 - threshold) * n edits. Up to two edits, both terms have an equal
    rest after k deletions at most; beyond, of k + 1 pieces of the shorter one some lies in the longer one, k letters off at
    most. Terms meet on these rests and pieces, and the distance decides.
    """
    if not 0.8 <= threshold < 1:
        raise ValueError("below 0.8 too many terms meet")
    edits = lambda n: F.floor(n * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")
    terms = materialized(found.select("concept", F.length("concept").alias("n")), "terms")
    # the longest partner is no longer than the terms that there are
    sizes = terms.select("n").distinct()
    reach = sizes.join(sizes.select(F.col("n").alias("longest")), (F.col("longest") >= F.col("n")) & (F.col("longest") <= F.floor(F.col("n") / F.lit(threshold) + F.lit(1e-9))))
    terms = terms.join(F.broadcast(materialized(reach.groupBy("n").agg(F.max("longest").alias("longest")), "lengths")), "n").select("concept", "n", "longest")
    most = F.least(edits(F.col("longest")), F.lit(2))
    short = terms.filter((most >= 1) & (edits(F.col("n")) <= 2)).withColumn("one", _without_one(F.col("concept")))
    two = F.when(most > 1, F.array_distinct(F.flatten(F.transform("one", _without_one)))).otherwise(F.array())
    rests = short.select("concept", F.explode(F.array_union(F.array_union(F.array("concept"), F.col("one")), two)).alias("rest"))
    met = rests.join(rests.withColumnRenamed("concept", "other"), "rest").filter("concept < other").select("concept", "other")
    # (length of the longer, of the shorter, number and text of the piece)
    cut = lambda i, n, k: F.floor(i * n / (k + 1)).cast("int")
    begin, end = cut(F.col("i"), F.col("n"), F.col("k")), cut(F.col("i") + 1, F.col("n"), F.col("k"))
    pieces = terms.filter("n > 0").withColumn("long", F.explode(F.sequence("n", "longest"))).withColumn("k", edits(F.col("long"))).filter("k > 2").withColumn("i", F.explode(F.sequence(F.lit(0), "k")))
    pieces = pieces.select("long", "n", "i", F.substring("concept", begin + 1, end - begin).alias("piece"), F.col("concept").alias("a"))
    within = terms.select(F.col("concept").alias("b"), F.col("n").alias("long"), edits(F.col("n")).alias("k")).filter("k > 2")
    within = within.withColumn("n", F.explode(F.sequence(F.col("long") - F.col("k"), "long"))).withColumn("i", F.explode(F.sequence(F.lit(0), "k"))).withColumn("off", F.explode(F.sequence(-F.col("k"), "k")))
    at = begin + F.col("off")
    within = within.filter((at >= 0) & (at + end - begin <= F.col("long"))).select("long", "n", "i", F.substring("b", at + 1, end - begin).alias("piece"), "b").distinct()
    far = pieces.join(within, ["long", "n", "i", "piece"]).filter("a <> b").select(F.least("a", "b").alias("concept"), F.greatest("a", "b").alias("other"))
    ratio = 1 - F.levenshtein("concept", "other") / F.greatest(F.length("concept"), F.length("other"))
    return met.unionByName(far).distinct().filter(ratio >= threshold)


def singular_concepts(found: DataFrame) -> DataFrame:
    """The terms without those that are another one with a final s; their names go to that one (ENR13)."""
    own = found.select(F.col("concept").alias("single"))
    held = found.join(own, F.lower("concept") == F.lower(F.concat("single", F.lit("s"))), "left")
    return held.groupBy(F.coalesce("single", "concept").alias("concept")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


def synonyms(found: DataFrame) -> DataFrame:
    """(concept, synonym): the technical names of a term, and the term in lower case with underscores, where they differ from it (ENR13)."""
    names = found.select("concept", F.explode(F.concat("names", F.array(F.lower(F.regexp_replace("concept", " ", "_"))))).alias("synonym"))
    return names.filter("synonym <> concept").distinct()


def key_relations(rows_: DataFrame) -> DataFrame:
    """(left, right): concepts whose columns are joined (ENR13)."""
    joined = rows_.filter(~S.is_missing("join_left_column") & ~S.is_missing("join_right_column"))
    return joined.select(S.concept("join_left_column").alias("left"), S.concept("join_right_column").alias("right")).filter("left <> '' AND right <> ''").distinct()
