"""Lineage rows from elements (EXT1-33): each emitter selects elements, joins their children and projects a row.

`e` is the element table of `sources.shred.elements`. Emitters never leave the JVM but for html references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tokens
from ..functions import scalars as S
from ..schema import conform, union_all
from ..storage import materialized



def NULL() -> Column:  # noqa: N802  a constant, once there is a session
    """The null token."""
    return F.lit(tokens.NULL)


#: Tag of a node by profile. Fixed values.
NODE_TAGS = {"CV": "calculationView", "ANV": "cube", "ATV": "ColumnView", "DIM": "dimension"}
#: Where mappings are: profiles, parent, child, (grandchild, column), object from schema and table, target attribute, type, formula attribute. Fixed values.
MAPPINGS = (
    (("CV",), "input", "mapping", (None, "source"), False, "target", "Mapping", None),
    (("CV",), "attributes", "attribute", ("keyMapping", "columnName"), False, "id", "Mapping", None),
    (("CV",), "baseMeasures", "measure", ("measureMapping", "columnName"), False, "id", "Aggregation", "aggregationType"),
    (("ANV", "DIM"), "attributes", "attribute", ("keyMapping", "columnName"), True, "id", "Mapping", None),
    (("ANV", "DIM"), "baseMeasures", "measure", ("measureMapping", "columnName"), True, "id", "Aggregation", "aggregationType"),
    (("ATV",), "input", "mapping", (None, "sourceName"), False, "targetName", "Mapping", None),
)
#: Attributes of measures, of the scenario and of dimensions that rows carry. Fixed values.
MEASURE_META = {"aggregationType": "aggregation_type", "engineAggregation": "engine_aggregation", "measureType": "measure_type", "calculatedMeasureType": "calculated_measure_type", "datatype": "datatype", "expressionLanguage": "expression_language", "length": "length", "scale": "scale"}
SCENARIO_ATTRS = ("id", "dataCategory", "calculationScenarioType", "visibility", "applyPrivilegeType", "checkAnalyticPrivileges", "defaultClient", "defaultLanguage")
DIMENSION_ATTRS = ("id", "dimensionType", "schemaVersion", "visibility", "applyPrivilegeType", "checkAnalyticPrivileges", "defaultClient", "defaultLanguage", "hierarchiesSQLEnabled", "translationRelevant", "type", "generateConcatAttributes")
PROJECTING = ("projectionNode", "aggregationNode", "unionNode")


def attr(name: str, of: str = "attrs") -> Column:
    """A trimmed attribute, null where it is blank or absent (PRJ22)."""
    return F.nullif(S.trimmed(F.try_element_at(F.col(of), F.lit(name))), F.lit(""))


def type_of(of: str = "attrs") -> Column:
    """The xsi:type of an element, whatever the prefix."""
    found = F.filter(F.map_entries(F.col(of)), lambda x: (x["key"] == "xsi:type") | x["key"].endswith(":type"))
    return F.coalesce(F.try_element_at(found, F.lit(1))["value"], F.lit(""))


def context(e: DataFrame) -> DataFrame:
    """Elements with node (the nearest node's name), level and parent_input (EXT1-2, FLT4).

    A logical model under a scenario is a node for its own subtree.
    """
    own = F.struct("node_id", "local_name", attr("id").alias("id"), attr("name").alias("name"), attr("node").alias("node"))
    line = F.concat("ancestors", F.array(own))
    tag = F.create_map(*[F.lit(x) for pair in NODE_TAGS.items() for x in pair])[F.col("profile")]
    nodes = F.filter("line", lambda a: (a["local_name"] == F.col("tag")) | ((F.col("root_local") == "scenario") & (a["local_name"] == "logicalModel") & a["id"].isNotNull()))
    name = F.transform("nodes", lambda a: F.coalesce(F.when(F.col("profile") == "ATV", a["name"]).otherwise(a["id"]), NULL()))
    inputs = F.filter("line", lambda a: (a["local_name"] == "input") & (F.col("profile") == "CV"))
    out = e.withColumn("line", line).withColumn("tag", tag).withColumn("nodes", nodes).withColumn("inputs", inputs)
    out = out.withColumn("node", F.coalesce(F.try_element_at(name, F.lit(-1)), F.nullif(F.trim("root_name"), F.lit("")), NULL())).withColumn("level", F.size("nodes"))
    parent = F.when(F.size("inputs") > 0, F.coalesce(F.try_element_at("inputs", F.lit(-1))["node"], NULL())).otherwise(F.col("node"))
    return out.withColumn("parent_input", parent).drop("line", "tag", "nodes", "inputs")


def of_profile(e: DataFrame, *profiles: str) -> DataFrame:
    return e.filter(F.col("profile").isin(*profiles))


def tagged(e: DataFrame, *names: str) -> DataFrame:
    return e.filter(F.col("local_name").isin(*names))


def up(e: DataFrame, steps: int = 1) -> Column:
    """Local name of an ancestor, 1 being the parent."""
    return F.try_element_at("ancestors", F.lit(-steps))["local_name"]


def child(parents: DataFrame, e: DataFrame, *names: str, alias: str, cond: Column | None = None) -> DataFrame:
    """`parents` with `alias`: the first child of that name (attrs, text, node_id), or null."""
    kids = tagged(e, *names)
    kids = kids.filter(cond) if cond is not None else kids
    first = kids.groupBy("path", F.col("parent_id").alias("node_id")).agg(F.min_by(F.struct("attrs", "text", F.col("node_id").alias("node_id")), "node_id").alias(alias))
    return parents.join(first, ["path", "node_id"], "left")


def children(parents: DataFrame, e: DataFrame, *names: str, alias: str) -> DataFrame:
    """`parents` with `alias`: all children of these names in order."""
    kids = tagged(e, *names).groupBy("path", F.col("parent_id").alias("node_id"))
    every = kids.agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("node_id"), F.col("text").alias("text"), F.to_json("attrs").alias("json")))).alias("k"))
    typed = F.transform("k", lambda c: F.struct(c["node_id"].alias("node_id"), c["text"].alias("text"), F.from_json(c["json"], "map<string,string>").alias("attrs")))
    return parents.join(every.select("path", "node_id", typed.alias(alias)), ["path", "node_id"], "left")


def row(df: DataFrame, order: int, kind, **columns) -> DataFrame:
    """A lineage row for each element; columns that aren't given are missing."""
    own = {
        "row_seq": F.col("node_id").cast("long") * 64 + order, "current_node": F.col("node"), "hierarchy_level": F.col("level"), "source_file": F.col("path"),
        "transformation_type": F.lit(kind) if isinstance(kind, str) else kind, "xpath": F.col("xpath"),
    } | {k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()}
    for c in ("parent_input_object", "source_object", "source_column", "target_column", "label", "node_output_columns", "formula", "filter_expression", "join_name", "join_expression", "join_left_object", "join_left_column", "join_right_object", "join_right_column"):
        own[c] = F.coalesce(F.nullif(own[c].cast("string"), F.lit("")), NULL()) if c in own else NULL()
    return df.select(*[v.alias(k) for k, v in own.items()])


def added(df: DataFrame, order: int, kind, level: int = 1, **columns) -> DataFrame:
    """A row of an augmenter: column level, current node from the document's root unless given."""
    return row(df.withColumn("level", F.lit(level)), order, kind, lineage_level="COLUMN", target_node="", source_node="", **({"current_node": F.coalesce(F.nullif(F.trim("root_name"), F.lit("")), NULL())} | columns))


# --- objects that rows refer to --------------------------------------------------------------------------------------


def input_objects(e: DataFrame) -> DataFrame:
    """(path, node_id, entity_object) of every input with an entity (EXT15, PRJ4)."""
    found = tagged(e, "entity").filter(up(e) == "input").groupBy("path", F.col("parent_id").alias("node_id")).agg(F.min_by(S.entity_object("text"), "node_id").alias("entity_object"))
    return found


def central_tables(e: DataFrame) -> DataFrame:
    """(path, central): the first central table of each document (EXT13)."""
    proxy = tagged(e, "tableProxy").filter(F.lower(F.coalesce(attr("centralTable"), F.lit(""))) == "true").select("path", F.col("node_id").alias("proxy"))
    table = tagged(e, "table").withColumn("proxy", F.try_element_at(F.filter("ancestors", lambda a: a["local_name"] == "tableProxy"), F.lit(-1))["node_id"])
    both = table.join(proxy, ["path", "proxy"]).withColumn("central", F.concat(attr("schemaName"), F.lit("."), attr("columnObjectName"))).filter("central IS NOT NULL")
    return both.groupBy("path").agg(F.min_by("central", "node_id").alias("central"))


def with_source_object(df: DataFrame, e: DataFrame) -> DataFrame:
    """`df` with source_object: the entity of the nearest ancestor's first input, the central table, or the parent input (EXT16)."""
    first = tagged(e, "input").join(input_objects(e), ["path", "node_id"], "left").groupBy("path", F.col("parent_id").alias("holder")).agg(F.min(F.struct("node_id", F.col("entity_object").alias("o"))).alias("first"))
    lines = df.select("path", "node_id", F.explode(F.array_append(F.transform("ancestors", lambda a: a["node_id"]), F.col("node_id"))).alias("holder"))
    near = lines.join(first, ["path", "holder"]).groupBy("path", "node_id").agg(F.max_by("first.o", "holder").alias("near_object"))
    out = df.join(near, ["path", "node_id"], "left").join(central_tables(e), "path", "left")
    return out.withColumn("source_object", F.coalesce("near_object", "central", F.nullif("parent_input", NULL()))).drop("near_object", "central")


def scalars_of(e: DataFrame) -> DataFrame:
    """Context columns once for all emitters."""
    return context(e)


# --- emitters of the extractor ---------------------------------------------------------------------------------------


def mappings(c: DataFrame) -> DataFrame:
    """Source to target mappings (EXT3); a plain mapping whose names differ is a Rename."""
    parts = []
    objects = input_objects(c).withColumnRenamed("node_id", "parent_id")
    for n, (profiles, parent, tag, (grand, column), qualified, target, kind, formula) in enumerate(MAPPINGS):
        own = tagged(of_profile(c, *profiles), tag).filter(up(c) == parent)
        if grand:
            own = child(own, c, grand, alias="g").withColumn("g_attrs", F.col("g.attrs"))
            source, obj = attr(column, "g_attrs"), F.concat(attr("schemaName", "g_attrs"), F.lit("."), attr("columnObjectName", "g_attrs")) if qualified else F.lit(None).cast("string")
        else:
            source, obj = attr(column), F.lit(None).cast("string")
        own = own.join(objects, ["path", "parent_id"], "left")
        goal = F.coalesce(attr(target), NULL())
        what = F.when((goal != F.coalesce(source, NULL())), "Rename").otherwise(kind) if kind == "Mapping" else F.lit(kind)
        parts.append(row(own, n, what, parent_input_object=F.col("parent_input"), target_column=goal, source_column=source, source_object=F.coalesce(obj, F.when(F.lit(parent == "input"), F.col("entity_object"))), formula=attr(formula) if formula else NULL()))
    return union_all(*parts)


def _node_mapping_children(c: DataFrame) -> DataFrame:
    inside = F.exists("ancestors", lambda a: a["local_name"].isin(*PROJECTING))
    first = lambda *names: F.coalesce(*map(attr, names))
    own = tagged(of_profile(c, "CV"), "mapping", "attributeMapping", "attribute").filter((up(c) == "viewNode") & inside)
    return own.withColumn("goal", first("target", "targetName", "id", "name")).withColumn("origin", first("source", "sourceName", "attribute"))


def node_mappings(c: DataFrame) -> DataFrame:
    """Mappings of projection, aggregation and union nodes (EXT4)."""
    own = with_source_object(_node_mapping_children(c).filter("goal IS NOT NULL"), c)
    return row(own, 10, "Node_Mapping", parent_input_object=F.col("parent_input"), target_column=F.col("goal"), source_column=F.col("origin"), source_object=F.col("source_object"))


def pass_through(c: DataFrame, outputs: DataFrame) -> DataFrame:
    """Visible outputs that a node with one input doesn't map are passed through it (EXT5). `outputs` (path, node, column)."""
    kids = _node_mapping_children(c)
    holders = tagged(of_profile(c, "CV"), "viewNode").join(kids.select("path", F.col("parent_id").alias("node_id")).distinct(), ["path", "node_id"], "left_semi")
    inputs = tagged(c, "input").groupBy("path", "parent_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("path", "parent_id")
    holders = holders.join(inputs, ["path", "parent_id"], "left_semi")
    explicit = kids.filter("goal IS NOT NULL AND origin IS NOT NULL").select("path", F.col("parent_id").alias("node_id"), F.col("goal").alias("column"))
    open_ = holders.join(outputs, ["path", "node"]).join(explicit, ["path", "node_id", "column"], "left_anti").filter(F.col("column") != tokens.NULL)
    return row(with_source_object(open_, c), 11, "PassThrough", parent_input_object=F.col("parent_input"), target_column=F.col("column"), source_column=F.col("column"), source_object=F.col("source_object"))


def _formula(text: Column) -> Column:
    return F.regexp_replace(S.trimmed(text), r"^[ :]+", "")


def calculated_measures(c: DataFrame) -> DataFrame:
    """Calculated measures with their formula, description and attributes (EXT6)."""
    own = tagged(of_profile(c, "CV", "ANV", "DIM"), "measure").filter(up(c) == "calculatedMeasures")
    own = child(child(own, c, "formula", alias="f"), c, "descriptions", alias="d").withColumn("d_attrs", F.col("d.attrs"))
    meta = {column: F.coalesce(attr(name), NULL()) for name, column in MEASURE_META.items()}
    return row(with_source_object(own, c), 12, "Calculated_Measure", parent_input_object=F.col("parent_input"), target_column=attr("id"), formula=_formula(F.col("f.text")), source_object=F.col("source_object"), description=F.coalesce(attr("defaultDescription", "d_attrs"), NULL()), **meta)


def calculated_columns(c: DataFrame) -> DataFrame:
    """Calculated view attributes and attributes (EXT7)."""
    direct = child(tagged(of_profile(c, "CV", "ANV", "DIM"), "calculatedViewAttribute"), c, "formula", alias="f")
    keyed = child(tagged(of_profile(c, "CV", "ANV", "DIM"), "calculatedAttribute"), c.filter(up(c) == "calculatedAttribute"), "keyCalculation", alias="k")
    formulas = tagged(c, "formula").filter(up(c) == "keyCalculation").groupBy("path", F.col("parent_id").alias("kid")).agg(F.min_by(F.col("text"), "node_id").alias("f_text"))
    keyed = keyed.withColumn("kid", F.col("k.node_id")).join(formulas, ["path", "kid"], "left")
    one = row(direct, 13, "Calculated_Column", parent_input_object=F.col("parent_input"), target_column=attr("id"), formula=_formula(F.col("f.text")))
    return union_all(one, row(keyed, 14, "Calculated_Column", parent_input_object=F.col("parent_input"), target_column=attr("id"), formula=_formula(F.col("f_text"))))


def filters(c: DataFrame, outputs: DataFrame) -> DataFrame:
    """Attribute filters: a predicate, else a bundle of attributes, else the text (EXT8); for every output without an attribute."""
    own = child(tagged(of_profile(c, "CV", "ANV", "DIM"), "filter"), c, "valueFilter", alias="v").withColumn("v_attrs", F.col("v.attrs"))
    bare = attr("value").isNull() & attr("operator").isNull() & attr("including").isNull()
    pick = lambda n: F.coalesce(attr(n), F.when(bare, attr(n, "v_attrs")))
    own = own.withColumns({"q_value": pick("value"), "q_including": pick("including"), "q_operator": pick("operator"), "q_type": F.coalesce(F.nullif(type_of(), F.lit("")), F.when(bare & F.col("v").isNotNull(), F.nullif(type_of("v_attrs"), F.lit(""))))})
    own = own.join(c.select("path", F.col("node_id").alias("parent_id"), attr("id").alias("of")), ["path", "parent_id"], "left").withColumn("of", F.coalesce("of", attr("attributeName")))
    bundle = F.concat_ws("; ", F.concat(F.lit("value='"), "q_value", F.lit("'")), F.concat(F.lit("including="), "q_including"), F.concat(F.lit("operator="), "q_operator"), F.concat(F.lit("xsi:type="), "q_type"))
    made = F.when(F.col("of").isNotNull(), S.predicate("of", F.coalesce("q_operator", F.lit("")), F.coalesce("q_including", F.lit("")), F.coalesce("q_value", F.lit("")))).otherwise("")
    text = F.coalesce(F.nullif("inner_text", F.lit("")), F.lit(tokens.FILTER_WITHOUT_ATTRIBUTES))
    expression = F.when(made != "", made).when(F.col("of").isNotNull() & (bundle != ""), F.concat("of", F.lit(" :: "), bundle)).when(bundle != "", bundle).otherwise(text)
    own = own.withColumn("expression", expression)
    wide = own.filter("of IS NULL").join(outputs, ["path", "node"], "left").withColumn("goal", F.coalesce("column", NULL())).drop("column")
    return row(own.filter("of IS NOT NULL").withColumn("goal", F.col("of")).unionByName(wide), 15, "Filter", parent_input_object=F.col("parent_input"), target_column=F.col("goal"), filter_expression=F.col("expression"))


def joins(c: DataFrame, outputs: DataFrame) -> DataFrame:
    """Join views: a row for each output with the joined columns, and a summary of which side is populated (EXT9-10, JN14)."""
    own = tagged(of_profile(c, "CV"), "calculationView").filter(F.contains(type_of(), F.lit("JoinView")))
    own = children(children(own, c, "input", alias="ins"), c, "joinAttribute", alias="names")
    maps = tagged(c, "mapping").filter(up(c) == "input").withColumn("t", attr("target")).filter("t IS NOT NULL").groupBy("path", F.col("parent_id").alias("input_id"))
    maps = maps.agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("t", F.coalesce(attr("source"), F.lit("")).alias("s"))))).alias("m"))
    for side, at in (("l", 1), ("r", 2)):
        own = own.withColumn("input_id", F.try_element_at("ins", F.lit(at))["node_id"]).withColumn(f"{side}_obj", F.coalesce(F.nullif(F.try_element_at(F.try_element_at("ins", F.lit(at))["attrs"], F.lit("node")), F.lit("")), NULL()))
        own = own.join(maps.withColumnRenamed("m", f"{side}_map"), ["path", "input_id"], "left").drop("input_id")
        own = own.withColumn(f"{side}_map", F.coalesce(f"{side}_map", F.create_map().cast("map<string,string>")))
    names = F.transform(F.coalesce("names", F.array().cast("array<struct<node_id:int,text:string,attrs:map<string,string>>>")), lambda n: F.coalesce(S.trimmed(F.try_element_at(n["attrs"], F.lit("name"))), F.lit("")))
    own = own.withColumn("n", names)
    col = lambda side, x: F.coalesce(F.try_element_at(F.col(f"{side}_map"), x), x)
    pair = lambda x: F.when((col("l", x) != "") & (col("r", x) != ""), F.concat(F.col("l_obj"), F.lit("."), col("l", x), F.lit(" = "), F.col("r_obj"), F.lit("."), col("r", x)))
    own = own.withColumn("pairs", F.array_join(F.filter(F.transform("n", pair), lambda p: p.isNotNull()), "; "))
    kind, card = F.coalesce(attr("joinType"), F.lit("")), F.coalesce(attr("cardinality"), attr("joinOrder"), F.lit(""))
    expression = F.coalesce(F.nullif("pairs", F.lit("")), F.nullif(kind, F.lit("")), NULL())
    each = own.join(outputs, ["path", "node"], "left").withColumn("column", F.coalesce("column", NULL()))
    common = {"join_node_id": F.col("node"), "join_type": kind, "join_operator": "", "join_cardinality": card, "join_left_object": F.col("l_obj"), "join_right_object": F.col("r_obj")}
    rows = row(each, 16, "Join", parent_input_object=F.col("parent_input"), target_column=F.col("column"), join_expression=expression, **common)
    filled = lambda side: F.array_sort(F.map_keys(F.map_filter(F.col(f"{side}_map"), lambda k, v: v != "")))
    left, right = filled("l"), filled("r")
    populated = F.when((F.size(left) > 0) & (F.size(right) > 0), "BOTH").when(F.size(right) > 0, "RIGHT").when(F.size(left) > 0, "LEFT").otherwise("NONE")
    summary = row(own, 17, "Join", parent_input_object=F.col("node"), join_expression=F.col("pairs"), join_populated_side=populated, join_populated_fields=F.array_join(F.array_sort(F.array_union(left, right)), "; "), join_populated_fields_left=F.array_join(left, "; "), join_populated_fields_right=F.array_join(right, "; "), **common)
    return union_all(rows, summary)


def restricted_measures(c: DataFrame) -> DataFrame:
    """Restricted measures as aggregates of their base with a predicate (EXT11)."""
    own = tagged(of_profile(c, "ANV", "DIM"), "measure").filter(up(c) == "restrictedMeasures")
    own = child(child(own, c, "restriction", alias="r"), c, "descriptions", alias="d").withColumn("d_attrs", F.col("d.attrs"))
    filter_ = tagged(c, "filter").groupBy("path", F.col("parent_id").alias("rid")).agg(F.min_by(F.struct(F.col("node_id").alias("fid"), attr("attributeName").alias("name")), "node_id").alias("f"))
    value = tagged(c, "valueFilter").groupBy("path", F.col("parent_id").alias("fid")).agg(F.min_by(F.struct(F.col("node_id").alias("vid"), F.col("attrs").alias("a")), "node_id").alias("v"))
    operand = tagged(c, "operands").withColumn("o", attr("value")).filter("o IS NOT NULL").groupBy("path", F.col("parent_id").alias("vid")).agg(F.array_sort(F.collect_list(F.struct("node_id", "o"))).alias("ops"))
    own = own.withColumn("rid", F.col("r.node_id")).join(filter_, ["path", "rid"], "left").withColumn("fid", F.col("f.fid")).join(value, ["path", "fid"], "left").withColumn("vid", F.col("v.vid")).join(operand, ["path", "vid"], "left").withColumn("v_attrs", F.col("v.a"))
    yes = F.lower(F.coalesce(attr("including", "v_attrs"), F.lit(""))).isin("", "true", "1", "yes")
    name, val = F.col("f.name"), F.coalesce(F.try_element_at("v_attrs", F.lit("value")), F.lit(""))
    listed = F.array_join(F.transform("ops", lambda o: F.concat(F.lit("'"), o["o"], F.lit("'"))), ", ")
    made = F.when(name.isNull() | F.col("v").isNull(), NULL()).when(F.size("ops") > 0, F.concat(name, F.when(yes, " IN (").otherwise(" NOT IN ("), listed, F.lit(")")))
    made = made.when(F.upper(F.coalesce(attr("operator", "v_attrs"), F.lit(""))) == "NL", F.when(val != "", F.concat(name, F.lit(" NOT LIKE '"), val, F.lit("'"))).otherwise(F.concat(name, F.lit(" IS NOT NULL"))))
    made = made.when(val != "", F.concat(name, F.when(yes, " = '").otherwise(" <> '"), val, F.lit("'"))).otherwise(NULL())
    base = attr("baseMeasure")
    return row(own, 18, "Aggregate", parent_input_object=F.col("parent_input"), target_column=attr("id"), source_column=base, source_object=base, formula=F.concat(F.upper(F.coalesce(attr("engineAggregation"), F.lit("SUM"))), F.lit("("), base, F.lit(")")), filter_expression=made, description=F.coalesce(attr("defaultDescription", "d_attrs"), NULL()))


def source_tables(c: DataFrame) -> DataFrame:
    """Data sources and tables as star rows (EXT12)."""
    cv = row(tagged(of_profile(c, "CV"), "DataSource"), 19, "Source_Table", parent_input_object=F.col("parent_input"), source_object=attr("id"), source_column="*", target_column="*")
    full = F.concat_ws(".", attr("schemaName"), attr("columnObjectName"))
    other = row(tagged(of_profile(c, "ANV", "DIM"), "table"), 20, "Source_Table", parent_input_object=F.col("parent_input"), source_object=full, source_column=F.concat(full, F.lit(".*")), target_column="*")
    return union_all(cv, other)


def seeded_outputs(c: DataFrame) -> DataFrame:
    """(path, node, column): what nodes declare as visible."""
    cv = tagged(of_profile(c, "CV"), "viewAttribute").filter((up(c) == "viewAttributes") & (up(c, 2) == "calculationView")).select("path", F.coalesce(F.try_element_at("ancestors", F.lit(-2))["id"], NULL()).alias("node"), attr("id").alias("column"))
    atv = tagged(of_profile(c, "ATV"), "element").select("path", "node", attr("name").alias("column"))
    return cv.unionByName(atv).filter("column IS NOT NULL")


def synthesised(rows: DataFrame, c: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs without a source, taken from the central table, once each (EXT14). `outputs` (path, node, column), of which a comma ends a name."""
    listed = outputs.select(F.col("path").alias("source_file"), F.col("node").alias("current_node"), F.explode(F.split("column", ",")).alias("target_column")).withColumn("target_column", S.trimmed("target_column")).distinct()
    open_ = rows.filter(S.is_missing("source_column") & ~S.is_missing("target_column")).join(central_tables(c).withColumnRenamed("path", "source_file"), "source_file")
    open_ = open_.join(listed, ["source_file", "current_node", "target_column"], "left_semi")
    names = [x for x in rows.columns if x != "row_seq"]
    one = open_.groupBy("source_file", "central", "target_column").agg(F.min(F.struct("row_seq", *[x for x in names if x not in ("source_file", "target_column")])).alias("r"))
    own = one.select(*[F.col(x) if x in ("source_file", "target_column") else F.col(f"r.{x}") for x in ["row_seq", *names]], "central")
    return own.withColumns({"source_object": F.col("central"), "source_column": F.col("target_column"), "transformation_type": F.lit("Synth_Mapping"), "row_seq": F.col("row_seq") + 1}).select(*rows.columns)


# --- emitters of the augmenters --------------------------------------------------------------------------------------


def constant_mappings(c: DataFrame) -> DataFrame:
    """Constants that a view maps (EXT21)."""
    own = tagged(of_profile(c, "CV"), "mapping").filter(F.contains(type_of(), F.lit("ConstantAttributeMapping")))
    node = F.try_element_at(F.filter("ancestors", lambda a: (a["local_name"] == "calculationView") & (F.coalesce(a["id"], F.lit("")) != "")), F.lit(-1))["id"]
    ref = F.try_element_at(F.filter("ancestors", lambda a: a["local_name"] == "input"), F.lit(-1))["node"]
    parts = F.concat_ws(", ", F.concat(F.lit("value='"), attr("value"), F.lit("'")), F.concat(F.lit("null="), attr("null")))
    return added(own, 30, "Constant_Mapping", 0, current_node=F.coalesce(node, NULL()), parent_input_object=ref, target_column=attr("target"), source_column=tokens.CONST, formula=parts)


def logical_bindings(c: DataFrame) -> DataFrame:
    """Attributes of the logical model (EXT22)."""
    own = child(tagged(of_profile(c, "CV"), "attribute").filter((up(c) == "attributes") & (up(c, 2) == "logicalModel")), c, "keyMapping", alias="k").filter("k IS NOT NULL").withColumn("k_attrs", F.col("k.attrs"))
    return added(own, 31, "Logical_Binding", 0, current_node=NULL(), target_column=attr("id"), source_object=attr("columnObjectName", "k_attrs"), source_column=attr("columnName", "k_attrs"))


def entity_stars(c: DataFrame) -> DataFrame:
    """Entities of attribute views as star rows (EXT23)."""
    own = tagged(of_profile(c, "ATV"), "input").filter(up(c) == "viewNode").join(input_objects(c), ["path", "node_id"]).filter("entity_object IS NOT NULL")
    return added(own, 32, "Source_Table", parent_input_object=F.coalesce("root_name", NULL()), source_object=F.col("entity_object"), source_column=F.concat("entity_object", F.lit(".*")), target_column="*")


def label_bindings(c: DataFrame) -> DataFrame:
    """Label columns of attribute views (EXT24)."""
    own = child(tagged(of_profile(c, "ATV"), "element").filter(attr("name").isNotNull()), c, "labelElement", alias="l").filter("l IS NOT NULL")
    return added(own, 33, "Label_Binding", parent_input_object=F.coalesce("root_name", NULL()), target_column=attr("name"), source_column=F.element_at(F.split("l.text", "/"), -1), formula="labelElement")


def shared_dimensions(c: DataFrame) -> DataFrame:
    """Columns that an analytic view shares with its dimensions, by position and by alias (EXT17)."""
    own = child(tagged(of_profile(c, "ANV"), "logicalJoin").filter(up(c) == "sharedDimensions"), c, "properties", alias="p").withColumn("p_attrs", F.col("p.attrs"))
    uri = attr("associatedObjectUri")
    own = own.withColumn("view", F.coalesce(S.view_of_uri(uri), NULL()))
    meta = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), attr(n, "p_attrs")) for n in ("joinType", "joinOperator", "cardinality")], F.concat(F.lit("associatedObjectUri="), uri))
    own = own.withColumn("meta", meta)

    def listed(holder: str, item: str, name: str) -> DataFrame:
        holders = tagged(c, holder).select("path", F.col("node_id").alias("hid"), F.col("parent_id").alias("node_id"))
        items = tagged(c, item).select("path", F.col("parent_id").alias("hid"), F.col("node_id").alias("n"), F.col("text").alias("t"))
        got = items.join(holders, ["path", "hid"]).groupBy("path", "node_id").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("x"))
        return got.select("path", "node_id", F.posexplode(F.transform("x", lambda s: s["t"])).alias("pos", name))

    pairs = listed("attributes", "attributeRef", "goal").join(listed("associatedAttributeNames", "attributeName", "origin"), ["path", "node_id", "pos"])
    zipped = own.join(pairs, ["path", "node_id"]).withColumn("goal", F.regexp_replace("goal", "^#+", "")).filter("goal <> '' AND origin <> ''")
    first = added(zipped, 34, "Shared_Dimension", parent_input_object=F.col("view"), target_column=F.col("goal"), source_object=F.col("view"), source_column=F.col("origin"), formula=F.col("meta"))
    holders = tagged(c, "associatedAttributeFeatures").select("path", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("join_id"))
    feats = tagged(c, "attributeReference").join(holders, ["path", "parent_id"]).join(own.select("path", F.col("node_id").alias("join_id"), "view", "meta"), ["path", "join_id"]).filter(attr("alias").isNotNull() & attr("attributeName").isNotNull())
    second = added(feats, 35, "Shared_Dimension", parent_input_object=F.col("view"), target_column=attr("alias"), source_object=F.col("view"), source_column=attr("attributeName"), formula=F.col("meta"))
    return union_all(first, second)


def exception_aggregation(c: DataFrame) -> DataFrame:
    """Attributes over which calculated measures aggregate exceptionally (EXT18)."""
    measures = tagged(of_profile(c, "ANV"), "measure").filter(up(c) == "calculatedMeasures").select("path", F.col("node_id").alias("mid"), attr("id").alias("measure")).filter("measure IS NOT NULL")
    holders = tagged(c, "exceptionAggregation").select("path", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("mid"), attr("exceptionAggregationType").alias("how"))
    own = tagged(c, "attribute").join(holders, ["path", "parent_id"]).join(measures, ["path", "mid"]).filter(attr("attributeName").isNotNull())
    return added(own, 36, "Exception_Agg_Attribute", parent_input_object=F.coalesce("root_name", NULL()), target_column=F.col("measure"), source_object=S.view_of_uri(attr("dimensionUri")), source_column=attr("attributeName"), formula=F.concat(F.lit("exceptionAggregationType="), "how"))


def _table_label(of: str) -> Column:
    return F.coalesce(attr("alias", of), F.nullif(F.concat_ws(".", attr("schemaName", of), attr("columnObjectName", of)), F.lit("")))


def private_tables(c: DataFrame) -> DataFrame:
    """Tables of the private foundation, by alias if they have one (EXT27)."""
    own = tagged(of_profile(c, "ANV", "DIM"), "table").filter((up(c) == "tableProxy") & (up(c, 2) == "tableProxies") & (up(c, 3) == "privateDataFoundation")).withColumn("o", _table_label("attrs")).filter("o IS NOT NULL")
    return added(own, 37, "Source_Table", parent_input_object=F.coalesce("root_name", NULL()), source_object=F.col("o"), source_column=F.concat("o", F.lit(".*")), target_column="*")


def key_mappings(c: DataFrame) -> DataFrame:
    """Keys of a dimension's attributes with their flags (EXT28)."""
    own = child(tagged(of_profile(c, "DIM"), "attribute").filter(up(c) == "attributes"), c, "keyMapping", alias="k").withColumn("k_attrs", F.col("k.attrs")).filter(attr("id").isNotNull() & F.col("k").isNotNull())
    return added(own, 38, "Logical_Binding", parent_input_object=F.coalesce("root_name", NULL()), target_column=attr("id"), source_object=_table_label("k_attrs"), source_column=attr("columnName", "k_attrs"), attribute_key=attr("key"), attribute_hidden=attr("hidden"), attribute_order=attr("order"), attribute_description_column=attr("descriptionColumnName"))


def private_joins(c: DataFrame) -> DataFrame:
    """Joins of the private foundation, a row for each pair of columns (EXT29)."""
    own = tagged(of_profile(c, "ANV", "DIM"), "join").filter((up(c) == "joins") & (up(c, 2) == "privateDataFoundation"))
    for name, alias in (("leftTable", "lt"), ("rightTable", "rt"), ("properties", "pr"), ("leftColumns", "lc"), ("rightColumns", "rc")):
        own = child(own, c, name, alias=alias)
    own = own.filter("lt IS NOT NULL AND rt IS NOT NULL").withColumns({f"{a}_attrs": F.col(f"{a}.attrs") for a in ("lt", "rt", "pr")})
    texts = tagged(c, "columnName").groupBy("path", F.col("parent_id").alias("hid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda s: s["text"]).alias("t"))
    for side in ("l", "r"):
        own = own.withColumn("hid", F.col(f"{side}c.node_id")).join(texts.withColumnRenamed("t", f"{side}_cols"), ["path", "hid"], "left").drop("hid").withColumn(f"{side}_cols", F.coalesce(f"{side}_cols", F.array().cast("array<string>")))
    n = F.when((F.size("l_cols") > 0) | (F.size("r_cols") > 0), F.greatest(F.least(F.size("l_cols"), F.size("r_cols")), F.lit(1))).otherwise(0)
    own = own.withColumn("n", n).filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda side: F.coalesce(F.get(f"{side}_cols", F.col("i")), F.lit(tokens.MISSING))
    own = own.withColumns({"lo": F.coalesce(_table_label("lt_attrs"), NULL()), "ro": F.coalesce(_table_label("rt_attrs"), NULL()), "lcol": at("l"), "rcol": at("r")})
    whole = ~F.col("lcol").isin("", tokens.MISSING) & ~F.col("rcol").isin("", tokens.MISSING)
    expression = F.concat_ws(" | ", attr("joinOperator", "pr_attrs"), F.when(whole, F.concat("lo", F.lit("."), "lcol", F.lit(" = "), "ro", F.lit("."), "rcol")))
    language = attr("languageColumn")
    formula = F.concat_ws(", ", F.concat(F.lit("type="), attr("joinType", "pr_attrs")), F.concat(F.lit("cardinality="), attr("cardinality", "pr_attrs")), F.concat(F.lit("languageColumn="), language))
    return added(own, 39, "Join", parent_input_object=F.coalesce("root_name", NULL()), join_left_object=F.col("lo"), join_left_column=F.col("lcol"), join_right_object=F.col("ro"), join_right_column=F.col("rcol"), join_expression=expression, join_language_column=F.coalesce(language, NULL()), formula=formula)


def table_filters(c: DataFrame) -> DataFrame:
    """Filters on tables of the private foundation (EXT30)."""
    proxies = child(tagged(of_profile(c, "ANV", "DIM"), "tableProxy").filter((up(c) == "tableProxies") & (up(c, 2) == "privateDataFoundation")), c, "table", alias="t").filter("t IS NOT NULL").withColumn("t_attrs", F.col("t.attrs"))
    proxies = proxies.select("path", F.col("node_id").alias("parent_id"), F.coalesce(_table_label("t_attrs"), NULL()).alias("o"))
    own = child(tagged(c, "columnFilter").join(proxies, ["path", "parent_id"]), c, "valueFilter", alias="v").withColumn("v_attrs", F.col("v.attrs"))
    operand = tagged(c, "operands").withColumn("x", attr("value")).filter("x IS NOT NULL").groupBy("path", F.col("parent_id").alias("vid")).agg(F.array_sort(F.collect_list(F.struct("node_id", "x"))).alias("ops"))
    own = own.withColumn("vid", F.col("v.node_id")).join(operand, ["path", "vid"], "left")
    listed = F.array_join(F.transform("ops", lambda o: F.concat(F.lit("'"), o["x"], F.lit("'"))), ", ")
    op, incl = F.upper(attr("operator", "v_attrs")), F.lower(attr("including", "v_attrs"))
    parts = F.concat_ws(", ", F.concat(F.lit("xsi:type="), F.nullif(type_of("v_attrs"), F.lit(""))), F.concat(F.lit("operator="), op), F.concat(F.lit("including="), incl), F.concat(F.lit("value='"), attr("value", "v_attrs"), F.lit("'")), F.when(F.size("ops") > 0, F.concat(F.lit("operands=["), listed, F.lit("]"))))
    named = F.concat("o", F.lit("."), attr("columnName"))
    expression = F.when((F.size("ops") > 0) & (op == "IN"), F.concat(named, F.when(F.coalesce(incl, F.lit("")).isin("", "true"), " IN (").otherwise(" NOT IN ("), listed, F.lit(")"))).otherwise(named)
    return added(own, 40, "Filter", parent_input_object=F.coalesce("root_name", NULL()), source_object=F.col("o"), filter_expression=expression, formula=parts)


def dimension_calculations(c: DataFrame) -> DataFrame:
    """Calculated attributes of dimensions with their references decoded (EXT31)."""
    own = child(tagged(of_profile(c, "DIM"), "calculatedAttribute").filter((up(c) == "calculatedAttributes") & attr("id").isNotNull()), c, "keyCalculation", alias="k")
    formulas = tagged(c, "formula").groupBy("path", F.col("parent_id").alias("kid")).agg(F.min_by(F.col("text"), "node_id").alias("f_text"))
    own = own.withColumn("kid", F.col("k.node_id")).join(formulas, ["path", "kid"], "left").withColumn("f_text", S.unescaped("f_text"))
    return added(own, 41, "Calculated_Attribute", parent_input_object=F.coalesce("root_name", NULL()), target_column=attr("id"), formula=F.col("f_text"))


# --- columns that documents give to all their rows -------------------------------------------------------------------


def semantic_labels(c: DataFrame) -> DataFrame:
    """(path, column, label) of described outputs; the last description of a column holds (EXT32)."""
    own = tagged(c, "attribute", "measure", "calculatedViewAttribute").filter(up(c) == "attributes")
    own = child(own, c, "descriptions", alias="d").withColumn("d_attrs", F.col("d.attrs")).withColumns({"column": F.coalesce(attr("id"), attr("name")), "l": attr("defaultDescription", "d_attrs")})
    return own.filter("column IS NOT NULL AND l IS NOT NULL").groupBy("path", "column").agg(F.max_by("l", "node_id").alias("l"))


def with_labels(rows: DataFrame, c: DataFrame) -> DataFrame:
    """Labels of target columns where a row has none (JN2)."""
    found = semantic_labels(c).select(F.col("path").alias("source_file"), F.col("column").alias("target_column"), F.col("l").alias("__label"))
    out = rows.join(found, ["source_file", "target_column"], "left")
    return out.withColumn("label", F.when(S.is_missing("label"), F.coalesce("__label", "label")).otherwise(F.col("label"))).select(*rows.columns)


def data_sources(c: DataFrame) -> DataFrame:
    """(path, id, type, uri, object) of declared data sources (EXT20)."""
    own = child(child(tagged(of_profile(c, "CV"), "DataSource").filter((up(c) == "dataSources") & attr("id").isNotNull()), c, "resourceUri", alias="u"), c, "columnObject", alias="o").withColumn("o_attrs", F.col("o.attrs"))
    return own.groupBy("path", attr("id").alias("id")).agg(F.max_by(F.struct(attr("type").alias("type"), F.nullif("u.text", F.lit("")).alias("uri"), F.concat(attr("schemaName", "o_attrs"), F.lit("."), attr("columnObjectName", "o_attrs")).alias("object")), "node_id").alias("s")).select("path", "id", "s.*")


def with_document_columns(rows: DataFrame, c: DataFrame) -> DataFrame:
    """Scenario, data source and dimension columns (EXT19-20, EXT25-26, JN3)."""
    roots = c.filter("depth = 0")
    pick = lambda names: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.coalesce(attr(n), NULL()) for n in names]))
    meta = child(child(roots, c, "descriptions", alias="d"), c, "metadata", alias="m").withColumns({"d_attrs": F.col("d.attrs"), "m_attrs": F.col("m.attrs"), "did": F.col("d.node_id")})
    comment = tagged(c, "comment").withColumn("t", F.regexp_replace(S.unescaped(attr("text")), r"[\r\n]", " ")).filter("t IS NOT NULL").groupBy("path", F.col("parent_id").alias("did")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "t"))), lambda s: s["t"]), " | ").alias("comments"))
    meta = meta.join(comment, ["path", "did"], "left")
    described = F.col("profile").isin("DIM", "ANV")
    cols = meta.select(
        F.col("path").alias("source_file"), F.when(F.col("root_local") == "scenario", pick(SCENARIO_ATTRS)).alias("scenario"), F.when(F.col("root_local") == "dimension", pick(DIMENSION_ATTRS)).alias("dimension"),
        F.when(described, attr("defaultDescription", "d_attrs")).alias("dimension_default_description"), F.when(described, F.col("comments")).alias("dimension_comments"),
        F.when(described, attr("activatedAt", "m_attrs")).alias("dimension_activated_at"), F.when(described, attr("changedAt", "m_attrs")).alias("dimension_changed_at"),
    )
    sources = data_sources(c).select(F.col("path").alias("source_file"), F.concat(F.lit("#"), "id").alias("parent_input_object"), F.col("id").alias("data_source_id"), F.col("type").alias("data_source_type"), F.col("uri").alias("data_source_resource_uri"), F.col("object").alias("data_source_object"))
    names = [x for x in rows.columns if x not in (*cols.columns, *sources.columns) or x in ("source_file", "parent_input_object")]
    return rows.select(*names).join(cols, "source_file", "left").join(sources, ["source_file", "parent_input_object"], "left")


def with_outputs(rows: DataFrame, outputs: DataFrame) -> DataFrame:
    """node_output_columns of the rows marked `__listed`: what their node puts out, a text of each node. `outputs` (path, node, column)."""
    texts = outputs.groupBy(F.col("path").alias("source_file"), F.col("node").alias("__node")).agg(S.outputs_text(F.collect_set("column")).alias("__outputs"))
    own = rows.withColumn("__node", F.when(F.col("__listed"), F.col("current_node"))).join(texts, ["source_file", "__node"], "left")
    return own.withColumn("node_output_columns", F.coalesce(F.nullif("__outputs", F.lit("")), NULL())).drop("__node", "__outputs", "__listed")


def extract(elements: DataFrame) -> DataFrame:
    """All lineage rows of the documents, in the fixed schema.

    The emitters' rows are written to the shared folder one after another, so that no plan holds all emitters and none runs twice.
    What a document or a node gives to all its rows is joined last and never written: a node's list of outputs, on each of its rows,
    grows with the square of the node.
    """
    c = materialized(scalars_of(elements), "elements")
    own = materialized(union_all(mappings(c), node_mappings(c), calculated_measures(c), calculated_columns(c), restricted_measures(c), source_tables(c)), "rows")
    named = own.select(F.col("source_file").alias("path"), F.col("current_node").alias("node"), F.col("target_column").alias("column"))
    outputs = materialized(named.unionByName(seeded_outputs(c)).filter(F.col("column") != tokens.NULL).distinct(), "outputs")
    own = union_all(own, materialized(pass_through(c, outputs), "rows"), materialized(filters(c, outputs), "rows"), materialized(joins(c, outputs), "rows"))
    own = own.withColumn("__listed", F.lit(True))
    parts = [own, materialized(synthesised(own, c, outputs), "rows")]
    parts.append(materialized(union_all(constant_mappings(c), logical_bindings(c), entity_stars(c), label_bindings(c)), "rows"))
    parts.append(materialized(union_all(shared_dimensions(c), exception_aggregation(c)), "rows"))
    parts.append(materialized(union_all(private_tables(c), key_mappings(c), private_joins(c)), "rows"))
    parts.append(materialized(union_all(table_filters(c), dimension_calculations(c)), "rows"))
    return conform(with_outputs(with_labels(with_document_columns(union_all(*parts), c), c), outputs))
