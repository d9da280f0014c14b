"""Documents written from the star schema and read back: what comes out must equal the tables (F3).

One analytic view for each nation, one calculation view scenario for each region, one attribute view for each brand of a
part, one dimension for each nation's suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract
from ..schema import conform
from ..sources import shred
from .catalogue import QUERIES, SQL

_XSI = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(df: DataFrame, key: str, **texts: str) -> DataFrame:
    """For each key, format strings over the rows' columns, put together."""
    return df.groupBy(key).agg(*[F.array_join(F.collect_list(F.expr(t)), "").alias(n) for n, t in texts.items()])


def documents(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(path, content) of the asked kinds: anv, cv, atv, dim."""
    nation, customer, supplier, part = (_read(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "part"))
    out = []
    if "anv" in kinds:
        c = _joined(
            customer, "c_nationkey",
            attributes="""concat('<attribute id="C', c_custkey, '"><descriptions defaultDescription="Customer ', c_custkey, '"/><keyMapping schemaName="DWH" columnObjectName="CUSTOMER" columnName="', c_mktsegment, '"/></attribute>')""",
            shared="""concat('<logicalJoin associatedObjectUri="/pkg/attributeviews/ATV_', c_mktsegment, '"><attributes><attributeRef>#C', c_custkey, '</attributeRef></attributes><associatedAttributeNames><attributeName>', c_name, '</attributeName></associatedAttributeNames><properties joinType="ref" cardinality="CN_1"/><associatedAttributeFeatures><attributeReference alias="AL', c_custkey, '" attributeName="KEY"/></associatedAttributeFeatures></logicalJoin>')""",
            measures="""concat('<measure id="M', c_custkey, '" aggregationType="sum"><measureMapping schemaName="DWH" columnObjectName="CUSTOMER" columnName="ACCTBAL"/></measure>')""",
            calculated="""concat('<measure id="K', c_custkey, '" datatype="DECIMAL"><descriptions defaultDescription="Twice ', c_custkey, '"/><formula> : "M', c_custkey, '" * 2</formula><exceptionAggregation exceptionAggregationType="avg"><attribute attributeName="DAY" dimensionUri="/pkg/attributeviews/ATV_TIME_', c_custkey % 7, '"/></exceptionAggregation></measure>')""",
            restricted="""concat('<measure id="R', c_custkey, '" baseMeasure="M', c_custkey, '" engineAggregation="max"><restriction><filter attributeName="SEG"><valueFilter ', CASE c_custkey % 3 WHEN 0 THEN concat('including="false" value="', c_mktsegment, '"/>') WHEN 1 THEN 'including="true"><operands value="A"/><operands value="B"/></valueFilter>' ELSE 'operator="NL" value="x%"/>' END, '</filter></restriction></measure>')""",
        )
        f = _joined(
            supplier, "s_nationkey",
            proxies="""concat('<tableProxy><table schemaName="DWH" columnObjectName="S', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN concat('" alias="AL', s_suppkey) ELSE '' END, '"/><columnFilter columnName="K"><valueFilter operator="IN" including="', s_suppkey % 3 = 0, '"><operands value="1"/><operands value="', s_suppkey, '"/></valueFilter></columnFilter></tableProxy>')""",
            joins="""concat('<join languageColumn="L', s_suppkey, '"><leftTable schemaName="DWH" columnObjectName="S', s_suppkey, '"/><rightTable schemaName="DWH" columnObjectName="NATION"/><leftColumns><columnName>A</columnName><columnName>B</columnName></leftColumns><rightColumns><columnName>C', s_suppkey, '</columnName></rightColumns><properties joinType="inner" joinOperator="Equal" cardinality="CN_1"/></join>')""",
        )
        both = c.join(f, c["c_nationkey"] == f["s_nationkey"], "left").withColumn("k", F.col("c_nationkey")).na.fill("", ["proxies", "joins"])
        out.append(both.select(F.concat(F.lit("anv_"), "k", F.lit(".xml")).alias("path"), F.concat(F.lit(f'<Cube:cube xmlns:Cube="urn:cube" {_XSI} id="ANV_NATION_'), "k", F.lit('"><attributes>'), "attributes", F.lit("</attributes><baseMeasures>"), "measures", F.lit("</baseMeasures><calculatedMeasures>"), "calculated", F.lit("</calculatedMeasures><restrictedMeasures>"), "restricted", F.lit("</restrictedMeasures><privateDataFoundation><tableProxies>"), "proxies", F.lit("</tableProxies><joins>"), "joins", F.lit("</joins></privateDataFoundation><sharedDimensions>"), "shared", F.lit("</sharedDimensions></Cube:cube>")).alias("xml")))
    if "cv" in kinds:
        n = _joined(
            nation, "n_regionkey",
            sources="""concat('<DataSource id="DS', n_nationkey, '" type="DATA_BASE_TABLE"><columnObject schemaName="DWH" columnObjectName="', n_name, '"/><resourceUri>/u/', n_nationkey, '</resourceUri></DataSource>')""",
            views="""concat('<calculationView xsi:type="Calculation:ProjectionView" id="P', n_nationkey, '"><viewAttributes><viewAttribute id="A', n_nationkey, '"><filter including="true" operator="', CASE WHEN n_nationkey % 2 = 0 THEN 'GE' ELSE '' END, '" value="', n_nationkey, '"/></viewAttribute></viewAttributes><calculatedViewAttributes><calculatedViewAttribute id="X', n_nationkey, '"><formula>"A', n_nationkey, '" + 1</formula></calculatedViewAttribute></calculatedViewAttributes><input node="#DS', n_nationkey, '"><mapping xsi:type="Calculation:AttributeMapping" target="A', n_nationkey, '" source="', n_name, '"/><mapping xsi:type="Calculation:ConstantAttributeMapping" target="Z" value="', n_nationkey, '"/></input></calculationView><calculationView xsi:type="Calculation:JoinView" id="J', n_nationkey, '" joinType="inner" cardinality="C1_N"><viewAttributes><viewAttribute id="O1"/><viewAttribute id="O2"/></viewAttributes><input node="#P', n_nationkey, '"><mapping target="O1" source="A', n_nationkey, '"/></input><input node="#P0"><mapping target="O2" source="A0"/></input><joinAttribute name="O1"/></calculationView>')""",
            nodes="""concat('<projectionNode id="N', n_nationkey, '"><input node="#DS', n_nationkey, '"/><viewNode><mapping targetName="T', n_nationkey, '" sourceName="S', n_nationkey, '"/></viewNode></projectionNode>')""",
            logical="""concat('<attribute id="L', n_nationkey, '"><descriptions defaultDescription="', n_name, '"/><keyMapping columnObjectName="J', n_nationkey, '" columnName="O1"/></attribute>')""",
        )
        out.append(n.select(F.concat(F.lit("cv_"), "n_regionkey", F.lit(".xml")).alias("path"), F.concat(F.lit(f'<Calculation:scenario xmlns:Calculation="urn:calc" {_XSI} id="CV_REGION_'), "n_regionkey", F.lit('" visibility="external"><dataSources>'), "sources", F.lit("</dataSources><calculationViews>"), "views", "nodes", F.lit('</calculationViews><logicalModel id="LM"><attributes>'), "logical", F.lit("</attributes></logicalModel></Calculation:scenario>")).alias("xml")))
    if "atv" in kinds:
        p = _joined(part, "p_brand", elements="""concat('<element name="P', p_partkey, '"><labelElement>#//ATV/T', p_size, '</labelElement></element>')""", maps="""concat('<mapping sourceName="S', p_partkey % 9, '" targetName="P', p_partkey, '"/>')""")
        out.append(p.select(F.concat(F.lit("atv_"), "p_brand", F.lit(".txt")).alias("path"), F.concat(F.lit('<View:ColumnView xmlns:View="urn:view" name="ATV_'), "p_brand", F.lit('"><viewNode>'), "elements", F.lit('<input><entity>#//"DWH".PART</entity>'), "maps", F.lit("</input></viewNode></View:ColumnView>")).alias("xml")))
    if "dim" in kinds:
        d = _joined(supplier, "s_nationkey", attributes="""concat('<attribute id="S', s_suppkey, '" key="', s_suppkey % 2 = 0, '" order="', s_suppkey, '"><keyMapping schemaName="DWH" columnObjectName="SUPPLIER" columnName="C', s_suppkey, '"/></attribute>')""", calculated="""concat('<calculatedAttribute id="X', s_suppkey, '"><keyCalculation><formula>"S', s_suppkey, '" &amp;lt; 3</formula></keyCalculation></calculatedAttribute>')""")
        out.append(d.select(F.concat(F.lit("dim_"), "s_nationkey", F.lit(".xml")).alias("path"), F.concat(F.lit('<Dimension:dimension xmlns:Dimension="urn:dim" id="DIM_'), "s_nationkey", F.lit('" dimensionType="std"><attributes>'), "attributes", F.lit("</attributes><calculatedAttributes>"), "calculated", F.lit("</calculatedAttributes></Dimension:dimension>")).alias("xml")))
    docs = out[0]
    for d in out[1:]:
        docs = docs.unionByName(d)
    return docs.select("path", F.col("xml").cast("binary").alias("content"))


def _context(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    from ..storage import materialized

    return materialized(extract.scalars_of(shred.elements(shred.shred(documents(spark, sf_dir, *kinds)))), "elements")


def _register(name: str, kinds: str, sql: str | None, columns: str):
    wanted = columns.split()

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(_context(spark, sf_dir, *kinds.split())).select(*wanted)
        if sql:
            SQL[name] = sql.strip()
        return f

    return put


@_register("xml_mappings", "anv cv atv dim", """
SELECT 'anv_' || c_nationkey || '.xml' AS source_file, 'ANV_NATION_' || c_nationkey AS current_node, 'DWH.CUSTOMER' AS source_object, c_mktsegment AS source_column, 'C' || c_custkey AS target_column, 'Rename' AS transformation_type, '<NULL>' AS formula FROM customer
UNION ALL SELECT 'anv_' || c_nationkey || '.xml', 'ANV_NATION_' || c_nationkey, 'DWH.CUSTOMER', 'ACCTBAL', 'M' || c_custkey, 'Aggregation', 'sum' FROM customer
UNION ALL SELECT 'cv_' || n_regionkey || '.xml', 'P' || n_nationkey, '<NULL>', n_name, 'A' || n_nationkey, 'Rename', '<NULL>' FROM nation
UNION ALL SELECT 'cv_' || n_regionkey || '.xml', 'P' || n_nationkey, '<NULL>', '<NULL>', 'Z', 'Rename', '<NULL>' FROM nation
UNION ALL SELECT 'cv_' || n_regionkey || '.xml', 'J' || n_nationkey, '<NULL>', 'A' || n_nationkey, 'O1', 'Rename', '<NULL>' FROM nation
UNION ALL SELECT 'cv_' || n_regionkey || '.xml', 'J' || n_nationkey, '<NULL>', 'A0', 'O2', 'Rename', '<NULL>' FROM nation
UNION ALL SELECT 'cv_' || n_regionkey || '.xml', 'LM', '<NULL>', 'O1', 'L' || n_nationkey, 'Rename', '<NULL>' FROM nation
UNION ALL SELECT 'atv_' || p_brand || '.txt', 'ATV_' || p_brand, 'DWH.PART', 'S' || (p_partkey % 9), 'P' || p_partkey, 'Rename', '<NULL>' FROM part
UNION ALL SELECT 'dim_' || s_nationkey || '.xml', 'DIM_' || s_nationkey, 'DWH.SUPPLIER', 'C' || s_suppkey, 'S' || s_suppkey, 'Rename', '<NULL>' FROM supplier
""", "source_file current_node source_object source_column target_column transformation_type formula")  # fmt: skip
def _(c):
    return extract.mappings(c)


@_register("xml_node_mappings", "cv", "SELECT 'CV_REGION_' || n_regionkey AS current_node, 'T' || n_nationkey AS target_column, 'S' || n_nationkey AS source_column, 'CV_REGION_' || n_regionkey AS source_object FROM nation", "current_node target_column source_column source_object")
def _(c):
    return extract.node_mappings(c)


@_register("xml_filters", "cv", "SELECT 'P' || n_nationkey AS current_node, 'A' || n_nationkey AS target_column, 'A' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ' >= ''' ELSE ' = ''' END || n_nationkey || '''' AS filter_expression FROM nation", "current_node target_column filter_expression")
def _(c):
    return extract.filters(c, extract.seeded_outputs(c))


@_register("xml_calculated", "anv cv", """
SELECT 'ANV_NATION_' || c_nationkey AS current_node, 'K' || c_custkey AS target_column, '"M' || c_custkey || '" * 2' AS formula, 'Calculated_Measure' AS transformation_type, 'Twice ' || c_custkey AS description FROM customer
UNION ALL SELECT 'P' || n_nationkey, 'X' || n_nationkey, '"A' || n_nationkey || '" + 1', 'Calculated_Column', NULL FROM nation""", "current_node target_column formula transformation_type description")  # fmt: skip
def _(c):
    return extract.union_all(extract.calculated_measures(c), extract.calculated_columns(c))


@_register("xml_restricted", "anv", """SELECT 'R' || c_custkey AS target_column, 'M' || c_custkey AS source_column, 'MAX(M' || c_custkey || ')' AS formula,
CASE c_custkey % 3 WHEN 0 THEN 'SEG <> ''' || c_mktsegment || '''' WHEN 1 THEN 'SEG IN (''A'', ''B'')' ELSE 'SEG NOT LIKE ''x%''' END AS filter_expression FROM customer""", "target_column source_column formula filter_expression")  # fmt: skip
def _(c):
    return extract.restricted_measures(c)


@_register("xml_source_tables", "anv cv", """SELECT 'cv_' || n_regionkey || '.xml' AS source_file, 'DS' || n_nationkey AS source_object, '*' AS source_column FROM nation
UNION ALL SELECT 'anv_' || s_nationkey || '.xml', 'DWH.S' || s_suppkey, 'DWH.S' || s_suppkey || '.*' FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)""", "source_file source_object source_column")  # fmt: skip
def _(c):
    return extract.source_tables(c)


@_register("xml_join_views", "cv", """WITH o AS (SELECT * FROM (VALUES ('O1'), ('O2')) v(c)) SELECT 'J' || n_nationkey AS current_node, o.c AS target_column, '#P' || n_nationkey || '.A' || n_nationkey || ' = #P0.O1' AS join_expression, 'inner' AS join_type, NULL AS join_populated_side FROM nation, o
UNION ALL SELECT 'J' || n_nationkey, '<NULL>', '#P' || n_nationkey || '.A' || n_nationkey || ' = #P0.O1', 'inner', 'BOTH' FROM nation""", "current_node target_column join_expression join_type join_populated_side")  # fmt: skip
def _(c):
    return extract.joins(c, extract.seeded_outputs(c))


@_register("xml_constants", "cv", "SELECT 'P' || n_nationkey AS current_node, 'Z' AS target_column, '<CONST>' AS source_column, 'value=''' || n_nationkey || '''' AS formula, '#DS' || n_nationkey AS parent_input_object FROM nation", "current_node target_column source_column formula parent_input_object")
def _(c):
    return extract.constant_mappings(c)


@_register("xml_logical_bindings", "cv", "SELECT 'L' || n_nationkey AS target_column, 'J' || n_nationkey AS source_object, 'O1' AS source_column FROM nation", "target_column source_object source_column")
def _(c):
    return extract.logical_bindings(c)


@_register("xml_shared_dims", "anv", """SELECT 'ANV_NATION_' || c_nationkey AS current_node, 'C' || c_custkey AS target_column, 'ATV_' || c_mktsegment AS source_object, c_name AS source_column FROM customer
UNION ALL SELECT 'ANV_NATION_' || c_nationkey, 'AL' || c_custkey, 'ATV_' || c_mktsegment, 'KEY' FROM customer""", "current_node target_column source_object source_column")  # fmt: skip
def _(c):
    return extract.shared_dimensions(c)


@_register("xml_exception_agg", "anv", "SELECT 'K' || c_custkey AS target_column, 'ATV_TIME_' || (c_custkey % 7) AS source_object, 'DAY' AS source_column, 'exceptionAggregationType=avg' AS formula FROM customer", "target_column source_object source_column formula")
def _(c):
    return extract.exception_aggregation(c)


@_register("xml_private_tables", "anv", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'AL' || s_suppkey ELSE 'DWH.S' || s_suppkey END AS source_object FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)", "source_object")
def _(c):
    return extract.private_tables(c)


@_register("xml_private_joins", "anv", "SELECT 'DWH.S' || s_suppkey AS join_left_object, 'A' AS join_left_column, 'C' || s_suppkey AS join_right_column, 'Equal | DWH.S' || s_suppkey || '.A = DWH.NATION.C' || s_suppkey AS join_expression, 'type=inner, cardinality=CN_1, languageColumn=L' || s_suppkey AS formula FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)", "join_left_object join_left_column join_right_column join_expression formula")
def _(c):
    return extract.private_joins(c)


@_register("xml_table_filters", "anv", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'AL' || s_suppkey ELSE 'DWH.S' || s_suppkey END || '.K ' || CASE WHEN s_suppkey % 3 = 0 THEN 'IN' ELSE 'NOT IN' END || ' (''1'', ''' || s_suppkey || ''')' AS filter_expression FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)", "filter_expression")
def _(c):
    return extract.table_filters(c)


@_register("xml_labels", "atv", "SELECT 'ATV_' || p_brand AS current_node, 'P' || p_partkey AS target_column, 'T' || p_size AS source_column FROM part", "current_node target_column source_column")
def _(c):
    return extract.label_bindings(c)


@_register("xml_entity_star", "atv", "SELECT DISTINCT 'ATV_' || p_brand AS current_node, 'DWH.PART' AS source_object, 'DWH.PART.*' AS source_column FROM part", "current_node source_object source_column")
def _(c):
    return extract.entity_stars(c)


@_register("xml_key_mappings", "dim", "SELECT 'DIM_' || s_nationkey AS current_node, 'S' || s_suppkey AS target_column, 'DWH.SUPPLIER' AS source_object, 'C' || s_suppkey AS source_column, CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END AS attribute_key, CAST(s_suppkey AS VARCHAR) AS attribute_order FROM supplier", "current_node target_column source_object source_column attribute_key attribute_order")
def _(c):
    return extract.key_mappings(c)


@_register("xml_dimension_calculations", "dim", "SELECT 'X' || s_suppkey AS target_column, '\"S' || s_suppkey || '\" < 3' AS formula FROM supplier", "target_column formula")
def _(c):
    return extract.dimension_calculations(c)


@_register("xml_semantic_labels", "anv cv", "SELECT 'anv_' || c_nationkey || '.xml' AS path, 'C' || c_custkey AS \"column\", 'Customer ' || c_custkey AS l FROM customer UNION ALL SELECT 'cv_' || n_regionkey || '.xml', 'L' || n_nationkey, n_name FROM nation", "path column l")
def _(c):
    return extract.semantic_labels(c)


@_register("xml_data_sources", "cv", "SELECT 'cv_' || n_regionkey || '.xml' AS path, 'DS' || n_nationkey AS id, 'DATA_BASE_TABLE' AS type, '/u/' || n_nationkey AS uri, 'DWH.' || n_name AS object FROM nation", "path id type uri object")
def _(c):
    return extract.data_sources(c)


def _all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = shred.elements(shred.shred(documents(spark, sf_dir, "anv", "cv", "atv", "dim")))
    return extract.extract(own).groupBy("transformation_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES["xml_all_rows"] = _all_rows


def _bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML isn't XML: every page is set aside with its reason."""
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return shred.bad_documents(shred.shred(pages)).select(F.col("path").cast("long").alias("page_id"))


QUERIES["bad_documents"] = _bad
SQL["bad_documents"] = "SELECT page_id FROM pages"


@_register("xml_labelled_rows", "anv", "SELECT 'ANV_NATION_' || c_nationkey AS current_node, 'C' || c_custkey AS target_column, 'Customer ' || c_custkey AS label FROM customer", "current_node target_column label")
def _(c):
    return extract.with_labels(conform(extract.mappings(c)), c).filter("label LIKE 'Customer %'")


@_register("xml_data_source_rows", "cv", "SELECT 'P' || n_nationkey AS current_node, 'DS' || n_nationkey AS data_source_id, 'DATA_BASE_TABLE' AS data_source_type, 'DWH.' || n_name AS data_source_object, 'external' AS visibility FROM nation", "current_node data_source_id data_source_type data_source_object visibility")
def _(c):
    return extract.with_document_columns(conform(extract.constant_mappings(c)), c).withColumn("visibility", F.col("scenario")["visibility"])


@_register("xml_dimension_rows", "dim", "SELECT 'S' || s_suppkey AS target_column, 'std' AS kind FROM supplier", "target_column kind")
def _(c):
    return extract.with_document_columns(conform(extract.key_mappings(c)), c).withColumn("kind", F.col("dimension")["dimensionType"])
