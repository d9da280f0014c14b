"""What large documents leave in intermediate tables and in a task's memory."""

from pyspark.sql import functions as F

from tracewell.operators import extract
from tracewell.sources import shred

CUBE = '<Cube:cube xmlns:Cube="urn:cube" id="W"><calculatedMeasures>{}</calculatedMeasures><privateDataFoundation><tableProxies><tableProxy centralTable="true"><table schemaName="S" columnObjectName="T"/></tableProxy></tableProxies></privateDataFoundation></Cube:cube>'


def test_output_lists_stay_out_of_intermediate_rows(spark, monkeypatch):
    wide = CUBE.format("".join(f'<measure id="M{i}"><formula>1</formula></measure>' for i in range(2100)))
    docs = spark.createDataFrame([("w", wide.encode())], "path string, content binary")
    written, real = [], extract.materialized
    monkeypatch.setattr(extract, "materialized", lambda df, name, by=None: written.append(real(df, name, by)) or written[-1])
    found = extract.extract(shred.elements(shred.shred(docs)))
    kinds = {r["transformation_type"]: (r["n"], r["listed"]) for r in found.groupBy("transformation_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("node_output_columns") != "<NULL>").cast("int")).alias("listed")).collect()}
    # all outputs are taken from the central table, also those that the list's text leaves out
    assert kinds["Calculated_Measure"] == (2100, 2100) and kinds["Synth_Mapping"][0] == 2100
    assert kinds["Synth_Mapping"][1] == 2100 and kinds["Source_Table"] == (2, 1)
    assert all(df.filter("node_output_columns <> '<NULL>'").isEmpty() for df in written if "node_output_columns" in df.columns)


def test_documents_come_in_slices(spark, monkeypatch):
    monkeypatch.setattr(shred, "_SLICE", 7)
    texts = {"a": "<a><b x='é'>tüt</b><b/></a>", "open": "<a><b>ö", "none": "", "b": "<a>" + "<c/>" * 50 + "</a>"}
    docs = spark.createDataFrame([*((k, v.encode()) for k, v in texts.items()), ("null", None)], "path string, content binary").coalesce(1)
    got = {(r["path"], r["node_id"]): (r["local_name"], r["text"], r["error"]) for r in shred.shred(docs).collect()}
    assert got["a", 1] == ("b", "tüt", None) and got["open", 1] == ("b", "ö", None) and sum(p == "b" for p, _ in got) == 51
    assert {p for p, n in got if n == -1} == {"open", "none", "null"} and got["open", -1][2].startswith("no element found")


def test_a_kind_of_column_record_needs_no_search_of_the_other(spark, sf_dir, monkeypatch):
    from tracewell.operators import graph
    from tracewell.plans import columns
    from tracewell.sources import column_routes, repository

    written = []
    for module in (graph, column_routes, repository):
        monkeypatch.setattr(module, "materialized", lambda df, name, by=None, real=module.materialized: written.append(name) or real(df, name, by))
    docs = columns.documents(spark, sf_dir).limit(2)
    monkeypatch.setattr(columns, "documents", lambda spark, sf_dir: docs)
    n = columns.projections(spark, sf_dir).count()
    assert n and not {"front", "column-edges"} & set(written)
    written.clear()
    assert columns.mappings(spark, sf_dir).count() and not {"routes", "closure"} & set(written)
    assert column_routes.column_records(shred.shred(docs)).filter("record_type = 'PROJECTION'").count() == n


def test_small_documents_are_parsed_once(monkeypatch):
    import io

    from tracewell.sources import shred

    def never(document):
        raise AssertionError("checked apart")

    monkeypatch.setattr(shred, "_flaw", never)
    read = lambda data: [r for some in shred._rows_of("p", io.BytesIO(data), frozenset()) for r in some]
    assert [(r[5], r[7], r[13]) for r in read(b"<a><b>x</b></a>")] == [("b", "x", None), ("a", "", None)]
    assert [(r[5], r[7]) for r in read(b"<a><b>x</a>")] == [(None, None), ("b", "x"), ("a", "")]
    assert "mismatched tag" in read(b"<a><b>x</a>")[0][13] and read(b"")[0][13] and len(read(b"")) == 1
