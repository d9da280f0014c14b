"""Documents: discovery, order, broken ones, repository exports, sinks and the stream."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import extract
from tracewell.plans import fixtures, roundtrip
from tracewell.sinks import files
from tracewell.sources import catalog, documents, repository, shred
from tracewell.streaming.ingest import ingest


def docs(spark, **texts):
    return spark.createDataFrame([(k, v.encode()) for k, v in texts.items()], "path string, content binary")


def test_broken_and_unknown_documents(spark):
    s = shred.shred(docs(spark, bad="<a><b></a>", other="<x/>", empty="", good='<d:dimension xmlns:d="u" id="D"/>'))
    assert sorted(r["path"] for r in shred.bad_documents(s).collect()) == ["bad", "empty", "other"]
    assert [r["profile"] for r in shred.elements(s).collect()] == ["DIM"]
    assert shred.shred(docs(spark, x="<x/>").limit(0)).count() == 0


def test_elements_keep_order_text_and_place(spark):
    s = shred.shred(docs(spark, a="<r><!-- c --><x k='1'>t<y/>u</x><x/><filter>in <b>ner</b></filter></r>")).orderBy("node_id").collect()
    assert [(r["local_name"], r["xpath"], r["depth"], r["ordinal"]) for r in s][1:4] == [("x", "/r[1]/x[1]", 1, 0), ("y", "/r[1]/x[1]/y[1]", 2, 0), ("x", "/r[1]/x[2]", 1, 1)]
    assert s[1]["text"] == "t" and s[1]["attrs"] == {"k": "1"} and s[4]["inner_text"] == "in ner"


def test_discovery_and_order(spark, tmp_path):
    for name in ("10_b.xml", "9_a.XML", "z.txt", "no.csv"):
        (tmp_path / name).write_text("<x/>")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "1.xml").write_text("<x/>")
    names = [r["path"].rsplit("/", 1)[-1] for r in documents.in_file_order(documents.read_documents(spark, str(tmp_path))).collect()]
    assert names == ["9_a.XML", "10_b.xml", "z.txt"]
    assert documents.read_documents(spark, str(tmp_path), True).count() == 4


def test_catalog_csv(spark, tmp_path):
    (tmp_path / "v.csv").write_text("SCHEMA_NAME,VIEW_NAME,COLUMN_NAME,POSITION,DATA_TYPE_NAME,LENGTH,SCALE,IS_NULLABLE\nS,V,B,2,INT,1,0,TRUE\nS,V,A,1,INT,1,0,TRUE\n")
    got = catalog.view_columns(spark, str(tmp_path / "v.csv"))
    assert sorted((r["position"], r["column_name"]) for r in got.collect()) == [(1, "A"), (2, "B")]


def test_repository_records(spark):
    xml = """<Repo><DIJob name="J"><DIWorkflow name="W"><DIDataflow name="D"><DIDatabaseTableSource ownerName="S" tableName="A"/><DIFileSource fileName="f.csv"/>
    <DITransformCall name="Q"><sql_text>SELECT * FROM X.T1 join "T2" ON 1 = 1</sql_text></DITransformCall><DIDatabaseTableTarget ownerName="S" tableName="B"/></DIDataflow></DIWorkflow></DIJob></Repo>"""
    rows = repository.records(shred.shred(docs(spark, r=xml))).collect()
    got = {(r["record_type"], r["source_object"], r["target_object"]) for r in rows}
    assert got == {("COLUMN_MAPPING", "S.A", "S.B"), ("COLUMN_MAPPING", "FILE:f.csv", "S.B"), ("SQL_TRANSFORM", "SQL:D|Q", "S.B"), ("SQL_TRANSFORM", "X.T1", "SQL:D|Q"), ("SQL_TRANSFORM", "T2", "SQL:D|Q")}
    assert {(r["job_name"], r["workflow_name"], r["dataflow_name"]) for r in rows if r["target_object"] == "S.B"} == {("J", "W", "D")}
    flat = """<Repo><DIJob name="J"><DIWorkflowCall name="W"/></DIJob><DIWorkflow name="W"><DIDataflowCall name="D"/></DIWorkflow><DIDataflow name="D"><DIExcelSource name="x"/><DIDatabaseTableTarget tableName="B"/></DIDataflow></Repo>"""
    (r,) = repository.records(shred.shred(docs(spark, r=flat))).collect()
    assert (r["source_object"], r["job_name"], r["workflow_name"]) == ("EXCEL:x", "J", "W")


def test_dumps_give_missing_texts_and_malformed_lines_are_kept_aside(spark, tmp_path):
    xml = '<R><DIDataflow name="D"><DITransformCall name="Q"><sql_text/></DITransformCall><DIDatabaseTableTarget tableName="B"/></DIDataflow></R>'
    dump = '<R><DIDataflow name="D"><DITransformCall name="Q"><sql_text>SELECT 1 FROM T9</sql_text></DITransformCall></DIDataflow></R>'
    index = repository.dump_index(shred.shred(docs(spark, d=dump)))
    got = {(r["source_object"], r["target_object"]) for r in repository.records(shred.shred(docs(spark, r=xml)), index).collect()}
    assert got == {("SQL:D|Q", "B"), ("T9", "SQL:D|Q")} and repository.records(shred.shred(docs(spark, r=xml))).count() == 0
    lines = ["SCHEMA_NAME,VIEW_NAME,COLUMN_NAME,POSITION,DATA_TYPE_NAME,LENGTH,SCALE,IS_NULLABLE", "S,V,C,1,INT,1,0,N", "S,V,D,second,INT,1,0,N", "S,V"]
    (tmp_path / "c.csv").write_text("\n".join(lines))
    assert [tuple(r) for r in catalog.view_columns(spark, str(tmp_path)).collect()] == [("S", "V", "C", 1)]
    assert {r["line"] for r in catalog.malformed(spark, str(tmp_path), catalog.VIEW_COLUMNS).collect()} == set(lines[2:])
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.csv").write_text("a,b\n1,2\n3\n")
    assert [tuple(r) for r in catalog.cached_rows(spark, str(tmp_path / "e")).collect()] == [("1", "2")] and catalog.malformed(spark, str(tmp_path / "e")).count() == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "d.csv").write_text("a,b,c,d,e,f,g\nBS,BO,TABLE,DS,DO,VIEW,1\n")
    assert [tuple(r) for r in catalog.dependencies(spark, str(tmp_path / "d")).collect()] == [("DS", "DO", "BS", "BO", "TABLE", "1", "BS.BO")]


def test_broken_documents_give_what_can_be_recovered(spark):
    broken = {
        "open": "<a x='1'><b>one</b><c>two", "crossed": "<a><b><c>x</b></c><d/></a>", "amp": "<a><b t='p&q'>r & s &lt; &nope; &#233;</b></a>", "stray": "</z><a><b>1 < 2</b></a>", "cdata": "<a><b><![CDATA[<i>&]]></b><!-- x", "none": "just text", "empty": "",
    }
    got = shred.shred(docs(spark, **broken)).collect()
    assert {r["path"] for r in got if r["error"]} == set(broken)
    found = {p: [(r["xpath"], dict(r["attrs"]), r["text"]) for r in sorted(got, key=lambda r: r["node_id"]) if r["path"] == p and not r["error"]] for p in broken}
    assert found["open"] == [("/a[1]", {"x": "1"}, ""), ("/a[1]/b[1]", {}, "one"), ("/a[1]/c[1]", {}, "two")]
    assert [x for x, _, _ in found["crossed"]] == ["/a[1]", "/a[1]/b[1]", "/a[1]/b[1]/c[1]", "/a[1]/d[1]"]
    assert found["amp"][1] == ("/a[1]/b[1]", {"t": "p&q"}, "r & s < &nope; é") and found["stray"][1][2] == "1 < 2" and found["cdata"][1][2] == "<i>&"
    assert found["none"] == [] == found["empty"]
    fine = "<a p:q='1'><b>t</b>u<c/></a>"
    whole, own = (list(s) for s in ([], []))
    s = shred.Shredder("x", frozenset())
    s.parser.Parse(fine.encode(), True)
    whole = s.take()
    s = shred.Shredder("x", frozenset())
    for _ in shred.recover(s, fine.encode()):
        own += s.take()
    assert own == whole


def test_sinks(spark, sf_dir, tmp_path):
    df = fixtures.build(spark, sf_dir, fixtures.LINEAGE)
    assert files.choose_format(10, "XLSX") == "xlsx" and files.choose_format(10**7, "xlsx") == "parquet" and files.choose_format(10**7, "csv") == "csv"
    assert files.handoff(df.limit(0), str(tmp_path / "h")) is None
    files.handoff(df, str(tmp_path / "h"))
    back = spark.read.parquet(str(tmp_path / "h"))
    assert back.count() == df.count() and {t for _, t in back.dtypes} == {"string"}
    files.lineage_workbook(df, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w" / "LINEAGE_RAW"), header=True).count() == df.count()
    assert files.lint_report(df, str(tmp_path / "lint")) and spark.read.csv(str(tmp_path / "lint"), header=True).count() > 0
    files.concepts(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c" / "concepts")).count() > 0
    jobs = fixtures.build(spark, sf_dir, fixtures.JOBS)
    files.results(jobs, str(tmp_path / "r"))
    files.column_file(jobs, str(tmp_path / "cf"))
    assert len(spark.read.csv(str(tmp_path / "cf"), header=True).columns) == 9


@pytest.mark.slow
def test_stream_of_documents(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, r in enumerate(roundtrip.documents(spark, sf_dir, "atv").limit(3).collect()):
        (source / f"{i}.xml").write_bytes(bytes(r["content"]))
    (source / "bad.xml").write_text("<a>")
    ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("transformation_type") == "Label_Binding").count() > 0
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_extract_of_nothing(spark):
    none = shred.elements(shred.shred(docs(spark, x="<x/>")))
    assert extract.mappings(extract.scalars_of(none)).count() == 0
