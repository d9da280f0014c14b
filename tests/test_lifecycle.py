"""Whole runs over a folder of views and over job records."""

from tracewell.operators import graph, rows
from tracewell.plans import fixtures, lifecycle, roundtrip
from tracewell.sources.records import conform


def test_folder_of_views(spark, sf_dir, tmp_path):
    for r in roundtrip.documents(spark, sf_dir, "anv", "dim").limit(6).collect():
        (tmp_path / r["path"]).write_bytes(bytes(r["content"]))
    (tmp_path / "bad.xml").write_text("<a>")
    found, bad = lifecycle.read_views(spark, str(tmp_path))
    assert bad.count() == 1 and found.count() > 0
    columns, deps = fixtures.build(spark, sf_dir, fixtures.CATALOG_COLUMNS), fixtures.build(spark, sf_dir, fixtures.DEPENDENCIES)
    out = lifecycle.analyse(found, columns, deps)
    assert out.filter("weight_filter IS NOT NULL AND lld_score IS NOT NULL").count() > 0
    assert out.columns == found.columns
    assert rows.first_of_each(out).count() == out.count()


def test_job_picture(spark, sf_dir):
    got = lifecycle.trace_job(conform(fixtures.build(spark, sf_dir, fixtures.JOBS)), "JOB_R")
    hops = got["hop_map"]
    assert hops.filter("hop = 0").count() == 5 and got["edges"].filter("source LIKE 'SQL:%'").count() > 0
    assert got["summary"].count() == 5 and got["rows"].count() > 0 and got["terminal_sources"].count() > 0


def test_barycentres_settle(spark):
    e = spark.createDataFrame([("t", "a"), ("t", "b")], "target string, source string")
    p = spark.createDataFrame([("t", 9), ("a", 0), ("b", 2)], "node string, position int")
    assert dict(graph.barycentres(e, p, 1).collect()) == {"t": 1.0, "a": 0.0, "b": 2.0}


def test_key_relations(spark):
    kinds = "join_left_column string, join_right_column string"
    df = spark.createDataFrame([("customerAmount", "order_total"), ("customerAmount", "order_total"), ("<NULL>", "order_total"), ("customerAmount", ""), (None, None)], kinds)
    assert [tuple(r) for r in rows.key_relations(df).collect()] == [("Customer Amount", "Order Total")]
