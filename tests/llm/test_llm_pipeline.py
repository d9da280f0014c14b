"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline as pipeline
from tracewell.llm import common


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, kept = docs.columns, docs.count()
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf_dir, "labels").collect()}
    for name, stage in pipeline.STAGES:
        out = common.saved(stage(spark, docs, sf_dir), "stage")
        if name == pipeline.STAGES[-1][0]:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            break
        assert out.columns == columns and out.count() <= kept
        if name == "quality classifier":
            good = {i for i, q in labels.items() if q == 1}
            assert len(good & {r["doc_id"] for r in out.collect()}) >= 0.98 * len(good)
        docs, kept = out, out.count()
    texts = [r["text"] for r in docs.collect()]
    assert len({" ".join(t.split()) for t in texts}) == len(texts)


def test_run_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words here", None, None, 16), (3, "plain words here", None, None, 16), (None, "plain words here", "en", None, 16)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "a" / "labels.parquet"))
    got = sorted(r["doc_id"] for r in pipeline.run(spark, str(tmp_path / "a")).collect())
    assert got == [1, 3]  # one row of each text, whatever the doc_ids
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "b" / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path / "b")).count() == 0
