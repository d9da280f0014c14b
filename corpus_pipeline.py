"""A corpus pipeline of five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`, by their own names; other columns are carried along.

Defined cases: null and empty texts are one text and are scored, kept once and packed as the end id; of rows that repeat a
doc_id or have none, each counts by its own text, one row of each text or group of near copies stays, and substring dedup leaves
rows without a doc_id as they are; ties go to the smallest doc_id; texts of any length are read whole; without labels the
classifier accepts everything; empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import common


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of two thirds of the documents. Equal texts fare alike."""
    from tracewell.llm import labelled, quality

    common.tune(spark)
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), labelled.remainder("doc_id", 3) != 1)
    return docs.filter(quality.scorer(model)(F.col("text")) >= 0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) one row: that with the smallest doc_id, one without only if none has any."""
    from tracewell.llm import exact_dedup

    common.tune(spark)
    return exact_dedup.keep_first(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id; rows without words stay."""
    from tracewell.llm import ngram_join

    common.tune(spark)
    return ngram_join.keep_one_of_each(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that another document keeps; those left without words go; n_chars follows the text."""
    from tracewell.llm import substring_dedup

    common.tune(spark)
    left = substring_dedup.without_repeats(spark, docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    import public_tokenizers as vocabularies

    from tracewell.llm import packing

    common.tune(spark)
    return packing.best_fit_packing(spark, docs, vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, 2048, 0)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packing),
]

#: The classifier's scores have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with common.step(spark):  # what a stage has left goes once its result is written
            docs = common.saved(stage(spark, docs, sf_dir), "stage", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
