"""Incremental ingestion and event windows (extensions: the lineage model itself has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract
from ..sources.documents import stream_documents
from ..sources.shred import bad_documents, elements, shred
from ..storage import materialized


def ingest(spark, source: str, lineage: str, rejected: str, checkpoint: str, per_batch: int = 1000) -> StreamingQuery:
    """Follow a folder of documents: each batch's rows go to `lineage`, what can't be read to `rejected`.

    A batch that runs again replaces its own part, so rows are neither lost nor doubled.
    """

    def batch(docs: DataFrame, number: int) -> None:
        shredded = materialized(shred(docs), "shredded")
        for df, path in ((extract(elements(shredded)), lineage), (bad_documents(shredded), rejected)):
            df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream_documents(spark, source, per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Events and their value in each window and type; batch and stream alike, late events up to the watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    found = events.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "events", "total")
