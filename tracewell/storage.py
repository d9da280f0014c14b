"""Where intermediate tables live: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder that becomes it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialized(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """`df` as a table in the shared folder: its lineage ends there, and a lost executor costs only its tasks.

    With `by`, the table has a folder for each value of that column, so that a filter on it reads no others.
    """
    path = f"{shared_dir(df.sparkSession)}/tracewell/{name}-{uuid.uuid4().hex}"
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    try:
        conf.set(name, str(max(int(before), 8)) if by else before)  # few values need no sort
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that a task should hold at most when the table is shuffled.
ROWS_OF_A_TASK = 500_000


@contextmanager
def spread(table: DataFrame, rows: int = ROWS_OF_A_TASK):
    """Tables that are made within are shuffled into as many parts as the rows of a materialized table need, if these are more than the session's."""
    conf, name = table.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    try:
        conf.set(name, str(max(int(before), -(-table.count() // rows))))
        yield
    finally:
        conf.set(name, before)
