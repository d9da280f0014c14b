"""Shared plumbing of the training-data operators: tables, scratch space, Arrow batches, mixing functions."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in one Arrow batch. Texts may be long, so batches are kept small; operators slice them further by bytes.
BATCH_ROWS = 256

#: Bytes of text that a numpy pass works on at once; its temporaries take some 60 bytes for each.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI: spark.checkpoint.dir, or where that is unset a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
        found = spark.sparkContext.getCheckpointDir()
    return qualified(spark, found)


def _hadoop(spark: SparkSession, path: str):
    """Spark's own view of a path: the store and the place."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority that Spark takes it to have, for workers that know no default store."""
    store, place = _hadoop(spark, path)
    return re.sub(r"^file:/+", "file:///", store.makeQualified(place).toString()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}"


#: Bytes that a table's writer gathers before it writes them as a row group.
GROUP_BYTES = 2 << 20


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path that executors' Python can reach, and the path there."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


_steps = threading.local()


@contextlib.contextmanager
def step(spark: SparkSession):
    """Tables that `mapped` and `saved` make inside go when the block ends, but for those made with keep=True.

    What is kept belongs to the step around this one (keep=2: the one around that), or else stays in the shared folder, as
    results are read from it. At
    the end the driver's JVM is asked once to collect its garbage, since Spark removes the shuffle files of finished jobs only then.
    """
    made: list[str] = []
    stack = _steps.__dict__.setdefault("stack", [])
    stack.append(made)
    try:
        yield
    finally:
        stack.pop()
        for path in made:
            store, place = _hadoop(spark, path)
            store.delete(place, True)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _own(path: str, keep: int) -> None:
    stack = _steps.__dict__.get("stack", [])
    if len(stack) > keep:
        stack[-1 - keep].append(path)


def mapped(df: DataFrame, f, ddl: str | StructType, name: str, keep: int = False) -> DataFrame:
    """What `f` makes of the Arrow batches of `df`, as a table in the shared folder.

    Workers write their part themselves, under a name of the attempt that is then moved to that of the partition, so that
    tasks can be lost or run twice. For a store that pyarrow has no way to, Spark writes.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    _own(path, keep)
    schema = StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    try:
        store, place = filesystem(path)
        store.create_dir(place, recursive=True)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        df.mapInArrow(f, schema).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    def write(batches):
        own, at = filesystem(path)
        part, held, size, rows, writer = TaskContext.get().partitionId(), [], 0, 0, None
        attempt = f"{at}/_{part:06d}-{uuid.uuid4().hex}"

        def flush():
            nonlocal writer, size
            table_ = pa.Table.from_batches(held)
            writer = writer or pq.ParquetWriter(own.open_output_stream(attempt), table_.schema, compression="snappy")
            writer.write_table(table_)
            held.clear()
            size = 0

        for batch in f(batches):
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                rows += batch.num_rows
                if size >= GROUP_BYTES:
                    flush()
        if held:
            flush()
        if writer:
            writer.close()
            own.move(attempt, f"{at}/part-{part:06d}.parquet")
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    df.mapInArrow(write, "rows long").agg(F.sum("rows")).collect()
    return spark.read.schema(schema).parquet(path)


def saved(df: DataFrame, name: str, keep: int = False) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there, and lost executors cost only their tasks."""
    return mapped(df, lambda batches: batches, df.schema, name, keep)


def lean(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator works on, by their own names, whatever else the input carries."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def chosen_rows(docs: DataFrame, decided: DataFrame, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, given (doc_id, kept) of every row.

    Where a doc_id is null or repeats it can't tell rows apart: `choose` decides over those rows themselves.
    """
    with step(docs.sparkSession):
        per = decided.groupBy("doc_id").agg((F.col("doc_id").isNull() | (F.count(F.lit(1)) > 1)).alias("__odd"), F.bool_or("kept").alias("kept"))
        per = saved(per.filter("__odd OR NOT kept").select(F.col("doc_id").alias("__id"), "__odd"), "decisions", keep=True)
    named = docs.filter(F.col("doc_id").isNotNull())
    plain = named.join(per.hint("shuffle_hash"), F.col("doc_id") == F.col("__id"), "left_anti")
    if per.filter("__odd").isEmpty():
        return plain
    odd = named.join(per.filter("__odd").hint("shuffle_hash"), F.col("doc_id") == F.col("__id"), "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
    return plain.unionByName(choose(odd).select(*docs.columns))


def text_slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES):
    """Yield (first row, rows, bytes as uint8, offsets as int64) of slices of a string column, null counting as empty."""
    column = batch.column(batch.schema.get_field_index(text))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        a, b = int(offsets[first]), int(offsets[last])
        yield first, last - first, raw[a:b], offsets[first : last + 1] - a
        first = last
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that sums and polynomials spread over all bits."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64).copy()
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Return freed memory to the system: a worker is kept for later tasks, which may need other things."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def quiet_threads() -> None:
    """One core for each Python worker: native libraries start no pools of their own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
