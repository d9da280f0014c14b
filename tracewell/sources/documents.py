"""Documents of metadata: discovery, order and incremental reading (SRC1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILES = "path string, modificationTime timestamp, length long, content binary"
_NAME = r"(?i)\.(xml|txt)$"


def _only_documents(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").rlike(_NAME)).select("path", "content")


def read_documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, content) of the .xml and .txt files at `path`, a file or a folder."""
    return _only_documents(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path))


def stream_documents(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """The same as a stream of new files."""
    return _only_documents(spark.readStream.schema(_FILES).format("binaryFile").option("maxFilesPerTrigger", per_batch).load(path))


def in_file_order(files: DataFrame, numbered: bool = True) -> DataFrame:
    """By a number that begins the file's name, then by name; names without a number last (SRT1)."""
    name = F.element_at(F.split("path", "/"), -1)
    number = F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit("")).cast("decimal(38,0)")
    return files.orderBy(*([number.asc_nulls_last()] if numbered else []), name)
