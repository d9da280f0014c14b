"""Executable counterparts of the constructs that job lineage describes (ETL9-19; extensions, in plain DataFrame terms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialized


def table_comparison(new: DataFrame, old: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Keys and compared columns with `change`: INSERT, UPDATE or DELETE; unchanged rows go (ETL15). Nulls equal nulls."""
    a, b = new.select(*keys, F.struct(*compared).alias("n")), old.select(*keys, F.struct(*compared).alias("o"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("o").isNull(), "INSERT").when(F.col("n").isNull(), "DELETE").when(~F.col("n").eqNullSafe(F.col("o")), "UPDATE")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in compared], "change")


def history(changes: DataFrame, keys: list[str], since: str) -> DataFrame:
    """valid_from, valid_to (exclusive, null while current) and is_current of every version of a key (ETL17)."""
    w = W.partitionBy(*keys).orderBy(since)
    out = changes.withColumn("valid_from", F.col(since)).withColumn("valid_to", F.lead(since).over(w))
    return out.withColumn("is_current", F.col("valid_to").isNull())


def surrogate_keys(df: DataFrame, order: list[str], start: int = 1, name: str = "surrogate_key") -> DataFrame:
    """Consecutive keys in an order, without one task for all rows: ranges of the order, counted, then numbered (ETL18)."""
    parts = materialized(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__p", (F.sum("n").over(W.orderBy("__p")) - F.col("n")).alias("before"))  # a row for each range
    local = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    return parts.withColumn("__l", local).join(before, "__p").withColumn(name, F.col("before") + F.col("__l") + F.lit(start - 1)).drop("__p", "__l", "before")


def routed(df: DataFrame, routes: dict[str, Column], default: str = "DEFAULT") -> DataFrame:
    """`route`: the first condition that holds (ETL19)."""
    out = None
    for name, condition in routes.items():
        out = (F if out is None else out).when(condition, name)
    return df.withColumn("route", F.lit(default) if out is None else out.otherwise(default))


def pivoted(df: DataFrame, keys: list[str], by: str, value: str, names: list, how=F.sum) -> DataFrame:
    """One column for each named value of `by` (ETL16)."""
    return df.groupBy(*keys).pivot(by, names).agg(how(value))


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row for each of the columns (ETL16)."""
    return df.unpivot(keys, columns, name, value)
