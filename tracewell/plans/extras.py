"""Queries of the executable ETL constructs, event windows and catalog-wide checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import etl
from ..streaming.ingest import event_windows
from .catalogue import QUERIES, SQL


def _put(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_put("etl_table_comparison", """WITH n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0), o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(n.k, o.k) AS k, coalesce(n.s, o.s) AS s, CASE WHEN o.k IS NULL THEN 'INSERT' WHEN n.k IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS change FROM n FULL JOIN o ON n.k = o.k WHERE o.k IS NULL OR n.k IS NULL OR n.s <> o.s""")  # fmt: skip
def _(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    new = orders.filter("k % 7 <> 0").withColumn("s", F.when(F.col("k") % 10 == 0, "X").otherwise(F.col("s")))
    return etl.table_comparison(new, orders.filter("k % 5 <> 0"), ["k"], ["s"])


@_put("etl_history", "SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS valid_to, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NULL AS is_current FROM orders")
def _(spark, sf_dir):
    return etl.history(_read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", F.coalesce("valid_to", F.lit(-1).cast("long")).alias("valid_to"), "is_current")


@_put("etl_surrogate_keys", "SELECT o_orderkey, 99 + row_number() OVER (ORDER BY o_orderkey) AS surrogate_key FROM orders")
def _(spark, sf_dir):
    return etl.surrogate_keys(_read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 100)


@_put("etl_case_routing", "SELECT CASE WHEN o_totalprice > 100000 THEN 'LARGE' WHEN o_orderstatus = 'F' THEN 'FINAL' ELSE 'DEFAULT' END AS route, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return etl.routed(_read(spark, sf_dir, "orders"), {"LARGE": F.col("o_totalprice") > 100000, "FINAL": F.col("o_orderstatus") == "F"}).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@_put("etl_pivot", "SELECT l_linestatus, sum(l_linenumber) FILTER (l_returnflag = 'A')::BIGINT AS \"A\", sum(l_linenumber) FILTER (l_returnflag = 'N')::BIGINT AS \"N\", sum(l_linenumber) FILTER (l_returnflag = 'R')::BIGINT AS \"R\" FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return etl.pivoted(_read(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_returnflag", "l_linenumber", ["A", "N", "R"])


@_put("etl_reverse_pivot", "SELECT p_partkey, 'p_brand' AS name, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part")
def _(spark, sf_dir):
    return etl.unpivoted(_read(spark, sf_dir, "part"), ["p_partkey"], ["p_brand", "p_type"])


@_put("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    return event_windows(_read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
