"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(value: Column) -> Column:
    """Rounded to four places, half up, in the same way as R4 does in SQL."""
    return F.floor(value * 1e4 + 0.5) / 1e4


def R4(sql: str) -> str:  # noqa: N802
    return f"floor(({sql}) * 1e4 + 0.5) / 1e4"


# Sales, the alternatives they choose from, and what is known of these.
SALES_SQL = "(SELECT o_orderkey AS obs_id, c_nationkey AS alt_id, CAST(o_orderdate AS DATE) AS purchase_date, o_totalprice AS price, c_mktsegment AS agency, o_orderpriority AS category FROM orders JOIN customer ON o_custkey = c_custkey)"


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("obs_id"), F.col("c_nationkey").alias("alt_id"), F.col("o_orderdate").cast("date").alias("purchase_date"),
        F.col("o_totalprice").alias("price"), F.col("c_mktsegment").alias("agency"), F.col("o_orderpriority").alias("category"),
    )


ALTERNATIVES_SQL = """(SELECT n_nationkey AS alt_id, n_name AS name_detail, CASE WHEN n_nationkey % 2 = 0 THEN 'LIBRE' ELSE 'RESTRINGIDO' END AS access,
 CAST((n_nationkey * 7919) % 9973 AS DOUBLE) AS x, CAST((n_nationkey * 6271) % 9781 AS DOUBLE) AS y,
 coalesce(c.balance, 0) AS balance, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers
 FROM nation LEFT JOIN (SELECT c_nationkey, floor(avg(c_acctbal) * 1e4 + 0.5) / 1e4 AS balance, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
 LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey)"""


def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(r4(F.avg("c_acctbal")).alias("balance"), F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    key = F.col("n_nationkey")
    joined = nation.join(c, key == F.col("c_nationkey"), "left").join(s, key == F.col("s_nationkey"), "left")
    return joined.select(
        key.alias("alt_id"), F.col("n_name").alias("name_detail"), F.when(key % 2 == 0, "LIBRE").otherwise("RESTRINGIDO").alias("access"),
        ((key * 7919) % 9973).cast("double").alias("x"), ((key * 6271) % 9781).cast("double").alias("y"),
        F.coalesce("balance", F.lit(0.0)).alias("balance"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"),
    )
