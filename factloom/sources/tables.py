"""Access to the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with the values a record can be built from.

    The order's first line is a partial-aggregated minimum of a struct, so a hot order key
    is reduced before the shuffle.  Orders without lines keep null product and organization, and
    take no part in the joins with those.
    Join sides carry no broadcast hint: Spark broadcasts by measured size.
    """
    orders = table(spark, folder, "orders")
    first_line = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("line"))
        .select("l_orderkey", F.col("line.l_partkey").alias("partkey"), F.col("line.l_suppkey").alias("suppkey"))
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    line = (
        first_line.join(part, F.col("partkey") == F.col("p_partkey"), "left")
        .join(supplier, F.col("suppkey") == F.col("s_suppkey"), "left")
        .select("l_orderkey", "p_name", "s_name")
    )
    return (
        orders.select("o_orderkey", "o_custkey", "o_orderdate")
        .join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("o_orderkey").alias("example_id"),
            F.col("s_name").alias("organization"),
            F.col("c_name").alias("person"),
            F.col("p_name").alias("product"),
            F.col("n_name").alias("location"),
            F.to_date("o_orderdate").alias("day"),
        )
    )
