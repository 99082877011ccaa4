"""The driver's tables in the shape of the retail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with dates but no time of day: orders, their customers' nations as stores."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey, "left").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("user_id"), F.col("c_nationkey").alias("store_id"),
        F.col("o_totalprice").alias("final_amount"), F.col("o_orderdate").alias("created_at"),
    )


def event_transactions(events: DataFrame) -> DataFrame:
    """Transactions with a time of day."""
    return events.select(
        F.col("event_id").alias("transaction_id"), F.col("event_type").alias("store_id"), "user_id", F.col("value").alias("final_amount"), F.col("ts").alias("created_at")
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with many stores per user: order lines, their suppliers as stores."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("store_id"), F.col("o_orderdate").alias("created_at")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").alias("subtotal"), F.col("l_shipdate").alias("created_at"),
    )


def menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"), F.col("p_type").alias("coffee_category"),
        F.col("p_retailprice").alias("price"), F.lit("False").alias("is_seasonal"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("store_id"), F.col("n_name").alias("store_name"), F.col("n_regionkey").alias("city"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("gender"), F.col("c_name").alias("birthdate"), F.col("c_acctbal").alias("registered_at")
    )
