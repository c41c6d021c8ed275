"""The driver's tables as records of estimates, outcomes, versions, links, traces and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import work_class


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimates(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """An order is an estimate; its customer's segment (or, fine, the customer) owns it."""
    orders = table(spark, sf_dir, "orders")
    if fine:
        owned = orders.withColumn("owner", F.col("o_custkey").cast("string"))
    else:
        owned = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("owner", F.col("c_mktsegment"))
    return owned.select(
        F.col("o_orderkey").alias("estimate_id"), "owner", work_class(F.col("o_orderpriority")).alias("work_class"),
        F.col("o_totalprice").alias("estimated"), F.col("o_orderdate").alias("estimated_at"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order's lines came to; an order without lines is unresolved."""
    cents = F.expr("cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) * (1 + cast(l_tax as decimal(4,2)))")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("estimate_id")).agg(F.sum(cents).cast("double").alias("actual"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("estimate_id")).join(lines, "estimate_id", "left")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a record; its events are the record's versions; an error retracts."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), n.alias("version"), (F.col("event_type") == "error").alias("retracted"), "event_id", F.col("value").alias("payload")
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is one call: the type is the agent, the user is the run."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("agent"), F.col("user_id").alias("run_id"),
        F.col("value").cast("decimal(18,4)").alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), "ts",
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges, dependent to depended-upon, over orders, customers, nations and regions."""

    def edge(name: str, kind: str, a: str, x: str, b: str, y: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("link_type")
        )

    return (
        edge("orders", "assumes", "O-", "o_orderkey", "C-", "o_custkey")
        .unionByName(edge("customer", "justified_by", "C-", "c_custkey", "N-", "c_nationkey"))
        .unionByName(edge("supplier", "justified_by", "S-", "s_suppkey", "N-", "s_nationkey"))
        .unionByName(edge("nation", "estimated_as", "N-", "n_nationkey", "R-", "n_regionkey"))
    )
