"""Shared plumbing: tables in the cluster's shared folder and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where it is unset and all runs in one process, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A name of its own in the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a ``materialize`` result that no later plan reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def finish(df: DataFrame, *used: DataFrame) -> DataFrame:
    """``df`` as a table of its own, after which the tables it was made from go."""
    out = materialize(df)
    for table in used:
        discard(table)
    return out


def small(table: DataFrame, rows: int = 50_000) -> DataFrame:
    """A table that is to be broadcast if it has so few rows, by count, and else is joined as Spark sees fit."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Hubs only meet in partial
    aggregates and in equi-joins that adaptive execution may split, so no node's neighbours are
    gathered. Edges with a null end, and loops, are ignored; repeated edges count once.
    A graph that has not settled after ``max_rounds`` rounds is an error. The result stands on a table, which ``discard`` takes.
    """
    now = materialize(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    mark = None
    for done in range(max_rounds + 1):
        stat = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if stat["n"] == 0 or (stat["n"], stat["x"]) == mark:
            break
        if done == max_rounds:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
        mark = (stat["n"], stat["x"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .distinct()
        )
        nxt = materialize(small)
        discard(now)
        now = nxt
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    out._tidemark_path = now._tidemark_path
    return out
