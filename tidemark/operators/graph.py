"""Bounded walks over a typed edge table (src depends on dst)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.operators.rounds import settled, shared_folder

MAX_DEPTH = 16


def walk(edges: DataFrame, roots: DataFrame, reverse: bool = True, depth: int = MAX_DEPTH) -> DataFrame:
    """(root, node, depth): every node within ``depth`` edges, at its least depth.

    ``roots`` has one column, ``root``. The frontier drops nodes already reached, so rows stay bounded on
    dense graphs; the root itself comes back only if a cycle leads to it, at the cycle's length. What is reached is one
    table in the shared folder, with a folder for each depth, which is also the result.
    """
    spark = edges.sparkSession
    here, there = ("dst", "src") if reverse else ("src", "dst")
    step = settled(edges.select(F.col(here).alias("node"), F.col(there).alias("next")).distinct())
    frontier = roots.select("root", F.col("root").alias("node")).distinct()
    place = f"{shared_folder(spark)}/walks/{uuid.uuid4().hex}"
    shape = StructType([frontier.schema["root"], StructField("node", step.schema["next"].dataType), StructField("depth", IntegerType())])
    reached = None
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        fresh = frontier.join(step, "node").select("root", F.col("next").alias("node")).distinct()
        if reached is not None:
            fresh = fresh.join(reached, ["root", "node"], "left_anti")
        fresh.write.parquet(f"{place}/depth={d}")
        reached = spark.read.schema(shape).parquet(place)
        frontier = reached.where(F.col("depth") == d).select("root", "node")
        if frontier.isEmpty():
            break
    return spark.createDataFrame([], shape) if reached is None else reached
