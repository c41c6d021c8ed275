"""Cutting lineage between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of its own if all runs in one process, else an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp())
    return (named or sc.getCheckpointDir()).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows, held in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder: they take less room than ``settled`` ones, and each column can be read alone."""
    place = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A table that is to be broadcast if it has so few rows, by count, and else is joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
