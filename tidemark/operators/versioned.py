"""Versioned, append-only relations: heads, current records, validation and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.running import running


def head(versions: DataFrame, key: str = "id") -> DataFrame:
    """The newest version of each record, whole, by one aggregate and no self-join."""
    rest = [c for c in versions.columns if c not in (key, "version")]
    best = versions.groupBy(key).agg(F.max_by(F.struct("version", *rest), "version").alias("r"))
    return best.select(key, "r.*")


def standing(versions: DataFrame, key: str = "id") -> DataFrame:
    """Current records that are not retracted."""
    return head(versions, key).where(~F.col("retracted"))


def version_gaps(versions: DataFrame, key: str = "id") -> DataFrame:
    """Rows that break 1, 2, 3, ...; an append-only ledger has none."""
    before = F.coalesce(F.lag("version").over(Window.partitionBy(key).orderBy("version")), F.lit(0))
    return versions.withColumn("before", before).where(F.col("version") != F.col("before") + 1)


def revisions(proposed: DataFrame, versions: DataFrame, key: str = "id") -> DataFrame:
    """Optimistic concurrency: a proposal against the head becomes the next version, any other is a conflict."""
    now = head(versions, key).select(key, F.col("version").alias("head"))
    ok = F.col("version") == F.col("head")
    return proposed.join(now, key, "left").select(key, "version", "head", F.when(ok, F.col("head") + 1).alias("written"), (~F.coalesce(ok, F.lit(False))).alias("conflict"))


def next_ids(news: DataFrame, taken: DataFrame, kind: str, order: str) -> DataFrame:
    """Sequential ordinals after the largest of each kind, in a fixed order, however many a kind has."""
    top = taken.groupBy(kind).agg(F.max("ordinal").alias("top"))
    ranked = running(news.where(F.col(kind).isNotNull()).withColumn("_one", F.lit(1)), [kind], [order], {"rank": "_one"})
    return ranked.join(top, kind, "left").withColumn("ordinal", F.coalesce("top", F.lit(0)) + F.col("rank")).drop("rank", "top", "_one")


def counts_with_zeros(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Count by value with every value of a closed list present."""
    listed = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))
    return listed.join(df.groupBy(column).agg(F.count("*").alias("c")), column, "left").select(column, F.coalesce("c", F.lit(0)).alias("n"))


def page(df: DataFrame, cursor: str, before: int | None, size: int | None = 50) -> DataFrame:
    """A keyset page, newest first; sizes are clamped to 1..500."""
    wanted = min(500, max(1, 50 if size is None else size))
    rows = df if before is None else df.where(F.col(cursor) < before)
    return rows.orderBy(F.desc(cursor)).limit(wanted)


def retract(versions: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The next version of each listed standing record, flagged as retracted, its payload carried forward."""
    return standing(versions, key).join(ids.select(key).distinct(), key, "left_semi").withColumns({"version": F.col("version") + 1, "retracted": F.lit(True)})
