"""Expiry, monitoring, fusion and curation verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import folded


def normalised_event(x: Column) -> Column:
    return folded(x)


def fired(condition: Column, now: Column, events: Column) -> Column:
    """``after("instant")`` and ``on_event("text")``; an event not observed has not happened. Else null."""
    instant = F.regexp_extract(condition, r'^\s*after\(\s*"([^"]*)"\s*\)\s*$', 1)
    awaited = F.regexp_extract(condition, r'^\s*on_event\(\s*"([^"]*)"\s*\)\s*$', 1)
    seen = F.exists(events, lambda e: normalised_event(e) == normalised_event(awaited))
    return F.when(instant != "", now >= F.try_to_timestamp(instant)).when(awaited != "", F.coalesce(seen, F.lit(False)))


def status(holds: Column, expired: Column) -> Column:
    """Breached and holding are decided by the predicate alone; an unknown may have expired."""
    return F.when(~holds, "breached").when(holds, "holding").when(expired, "expired").otherwise("unchanged")


def changes(verdicts: DataFrame) -> DataFrame:
    """Only rows whose status is to be written."""
    return verdicts.where((F.col("new_status") != "unchanged") & (F.col("new_status") != F.col("status")))


def severity(resting: DataFrame, by: str) -> DataFrame:
    """Worst impact among decisions that rest on a node; high impact on a whole organisation is critical."""
    rank = F.when(F.col("impact") == "high", 3).when(F.col("impact") == "medium", 2).otherwise(1)
    g = resting.groupBy(by).agg(F.max(rank).alias("worst"), F.bool_or((F.col("impact") == "high") & (F.col("scope") == "organisation")).alias("all"))
    return g.select(by, F.when(F.col("all"), "critical").when(F.col("worst") == 3, "high").when(F.col("worst") == 2, "medium").otherwise("low").alias("severity"))


def moved(estimate: Column, unclassified: Column, subject: Column, factor: Column, raw: Column, calibrated: Column) -> Column:
    """What calibrating an estimate does to the verdict of an assumption, first reason first."""
    return (
        F.when(estimate.isNull(), "missing_estimate").when(unclassified, "unclassified_work").when(subject.isNull(), "no_subject")
        .when(factor.isNull(), "no_factor").when(raw.isNull() | calibrated.isNull(), "undecided").when(raw == calibrated, "unchanged")
        .when(raw, "flipped").otherwise("relieved")
    )


def finding_changes(proposed: DataFrame, standing: DataFrame, key: list[str], text: str) -> DataFrame:
    """added, revised (text differs) or kept, so that a second pass writes nothing."""
    old = standing.select(*key, F.col(text).alias("_old"), F.lit(True).alias("_known"))
    action = F.when(F.col("_known").isNull(), "added").when(~F.col("_old").eqNullSafe(F.col(text)), "revised").otherwise("kept")
    return proposed.join(old, key, "left").withColumn("action", action).drop("_old", "_known")


def retirements(assumptions: DataFrame, audit: DataFrame, resting: DataFrame, at: Column, idle_days: int = 60) -> DataFrame:
    """Unverified assumptions idle since their first write, with the reason against retiring, if any."""
    first = audit.groupBy("id").agg(F.min("occurred_at").alias("first"), F.bool_or(F.col("actor") == "monitor").alias("watched"))
    used = resting.select("id").distinct().withColumn("used", F.lit(True))
    rows = assumptions.where("status = 'unverified'").join(first, "id").where("not watched").join(used, "id", "left")
    idle = F.floor((F.unix_seconds(at) - F.unix_seconds("first")) / 86400)
    return rows.select("id", F.when(idle < idle_days, "too_recent").when(F.col("used"), "still_in_use").alias("refused"), (idle >= idle_days).alias("idle"))


def merges(shapes: DataFrame, superseded: DataFrame) -> DataFrame:
    """(older, newer): records with the same shape; the latest survives, pairs already superseded are left out."""
    last = Window.partitionBy("shape").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = shapes.withColumn("newer", F.first("id").over(last)).where("id <> newer").select(F.col("id").alias("older"), "newer")
    return rows.join(superseded, ["older", "newer"], "left_anti")
