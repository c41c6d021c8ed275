"""Evaluation: overlap matching, precision, recall, confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import reported
from tidemark.operators import overlaps


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision (0 of nothing), recall (1 of nothing), and F1 from the rounded two."""
    p = F.coalesce(reported(F.try_divide(tp, tp + fp)), F.lit(0.0))
    r = F.coalesce(reported(F.try_divide(tp, tp + fn)), F.lit(1.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(reported(F.try_divide(2 * p * r, p + r)), F.lit(0.0))}


def confusion(df: DataFrame, expected: str, reached: str) -> DataFrame:
    return df.groupBy(expected, reached).agg(F.count("*").alias("n"))


def overlap_pairs(items: DataFrame, claims: DataFrame, by: list[str]) -> DataFrame:
    """(by, item_id, record_id, overlap): greedy one-to-one matching of items with claims, largest overlap first, ties by ids."""
    return overlaps.greedy_pairs(items, claims, by)


def unmatched(items: DataFrame, claims: DataFrame, matched: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(missed items, spurious claims): what no match took."""
    return items.join(matched, [*by, "item_id"], "left_anti"), claims.join(matched, [*by, "record_id"], "left_anti")


def field_matches(comparison: Column, expected: Column, actual: Column, tolerance: Column) -> Column:
    """exact, contains, set (parts between ``|``) or numeric (within the tolerance); never null."""
    parts = lambda x: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.lower(x), r"\|"), lambda p: F.trim(p)), lambda p: p != "")))
    number = lambda x: F.trim(x).try_cast("decimal(28,8)")
    same = (
        F.when(comparison == "exact", F.trim(actual) == F.trim(expected)).when(comparison == "contains", F.contains(F.lower(actual), F.lower(F.trim(expected))))
        .when(comparison == "set", parts(actual) == parts(expected)).otherwise(F.abs(number(expected) - number(actual)) <= tolerance)
    )
    return F.coalesce(same, F.lit(False))


def exact_matches(fields: DataFrame, by: list[str], ok: str = "ok") -> DataFrame:
    """(by, exact): whether every expected field of a match is right."""
    return fields.groupBy(*by).agg(F.bool_and(ok).alias("exact"))


def overall(scores: DataFrame) -> DataFrame:
    """The micro-average: counts add, then the rates are taken."""
    total = scores.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return total.select("*", *(x.alias(k) for k, x in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()))


def pair_score(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Counts and rates of two sets of pairs with the same columns; repeats count once."""
    key = expected.columns
    sides = expected.distinct().withColumn("_e", F.lit(1)).unionByName(found.select(*key).distinct().withColumn("_e", F.lit(2)))
    side = sides.groupBy(*key).agg(F.sum("_e").alias("side"))
    return overall(side.agg(F.count_if(F.col("side") == 3).alias("tp"), F.count_if(F.col("side") == 2).alias("fp"), F.count_if(F.col("side") == 1).alias("fn")))


def unordered(a: str, b: str) -> list[Column]:
    """A symmetric edge's ends, smaller first."""
    return [F.least(a, b).alias(a), F.greatest(a, b).alias(b)]


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.coalesce(reported(F.try_divide(part, whole)), F.lit(empty))


def shares(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """total and, for each listed value, its share of all rows (0 of nothing)."""
    return df.agg(F.count("*").alias("total"), *(rate(F.count_if(F.col(column) == v), F.count("*")).alias(v) for v in values))


def monitoring_score(expected: DataFrame, reached: DataFrame, key: str) -> DataFrame:
    """Accuracy and the breach rates; a record without a verdict counts as unverified, aged ones told breached are counted."""
    v = expected.join(reached, key, "left").withColumn("reached", F.coalesce("reached", F.lit("unverified")))
    is_e, is_r = F.col("expected") == "breached", F.col("reached") == "breached"
    n = v.agg(
        F.count("*").alias("graded"), F.count_if(F.col("expected") == F.col("reached")).alias("right"),
        F.count_if((F.col("expected") == "expired") & is_r).alias("aged_as_breached"),
        F.count_if(is_e & is_r).alias("tp"), F.count_if(~is_e & is_r).alias("fp"), F.count_if(is_e & ~is_r).alias("fn"),
    )
    p = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.select("graded", "aged_as_breached", rate(F.col("right"), F.col("graded")).alias("accuracy"), p["precision"].alias("precision"), p["recall"].alias("recall"))


def vocabulary(proposed: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Distinct values that a vocabulary does not hold yet."""
    return proposed.select(column).distinct().join(known.select(column), column, "left_anti")


def deltas(rungs: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Each rung's change against the one before; the first has none. A ladder has a handful of rungs."""
    w = Window.orderBy(order)
    return rungs.select(order, *(reported(F.col(c) - F.lag(c).over(w)).alias(f"{c}_delta") for c in columns))


def expected_edges(items: DataFrame, link_type: str) -> DataFrame:
    """(source, target) of an answer key's links of one type."""
    return items.select("item_id", F.explode("links").alias("l")).where(F.col("l.link_type") == link_type).select(F.col("item_id").alias("source"), F.col("l.target_item_id").alias("target"))
