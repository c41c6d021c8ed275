"""Ranges that overlap, and the greedy matching of two sides of them.

Overlaps are found on a ladder of grids: a range lies in one or two cells of the grid whose cells are as long as it is, rounded up to
a power of two, and a shorter range looks for it in the one or two cells that it lies in there. So ranges meet those near them,
not all of their document.

Matching goes through groups of few ranges as they are joined. In larger ones it works on islands, stretches that no range crosses the end of: what is taken in one never bears on another. Islands fall out of a
sweep by start with a running maximum of ends, and each is gone through once in the order of the rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rounds import settled, small, stored
from tidemark.operators.running import running

#: Overlapping pairs of an island that one task goes through; a larger island is matched in rounds.
ISLAND = 5_000_000
#: Ranges of a group that is matched as one row, without ladder and islands.
FEW = 64


def _level(start: str, end: str) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2((F.col(end) - F.col(start)).cast("double")))).cast("int")


def _in_cells(df: DataFrame, start: str, end: str, level: str, levels: list[int], first: str) -> DataFrame:
    """A row for each grid that a partner may be as long as, and each cell there; ``first`` is the range's first cell."""
    size = F.pow(F.lit(2.0), F.col("grid"))
    grids = F.filter(F.array(*map(F.lit, levels)), lambda g: g >= F.col(level))
    at = df.withColumn("grid", F.explode(grids)).withColumn(first, F.floor(F.col(start) / size).cast("bigint"))
    last = F.greatest(F.col(first), (F.ceil(F.col(end) / size) - 1).cast("bigint"))
    return at.withColumn("cell", F.explode(F.sequence(F.col(first), last)))


def overlapping(items: DataFrame, claims: DataFrame, by: list[str]) -> DataFrame:
    """Columns of both sides and ``overlap`` for each item (i_start, i_end) and claim (c_start, c_end) that share more than an end; ends are numbers."""
    a = items.where("i_start < i_end").withColumn("_i", _level("i_start", "i_end"))
    b = claims.where("c_start < c_end").withColumn("_c", _level("c_start", "c_end"))
    levels = [r[0] for r in a.select("_i").distinct().unionByName(b.select(F.col("_c").alias("_i"))).distinct().collect()]  # a handful: powers of two
    if not levels:
        return items.join(claims, by).withColumn("overlap", F.col("i_end") - F.col("i_start")).where("false")
    left, right = _in_cells(a, "i_start", "i_end", "_i", levels, "_if"), _in_cells(b, "c_start", "c_end", "_c", levels, "_cf")
    met = left.join(right, [*by, "grid", "cell"]).where((F.greatest("_i", "_c") == F.col("grid")) & (F.greatest("_if", "_cf") == F.col("cell")))
    width = F.least("i_end", "c_end") - F.greatest("i_start", "c_start")
    return met.withColumn("overlap", width).where("overlap > 0").drop("grid", "cell", "_i", "_c", "_if", "_cf")


def islands(items: DataFrame, claims: DataFrame, by: list[str]) -> DataFrame:
    """``items`` with ``island``: a number that all ranges of a stretch without gaps share; 0 for all of a group in which an id repeats."""
    known = lambda df: df.where(" and ".join(f"`{c}` is not null" for c in by))
    both = known(items).select(*by, F.lit(0).alias("side"), F.col("item_id").cast("string").alias("_id"), F.col("i_start").alias("_start"), F.col("i_end").alias("_end")).unionByName(
        known(claims).select(*by, F.lit(1).alias("side"), F.col("record_id").cast("string").alias("_id"), F.col("c_start").alias("_start"), F.col("c_end").alias("_end"))
    )
    order = ["_start", "_end", "side", "_id"]
    ends = running(both.where("_start < _end"), by, order, maxima={"_reach": "_end"})
    broken = ends.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("_start") >= F.col("_reach")), 1).otherwise(0))
    repeated = both.groupBy(*by, "side", "_id").count().where("count > 1").select(*by).distinct().withColumn("_repeated", F.lit(True))
    numbered = running(broken, by, order, sums={"island": "_new"}).where("side = 0").join(repeated, by, "left")
    numbered = numbered.select(*by, "_id", F.when(F.col("_repeated"), 0).otherwise(F.col("island")).alias("island")).distinct()
    return items.withColumn("_id", F.col("item_id").cast("string")).join(numbered, [*by, "_id"]).drop("_id")


def _take(width: int):
    """Rows sorted by island, then in the order of the rule; the first ``width`` columns tell the island."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, items, claims = None, set(), set()
        for b in batches:
            keep = []
            for key, item, claim in zip(zip(*(c.to_pylist() for c in b.columns[:width])), b.column("item_id").to_pylist(), b.column("record_id").to_pylist()):
                if key != here:
                    here, items, claims = key, set(), set()
                free = item not in items and claim not in claims
                keep.append(free)
                if free:
                    items.add(item)
                    claims.add(claim)
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def _in_rounds(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs that are the best of both their sides are taken together, the rest meet again; as the order is total this ends where the one-by-one rule ends."""
    order = [F.desc("overlap"), "item_id", "record_id"]
    best = lambda side: F.row_number().over(Window.partitionBy(*by, side).orderBy(*order)) == 1
    left, matched = settled(pairs), pairs.where("false")
    while not left.isEmpty():
        now = settled(left.withColumn("_i", best("item_id")).withColumn("_r", best("record_id")).where("_i and _r").drop("_i", "_r"))
        matched = matched.unionByName(now)
        left = settled(left.join(now.select(*by, "item_id"), [*by, "item_id"], "left_anti").join(now.select(*by, "record_id"), [*by, "record_id"], "left_anti"))
    return matched


def _of_few(items: DataFrame, claims: DataFrame, by: list[str]) -> DataFrame:
    """The matching of groups of at most ``FEW`` ranges: all pairs of a group that overlap, gone through in the order of the rule."""
    overlap = F.least("i_end", "c_end") - F.greatest("i_start", "c_start")
    met = items.where("item_id is not null and i_start < i_end").join(claims.where("c_start < c_end"), by).withColumn("overlap", overlap).where("overlap > 0")
    pairs = met.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("overlap")).alias("minus"), "item_id", "record_id", "overlap"))).alias("p"))
    used = lambda x: lambda y: y["item_id"].eqNullSafe(x["item_id"]) | y["record_id"].eqNullSafe(x["record_id"])
    taken = F.aggregate("p", F.slice("p", 1, 0), lambda acc, x: F.when(F.exists(acc, used(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return pairs.select(*by, F.inline(taken)).select(*by, "item_id", "record_id", "overlap")


def greedy_pairs(items: DataFrame, claims: DataFrame, by: list[str], island: int = ISLAND) -> DataFrame:
    """(by, item_id, record_id, overlap): one-to-one matching, largest overlap first, ties by ids. Ranges of one id within ``by`` are matched once."""
    items, claims = items.select(*by, "item_id", "i_start", "i_end"), claims.select(*by, "record_id", "c_start", "c_end")
    many = stored(items.select(*by).unionByName(claims.select(*by)).groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select(*by))
    if many.isEmpty():
        return stored(_of_few(items, claims, by))
    held = small(many)
    taken = stored(_of_few(items.join(held, by, "left_anti"), claims.join(held, by, "left_anti"), by))
    return taken.unionByName(_of_many(items.join(held, by, "left_semi"), claims.join(held, by, "left_semi"), by, island))


def _of_many(items: DataFrame, claims: DataFrame, by: list[str], island: int) -> DataFrame:
    of = [*by, "island"]
    found = overlapping(islands(items, claims, by), claims, by)
    pairs = settled(found.select(*of, "item_id", "record_id", "overlap"))
    large = settled(pairs.groupBy(*of).agg(F.count("*").alias("_n")).where(F.col("_n") > island).select(*of))
    few = pairs if large.isEmpty() else pairs.join(large, of, "left_anti")
    sorted_ = few.repartition(*of).sortWithinPartitions(*of, F.desc("overlap"), "item_id", "record_id")
    taken = sorted_.mapInArrow(_take(len(of)), few.schema)
    if not large.isEmpty():
        taken = taken.unionByName(_in_rounds(pairs.join(large, of, "left_semi"), by))
    return taken.select(*by, "item_id", "record_id", "overlap")
