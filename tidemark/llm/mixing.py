"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets in words come from weights by water-filling. Blocks of near equal word counts are apportioned
to sources by highest quotients, then each source's blocks to its shards the same way, which gives
integer quotas per shard; inside a shard a seeded phase picks the blocks. A source has ``SHARDS`` shards, and more
where that keeps it to ``SHARD_ROWS`` rows and ``SHARD_WORDS`` words or so; rows fall to shards by id and text, so rows
that share an id only, or have none, spread. Everything is DataFrame
code. Defined cases: a null text has no words; a null source is a source of its own, last in order;
rows that are equal in every used column are interchangeable; an empty table gives no rows; a corpus
without words has zero targets; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import finish, materialize

BLOCK_WORDS = 64
SHARDS = 1024
SHARD_ROWS = 100_000
#: With so many words a shard the products of words and blocks stay far under 2 ** 63.
SHARD_WORDS = 1 << 31
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds ``target``: the total size shared by ``weight``, none above ``cap`` times its size.

    Sorted by the level at which each source reaches its cap, the first source that does not reach it
    gives the common level. ``sources`` has one row per source.
    """
    order = Window.orderBy(F.col("source_size") * cap / F.col("weight"), "rank")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    full = F.col("source_size") * F.lit(float(cap))
    leveled = sources.select(
        "*",
        (full / F.col("weight")).alias("own_level"),
        (
            (F.sum("source_size").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum(full).over(upto), F.lit(0.0)))
            / F.sum("weight").over(onward)
        ).alias("level"),
        F.row_number().over(order).alias("at"),
    )
    first = F.min_by(F.when(F.col("own_level") >= F.col("level"), F.col("level")), F.when(F.col("own_level") >= F.col("level"), F.col("at")))
    return leveled.withColumn("final", first.over(Window.partitionBy())).select(
        *sources.columns, F.least(full, F.col("weight") * F.coalesce("final", F.lit(0.0))).alias("target")
    )


def sainte_lague(votes: DataFrame, group: list[str], key: str) -> DataFrame:
    """Adds ``quota``: each group's ``seats`` dealt to its rows by the highest quotients votes / (2 j + 1).

    With n rows in a group, a row's quota lies within its share of seats -n/2 to +n/2, give or take a
    half, so only quotients in that span are ranked: about 3 n rows a group, whatever the seats.
    Ties go to the smaller key.
    """
    g = Window.partitionBy(*group)
    known = votes.where(F.col("votes") > 0).select(
        *group, key, "votes", "seats", F.sum("votes").over(g).alias("all"), F.count("*").over(g).alias("n")
    )
    share = F.col("votes") / F.col("all")
    spans = known.select(
        *group, key, "votes", "seats",
        F.greatest(F.lit(0).cast("long"), F.floor(share * (F.col("seats") - F.col("n") / 2) - 0.5).cast("long")).alias("sure"),
        (F.floor(share * (F.col("seats") + F.col("n") / 2) + 0.5).cast("long") + 1).alias("most"),
    ).withColumn("left", F.col("seats") - F.sum("sure").over(g))
    tried = spans.select(*group, key, "votes", "sure", "left", F.explode(F.sequence("sure", "most")).alias("j"))
    best = g.orderBy(F.desc(F.col("votes") / (2 * F.col("j") + 1)), key, "j")
    dealt = (
        tried.withColumn("at", F.row_number().over(best))
        .groupBy(*group, key)
        .agg((F.max("sure") + F.count_if(F.col("at") <= F.col("left"))).alias("quota"))
    )
    return dealt


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_words: int = BLOCK_WORDS, shards: int = SHARDS, cap: int = CAP, seed: int = 1, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, text_hash, taken) of every row."""
    sized = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col))).alias("skey"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
        F.xxhash64(F.col(text_col)).alias("th"),
    )
    kept = materialize(sized)
    largest = kept.groupBy("skey").agg(F.count("*").alias("n"), F.sum("size").alias("words")).agg(F.max("n").alias("n"), F.max("words").alias("words")).first()
    while shards * shard_rows < (largest["n"] or 0) or shards * SHARD_WORDS < (largest["words"] or 0):
        shards *= 2
    docs = kept.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))

    cells = docs.groupBy("skey", "source", "shard").agg(F.sum("size").alias("cell_size")).withColumn(
        "blocks",
        F.when(F.col("cell_size") > 0, F.greatest(F.lit(1).cast("long"), F.round(F.col("cell_size") / block_words).cast("long"))).otherwise(0),
    )
    cells = materialize(cells)
    ranked = (
        cells.groupBy("skey", "source").agg(F.sum("cell_size").alias("source_size"), F.sum("blocks").alias("source_blocks"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
        .withColumn("weight", (F.pmod(F.col("rank") - 1, F.lit(3)) + 1).cast("double"))
    )
    targets = materialize(water_fill(ranked, cap))

    votes = targets.select(
        F.lit(0).alias("all_of"), "skey",
        F.when(F.col("source_size") > 0, F.col("target") * F.col("source_blocks") / F.col("source_size")).otherwise(0.0).alias("votes"),
    )
    seats = votes.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy("all_of"))).cast("long"))
    by_source = sainte_lague(seats, ["all_of"], "skey").select("skey", F.col("quota").alias("seats"))
    by_shard = sainte_lague(
        cells.join(by_source, "skey").select("skey", "shard", F.col("blocks").cast("double").alias("votes"), "seats"), ["skey"], "shard"
    )
    plan = (
        cells.join(by_shard, ["skey", "shard"], "left")
        .join(targets.select("skey", "source_size", "target"), "skey")
        .select(
            "skey", "shard", "cell_size", "blocks", "source_size", "target",
            F.least(F.coalesce("quota", F.lit(0).cast("long")), F.col("blocks") * cap).alias("quota"),
            F.pmod(F.xxhash64(F.lit(seed), "skey", "shard"), F.greatest("blocks", F.lit(1).cast("long"))).alias("phase"),
        )
    )
    run = Window.partitionBy("skey", "shard").orderBy("h", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, 0)
    at = docs.withColumn("upto", F.sum("size").over(run)).withColumn("from", F.col("upto") - F.col("size"))
    picked = """
        aggregate(sequence(((from + 1) * blocks - 1) div cell_size, (upto * blocks - 1) div cell_size), 0L, (s, k) -> s
            + (((k + phase) % blocks + 1) * (quota % blocks) div blocks - ((k + phase) % blocks) * (quota % blocks) div blocks)
            * (least(upto, (k + 1) * cell_size div blocks) - greatest(from, k * cell_size div blocks)))
    """
    out = at.join(plan, ["skey", "shard"]).select(
        "doc_id", "size", "source", "source_size", "target", F.col("th").alias("text_hash"),
        F.when(F.col("size") > 0, F.expr(f"(quota div blocks) * size + {picked}")).otherwise(F.lit(0).cast("long")).alias("taken"),
    )
    return finish(out, kept, cells, targets)
