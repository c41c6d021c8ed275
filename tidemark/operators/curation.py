"""Pairs to compare, contradictions to prove, merges, retirements, challenges, the gate, and collateral findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import digest_id
from tidemark.operators import predicates, reviews
from tidemark.operators.rounds import settled
from tidemark.operators.running import running
from tidemark.operators.metrics import rate

BATCH, MOST_PAIRS, CHALLENGES, FLOOR = 12, 60, 8, 0.5


def without_known(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (left, right) that are not known in either order."""
    ends = lambda a, b: (F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"))
    return pairs.select("*", *ends("left", "right")).join(known.select(*ends("left", "right")).distinct(), ["_a", "_b"], "left_anti").drop("_a", "_b")


def strongest(pairs: DataFrame, k: int) -> DataFrame:
    """The k strongest pairs in a total order, with how many were formed."""
    formed = pairs.agg(F.count("*")).scalar()
    return pairs.orderBy(F.desc("subjects"), F.desc("words"), "left", "right").limit(k).withColumn("formed", formed)


def contradictions(pairs: DataFrame, constraints: DataFrame, most: int = MOST_PAIRS, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(proven, residue): of the strongest pairs those whose constraints cannot hold together (left, right, name), and the others in batches for a judge.

    ``pairs``: left, right, subjects, words; ``constraints``: id, ranges. ``most`` bounds what one pass looks at.
    """
    return judged(strongest(pairs, most), constraints, batch)


def judged(pairs: DataFrame, constraints: DataFrame, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(proven, residue) as ``contradictions`` tells them, over all of the few pairs given."""
    taken = settled(pairs)
    wanted = lambda side: constraints.join(taken.select(F.col(side).alias("id")).distinct(), "id", "left_semi")
    proof = predicates.conflicts(wanted("left"), wanted("right")).select(F.col("a_id").alias("left"), F.col("b_id").alias("right"), "name")
    proven = taken.join(proof, ["left", "right"]).select("left", "right", "name")
    rest = taken.join(proven, ["left", "right"], "left_anti")
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("subjects"), F.desc("words"), "left", "right"))
    return proven, rest.select("left", "right", F.floor((at - 1) / batch).cast("int").alias("batch"))


def candidate_documents(wanted: DataFrame, documents: DataFrame, limit: int = 3, shared: int = 2) -> DataFrame:
    """(estimate, document, overlap, rank): an estimate's own document first, then those with ``shared`` words or more in common, most first.

    ``wanted``: estimate, home, words; ``documents``: document, words.
    """
    near = reviews.candidates(wanted.withColumnRenamed("home", "own"), documents.withColumnRenamed("document", "passage"), limit, shared)
    return near.select("estimate", F.col("passage").alias("document"), F.col("words").alias("overlap"), "rank")


def merges(shapes: DataFrame, contradicting: DataFrame, superseded: DataFrame) -> DataFrame:
    """(older, newer, outcome): what curating does to each candidate pair.

    Records of one shape are duplicates, the latest (created_at, id) survives. A contradicting pair (left, right,
    same_document) is a revision of the older by the newer, unless both were made at one time or cite one document. A pair
    superseded already is left out, and one that is both a duplicate and contradicting is a duplicate.
    ``shapes``: id, created_at, shape (null without one).
    """
    last = Window.partitionBy("shape").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = shapes.where("shape is not null").withColumn("newer", F.first("id").over(last)).where("id <> newer").select(F.col("id").alias("older"), "newer", F.lit("duplicate").alias("outcome"))
    made = lambda side: shapes.select(F.col("id").alias(side), F.col("created_at").alias(f"_{side}"))
    both = contradicting.join(made("left"), "left").join(made("right"), "right")
    first = (F.col("_left") < F.col("_right")) | ((F.col("_left") == F.col("_right")) & (F.col("left") < F.col("right")))
    outcome = F.when(F.col("same_document"), "same_document").when(F.col("_left") == F.col("_right"), "same_time").otherwise("revision")
    against = both.select(F.when(first, F.col("left")).otherwise(F.col("right")).alias("older"), F.when(first, F.col("right")).otherwise(F.col("left")).alias("newer"), outcome.alias("outcome"))
    fresh = same.unionByName(against.join(same, ["older", "newer"], "left_anti")).distinct()
    return fresh.join(superseded.select("older", "newer"), ["older", "newer"], "left_anti")


def retirement_rate(told: DataFrame) -> DataFrame:
    """(considered, retired, rate, too_recent, still_in_use) over retirements with their reason against, if any."""
    n = lambda reason: F.count_if(F.col("refused") == reason).alias(reason)
    retired = F.count_if(F.col("refused").isNull())
    return told.agg(F.count("*").alias("considered"), retired.alias("retired"), rate(retired, F.count("*")).alias("rate"), n("too_recent"), n("still_in_use"))


def gate(findings: DataFrame, rules: dict[str, Column], overturned: Column) -> DataFrame:
    """``findings`` with ``reasons`` (every rule that fails, in order) and ``route``: dropped if overturned, emit without a reason, else needs_human."""
    failed = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    told = findings.withColumn("_failed", failed)
    route = F.when(overturned, "dropped").when(F.size("_failed") == 0, "emit").otherwise("needs_human")
    return told.withColumns({"reasons": F.array_join("_failed", ","), "route": route}).drop("_failed")


def challenge_batches(findings: DataFrame, by: str, size: int = CHALLENGES, floor: float = FLOOR) -> DataFrame:
    """(id, by, batch): findings sure enough to argue about, in batches within each value of ``by``, however many one value has."""
    sure = findings.where((F.col("confidence") >= floor) & F.col(by).isNotNull()).select("id", by, F.lit(1).alias("_one"))
    return running(sure, [by], ["id"], {"_at": "_one"}).select("id", by, F.floor((F.col("_at") - 1) / size).cast("int").alias("batch"))


def concede_rate(findings: DataFrame) -> DataFrame:
    """(decided, overturned, rate) over findings with a verdict."""
    decided, lost = F.count("verdict"), F.count_if(F.col("verdict") == "overturned")
    return findings.agg(decided.alias("decided"), lost.alias("overturned"), rate(lost, decided).alias("rate"))


def collateral_findings(damage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, edges) against badly missed estimates on which a decision rests.

    ``damage``: root, estimated, actual, decisions, severity. An edge of type collateral_of joins each finding to its
    estimate; ids come from what is said of whom, so a second pass writes nothing new.
    """
    big, small = F.greatest("estimated", "actual"), F.least("estimated", "actual")
    overrun = F.coalesce(F.concat(F.lit(" ("), F.bround(F.try_divide(big, small), 2).cast("decimal(18,2)").cast("string"), F.lit(" times)")), F.lit(" (no ratio)"))
    amount = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    text = F.concat("root", F.lit(" was estimated at "), amount("estimated"), F.lit(" and took "), amount("actual"), overrun, F.lit("; decisions resting on it: "), F.col("decisions").cast("string"))
    found = damage.where("decisions > 0").select(
        digest_id("F", F.lit("collateral"), F.col("root")).alias("id"), F.lit("collateral").alias("finding_kind"), F.col("root").alias("subject_id"), "severity", text.alias("prosecution")
    )
    edges = found.select(
        F.lit("collateral_of").alias("link_type"), F.col("id").alias("src"), F.lit("finding").alias("src_kind"), F.col("subject_id").alias("dst"), F.lit("estimate").alias("dst_kind")
    )
    return found, edges
