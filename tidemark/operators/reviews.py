"""Composite reads over decisions, assumptions, estimates and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import folded
from tidemark.operators import graph
from tidemark.operators.calibration import reported
from tidemark.operators.rounds import small, stored

#: Which kinds may stand at the ends of each type of edge.
CLAIMS = ["decision", "assumption", "estimate", "outcome", "finding"]
EVIDENCE = ["document", "span", "estimate", "outcome", "finding"]
ENDPOINTS = {
    "assumes": (["decision"], ["assumption"]),
    "justified_by": (["decision", "assumption", "finding"], EVIDENCE),
    "contradicts": (CLAIMS, CLAIMS),
    "supersedes": (CLAIMS, CLAIMS),
    "estimated_as": (["assumption"], ["estimate"]),
    "collateral_of": (["finding"], CLAIMS),
}
#: Working hours of each unit.
HOURS = {"hours": 1, "days": 8, "weeks": 40}


def endpoints_valid(link_type: Column, source: Column, target: Column) -> Column:
    """Whether an edge of this type may join these kinds; superseding joins like with like."""
    out = F.lit(False)
    for kind, (sources, targets) in ENDPOINTS.items():
        fits = source.isin(sources) & target.isin(targets)
        out = F.when(link_type == kind, fits & (source == target) if kind == "supersedes" else fits).otherwise(out)
    return F.coalesce(out, F.lit(False))


def converted(quantity: Column, unit: Column, to: Column) -> Column:
    """A quantity in another unit of working time; other pairs of unlike units have no value."""
    hours = F.create_map(*(F.lit(x) for pair in HOURS.items() for x in pair))
    return F.when(unit == to, quantity).otherwise(F.try_divide(quantity * F.try_element_at(hours, unit), F.try_element_at(hours, to)))


def bias_findings(factors: DataFrame, estimates: DataFrame) -> DataFrame:
    """(owner, work_class, subject_id, magnitude, direction, severity) of each biased group, on its lowest estimate."""
    anchor = estimates.groupBy("owner", "work_class").agg(F.min("estimate_id").alias("subject_id"))
    told = factors.where("verdict = 'measured' and direction <> 'none'")
    severity = F.when(F.col("magnitude") >= 4, "critical").when(F.col("magnitude") >= 2, "high").otherwise("medium")
    return told.join(anchor, ["owner", "work_class"]).select("owner", "work_class", "subject_id", "magnitude", "direction", severity.alias("severity"))


def improvement(before: Column, after: Column) -> tuple[Column, Column]:
    """How far an error fell: as it is, and as a share of the error there was (0 of none)."""
    return reported(before - after), F.coalesce(reported(F.try_divide(before - after, before)), F.lit(0.0))


def collateral(misses: DataFrame, edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """(root, decisions, assumptions, nearest, damaging): what rests on each missed estimate, any number of edges away.

    ``misses`` has root; ``kinds`` has node and kind of standing records, so a walk passes through retracted
    ones without naming them. A miss that nothing rests on keeps its row.
    """
    reached = graph.walk(edges, misses.select("root").distinct()).join(kinds, "node")
    count = lambda k: F.count_if(F.col("kind") == k)
    g = reached.groupBy("root").agg(
        count("decision").alias("decisions"), count("assumption").alias("assumptions"), F.min(F.when(F.col("kind") == "decision", F.col("depth"))).alias("nearest")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return misses.join(g, "root", "left").select(*misses.columns, zero("decisions"), zero("assumptions"), "nearest", (F.coalesce("decisions", F.lit(0)) > 0).alias("damaging"))


def resting_on(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, decision): unretracted decisions that assume a node directly."""
    near = edges.where("link_type = 'assumes'").select(F.col("dst").alias("id"), F.col("src").alias("decision"))
    return near.join(decisions.select("decision"), "decision", "left_semi").select("id", "decision")


def touching(edges: DataFrame) -> DataFrame:
    """(node, other, link_type): each edge from both of its ends, a loop once."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "link_type")
    return out.unionByName(edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), "link_type"))


def awaited(conditions: DataFrame, seen: DataFrame) -> DataFrame:
    """Events that conditions wait for and nobody has seen; both sides have ``event``."""
    fold = folded(F.col("event"))
    return conditions.select(fold.alias("event")).distinct().join(seen.select(fold.alias("event")).distinct(), "event", "left_anti")


def awaited_first(conditions: DataFrame, seen: DataFrame, most: int = 40) -> DataFrame:
    """(event, at): the events waited for and not seen, in the order in which they were first named; ``conditions`` has event and at."""
    fold = folded(F.col("event"))
    first = conditions.select(fold.alias("event"), "at").groupBy("event").agg(F.min("at").alias("at"))
    return first.join(seen.select(fold.alias("event")).distinct(), "event", "left_anti").orderBy("at", "event").limit(most)


def layered(facts: DataFrame) -> DataFrame:
    """(name, value): the fact of the latest layer of each name."""
    return facts.groupBy("name").agg(F.max_by("value", "layer").alias("value"))


def measured_facts(assumptions: DataFrame, edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(name, value): resolved outcomes of the estimates that one-subject assumptions were estimated as.

    ``assumptions``: id, subject, unit, created_at; ``edges``: src, dst; ``outcomes``: estimate_id, actual, unit.
    Units must agree; the last assumption by (created_at, id) decides a name.
    """
    met = assumptions.where("subject is not null").join(edges, F.col("id") == F.col("src"))
    o = outcomes.where("actual is not null").select("estimate_id", "actual", F.col("unit").alias("measured_in"))
    return met.join(o, (F.col("dst") == F.col("estimate_id")) & (F.col("unit") == F.col("measured_in"))).groupBy(F.col("subject").alias("name")).agg(
        F.max_by("actual", F.struct("created_at", "id", "dst")).alias("value")
    )


#: Rarest words of a wanted text, and texts of the most words, that tell how many words its best texts share with it at least.
FIRST, LONG = 4, 32


def sharing(wanted: DataFrame, texts: DataFrame, shared: int, best: int | None = None) -> DataFrame:
    """(wanted, text, words): pairs with ``shared`` distinct words or more in common, and how many; with ``best``, all
    that are among the ``best`` of their wanted one by words, ties too, and maybe others.

    Both sides have id and words. A pair that shares so many shares one even if the ``shared - 1`` commonest of the
    wanted side's words are left aside, so pairs meet on the other ones only: a word that all texts hold makes no pairs of itself.
    Where the best are wanted, the texts that hold its rarest words and those of the most words are counted first; what the last of
    their best shares takes the place of ``shared``.
    """
    from pyspark.sql import Window

    a = stored(wanted.select(F.monotonically_increasing_id().alias("_a"), F.col("id").alias("wanted"), F.array_distinct("words").alias("_words")))
    b = texts.select(F.col("id").alias("text"), F.array_distinct("words").alias("_held"))
    held = b.select("text", F.explode("_held").alias("word"))
    common = held.groupBy("word").agg(F.count("*").alias("_texts"))
    asked = a.select("_a", F.explode("_words").alias("word")).join(common, "word")
    rare = F.row_number().over(Window.partitionBy("_a").orderBy("_texts", "word"))
    leads = stored(asked.select("_a", "word", rare.alias("_rank"), F.count("*").over(Window.partitionBy("_a")).alias("_n")))

    def met(some: DataFrame) -> DataFrame:
        pairs = stored(held.join(small(stored(some.select("_a", "word"))), "word").select("_a", "text").distinct())
        both = b.join(small(pairs), "text").join(a, "_a")
        return both.select("_a", "wanted", "text", F.size(F.array_intersect("_words", "_held")).cast("bigint").alias("words")).where(F.col("words") >= shared)

    least = F.lit(shared)
    if best is not None:
        long = stored(b.where("text is not null").orderBy(F.size("_held").desc_nulls_last()).limit(LONG)).withColumn("_row", F.monotonically_increasing_id())
        far = long.select("text", "_row", F.explode("_held").alias("word")).join(leads, "word").groupBy("_a", "text", "_row").agg(F.count("*").alias("words"))
        known = met(leads.where(F.col("_rank") <= FIRST)).select("_a", "text", "words").unionByName(far.where(F.col("words") >= shared).drop("_row"))
        known = known.groupBy("_a", "text").agg(F.max("words").alias("words"))
        place = F.row_number().over(Window.partitionBy("_a").orderBy(F.desc("words")))
        last = known.withColumn("_place", place).where(F.col("_place") == best).select("_a", F.col("words").alias("_least"))
        leads, least = leads.join(last, "_a", "left"), F.coalesce("_least", F.lit(shared))
    return met(leads.where(F.col("_rank") <= F.col("_n") - (least - 1))).drop("_a")


def candidates(wanted: DataFrame, passages: DataFrame, limit: int, shared: int) -> DataFrame:
    """(estimate, passage, words): passages that share words with an estimate; its own one always, first ``limit`` in order.

    ``wanted``: estimate, own, words; ``passages``: passage, words.
    """
    from pyspark.sql import Window

    passages = stored(passages.select("passage", F.array_distinct("words").alias("words")))
    met = sharing(wanted.select(F.col("estimate").alias("id"), "words"), passages.select(F.col("passage").alias("id"), "words"), shared, limit)
    near = met.select(F.col("wanted").alias("estimate"), F.col("text").alias("passage"), "words").join(wanted.select("estimate", "own"), "estimate")
    home = wanted.withColumnRenamed("words", "_w").join(passages.withColumnRenamed("words", "_p"), F.col("own") == F.col("passage"))
    home = home.select("estimate", "own", "passage", F.size(F.array_intersect("_w", "_p")).cast("bigint").alias("words"))
    rows = near.select("estimate", "own", "passage", "words").unionByName(home).groupBy("estimate", "own", "passage").agg(F.max("words").alias("words"))
    order = Window.partitionBy("estimate").orderBy((F.col("own") == F.col("passage")).desc_nulls_last(), F.desc("words"), "passage")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("estimate", "passage", "words", "rank")


def confidence(checkable: Column, a: Column, b: Column) -> Column:
    """Product of two confidences, at most 0.3 where nothing can be checked."""
    return F.when(checkable, a * b).otherwise(F.least(a * b, F.lit(0.3)))
