"""Grades of whole stages against an answer key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import content_hash
from tidemark.operators import metrics, textops
from tidemark.operators.metrics import rate

#: The answer key as it is stored, one JSON object a file.
KEY = (
    "documents array<struct<path:string,source_kind:string,content_sha256:string,byte_length:bigint,items:array<struct<item_id:string,kind:string,is_distractor:boolean,"
    "start_byte:int,end_byte:int,quote:string,fields:array<struct<name:string,value:string,comparison:string,tolerance:string>>,"
    "links:array<struct<link_type:string,target_item_id:string>>,resolves_item_id:string>>>>, "
    "monitoring struct<facts:map<string,string>,events:array<string>,as_of:timestamp,verdicts:array<struct<item_id:string,status:string,note:string>>>"
)


def read_key(spark, path: str) -> DataFrame:
    return spark.read.schema(KEY).json(path, multiLine=True)


def write_key(key: DataFrame, path: str) -> None:
    key.coalesce(1).write.mode("overwrite").json(path)


def key_items(key: DataFrame) -> DataFrame:
    """One row an item, with the path and hash of its document."""
    docs = key.select(F.inline("documents"))
    return docs.select("path", "content_sha256", F.inline("items"))


def key_problems(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, problem): items whose document has another hash or length, whose bytes are not the quote, whose id repeats, or whose links lead nowhere.

    ``items``: item_id, path, content_sha256, start_byte, end_byte, quote, targets; ``docs``: path, content.
    """
    met = items.join(docs, "path", "left")
    said = textops.verify_span(F.col("content"), F.col("start_byte"), F.col("end_byte"), F.col("quote"))
    own = met.select("item_id", F.when(F.col("content").isNull(), "no_document").when(content_hash(F.col("content")) != F.col("content_sha256"), "other_content").when(said != "ok", said).alias("problem"))
    twice = items.groupBy("item_id").count().where("count > 1").select("item_id", F.lit("repeated_id").alias("problem"))
    aims = items.select("item_id", F.explode("targets").alias("target"))
    lost = aims.join(items.select(F.col("item_id").alias("target")), "target", "left_anti").select("item_id", F.lit("link_to_nothing").alias("problem")).distinct()
    return own.where("problem is not null").unionByName(twice).unionByName(lost)


def distracted(items: DataFrame, claims: DataFrame, matched: DataFrame, by: list[str]) -> DataFrame:
    """(found, missed, spurious, distracted): items matched and not, claims on nothing, and claims on distractors."""
    real = items.where("not is_distractor").select(*by, "item_id")
    hits = matched.join(items.select(*by, "item_id", "is_distractor"), [*by, "item_id"])
    missed, spurious = metrics.unmatched(real, claims, matched, by)
    count = lambda df: df.agg(F.count("*")).scalar()
    return hits.agg(F.count_if(~F.col("is_distractor")).alias("found"), F.count_if("is_distractor").alias("distracted")).select(
        "found", count(missed).alias("missed"), count(spurious).alias("spurious"), "distracted"
    )


def memory_grade(expected: DataFrame, found: DataFrame, names: DataFrame, settled: DataFrame) -> DataFrame:
    """(pairs, found, proposed, settled, unnamed): contradictions in the key's ids; ``found``: left, right, how; ``names``: id, item.

    A pair is proposed if a judge was asked, and settled if it is superseded since; pairs with an end the key does not name count as unnamed.
    """
    named = found
    for side in ("left", "right"):
        named = named.join(names.select(F.col("id").alias(side), F.col("item").alias(f"_{side}")), side, "left")
    known = named.where("_left is not null and _right is not null").select(F.least("_left", "_right").alias("left"), F.greatest("_left", "_right").alias("right"), "how").distinct()
    want = expected.select(*metrics.unordered("left", "right")).distinct()
    done = settled.select(*metrics.unordered("left", "right")).distinct().withColumn("done", F.lit(True))
    by = known.groupBy("left", "right").agg(F.bool_or(F.col("how") == "proven").alias("proven"), F.bool_or(F.col("how") == "asked").alias("asked"))
    told = want.join(by, ["left", "right"], "left").join(done, ["left", "right"], "left")
    out = told.agg(F.count("*").alias("pairs"), F.count_if("proven").alias("found"), F.count_if("asked").alias("proposed"), F.count_if("done").alias("settled"))
    return out.withColumn("unnamed", named.where("_left is null or _right is null").agg(F.count("*")).scalar())


def memory_grade_of_kinds(kinds: DataFrame) -> DataFrame:
    """The grade of ``memory_grade`` over distinct pairs that are counted by kind and not listed.

    ``kinds``: n, how many pairs are of that kind; expected, how (proven, asked or null), settled, named (both ends), of which all but how are not null.
    """
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    want = F.col("expected") & F.col("named")
    return kinds.agg(
        n(want).alias("pairs"), n(want & (F.col("how") == "proven")).alias("found"), n(want & (F.col("how") == "asked")).alias("proposed"), n(want & F.col("settled")).alias("settled"),
        n(F.col("how").isNotNull() & ~F.col("named")).alias("unnamed"),
    )


def calibration_grade(factors: DataFrame, calibrated: DataFrame, threshold: int = 5) -> DataFrame:
    """(threshold_holds, untouched_hold): a factor exactly where enough was measured, and quantities unchanged exactly where none applies."""
    enough = (F.col("n") >= threshold) & (F.col("work_class") != "unclassified")
    holds = factors.agg(F.coalesce(F.bool_and(F.col("factor").isNotNull() == enough), F.lit(True)).alias("threshold_holds"))
    untouched = calibrated.agg(F.coalesce(F.bool_and(F.when(F.col("applied"), True).otherwise(F.col("calibrated") == F.col("quantity"))), F.lit(True)))
    return holds.withColumn("untouched_hold", untouched.scalar())


def fusion_grade(priced: DataFrame, refused: DataFrame, flips: DataFrame) -> DataFrame:
    """(priced, refusals_hold, flips_hold, flip_rate): whether what must be refused has no price and what must flip flips. ``priced``: id, verdict."""
    decided = F.col("verdict").isin("flipped", "relieved", "unchanged")
    told = priced.join(refused.select("id", F.lit(True).alias("_r")), "id", "left").join(flips.select("id", F.lit(True).alias("_f")), "id", "left")
    return told.agg(
        F.count("*").alias("priced"), F.coalesce(F.bool_and(F.when(F.col("_r"), ~decided).otherwise(True)), F.lit(True)).alias("refusals_hold"),
        F.coalesce(F.bool_and(F.when(F.col("_f"), F.col("verdict") == "flipped").otherwise(True)), F.lit(True)).alias("flips_hold"),
        rate(F.count_if(F.col("verdict") == "flipped"), F.count_if(decided)).alias("flip_rate"),
    )


def governance_grade(findings: DataFrame, wrong: Column, merged: DataFrame, expected: DataFrame) -> DataFrame:
    """(concede, abstention, abstention_precision, merge_recall). ``findings``: verdict, route; ``wrong`` says which a person should see."""
    asked = F.col("route") == "needs_human"
    out = findings.agg(
        rate(F.count_if(F.col("verdict") == "overturned"), F.count("verdict")).alias("concede"), rate(F.count_if(asked), F.count_if(F.col("route") != "dropped")).alias("abstention"),
        rate(F.count_if(asked & wrong), F.count_if(asked)).alias("abstention_precision"),
    )
    hit = expected.distinct().join(merged.select(*expected.columns).distinct().withColumn("_m", F.lit(True)), expected.columns, "left")
    return out.withColumn("merge_recall", hit.agg(rate(F.count_if("_m"), F.count("*"), 1.0)).scalar())


def claims_view(records: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(record_id, kind, content_hash, start_byte, end_byte) of every record that cites a span, and the values of its ``fields`` (a map), if it has any."""
    placed = records.join(spans, "span_id").join(docs.select("doc_id", "content_hash"), "doc_id")
    return placed.select("record_id", "kind", "content_hash", "start_byte", "end_byte", *(["fields"] if "fields" in records.columns else []))


def resolutions(expected: DataFrame, reached: DataFrame, names: DataFrame) -> DataFrame:
    """Counts and rates of resolved items: ``expected`` (item), ``reached`` (id), each id under the key's name for it."""
    found = reached.join(names, "id").select("item").distinct()
    return metrics.pair_score(expected.select("item").distinct(), found)


def parse_report(predicates_: DataFrame, by: str) -> DataFrame:
    """(by, total, parsed, share): how many of each source's predicates parse; ``predicates_`` has ``parses``."""
    return predicates_.groupBy(by).agg(F.count("*").alias("total"), F.count_if("parses").alias("parsed"), rate(F.count_if("parses"), F.count("*")).alias("share"))


def ablation(rows: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], expected: Column) -> DataFrame:
    """(rung, kept, precision, recall): each rung applies one more stage than the one before; ``rows`` keeps what all stages so far keep."""
    total, kept, out = rows.agg(F.count_if(expected)).scalar(), rows, []
    for n, (name, stage) in enumerate(stages.items()):
        kept = stage(kept)
        counts = kept.agg(F.count("*").alias("kept"), F.count_if(expected).alias("tp")).withColumn("all", total)
        score = metrics.prf(F.col("tp"), F.col("kept") - F.col("tp"), F.col("all") - F.col("tp"))
        out.append(counts.select(F.lit(n).alias("place"), F.lit(name).alias("rung"), "kept", score["precision"].alias("precision"), score["recall"].alias("recall")))
    return reduce(DataFrame.unionByName, out)
