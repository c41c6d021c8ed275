"""A store filled from a folder of decision records and from lines of estimates and outcomes, in one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import digest_id, flattened, work_class
from tidemark.operators.rounds import settled
from tidemark.sources.documents import decision_tables, read_jsonl
from tidemark.store import Store

ESTIMATES = "id string, subject string, owner string, work_class string, active_quantity double, quantity double, blocked_quantity double, unit string, confidence double, logged_at string"
OUTCOMES = "id string, estimate_id string, active_quantity double, quantity double, unit string"


def _add(store: Store, kind: str, rows: DataFrame, payload: list[str | Column]) -> int:
    """The rows (id, ...) that are not stored yet, as records; how many."""
    fresh = settled(rows.select("id", F.to_json(F.struct(*payload)).alias("payload")).dropDuplicates(["id"]).join(store.heads(kind).select("id"), "id", "left_anti"))
    store.add(kind, fresh, "seed")
    return fresh.count()


def _decisions(store: Store) -> dict[str, int]:
    docs = store.list_all("document", schema="source_uri string, source_kind string, content string").withColumnRenamed("id", "doc_id").drop("version")
    told = settled(decision_tables(docs.where("source_kind = 'markdown'")).join(docs.select("source_uri", "doc_id"), "source_uri"))
    spans = store.spans().select("doc_id", F.col("id").alias("span_id"), F.col("start_byte"), flattened(F.col("text")).alias("_text"))

    def cite(rows: DataFrame, words: str) -> DataFrame:
        """The first passage of the document that has the words."""
        near = rows.select("id", "doc_id", flattened(F.col(words)).alias("_words")).join(spans, "doc_id").where(F.contains("_text", "_words"))
        return rows.join(near.groupBy("id").agg(F.min_by("span_id", "start_byte").alias("span_id")), "id", "left")

    decisions = cite(told.withColumn("id", digest_id("D", F.col("doc_id"))), "chosen")
    rows = told.select("doc_id", digest_id("D", F.col("doc_id")).alias("decision"), F.inline("assumptions"))
    assumed = settled(cite(rows.withColumn("id", digest_id("A", F.col("doc_id"), F.col("claim"))), "claim"))
    counts = {
        "decisions": _add(store, "decision", decisions, ["title", "chosen", "rejected", "doc_id", "span_id"]),
        "assumptions": _add(store, "assumption", assumed, [F.col("claim").alias("statement"), "predicate", F.nullif("expiry", F.lit("")).alias("expiry_condition"), "doc_id", "span_id"]),
    }
    ends = assumed.select(F.lit("assumes").alias("link_type"), F.col("decision").alias("src"), F.lit("decision").alias("src_kind"), F.col("id").alias("dst"), F.lit("assumption").alias("dst_kind"))
    before = store.edges().count()
    store.link(ends)
    return counts | {"links": store.edges().count() - before}


def _quantities(store: Store, estimates: str, outcomes: str) -> dict[str, int]:
    """Older lines name a quantity only; an estimate that nothing answers gets an unresolved outcome, so that it stays in the history."""
    e, o = (settled(read_jsonl(store.spark, p, s)) for p, s in ((estimates, ESTIMATES), (outcomes, OUTCOMES)))
    active = F.coalesce("active_quantity", "quantity", F.lit(0.0)).alias("active")
    est = e.withColumn("log_id", F.col("id")).withColumn("id", digest_id("EST", F.col("log_id")))
    met = e.select(F.col("id").alias("estimate_id")).join(o.withColumnRenamed("id", "outcome_id"), "estimate_id", "left")
    out = met.withColumn("id", digest_id("OUT", F.coalesce("outcome_id", F.col("estimate_id"))))
    taken = F.when(F.col("outcome_id").isNotNull(), F.coalesce("active_quantity", "quantity")).alias("active")
    return {
        "estimates": _add(store, "estimate", est, ["subject", "owner", work_class(F.col("work_class")).alias("work_class"), active, F.coalesce("blocked_quantity", F.lit(0.0)).alias("blocked"), "unit", "confidence", "logged_at", "log_id"]),
        "outcomes": _add(store, "outcome", out, [digest_id("EST", F.col("estimate_id")).alias("estimate_id"), taken, "unit", F.when(F.col("outcome_id").isNull(), "unanswered").alias("unresolved")]),
        "unresolved": out.where("outcome_id is null").count(),
    }


def seed(store: Store, records: str, estimates: str | None = None, outcomes: str | None = None) -> dict[str, int]:
    """What was written, by kind. All of it appears together or not at all; seeding again writes nothing."""
    with store.transaction():
        documents, _ = store.ingest(records, "seed")
        counts = {"documents": documents, **_decisions(store)}
        if estimates and outcomes:
            counts |= _quantities(store, estimates, outcomes)
    return counts
