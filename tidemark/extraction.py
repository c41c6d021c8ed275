"""Reading documents into decisions, assumptions, estimates and outcomes, in the order in which each rests on the one before.

What a language model would answer is a parameter: ``ask(stage, offered)`` gets (id, offered), the unit and what it is shown as JSON, and gives
(id, answer), JSON text or null. Everything else is here: what is offered, which answers stand, and what they become. An answer cites a
passage by id and quotes it; a citation of what was not offered, or of words that are not there, is refused with its reason.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.scalars import digest_id, flattened, word_keys, work_class
from tidemark.operators import predicates, reviews
from tidemark.operators.rounds import settled
from tidemark.stages import Stage
from tidemark.store import Store

Ask = Callable[[str, DataFrame], DataFrame]


@F.pandas_udf(StringType())
def merged(payload: pd.Series, patch: pd.Series) -> pd.Series:
    """Two JSON objects as one; the second one's fields stand."""
    return pd.Series([json.dumps({**json.loads(a), **json.loads(b)}) for a, b in zip(payload, patch)])


def passages(store: Store, units: DataFrame) -> DataFrame:
    """(id, offered) for units (id, doc_id): the passages of the unit's document in order, with their ids."""
    each = units.join(store.spans().select("doc_id", "start_byte", F.col("id").alias("span_id"), "text"), "doc_id")
    rows = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "span_id", "text"))).alias("p"))
    return rows.select("id", F.to_json(F.transform("p", lambda p: F.struct(p["span_id"].alias("span_id"), p["text"].alias("text")))).alias("offered"))


def cited(store: Store, told: DataFrame, units: DataFrame, fields: str) -> DataFrame:
    """A row for each thing an answer names, with ``doc_id`` and ``reason``: null where its quotation stands in a passage of the unit's document."""
    shape = f"array<struct<{fields}, span_id: string, quote: string>>"
    items = told.join(units.select("id", "doc_id"), "id").select("id", "doc_id", F.inline(F.from_json("answer", shape)))
    spans = store.spans().select(F.col("id").alias("span_id"), F.col("doc_id").alias("_home"), F.col("text").alias("_text"))
    met = items.join(spans, "span_id", "left")
    reason = (
        F.when(F.col("_home").isNull(), "no_such_passage").when(F.col("_home") != F.col("doc_id"), "not_offered")
        .when(F.coalesce(flattened(F.col("quote")), F.lit("")) == "", "no_quotation").when(~F.contains(flattened(F.col("_text")), flattened(F.col("quote"))), "not_quoted")
    )
    return settled(met.withColumn("reason", reason).drop("_home", "_text"))


def _write(store: Store, kind: str, rows: DataFrame, by: str) -> None:
    """(id, payload) that are not stored yet."""
    fresh = rows.dropDuplicates(["id"]).join(store.heads(kind).select("id"), "id", "left_anti")
    store.add(kind, settled(fresh), by)


def _refuse(store: Store, rows: DataFrame, stage: str) -> None:
    bad = rows.where("reason is not null").select(F.concat(F.lit(f"{stage}:"), "id").alias("source_uri"), "reason")
    if not bad.isEmpty():
        store._write("refused", bad)


def _edge(rows: DataFrame, link_type: str, src: str, src_kind: str, dst: str, dst_kind: str) -> DataFrame:
    return rows.select(F.lit(link_type).alias("link_type"), F.col(src).alias("src"), F.lit(src_kind).alias("src_kind"), F.col(dst).alias("dst"), F.lit(dst_kind).alias("dst_kind"))


def _documents(store: Store) -> DataFrame:
    return store.list_all("document").select("id")


def _of(store: Store, kind: str, todo: DataFrame, *fields: str) -> DataFrame:
    """The units of one kind with their payload, version and some of its fields."""
    rows = store.heads(kind).join(todo, "id", "left_semi")
    return rows.select("id", "version", "payload", *(F.get_json_object("payload", f"$.{f}").alias(f) for f in fields))


def _scout(ask: Ask) -> Callable[[Store, DataFrame], None]:
    def work(store: Store, todo: DataFrame) -> None:
        units = todo.withColumn("doc_id", F.col("id"))
        found = cited(store, ask("scout", passages(store, units)), units, "title: string, impact: string")
        good = found.where("reason is null and title is not null").withColumn("new", digest_id("D", F.col("doc_id"), F.col("span_id"), F.col("title")))
        _write(store, "decision", good.select(F.col("new").alias("id"), F.to_json(F.struct("title", "impact", "span_id", "doc_id")).alias("payload")), "scout")
        _refuse(store, found, "scout")

    return work


def _assumptions(ask: Ask) -> Callable[[Store, DataFrame], None]:
    def work(store: Store, todo: DataFrame) -> None:
        units = _of(store, "decision", todo, "doc_id")
        found = cited(store, ask("assumptions", passages(store, units.select("id", "doc_id"))), units, "statement: string, confidence: double")
        good = settled(found.where("reason is null and statement is not null").withColumn("new", digest_id("A", F.col("doc_id"), F.col("span_id"), F.col("statement"))))
        _write(store, "assumption", good.select(F.col("new").alias("id"), F.to_json(F.struct("statement", "confidence", "span_id", "doc_id")).alias("payload")), "extractor")
        store.link(_edge(good, "assumes", "id", "decision", "new", "assumption"))
        _refuse(store, found, "assumptions")

    return work


def _formalise(ask: Ask) -> Callable[[Store, DataFrame], None]:
    def work(store: Store, todo: DataFrame) -> None:
        rows = _of(store, "assumption", todo, "statement", "confidence")
        told = ask("formalise", rows.select("id", F.to_json(F.struct("statement")).alias("offered")))
        said = told.select("id", F.from_json("answer", "predicate string, sureness double").alias("a")).select("id", "a.*")
        met = predicates.described(said.where("predicate is not null"), "predicate").select("id", "predicate", "sureness", "parses")
        sure = reviews.confidence(F.col("parses"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), F.coalesce("sureness", F.lit(0.0)))
        patch = F.to_json(F.struct(F.when(F.col("parses"), F.col("predicate")).alias("predicate"), sure.alias("confidence")))
        store.revise("assumption", settled(rows.join(met, "id").select("id", "version", merged("payload", patch).alias("payload"))), "formaliser")
        _refuse(store, met.where("not parses").withColumn("reason", F.lit("not_a_predicate")), "formalise")

    return work


def extraction(ask: Ask) -> list[Stage]:
    """Documents to decisions, decisions to assumptions with their edges, assumptions to predicates."""
    current = lambda kind: lambda store: store.list_all(kind).select("id")
    return [
        Stage("scout", _documents, _scout(ask)),
        Stage("assumptions", current("decision"), _assumptions(ask), ("scout",)),
        Stage("formalise", current("assumption"), _formalise(ask), ("assumptions",)),
    ]


def _estimates(ask: Ask) -> Callable[[Store, DataFrame], None]:
    def work(store: Store, todo: DataFrame) -> None:
        units = todo.withColumn("doc_id", F.col("id"))
        found = cited(store, ask("estimates", passages(store, units)), units, "subject: string, owner: string, active: double, unit: string")
        good = found.where("reason is null and active is not null").withColumn("new", digest_id("EST", F.col("doc_id"), F.col("span_id"), F.col("subject")))
        body = F.to_json(F.struct("subject", "owner", "active", "unit", "span_id", "doc_id", F.lit("unclassified").alias("work_class")))
        good = settled(good)
        _write(store, "estimate", good.select(F.col("new").alias("id"), body.alias("payload")), "estimator")
        assumed = store.list_all("assumption").select(F.col("id").alias("assumption"), F.get_json_object("payload", "$.span_id").alias("span_id"))
        store.link(_edge(good.join(assumed, "span_id"), "estimated_as", "assumption", "assumption", "new", "estimate"))
        _refuse(store, found, "estimates")

    return work


def _classify(ask: Ask) -> Callable[[Store, DataFrame], None]:
    def work(store: Store, todo: DataFrame) -> None:
        rows = _of(store, "estimate", todo, "subject", "work_class")
        told = ask("classify", rows.select("id", F.to_json(F.struct("subject")).alias("offered"))).select("id", F.coalesce(work_class(F.get_json_object("answer", "$.work_class")), F.lit("unclassified")).alias("said"))
        fresh = rows.join(told, "id").where(F.col("said") != F.col("work_class"))
        store.revise("estimate", settled(fresh.select("id", "version", merged("payload", F.to_json(F.struct(F.col("said").alias("work_class")))).alias("payload"))), "classifier")

    return work


def _match(ask: Ask) -> Callable[[Store, DataFrame], None]:
    def work(store: Store, todo: DataFrame) -> None:
        """Every estimate leaves with one outcome, resolved or not."""
        rows = settled(_of(store, "estimate", todo, "subject", "unit", "span_id"))
        spans = store.spans().select("id", "text")
        wanted = rows.select(F.col("id").alias("estimate"), F.col("span_id").alias("own"), word_keys(F.col("subject")).alias("words"))
        near = reviews.candidates(wanted, spans.select(F.col("id").alias("passage"), word_keys(F.col("text")).alias("words")), 8, 2).where("passage <> own or own is null")
        shown = near.join(spans.withColumnRenamed("id", "passage"), "passage").groupBy(F.col("estimate").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("passage").alias("span_id"), "text"))).alias("p"))
        offered = rows.join(shown, "id").select("id", F.to_json(F.struct("subject", F.transform("p", lambda p: F.struct(p["span_id"].alias("span_id"), p["text"].alias("text"))).alias("passages"))).alias("offered"))
        told = ask("match", offered).select("id", F.from_json("answer", "actual double, unit string, span_id string, quote string").alias("a"))
        cite = told.select("id", "a.*").join(near.select(F.col("estimate").alias("id"), F.col("passage").alias("span_id"), F.lit(True).alias("_offered")), ["id", "span_id"], "left")
        cite = cite.join(spans.withColumnsRenamed({"id": "span_id", "text": "_text"}), "span_id", "left").withColumnsRenamed({"unit": "in_unit"})
        met = rows.drop("span_id").join(offered.select("id", F.lit(True).alias("_shown")), "id", "left").join(cite, "id", "left")
        reason = (
            F.when(F.col("_shown").isNull(), "no_candidate").when(F.col("actual").isNull(), "no_answer").when(F.col("_offered").isNull(), "not_offered")
            .when(~F.coalesce(F.contains(flattened(F.col("_text")), flattened(F.col("quote"))), F.lit(False)), "not_quoted").when(~F.col("in_unit").eqNullSafe(F.col("unit")), "other_unit")
        )
        judged = met.withColumn("reason", reason)
        body = F.to_json(F.struct(F.col("id").alias("estimate_id"), F.when(F.col("reason").isNull(), F.col("actual")).alias("active"), F.col("reason").alias("unresolved"), "span_id"))
        _write(store, "outcome", judged.select(digest_id("OUT", F.col("id")).alias("id"), body.alias("payload")), "matcher")

    return work


def estimation(ask: Ask) -> list[Stage]:
    """Documents to estimates, estimates to classes of work, estimates to outcomes."""
    current = lambda store: store.list_all("estimate").select("id")
    return [
        Stage("estimates", _documents, _estimates(ask), ("assumptions",)),
        Stage("classify", current, _classify(ask), ("estimates",)),
        Stage("match", current, _match(ask), ("classify",)),
    ]
