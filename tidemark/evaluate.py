"""A whole run over a corpus, graded against its answer key: ingest, read, monitor, compare, fuse, govern, grade."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import passes
from tidemark.extraction import Ask, estimation, extraction
from tidemark.operators import metrics, overlaps
from tidemark.operators.rounds import settled
from tidemark.stages import run
from tidemark.store import Store

KINDS = ("decision", "assumption", "estimate")


@dataclass(frozen=True)
class Flags:
    """Stages to run; a rung of an ablation turns them off from the last up."""

    estimation: bool = True
    memory: bool = True
    fusion: bool = True
    governance: bool = True


def claims(store: Store) -> DataFrame:
    """(record_id, kind, content_hash, start_byte, end_byte, payload) of every current record that cites a span, with all its field values."""
    rows = store.heads().where("not retracted").select(F.col("id").alias("record_id"), "kind", "payload", F.get_json_object("payload", "$.span_id").alias("span_id"))
    spans = store.spans().select(F.col("id").alias("span_id"), "doc_id", "start_byte", "end_byte")
    docs = store.heads("document").select(F.col("id").alias("doc_id"), F.get_json_object("payload", "$.content_hash").alias("content_hash"))
    return rows.join(spans, "span_id").join(docs, "doc_id").select("record_id", "kind", "content_hash", "start_byte", "end_byte", "payload")


def matched_items(items: DataFrame, said: DataFrame) -> DataFrame:
    """(content_hash, kind, item_id, record_id): the key's items and the records that stand for them, one to one."""
    left = items.select(F.col("content_sha256").alias("content_hash"), "kind", "item_id", F.col("start_byte").alias("i_start"), F.col("end_byte").alias("i_end"))
    right = said.select("content_hash", "kind", "record_id", F.col("start_byte").alias("c_start"), F.col("end_byte").alias("c_end"))
    return overlaps.greedy_pairs(left, right, ["content_hash", "kind"]).drop("overlap")


def _long(row: DataFrame, prefix: str) -> DataFrame:
    """One row of numbers as (measure, value)."""
    pairs = F.array(*(F.struct(F.lit(f"{prefix}.{c}").alias("measure"), F.col(c).cast("double").alias("value")) for c in row.columns))
    return row.select(F.inline(pairs))


def _found(items: DataFrame, said: DataFrame, matched: DataFrame, kind: str) -> DataFrame:
    hit = matched.where(F.col("kind") == kind).join(items.select("item_id", "is_distractor"), "item_id")
    n = lambda df, when=None: df.agg(F.count("*") if when is None else F.count_if(when)).scalar()
    own = items.where((F.col("kind") == kind) & ~F.col("is_distractor"))
    counts = hit.agg(F.count_if(~F.col("is_distractor")).alias("tp")).select("tp", (n(said.where(F.col("kind") == kind)) - F.col("tp")).alias("fp"), (n(own) - F.col("tp")).alias("fn"))
    return counts.select(F.lit(kind).alias("kind"), "*")


def grade(store: Store, items: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(measure, value) of a store against its key. ``items``: those of ``evaluation.key_items``; ``verdicts``: item_id, status that monitoring should reach.

    By kind and in all: precision, recall, F1 of what was found; the share of fields that are right; edges the key names (for
    ``estimated_as`` a recall only, since the key labels what it planted); monitoring against its verdicts.
    """
    said, items = settled(claims(store).where(F.col("kind").isin(*KINDS))), settled(items.where(F.col("kind").isin(*KINDS)))
    matched = settled(matched_items(items, said))
    counts = settled(reduce(DataFrame.unionByName, (_found(items, said, matched, k) for k in KINDS)))
    rates = metrics.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    by_kind = counts.select("kind", *(c.alias(k) for k, c in rates.items()))
    out = [by_kind.select(F.inline(F.array(*(F.struct(F.concat("kind", F.lit(f".{m}")).alias("measure"), F.col(m).alias("value")) for m in rates))))]
    out.append(_long(metrics.overall(counts).select(*rates), "all"))

    fields = items.where("not is_distractor").select("item_id", F.inline("fields")).join(matched, "item_id").join(said.select("record_id", "payload"), "record_id")
    actual = F.element_at(F.from_json("payload", "map<string,string>"), F.col("name"))
    right = metrics.field_matches(F.col("comparison"), F.col("value"), actual, F.coalesce(F.col("tolerance").cast("double"), F.lit(0.0)))
    graded = fields.withColumn("ok", right)
    out.append(_long(graded.agg(metrics.rate(F.count_if("ok"), F.count("*"), 1.0).alias("right")), "fields"))
    exact = metrics.exact_matches(graded, ["item_id"])
    out.append(_long(exact.agg(metrics.rate(F.count_if("exact"), F.count("*"), 1.0).alias("exact")), "items"))

    names = matched.select(F.col("record_id").alias("id"), F.col("item_id").alias("item"))
    edges = store.standing_edges().select("link_type", "src", "dst")
    named = edges.join(names.withColumnsRenamed({"id": "src", "item": "source"}), "src").join(names.withColumnsRenamed({"id": "dst", "item": "target"}), "dst")
    for link in ("assumes", "estimated_as"):
        want, have = metrics.expected_edges(items, link), named.where(F.col("link_type") == link).select("source", "target")
        score = metrics.pair_score(want, have)
        out.append(_long(score.select("precision", "recall") if link == "assumes" else score.select("recall"), link))

    if verdicts is not None:
        status = F.coalesce(F.get_json_object("payload", "$.status"), F.lit("unverified"))
        reached = store.heads("assumption").select("id", status.alias("reached")).join(names, "id").select(F.col("item").alias("item_id"), "reached")
        out.append(_long(metrics.monitoring_score(verdicts.select("item_id", F.col("status").alias("expected")), reached, "item_id"), "monitoring"))
    return reduce(DataFrame.unionByName, out)


def evaluate(
    store: Store, folder: str, items: DataFrame, ask: Ask, facts: dict | None = None, events: list[str] | None = None, now: Column | None = None,
    verdicts: DataFrame | None = None, judge: Callable[[DataFrame], DataFrame] | None = None, flags: Flags = Flags(),
) -> DataFrame:
    """(measure, value) of a run over the documents in ``folder``. The store is the caller's, to look at what was written; what is done already is not done again."""
    store.ingest(folder)
    run(store, [*extraction(ask), *(estimation(ask) if flags.estimation else [])])
    if flags.memory:
        passes.monitor(store, facts or {}, events or [], now)
        passes.contradictions(store, dry=False)
    if flags.fusion:
        passes.fuse(store)
    if flags.governance:
        passes.governed(store, judge)
    return grade(store, items, verdicts)
