"""Passes over a store: monitor assumptions, price what calibration changes, retire duplicates.

Each pass writes only what changed, so a second pass over the same store writes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.scalars import digest_id
from tidemark.operators import calibration, conflicting, curation, expiry, graph, monitoring, predicates, reviews, trails, versioned
from tidemark.operators.rounds import settled, stored
from tidemark.store import Store

ASSUMPTION = "predicate string, expiry_condition string, status string"


@F.pandas_udf(StringType())
def with_status(payload: pd.Series, status: pd.Series) -> pd.Series:
    return pd.Series([json.dumps({**json.loads(p), "status": s}) for p, s in zip(payload, status)])


def _assumptions(store: Store) -> DataFrame:
    rows = store.standing("assumption").withColumn("r", F.from_json("payload", ASSUMPTION))
    return rows.select("id", "version", "created_at", "payload", "r.*").withColumn("status", F.coalesce("status", F.lit("unverified")))


def verdicts(store: Store, facts: dict, events: list[str], now: Column) -> DataFrame:
    """(id, status, new_status, reason) of every current assumption in a world of facts and seen events."""
    rows = stored(_assumptions(store))  # read for predicates and for conditions
    held = predicates.judged(rows, "predicate", world=facts).withColumnRenamed("verdict", "holds")
    seen = F.array(*map(F.lit, events)) if events else F.array().cast("array<string>")
    due = expiry.fired(rows.where("expiry_condition is not null").select("id", "expiry_condition"), "expiry_condition", now, seen, world=facts)
    out = held.join(due, "id", "left").withColumn("new_status", monitoring.status(F.col("holds"), F.col("fired")))
    return out.select("id", "version", "payload", "status", "new_status", "reason")


def _write_findings(store: Store, found: DataFrame, dry: bool) -> DataFrame:
    """``found``: finding_kind, subject_id, severity, prosecution. Adds new findings, revises those whose text changed."""
    fields = ["finding_kind", "subject_id", "severity", "prosecution"]
    named = found.withColumn("id", digest_id("F", F.col("finding_kind"), F.col("subject_id")))
    standing = store.standing("finding", schema=", ".join(f"{f} string" for f in fields)).select("id", "version", "prosecution")
    told = settled(monitoring.finding_changes(named, standing, ["id"], "prosecution").join(standing.select("id", "version"), "id", "left"))
    if not dry:
        payload = F.to_json(F.struct(*fields)).alias("payload")
        with store.transaction():
            store.add("finding", told.where("action = 'added'").select("id", payload), "pass")
            store.revise("finding", told.where("action = 'revised'").select("id", "version", payload), "pass")
    return told.select("id", *fields, "action")


def monitor(store: Store, facts: dict, events: list[str], now: Column | None = None, dry: bool = False) -> DataFrame:
    """The assumptions whose status changed; each newly breached one gets a finding by what rests on it."""
    told = settled(monitoring.changes(verdicts(store, facts, events, F.current_timestamp() if now is None else now)))
    if not dry:
        decisions = store.standing("decision", schema="impact string, scope string").select(F.col("id").alias("decision"), "impact", "scope")
        resting = reviews.resting_on(store.dependencies(), decisions).join(decisions, "decision")
        hit = told.where("new_status = 'breached'").select("id")
        severity = monitoring.severity(hit.join(resting, "id", "left"), "id")
        found = settled(severity.select(F.lit("breach").alias("finding_kind"), F.col("id").alias("subject_id"), "severity", F.concat("id", F.lit(" no longer holds")).alias("prosecution")))
        with store.transaction():
            store.revise("assumption", told.select("id", "version", with_status("payload", "new_status").alias("payload")), "monitor")
            _write_findings(store, found, dry)
    return told.select("id", "status", "new_status", "reason")


def price(store: Store, history: DataFrame | None = None) -> DataFrame:
    """(assumption, estimate, verdict): what its group's factor does to each assumption that was estimated. ``history``: the store's, if it is at hand."""
    factors = calibration.factors(store.calibration_rows() if history is None else history).select("owner", "work_class", "factor")
    est = store.standing("estimate", schema="owner string, work_class string, active double").select(F.col("id").alias("estimate"), "owner", "work_class", "active")
    edges = store.dependencies().where("link_type = 'estimated_as'").select(F.col("src").alias("assumption"), F.col("dst").alias("dst"))
    a = predicates.described(_assumptions(store).select(F.col("id").alias("assumption"), "predicate"), "predicate").select("assumption", "predicate", "subject")
    rows = edges.join(a, "assumption").join(est, F.col("dst") == F.col("estimate"), "left").join(factors, ["owner", "work_class"], "left")
    rows = rows.select("*", F.concat_ws("|", "assumption", "dst").alias("id"), (F.col("active") * F.col("factor")).alias("scaled"))
    raw = predicates.judged(rows, "predicate", {"subject": "active"}).withColumnRenamed("verdict", "raw").drop("reason")
    both = predicates.judged(raw, "predicate", {"subject": "scaled"})
    verdict = monitoring.moved(F.col("estimate"), F.col("work_class") == "unclassified", F.col("subject"), F.col("factor"), F.col("raw"), F.col("verdict"))
    return both.select("assumption", F.col("dst").alias("estimate"), verdict.alias("verdict"))


def damage(store: Store, history: DataFrame | None = None) -> DataFrame:
    """(root, estimated, actual, decisions, severity) of every badly missed estimate; a miss on which several decisions rest is the worse."""
    live = (store.calibration_rows() if history is None else history).where("ratio is not null").withColumn("quality", calibration.match_quality(F.col("estimated"), F.col("actual")))
    missed = live.where("quality = 'miss'").select(F.col("estimate_id").alias("root"), "estimated", "actual")
    standing = store.standing("decision").select(F.col("id").alias("node"))
    reached = graph.walk(store.dependencies(), missed.select("root")).join(standing, "node").groupBy("root").agg(F.count("*").alias("decisions"))
    severity = F.when(F.col("decisions") >= 3, "high").when(F.col("decisions") > 0, "medium").otherwise("low")
    return missed.join(reached, "root", "left").withColumn("decisions", F.coalesce("decisions", F.lit(0))).withColumn("severity", severity)


def fuse(store: Store, dry: bool = False) -> DataFrame:
    """Findings on assumptions that hold as estimated and fail as calibrated, and on missed estimates that decisions rest on, with their edges."""
    history = stored(store.calibration_rows())  # both findings rest on it
    flips = price(store, history).where("verdict = 'flipped'").groupBy("assumption").agg(F.min("estimate").alias("estimate"))
    text = F.concat("assumption", F.lit(" holds by "), "estimate", F.lit(" as estimated, not as calibrated"))
    stale = flips.select(F.lit("stale").alias("finding_kind"), F.col("assumption").alias("subject_id"), F.lit("medium").alias("severity"), text.alias("prosecution"))
    found, edges = curation.collateral_findings(damage(store, history))
    found, edges = settled(stale.unionByName(found.drop("id"))), settled(edges)
    with store.transaction():
        told = _write_findings(store, found, dry)
        if not dry:
            store.link(edges)
    return told


@dataclass(frozen=True)
class Governed:
    """What one pass concluded. ``challenged``: id, verdict, rebuttal, action; ``merges``: older, newer, outcome, the refused ones too;
    ``retired``: id, refused; ``routes``: id, reasons, route, of the store as the pass leaves it."""

    challenged: DataFrame
    merges: DataFrame
    retired: DataFrame
    routes: DataFrame


FINDING = "finding_kind string, subject_id string, severity string, prosecution string, verdict string, challenge string, confidence double"


@F.pandas_udf(StringType())
def with_verdict(payload: pd.Series, verdict: pd.Series, challenge: pd.Series) -> pd.Series:
    return pd.Series([json.dumps({**json.loads(p), "verdict": v, "challenge": c}) for p, v, c in zip(payload, verdict, challenge)])


def challenge(store: Store, judge: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(id, version, payload, verdict, rebuttal, action) of every finding that was argued: revised where its challenge or verdict says something new.

    ``judge`` takes (id, finding_kind, subject_id, prosecution, batch), findings sure enough and without a verdict yet, and gives
    (id, verdict, rebuttal); a null verdict leaves a finding undecided. Without a judge nothing is argued.
    """
    standing = store.standing("finding").join(store.standing("finding", schema=FINDING).drop("version"), "id")
    if judge is None:
        return standing.limit(0).select("id", "version", "payload", F.col("verdict"), F.col("challenge").alias("rebuttal"), F.lit("kept").alias("action"))
    batches = curation.challenge_batches(standing.where("verdict is null"), "finding_kind").select("id", "batch")
    said = judge(standing.select("id", "finding_kind", "subject_id", "prosecution").join(batches, "id")).select("id", F.col("verdict").alias("said"), "rebuttal")
    same = F.col("verdict").eqNullSafe(F.col("said")) & F.col("challenge").eqNullSafe(F.col("rebuttal"))
    told = standing.join(said, "id").withColumn("action", F.when(same, "kept").otherwise("revised"))
    return settled(told.select("id", "version", "payload", F.col("said").alias("verdict"), "rebuttal", "action"))


def curate(store: Store) -> DataFrame:
    """(older, newer, outcome) of every pair of assumptions of one shape, and of every pair that an edge says contradicts."""
    rows = store.standing("assumption").select("id", "created_at", F.get_json_object("payload", "$.predicate").alias("predicate"), F.get_json_object("payload", "$.span_id").alias("span_id"))
    told = predicates.described(rows, "predicate")
    shapes = told.select("id", "created_at", F.when(F.size("shape") > 0, F.array_join("shape", "&")).alias("shape"))
    edges = store.standing_edges()
    pairs = edges.where("link_type = 'contradicts'").select(F.col("src").alias("left"), F.col("dst").alias("right"))
    apart = trails.same_document(pairs, rows.select("id", "span_id"), store.spans().select(F.col("id").alias("span_id"), "doc_id"))
    done = edges.where("link_type = 'supersedes'").select(F.col("dst").alias("older"), F.col("src").alias("newer"))
    return settled(curation.merges(shapes, apart, done))


def governed(store: Store, judge: Callable[[DataFrame], DataFrame] | None = None, at: Column | None = None, idle_days: int = 60, dry: bool = False) -> Governed:
    """Argue against findings, merge and retire assumptions, and route what stands then, in one commit.

    A merge is a ``supersedes`` edge from the newer to the older record; both stay. A second pass over the store finds nothing to write.
    """
    with store.transaction():
        argued = challenge(store, judge)
        if not dry:
            store.revise("finding", argued.where("action = 'revised'").select("id", "version", with_verdict("payload", "verdict", "rebuttal").alias("payload")), "governance")
        merges = curate(store)
        if not dry:
            kind = F.lit("assumption")
            kept = merges.where("outcome in ('duplicate', 'revision')")
            store.link(kept.select(F.lit("supersedes").alias("link_type"), F.col("newer").alias("src"), kind.alias("src_kind"), F.col("older").alias("dst"), kind.alias("dst_kind")))
        retired = retire(store, at, idle_days, dry)
        routed = settled(routes(store))
    return Governed(argued.select("id", "verdict", "rebuttal", "action"), merges, retired, routed)


def govern(store: Store, dry: bool = False) -> DataFrame:
    """(older, newer): what a pass merges, duplicates and revisions alike."""
    return governed(store, dry=dry).merges.where("outcome in ('duplicate', 'revision')").select("older", "newer")


def contradictions(store: Store, dry: bool = True) -> DataFrame:
    """(a_id, b_id, name): current assumptions whose constraints cannot hold together and that no edge joins yet; each pair once."""
    told = predicates.described(_assumptions(store).select("id", "predicate"), "predicate").select("id", "ranges")
    pairs = predicates.conflicts(told, told).where("a_id < b_id")
    known = store.standing_edges().where("link_type in ('contradicts', 'supersedes')").select(F.col("src").alias("left"), F.col("dst").alias("right"))
    fresh = settled(curation.without_known(pairs.withColumnsRenamed({"a_id": "left", "b_id": "right"}), known).withColumnsRenamed({"left": "a_id", "right": "b_id"}))
    if not dry:
        kind = F.lit("assumption")
        store.link(fresh.select(F.lit("contradicts").alias("link_type"), F.col("a_id").alias("src"), kind.alias("src_kind"), F.col("b_id").alias("dst"), kind.alias("dst_kind")))
    return fresh.select("a_id", "b_id", "name")


def contradiction_counts(store: Store) -> DataFrame:
    """(id, name, links, witness): for each constraint of a current assumption with any, how many others cannot hold with it, and one that cannot.

    Where a name is constrained by very many assumptions this says what ``contradictions`` would take all pairs to say.
    """
    told = predicates.described(_assumptions(store).select("id", "predicate"), "predicate").select("id", "ranges")
    return conflicting.conflict_links(told).where("links > 0").select("id", "name", "links", "witness")


def doctor(store: Store) -> DataFrame:
    """(id, problem): versions out of step, edges to what is not stored, records without an audit row."""
    records = store.records().withColumn("id", F.concat_ws(":", "kind", "id"))
    gaps = versioned.version_gaps(records).select("id", F.lit("version_gap").alias("problem"))
    edges = store.standing_edges().withColumn("link_id", F.col("id"))
    lost = trails.endpoints_missing(edges, store.records().select("id", "kind").distinct()).select(F.col("link_id").alias("id"), F.concat(F.lit("no_"), "end").alias("problem"))
    audit = store.audit().select(F.concat_ws(":", "kind", "id").alias("id"), "version")
    silent = records.select("id", "version").join(audit, ["id", "version"], "left_anti").select("id", F.lit("no_audit").alias("problem"))
    return gaps.unionByName(lost).unionByName(silent)


def routes(store: Store) -> DataFrame:
    """(id, reasons, route): where each finding goes: dropped if overturned, emitted if nothing speaks against it, else to a person."""
    rows = store.standing("finding", schema=FINDING)
    rules = {"undecided": F.col("verdict").isNull(), "unsure": F.col("confidence") < 0.5, "no_case": F.coalesce(F.trim("prosecution"), F.lit("")) == ""}
    gone = store.records("assumption").where("retracted").select(F.col("id").alias("subject_id")).distinct().withColumn("gone", F.lit(True))
    rules["subject_withdrawn"] = F.coalesce("gone", F.lit(False))
    return curation.gate(rows.join(gone, "subject_id", "left"), rules, F.coalesce(F.col("verdict") == "overturned", F.lit(False))).select("id", "reasons", "route")


def retire(store: Store, at: Column | None = None, idle_days: int = 60, dry: bool = False) -> DataFrame:
    """(id, refused): unverified assumptions never monitored, with the reason against retiring; the others are retracted."""
    audit = store.records("assumption").select("id", F.col("created_at").alias("occurred_at"), F.col("created_by").alias("actor"))
    decisions = store.standing("decision").select(F.col("id").alias("decision"))
    told = monitoring.retirements(_assumptions(store).select("id", "status"), audit, reviews.resting_on(store.dependencies(), decisions), F.current_timestamp() if at is None else at, idle_days)
    told = settled(told.select("id", "refused"))
    if not dry:
        store.retract("assumption", told.where("refused is null").select("id"), "curator")
    return told
