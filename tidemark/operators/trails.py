"""Audit rows and traces, drill-downs along them, and what they say has been done already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import graph

from tidemark.operators import versioned

PAGE, MOST = 50, 500


def timeline(audit: DataFrame, before: int | None = None, size: int | None = None) -> DataFrame:
    """(ordinal, ..., next_before, total): a page of audit rows, newest first, with where the next page starts (null at the end) and how many there are."""
    wanted = min(MOST, max(1, PAGE if size is None else size))
    rows = audit if before is None else audit.where(F.col("ordinal") < before)
    ahead = rows.orderBy(F.desc("ordinal")).limit(wanted + 1)
    told = ahead.agg(F.count("*").alias("n"), F.reverse(F.array_sort(F.collect_list("ordinal"))).alias("o"))
    cursor = told.select(F.when(F.col("n") > wanted, F.get("o", F.lit(wanted - 1)))).scalar()
    return ahead.orderBy(F.desc("ordinal")).limit(wanted).withColumns({"next_before": cursor, "total": audit.agg(F.count("*")).scalar()})


def in_run(rows: DataFrame, run: str, run_id, order: str) -> DataFrame:
    """The rows of one run, in order."""
    return rows.where(F.col(run) == run_id).orderBy(order)


def spent(rows: DataFrame, by: list[str], cost: str = "cost") -> DataFrame:
    """Exact decimal sums of costs with nine places."""
    return rows.groupBy(*by).agg(F.sum(F.col(cost).cast("decimal(18,9)")).alias("cost"))


def per_subject(findings: DataFrame) -> DataFrame:
    """(subject_id, n) of current findings that stand."""
    return versioned.standing(findings).groupBy("subject_id").agg(F.count("*").alias("n"))


def for_node(findings: DataFrame, subject, rank: Column) -> DataFrame:
    """A node's findings, the most severe first, then the newest."""
    return findings.where(F.col("subject_id") == subject).withColumn("rank", rank).orderBy("rank", F.desc("detected_at"), "id")


def queue(findings: DataFrame, labels: DataFrame, rank: Column, limit: int = 50, undecided: bool = False) -> DataFrame:
    """The findings to look at next, with what their subject is called (or its id)."""
    rows = findings.where("verdict is null") if undecided else findings
    best = rows.withColumn("rank", rank).orderBy("rank", F.desc("detected_at"), "id").limit(limit)
    named = labels.select(F.col("id").alias("subject_id"), "label")
    return best.join(named, "subject_id", "left").withColumn("label", F.coalesce("label", F.col("subject_id").cast("string")))


def decision_chain(decisions: DataFrame, edges: DataFrame, estimates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(decision, assumption, estimate, outcome): each decision's assumptions with the first estimate by link id and its outcome; gaps are null.

    ``edges``: link_id, link_type, src, dst.
    """
    assumed = edges.where("link_type = 'assumes'").select(F.col("src").alias("decision"), F.col("dst").alias("assumption"))
    first = edges.where("link_type = 'estimated_as'").join(estimates.select(F.col("estimate").alias("dst")), "dst", "left_semi")
    first = first.groupBy(F.col("src").alias("assumption")).agg(F.min_by("dst", F.struct("link_id", "dst")).alias("estimate"))
    return (
        decisions.select("decision").join(assumed, "decision", "left").join(first, "assumption", "left").join(outcomes.select("estimate", "outcome"), "estimate", "left")
        .select("decision", "assumption", "estimate", "outcome")
    )


def overview(assumptions: DataFrame, factors: DataFrame) -> DataFrame:
    """(live, valid_share, loudest, magnitude): the share of live assumptions that hold or are untested, and the group whose bias is greatest."""
    from tidemark.operators.metrics import rate

    live = assumptions.agg(F.count("*").alias("live"), rate(F.count_if(F.col("status").isin("holding", "unverified")), F.count("*")).alias("valid_share"))
    loud = factors.where("verdict = 'measured' and direction <> 'none'").withColumn("group", F.concat_ws("|", "owner", "work_class"))
    best = loud.agg(F.max_by(F.struct("group", "magnitude"), F.struct("magnitude", "group")).alias("b"))
    return live.withColumn("b", best.scalar()).select("live", "valid_share", F.col("b.group").alias("loudest"), F.col("b.magnitude").alias("magnitude"))


def endpoints_missing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(link_id, end): ends of edges whose id and kind no stored node has."""
    both = edges.select("link_id", F.inline(F.expr("array(named_struct('end', 'src', 'id', src, 'kind', src_kind), named_struct('end', 'dst', 'id', dst, 'kind', dst_kind))")))
    return both.join(nodes.select("id", "kind"), ["id", "kind"], "left_anti").select("link_id", "end")


def ledger_problems(applied: DataFrame, known: DataFrame) -> DataFrame:
    """(step, problem): steps applied with another checksum, not known here (a newer schema), or left out though a later one was applied."""
    last = applied.agg(F.max("step")).scalar()
    a, k = applied.select("step", F.col("checksum").alias("a")), known.select("step", F.col("checksum").alias("k"))
    problem = F.when(F.col("k").isNull(), "newer").when(F.col("a").isNull() & (F.col("step") < last), "left_out").when(F.col("a") != F.col("k"), "changed")
    return a.join(k, "step", "full").select("step", problem.alias("problem")).where("problem is not null")


def not_attempted(records: DataFrame, audit: DataFrame, actor: str) -> DataFrame:
    """Records on which the actor has left no audit row yet."""
    return records.join(audit.where(F.col("actor") == actor).select("id").distinct(), "id", "left_anti")


def not_read(documents: DataFrame, spans: DataFrame, records: DataFrame) -> DataFrame:
    """Documents of which no record cites a span."""
    cited = spans.join(records.select("span_id").distinct(), "span_id", "left_semi").select("doc_id").distinct()
    return documents.join(cited, "doc_id", "left_anti")


def same_document(pairs: DataFrame, records: DataFrame, spans: DataFrame) -> DataFrame:
    """``pairs`` (left, right) with ``same_document``: whether both records cite spans of one document; no span is no document."""
    where = records.join(spans.select("span_id", "doc_id"), "span_id").select("id", "doc_id")
    out = pairs
    for side in ("left", "right"):
        out = out.join(where.select(F.col("id").alias(side), F.col("doc_id").alias(f"_{side}")), side, "left")
    return out.select(*pairs.columns, F.coalesce(F.col("_left") == F.col("_right"), F.lit(False)).alias("same_document"))


def replayed(requests: DataFrame, fixtures: DataFrame) -> DataFrame:
    """``requests`` (digest, ...) with the stored ``response`` of their digest, and whether there is one."""
    return requests.join(fixtures.select("digest", "response"), "digest", "left").withColumn("hit", F.col("response").isNotNull())


def append_traces(rows: DataFrame, path: str) -> None:
    """One row an attempt; stored rows are never changed."""
    rows.write.mode("append").parquet(path)


def markdown(df: DataFrame, columns: list[str]) -> Column:
    """A row of a Markdown table; bars inside cells are escaped, missing cells are empty."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def decided_at(date: Column, ingested_at: Column) -> Column:
    """Midnight UTC of a stated date, else when the record came in."""
    return F.coalesce(date.try_cast("date").cast("timestamp"), ingested_at)


def estimate_details(estimates: DataFrame, outcomes: DataFrame, edges: DataFrame, live: DataFrame, findings: DataFrame) -> DataFrame:
    """(estimate, section, item, place): what there is to see of each estimate, a row for each thing, whatever hangs on it.

    Its first outcome by id; the standing assumptions that turned out to be it; the standing records that rest on it, by how many edges away; the
    findings that name it, most severe first (place 1 to 4). ``estimates``: id; ``outcomes``: id, estimate_id; ``edges``: src, dst, link_type, current ones; ``live``: id,
    kind, standing records; ``findings``: id, subject_id, severity.
    """
    roots = estimates.select(F.col("id").alias("root")).distinct()
    row = lambda df, section, item, place: df.select(F.col("root").alias("estimate"), F.lit(section).alias("section"), F.col(item).alias("item"), place.cast("int").alias("place"))
    first = outcomes.join(roots, F.col("estimate_id") == F.col("root")).groupBy("root").agg(F.min("id").alias("id"))
    meant = edges.where("link_type = 'estimated_as'").join(roots, F.col("dst") == F.col("root")).join(live.where("kind = 'assumption'").select(F.col("id").alias("src")), "src").select("root", "src").distinct()
    rests = edges.where(F.col("link_type").isin("assumes", "justified_by", "estimated_as"))
    reached = graph.walk(rests, roots).join(live.select(F.col("id").alias("node")), "node")
    told = findings.join(roots, F.col("subject_id") == F.col("root"))
    rank = F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 3).otherwise(4)
    parts = [row(first, "outcome", "id", F.lit(1)), row(meant, "assumption", "src", F.lit(1)), row(reached, "impacted", "node", F.col("depth")), row(told, "finding", "id", rank)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
