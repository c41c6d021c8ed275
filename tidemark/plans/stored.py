"""Queries of stores that are built from the driver's tables: commits, snapshots and passes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import passes
from tidemark.commits import Log
from tidemark.index import Index
from tidemark.migrations import Migrated, Step
from tidemark.operators import calibration, segments, trails
from tidemark.operators.rounds import shared_folder, stored
from tidemark.plans.catalog import _bm25_sql
from tidemark.plans.registry import EST, FACT, HIST, LINK, OUT, query
from tidemark.plans.testviews import estimates, links, outcomes, table
from tidemark.sources.documents import decision_tables, documents_of, read_jsonl, rendered_json, request_digest
from tidemark.sources.reports import report_lines
from tidemark.store import Refused, Store


def _new(s: SparkSession) -> Store:
    return Store(s, f"{shared_folder(s)}/stores/{uuid.uuid4().hex}")


def _named(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


@query("store_heads", """SELECT 'O-' || o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' AND o_orderstatus <> 'F' OR o_orderstatus = 'F' THEN 2 ELSE 1 END AS version, o_orderstatus NOT IN ('O', 'F') AS retracted,
    CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderpriority END AS told, (SELECT count(*) FROM orders) + count(*) FILTER (o_orderstatus <> 'O') OVER () AS audit FROM orders""")  # fmt: skip
def _(s, d):
    """Orders as records in two commits: finished ones are revised, pending ones withdrawn, with a snapshot in between; a commit that fails half way leaves nothing."""
    store, orders = _new(s), table(s, d, "orders")
    rows = lambda where: orders.where(where).select(_named("O-", "o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderpriority").alias("told"))).alias("payload"))
    store.add("decision", rows("o_orderkey % 2 = 0"), "load")
    store.add("decision", rows("o_orderkey % 2 = 1"), "load")
    changed = orders.where("o_orderstatus = 'F'").select(_named("O-", "o_orderkey").alias("id"), F.lit(1).alias("version"), F.lit('{"told": "closed"}').alias("payload"))
    store.revise("decision", changed, "clerk")
    store.compact()
    store.retract("decision", orders.where("o_orderstatus not in ('O', 'F')").select(_named("O-", "o_orderkey").alias("id")), "clerk")
    try:
        with store.transaction():
            store.add("assumption", rows("true"), "clerk")
            store.revise("decision", changed, "clerk")  # no longer the current versions
    except Refused:
        pass
    n = store.audit().agg(F.count("*")).scalar()
    return store.heads().where("kind <> 'assumption'").select("id", "version", "retracted", F.get_json_object("payload", "$.told").alias("told"), n.alias("audit"))


def _parts(s: SparkSession, d: str) -> Store:
    """Each part assumes something of sizes; later parts come in a commit of their own. A supplier's decision rests on each of the parts it lists first."""
    store, part = _new(s), table(s, d, "part")
    k, v = F.col("p_partkey"), F.col("p_size").cast("string")
    said = F.when(k % 4 == 0, F.concat(F.lit("size <= "), v)).when(k % 4 == 1, F.concat(F.lit("weight < "), v)).when(k % 4 == 2, F.concat(F.lit("size > "), v)).otherwise(F.concat(F.lit("weight >= "), v, F.lit(" and (")))
    until = (
        F.when(k % 8 == 1, F.concat(F.lit('on_event("Part \\"'), v, F.lit('\\"  done")'))).when(k % 8 == 5, F.concat(F.lit('after("1996-01-01T00:00:'), F.lpad(v, 2, "0"), F.lit('+00:00")')))
        .when(k % 8 == 3, F.concat(F.lit("when(size < "), v, F.lit(")"))).when(k % 8 == 7, "when(size <")
    )
    rows = part.select(_named("A-", "p_partkey").alias("id"), F.to_json(F.struct(said.alias("predicate"), until.alias("expiry_condition"))).alias("payload"), k.alias("k"))
    store.add("assumption", rows.where("k % 3 = 0").drop("k"), "load")
    store.add("assumption", rows.where("k % 3 > 0").drop("k"), "load")
    impact = F.when(F.col("s_suppkey") % 3 == 0, "high").otherwise("low")
    suppliers = table(s, d, "supplier")
    with store.transaction():
        store.add("decision", suppliers.select(_named("D-", "s_suppkey").alias("id"), F.to_json(F.struct(impact.alias("impact"), F.lit("team").alias("scope"))).alias("payload")), "load")
        ends = suppliers.select(_named("D-", "s_suppkey").alias("src"), _named("A-", "s_suppkey").alias("dst"))
        store.link(ends.select(F.lit("assumes").alias("link_type"), "src", F.lit("decision").alias("src_kind"), "dst", F.lit("assumption").alias("dst_kind")))
    return store


_PARTS = """p AS (SELECT p_partkey AS k, p_size AS v FROM part), t AS (SELECT k, v, CASE k % 4 WHEN 0 THEN 25 <= v WHEN 2 THEN 25 > v END AS holds,
    CASE k % 8 WHEN 1 THEN v = 30 WHEN 5 THEN v <= 30 WHEN 3 THEN 25 < v END AS fired FROM p),
    m AS (SELECT k, v, CASE WHEN NOT holds THEN 'breached' WHEN holds THEN 'holding' WHEN fired THEN 'expired' END AS new_status FROM t)"""


@query("store_monitor", f"""WITH {_PARTS} SELECT 'A-' || k AS id, new_status, CASE WHEN new_status = 'breached' THEN CASE WHEN s_suppkey % 3 = 0 THEN 'high' ELSE 'low' END END AS severity
    FROM m LEFT JOIN supplier ON s_suppkey = k WHERE new_status IS NOT NULL""")  # fmt: skip
def _(s, d):
    """Statuses that one pass writes and the findings it leaves; a second pass writes nothing."""
    store = _parts(s, d)
    world = ({"size": 25}, ['part "30" done'], F.lit("1996-01-01T00:00:30Z").cast("timestamp"))
    told = passes.monitor(store, *world)
    again = passes.monitor(store, *world)
    found = store.list_all("finding", schema="subject_id string, severity string").select(F.col("subject_id").alias("id"), "severity")
    return told.unionByName(again).join(found, "id", "left").select("id", "new_status", "severity")


@query("store_govern", """WITH p AS (SELECT p_partkey AS k, 'A-' || p_partkey AS id, p_size AS v, p_partkey % 3 > 0 AS late FROM part),
    s AS (SELECT *, CASE k % 4 WHEN 0 THEN 'le' WHEN 1 THEN 'w' WHEN 2 THEN 'gt' END || v AS shape FROM p WHERE k % 4 < 3),
    dup AS (SELECT id AS older, arg_max(id, (late, id)) OVER (PARTITION BY shape) AS newer FROM s),
    d AS (SELECT older, newer, 'duplicate' AS outcome FROM dup WHERE older <> newer),
    c AS (SELECT CASE WHEN (x.late, x.id) < (y.late, y.id) THEN x.id ELSE y.id END AS older, CASE WHEN (x.late, x.id) < (y.late, y.id) THEN y.id ELSE x.id END AS newer,
        CASE WHEN x.late = y.late THEN 'same_time' ELSE 'revision' END AS outcome FROM p x JOIN p y ON y.k = x.k + 1 WHERE x.k % 5 = 0)
    SELECT older, newer, outcome, 1 AS times FROM d UNION ALL SELECT older, newer, outcome, CASE outcome WHEN 'same_time' THEN 2 ELSE 1 END FROM c WHERE (older, newer) NOT IN (SELECT older, newer FROM d)""")  # fmt: skip
def _(s, d):
    """Duplicates by shape and revisions by contradiction, and how often two passes propose them: what was written once is not proposed again."""
    store = _parts(s, d)
    pairs = table(s, d, "part").where("p_partkey % 5 = 0").select(_named("A-", "p_partkey").alias("src"), F.concat(F.lit("A-"), (F.col("p_partkey") + 1).cast("string")).alias("dst"))
    known = pairs.join(store.heads("assumption").select(F.col("id").alias("dst")), "dst")
    kind = F.lit("assumption")
    store.link(known.select(F.lit("contradicts").alias("link_type"), "src", kind.alias("src_kind"), "dst", kind.alias("dst_kind")))
    both = passes.governed(store).merges.unionByName(passes.governed(store).merges)
    return both.groupBy("older", "newer", "outcome").agg(F.count("*").cast("int").alias("times"))


@query("index_search", _bm25_sql(["benchmark", "license", "released"]))
def _(s, d):
    """The search of ``search_bm25`` from a stored index: documents came in two segments, a third of them first with another text, and the segments were merged."""
    index, docs = Index(s, f"{shared_folder(s)}/stores/{uuid.uuid4().hex}"), table(s, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("version"), F.when(F.col("doc_id") % 3 == 0, F.lit("license released benchmark")).otherwise(F.col("text")).alias("body"))
    index.add(rows)
    index.add(docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit(2).alias("version"), F.col("text").alias("body")))
    index.merge()
    found = index.search(["license", "released", "benchmark"], 40)
    return found.select(F.col("id").cast("bigint").alias("doc_id"), "score").orderBy(F.desc("score"), "doc_id").limit(20)


# --- sources

_BYTES = """CASE doc_id % 6 WHEN 0 THEN '# Note ' || doc_id || chr(10) || chr(10) || text WHEN 1 THEN 'Title ' || doc_id || chr(10) || chr(10) || text WHEN 2 THEN text
    WHEN 3 THEN '{"name": "N ' || doc_id || '", "of": [' || n_chars || ', {}]}' WHEN 4 THEN '{"name": ' ELSE text END"""


@query("source_files", f"""WITH f AS (SELECT doc_id, doc_id % 6 AS k, {_BYTES} AS t, source FROM documents),
    g AS (SELECT doc_id, k, CASE k WHEN 3 THEN 'name: N ' || doc_id || chr(10) || chr(10) || 'of[0]: ' || regexp_extract(t, '\\[(\\d+)', 1) || chr(10) || chr(10) || 'of[1]: {{}}' || chr(10) ELSE t END AS content, CASE WHEN k = 2 AND length(split_part(t, chr(10), 1)) <= 120 AND trim(split_part(t, chr(10), 2)) = '' AND trim(split_part(t, chr(10), 1)) <> '' THEN trim(split_part(t, chr(10), 1)) END AS one FROM f)
    SELECT doc_id, CASE k WHEN 0 THEN 'markdown' WHEN 3 THEN 'json' ELSE 'text' END AS source_kind, CASE k WHEN 0 THEN 'Note ' || doc_id WHEN 1 THEN 'Title ' || doc_id WHEN 3 THEN 'N ' || doc_id ELSE one END AS title, sha256(content) AS content_hash, NULL AS reason FROM g WHERE k < 4
    UNION ALL SELECT doc_id, NULL, NULL, NULL, CASE k WHEN 4 THEN 'not_json' ELSE 'unknown_suffix' END FROM g WHERE k >= 4""")  # fmt: skip
def _(s, d):
    """Documents as the bytes of files: by suffix, with a byte order mark and other line ends, as JSON, broken and unknown ones; read as documents or refused."""
    docs = table(s, d, "documents")
    k, id_ = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    ends = F.element_at(F.array(*map(F.lit, [".md", ".TXT", "", ".json", ".json", ".bin"])), (k + 1).cast("int"))
    body = (
        F.when(k == 0, F.concat(F.lit("﻿# Note "), id_, F.lit("\r\n\r"), F.replace("text", F.lit("\n"), F.lit("\r\n")))).when(k == 1, F.concat(F.lit("Title "), id_, F.lit("\n\n"), "text"))
        .when(k == 3, F.concat(F.lit('{"name": "N '), id_, F.lit('", "of": ['), F.col("n_chars").cast("string"), F.lit(", {}]}"))).when(k == 4, F.lit('{"name": ')).otherwise(F.col("text"))
    )
    good, refused = documents_of(docs.select(F.concat(F.lit("/in/"), id_, ends).alias("path"), body.cast("binary").alias("content")), rendered_json)
    name = F.regexp_extract("source_uri", "/in/([0-9]+)", 1).cast("bigint").alias("doc_id")
    return good.select(name, "source_kind", "title", "content_hash", F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select(name, *(F.lit(None).cast("string").alias(c) for c in ("source_kind", "title", "content_hash")), "reason")
    )


@query("decision_records", """SELECT p_partkey, 'Part ' || p_partkey AS title, p_name AS chosen, p_brand || '=' || p_type AS rejected, 'holds ' || p_size || '|size <= ' || p_size || '|when(size > ' || p_size || ')' AS assumed FROM part WHERE p_partkey % 5 <> 1""")
def _(s, d):
    """Parts as Markdown decision records with tables; those without a choice are left out."""
    part, v = table(s, d, "part"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("# Part "), F.col("p_partkey").cast("string"), F.lit("\n\n## Chosen\n\n"), F.when(F.col("p_partkey") % 5 == 1, "").otherwise(F.concat("p_name", F.lit("\n\nMore on that."))), F.lit("\n\n## Rejected\n\n| Option | Reason |\n|---|---|\n| "),
        "p_brand", F.lit(" | "), "p_type", F.lit(" |\n\n## Assumptions\n\n| # | Claim | Predicate | Expiry |\n| --- | --- | --- | --- |\n| 1 | holds "), v, F.lit(" | `size <= "), v, F.lit("` | `when(size > "), v, F.lit(")` |\n"),
    )
    told = decision_tables(part.select(F.col("p_partkey").cast("string").alias("source_uri"), F.lit("markdown").alias("source_kind"), text.alias("content")))
    joined = lambda c, parts, by: F.array_join(F.transform(c, lambda r: F.concat_ws(by, *(r[p] for p in parts))), ";")
    return told.select(F.col("source_uri").cast("bigint").alias("p_partkey"), "title", "chosen", joined("rejected", ("option", "reason"), "=").alias("rejected"), joined("assumptions", ("claim", "predicate", "expiry"), "|").alias("assumed"))


@query("jsonl_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS active FROM orders")
def _(s, d):
    """Orders written as JSON lines, with comments and blank lines between, and read again."""
    path = f"{shared_folder(s)}/stores/{uuid.uuid4().hex}"
    rows = table(s, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("active"))).alias("value"))
    notes = s.range(50).select(F.when(F.col("id") % 2 == 0, "# a comment").otherwise("  ").alias("value"))
    rows.unionByName(notes).write.text(path)
    return read_jsonl(s, path, "id string, active double")


@query("request_digests", """SELECT p_partkey, substr(sha256('{"b":"' || p_name || '","k":' || p_partkey || ',"z":[1,{"a":null,"c":true}]}'), 1, 32) AS digest FROM part""")
def _(s, d):
    """Two spellings of one request have one digest."""
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.concat(F.lit('{"z": [1, {"c": true, "a": null}], "k": '), k.cast("string"), F.lit(', "b": "'), "p_name", F.lit('"}'))).otherwise(
        F.concat(F.lit('{"b":"'), "p_name", F.lit('","z":[1,{"a":null,"c":true}],"k":'), k.cast("string"), F.lit("}"))
    )
    return table(s, d, "part").select("p_partkey", request_digest(text).alias("digest"))


@query("elided_texts", "SELECT doc_id, sha256(CASE WHEN length(text) > 1200 THEN left(text, 1200) || ' ...' ELSE text END) AS shown FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(segments.elided(F.col("text")), 256).alias("shown"))


# --- edges and passes


@query("store_edges", """WITH e AS (SELECT 'S-' || s_suppkey AS src, 'N-' || s_nationkey AS dst, CASE WHEN s_suppkey % 2 = 0 THEN 'justified_by' ELSE 'contradicts' END AS link_type FROM supplier)
    SELECT 'in' AS way, src, dst, link_type FROM e WHERE dst = 'N-3' UNION ALL SELECT 'out', src, dst, link_type FROM e WHERE src = 'S-8' AND link_type = 'justified_by' UNION ALL SELECT 'rests', src, dst, link_type FROM e WHERE link_type = 'justified_by'""")
def _(s, d):
    """Suppliers that cite or contradict their nations, linked twice: edges into a node, out of one by type, and the edges that dependence runs along."""
    store, even = _new(s), F.col("s_suppkey") % 2 == 0
    edges = table(s, d, "supplier").select(
        F.when(even, "justified_by").otherwise("contradicts").alias("link_type"), _named("S-", "s_suppkey").alias("src"), F.lit("assumption").alias("src_kind"),
        _named("N-", "s_nationkey").alias("dst"), F.when(even, "estimate").otherwise("assumption").alias("dst_kind"),
    )
    store.link(edges)
    store.link(edges)
    seen = lambda way, df: df.select(F.lit(way).alias("way"), "src", "dst", "link_type")
    return seen("in", store.links("N-3", ("dst",))).unionByName(seen("out", store.links("S-8", ("src",), ["justified_by"]))).unionByName(seen("rests", store.dependencies()))


@query("store_fuse", f"""WITH {EST}, {OUT}, {HIST}, {FACT}, v AS (SELECT estimate_id, estimated, estimated * factor AS scaled FROM est JOIN facs USING (owner, work_class) WHERE factor IS NOT NULL AND work_class <> 'unclassified'),
    w AS (SELECT estimate_id FROM v WHERE estimate_id % 10 = 0 AND estimated <= 150000 AND scaled > 150000),
    miss AS (SELECT estimate_id FROM hist WHERE ratio IS NOT NULL AND estimate_id % 10 = 0 AND greatest(estimated, actual) / least(estimated, actual) >= 2.5)
    SELECT 'stale' AS finding_kind, 'A-' || estimate_id AS subject_id, 'medium' AS severity, 'added' AS action FROM w UNION ALL SELECT 'collateral', 'EST-' || estimate_id, 'medium', 'added' FROM miss""")  # fmt: skip
def _(s, d):
    """Orders as estimates and outcomes; each tenth has an assumption and a decision on it. What calibration turns over is stale, what was missed badly is damage."""
    store = _new(s)
    rows = stored(calibration.history(estimates(s, d), outcomes(s, d)).select("estimate_id", "owner", "work_class", "estimated", "actual"))  # five batches come from it
    told = lambda prefix, *fields: rows.select(_named(prefix, "estimate_id").alias("id"), F.to_json(F.struct(*fields)).alias("payload"))
    tenth = rows.where("estimate_id % 10 = 0")
    with store.transaction():
        store.add("estimate", told("EST-", "owner", "work_class", F.col("estimated").alias("active")), "load")
        store.add("outcome", told("OUT-", _named("EST-", "estimate_id").alias("estimate_id"), F.col("actual").alias("active")), "load")
        store.add("assumption", tenth.select(_named("A-", "estimate_id").alias("id"), F.lit('{"predicate": "total <= 150_000"}').alias("payload")), "load")
        store.add("decision", tenth.select(_named("D-", "estimate_id").alias("id"), F.lit("{}").alias("payload")), "load")
        edge = lambda kind, a, ak, b, bk: tenth.select(F.lit(kind).alias("link_type"), _named(a, "estimate_id").alias("src"), F.lit(ak).alias("src_kind"), _named(b, "estimate_id").alias("dst"), F.lit(bk).alias("dst_kind"))
        store.link(edge("estimated_as", "A-", "assumption", "EST-", "estimate").unionByName(edge("assumes", "D-", "decision", "A-", "assumption")))
    return passes.fuse(store).select("finding_kind", "subject_id", "severity", "action")


@query("migrated_lines", """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber <= 2 THEN round_even(l_quantity * 24, 1) WHEN l_linenumber <= 4 THEN l_quantity ELSE l_quantity END AS DECIMAL(12,1)) AS hours,
    CASE WHEN l_linenumber <= 2 THEN 'S' || l_suppkey % 10 WHEN l_linenumber <= 4 THEN 'S' || l_suppkey ELSE 'T' || l_suppkey END AS team FROM lineitem""")  # fmt: skip
def _(s, d):
    """Order lines written under three schemas, days and then hours, suppliers and then teams; read as one table in the last."""
    log, lines = Log(s, f"{shared_folder(s)}/stores/{uuid.uuid4().hex}"), table(s, d, "lineitem")
    key = {"l_orderkey": ("bigint", None), "l_linenumber": ("int", None)}
    steps = [
        Step(1, "days", {"lines": {**key, "days": ("double", None), "supplier": ("bigint", None)}}),
        Step(2, "hours", {"lines": {**key, "hours": ("double", "days * 24"), "owner": ("string", "concat('s', supplier % 10)")}}),
        Step(3, "teams", {"lines": {**key, "hours": ("decimal(12,1)", "hours"), "team": ("string", "upper(owner)")}}),
    ]
    for n, rows in enumerate((
        lines.where("l_linenumber <= 2").withColumns({"days": F.col("l_quantity"), "supplier": F.col("l_suppkey")}),
        lines.where("l_linenumber in (3, 4)").withColumns({"hours": F.col("l_quantity"), "owner": F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))}),
        lines.where("l_linenumber > 4").withColumns({"hours": F.col("l_quantity"), "team": F.concat(F.lit("T"), F.col("l_suppkey").cast("string"))}),
    ), 1):
        at = Migrated(log, steps[:n])
        at.migrate()
        at.write("lines", rows)
    return Migrated(log, steps).read("lines")


@query("estimate_details", f"""WITH RECURSIVE {LINK}, w(root, node, depth) AS (SELECT 'R-' || r_regionkey, 'R-' || r_regionkey, 0 FROM region UNION SELECT root, l.src, depth + 1 FROM w JOIN link l ON l.dst = w.node WHERE depth < 16)
    SELECT 'R-' || n_regionkey AS estimate, 'outcome' AS section, min('OUT-' || n_nationkey) AS item, 1 AS place FROM nation GROUP BY 1
    UNION ALL SELECT 'R-' || n_regionkey, 'assumption', 'N-' || n_nationkey, 1 FROM nation WHERE n_nationkey % 4 <> 0
    UNION ALL SELECT root, 'impacted', node, CAST(min(depth) AS INTEGER) FROM w WHERE depth > 0 AND node NOT LIKE 'S-%' AND NOT (node LIKE 'N-%' AND CAST(substr(node, 3) AS INTEGER) % 4 = 0) GROUP BY 1, 3
    UNION ALL SELECT 'R-' || p_partkey % 7, 'finding', 'F-' || p_partkey, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END FROM part WHERE p_partkey % 7 < (SELECT count(*) FROM region)""")
def _(s, d):
    """Regions as estimates: nations were estimated as them (those divisible by four are withdrawn), customers and orders rest on them, suppliers do not stand."""
    nation, part = table(s, d, "nation"), table(s, d, "part")
    live = nation.where("n_nationkey % 4 <> 0").select(_named("N-", "n_nationkey").alias("id"), F.lit("assumption").alias("kind")).unionByName(
        table(s, d, "customer").select(_named("C-", "c_custkey").alias("id"), F.lit("assumption").alias("kind")).unionByName(table(s, d, "orders").select(_named("O-", "o_orderkey").alias("id"), F.lit("decision").alias("kind")))
    )
    outs = nation.select(_named("OUT-", "n_nationkey").alias("id"), _named("R-", "n_regionkey").alias("estimate_id"))
    severity = F.element_at(F.array(*map(F.lit, ["critical", "high", "medium", "low"])), (F.col("p_size") % 4 + 1).cast("int"))
    found = part.select(_named("F-", "p_partkey").alias("id"), F.concat(F.lit("R-"), (F.col("p_partkey") % 7).cast("string")).alias("subject_id"), severity.alias("severity"))
    return trails.estimate_details(table(s, d, "region").select(_named("R-", "r_regionkey").alias("id")), outs, links(s, d), live, found)


@query("report_lines", """WITH n AS (SELECT row_number() OVER (ORDER BY n_regionkey, n_name) AS i, '| ' || n_regionkey || ' | ' || n_name || ' |' AS line FROM nation), r AS (SELECT row_number() OVER (ORDER BY r_name) AS i, '| ' || r_name || chr(92) || '| |' AS line FROM region)
    SELECT 0 AS part, 1 AS n, '# Places' AS line UNION ALL SELECT 1, unnest([1, 2, 3, 4]), unnest(['## Nations', '', '| n_regionkey | n_name |', '| --- | --- |']) UNION ALL SELECT 1, CAST(i + 4 AS INTEGER), line FROM n
    UNION ALL SELECT 2, unnest([1, 2, 3, 4]), unnest(['## Regions', '', '| name |', '| --- |']) UNION ALL SELECT 2, CAST(i + 4 AS INTEGER), line FROM r""")
def _(s, d):
    """Two tables as a report, bars in cells escaped."""
    regions = table(s, d, "region").select(F.concat("r_name", F.lit("|")).alias("name"))
    return report_lines("Places", {"Nations": (table(s, d, "nation"), ["n_regionkey", "n_name"]), "Regions": (regions, ["name"])})
