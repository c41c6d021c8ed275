"""Queries over the driver's tables, by name, with the same queries in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import blocking, calibration, citation, graph, metrics, monitoring, predicates, textops, trails, versioned
from tidemark.plans.registry import EST, FACT, FINE, HEAD, HIST, LINK, OUT, TR, VER, query
from tidemark.plans.testviews import estimates, links, outcomes, table, traces, versions

def _history(s: SparkSession, d: str, fine: bool = False) -> DataFrame:
    return calibration.history(estimates(s, d, fine), outcomes(s, d))


@query("calibration_history", f"WITH {EST}, {OUT}, {HIST} SELECT * FROM hist")
def _(s, d):
    return _history(s, d)


@query("calibration_factors", f"WITH {EST}, {OUT}, {HIST}, {FACT} SELECT * FROM facs")
def _(s, d):
    return calibration.factors(_history(s, d))


@query("calibration_factors_fine", f"WITH {FINE}, {OUT}, {HIST}, {FACT} SELECT * FROM facs")
def _(s, d):
    return calibration.factors(_history(s, d, True))


def _scaled_sql(f: str) -> str:
    """estimated * f, half-even at 4 places, in integers."""
    v = f"(CAST(round(estimated * 10000) AS HUGEINT) * CAST(round({f} * 10000) AS HUGEINT))"
    up = f"CASE WHEN {v} % 10000 > 5000 OR ({v} % 10000 = 5000 AND ({v} // 10000) % 2 = 1) THEN 1 ELSE 0 END"
    return f"CASE WHEN factor IS NULL OR estimated <= 0 THEN estimated ELSE greatest(({v} // 10000 + {up})::DOUBLE / 10000, 0.0001) END"


@query("calibrate_quantities", f"""WITH {EST}, {OUT}, {HIST}, {FACT}
    SELECT estimate_id, owner, work_class, estimated AS quantity, {_scaled_sql("factor")} AS calibrated, {_scaled_sql("low")} AS band_low,
        {_scaled_sql("high")} AS band_high, factor IS NOT NULL AS applied FROM est LEFT JOIN facs USING (owner, work_class)""")  # fmt: skip
def _(s, d):
    return calibration.calibrate(estimates(s, d), calibration.factors(_history(s, d)))


@query("match_quality", f"""WITH {EST}, {OUT}, {HIST} SELECT estimate_id, CASE WHEN actual IS NULL THEN 'unresolved' WHEN estimated = actual THEN 'exact'
    WHEN least(estimated, actual) <= 0 THEN 'miss' WHEN greatest(estimated, actual) / least(estimated, actual) < 1.10 THEN 'exact'
    WHEN greatest(estimated, actual) / least(estimated, actual) < 1.50 THEN 'close' WHEN greatest(estimated, actual) / least(estimated, actual) < 2.50 THEN 'partial'
    ELSE 'miss' END AS quality FROM hist""")  # fmt: skip
def _(s, d):
    return _history(s, d).select("estimate_id", calibration.match_quality(F.col("estimated"), F.col("actual")).alias("quality"))


@query("work_class_vocab", f"WITH {EST} SELECT DISTINCT work_class FROM est")
def _(s, d):
    return estimates(s, d).select("work_class").distinct()


_WALK = """us AS (SELECT owner, work_class, ratio, count(*) OVER w AS prior, round_even(exp(avg(ln(ratio)) OVER w), 4) AS factor
    FROM hist WHERE ratio IS NOT NULL AND work_class <> 'unclassified'
    WINDOW w AS (PARTITION BY owner, work_class ORDER BY estimate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    sc AS (SELECT *, abs(ln(ratio)) AS raw, CASE WHEN factor <> 0 THEN abs(ln(ratio / factor)) END AS corrected FROM us WHERE prior >= 5),
    wk AS (SELECT owner, work_class, count(*) AS scored, count(*) FILTER (raw - corrected > 0.0001) AS improved,
        count(*) FILTER (raw - corrected < -0.0001) AS worsened, round_even(avg(raw), 4) AS raw_error, round_even(avg(corrected), 4) AS corrected_error FROM sc GROUP BY 1, 2)"""


@query("backtest_walk", f"WITH {EST}, {OUT}, {HIST}, {_WALK} SELECT * FROM wk")
def _(s, d):
    return calibration.walk(_history(s, d))


@query("backtest_total", f"""WITH {EST}, {OUT}, {HIST}, {_WALK} SELECT CAST(sum(scored) AS BIGINT) AS scored, CAST(sum(improved) AS BIGINT) AS improved,
    CAST(sum(worsened) AS BIGINT) AS worsened, round_even(sum(raw_error * scored) / sum(scored), 4) AS raw_error,
    round_even(sum(corrected_error * scored) / sum(scored), 4) AS corrected_error, round_even(sum(improved)::DOUBLE / sum(scored), 4) AS score FROM wk""")  # fmt: skip
def _(s, d):
    return calibration.walk_total(calibration.walk(_history(s, d)))


@query("record_head", f"WITH {HEAD} SELECT id, version, retracted, event_id, payload FROM head")
def _(s, d):
    return versioned.head(versions(s, d))


@query("current_records", f"WITH {HEAD} SELECT id, version, event_id, payload FROM head WHERE NOT retracted")
def _(s, d):
    return versioned.standing(versions(s, d)).select("id", "version", "event_id", "payload")


@query("version_gaps", f"WITH {VER} SELECT id, CAST(count(*) AS BIGINT) AS gaps FROM (SELECT id, version, coalesce(lag(version) OVER (PARTITION BY id ORDER BY version), 0) AS b FROM v WHERE NOT retracted) WHERE version <> b + 1 GROUP BY id")
def _(s, d):
    return versioned.version_gaps(versions(s, d).where("not retracted")).groupBy("id").agg(F.count("*").alias("gaps"))


@query("revision_conflicts", f"WITH {HEAD} SELECT p.id, p.version, h.version AS head, CASE WHEN p.version = h.version THEN h.version + 1 END AS written, p.version <> h.version AS conflict FROM v p JOIN h USING (id)")
def _(s, d):
    v = versions(s, d)
    return versioned.revisions(v, v)


@query("next_sequential_ids", f"""WITH {TR}, top AS (SELECT agent, max(seq) AS m FROM t GROUP BY agent)
    SELECT u.agent, u.run_id, CAST(m + row_number() OVER (PARTITION BY u.agent ORDER BY u.run_id) AS BIGINT) AS ordinal FROM (SELECT DISTINCT agent, run_id FROM t) u JOIN top USING (agent)""")
def _(s, d):
    t = traces(s, d)
    return versioned.next_ids(t.select("agent", "run_id").distinct(), t.withColumnRenamed("seq", "ordinal"), "agent", "run_id").select("agent", "run_id", "ordinal")


@query("audit_page", f"WITH {TR} SELECT seq, agent, run_id FROM t WHERE seq < 5000 ORDER BY seq DESC LIMIT 50")
def _(s, d):
    return versioned.page(traces(s, d), "seq", 5000).select("seq", "agent", "run_id")


@query("audit_by_entity", f"WITH {VER} SELECT id, version, event_id FROM v")
def _(s, d):
    return versions(s, d).select("id", "version", "event_id")


@query("cost_by_agent", f"WITH {TR} SELECT agent, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS calls FROM t GROUP BY agent")
def _(s, d):
    return traces(s, d).groupBy("agent").agg(F.sum("cost").cast("double").alias("cost"), F.count("*").alias("calls"))


@query("tokens_by_agent", f"WITH {TR} SELECT agent, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(max(tokens) AS BIGINT) AS most FROM t GROUP BY agent")
def _(s, d):
    return traces(s, d).groupBy("agent").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))


@query("run_cost", f"WITH {TR} SELECT run_id, CAST(sum(cost) AS DOUBLE) AS cost, count(DISTINCT agent) AS agents FROM t GROUP BY run_id")
def _(s, d):
    return traces(s, d).groupBy("run_id").agg(F.sum("cost").cast("double").alias("cost"), F.countDistinct("agent").alias("agents"))


@query("recent_runs", f"WITH {TR} SELECT run_id, max(seq) AS last FROM t GROUP BY run_id ORDER BY last DESC LIMIT 20")
def _(s, d):
    return traces(s, d).groupBy("run_id").agg(F.max("seq").alias("last")).orderBy(F.desc("last")).limit(20)


@query("budget_gate", f"WITH {TR} SELECT seq, run_id, CAST(sum(cost) OVER (PARTITION BY run_id ORDER BY seq) AS DOUBLE) AS spent, sum(cost) OVER (PARTITION BY run_id ORDER BY seq) <= 500 AS affordable FROM t")
def _(s, d):
    from pyspark.sql import Window

    spent = F.sum("cost").over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return traces(s, d).select("seq", "run_id", spent.cast("double").alias("spent"), (spent <= 500).alias("affordable"))


@query("assumption_health", "SELECT k AS event_type, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES ('view'), ('signup'), ('error'), ('click'), ('purchase'), ('expired')) l(k) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e ON e.event_type = k")
def _(s, d):
    return versioned.counts_with_zeros(table(s, d, "events"), "event_type", ["view", "signup", "error", "click", "purchase", "expired"])


@query("decision_index", """SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(late, 0) AS breached, coalesce(late, 0) > 0 AS at_risk FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS late FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")  # fmt: skip
def _(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("late"))
    late = F.coalesce("late", F.lit(0))
    return table(s, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), late.alias("breached"), (late > 0).alias("at_risk"))


_RANK = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END"


@query("finding_queue", f"SELECT event_id, event_type, CAST({_RANK} AS INTEGER) AS rank FROM events ORDER BY {_RANK}, ts DESC, event_id LIMIT 100")
def _(s, d):
    return table(s, d, "events").withColumn("rank", F.expr(_RANK)).orderBy("rank", F.desc("ts"), "event_id").limit(100).select("event_id", "event_type", "rank")


@query("subject_labels", "SELECT 'C-' || c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT 'S-' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'P-' || p_partkey, p_name FROM part")
def _(s, d):
    def part(name: str, p: str, key: str, label: str) -> DataFrame:
        return table(s, d, name).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(label).alias("label"))

    return part("customer", "C-", "c_custkey", "c_name").unionByName(part("supplier", "S-", "s_suppkey", "s_name")).unionByName(part("part", "P-", "p_partkey", "p_name"))


@query("store_stats", f"WITH {LINK} SELECT link_type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM link GROUP BY 1")
def _(s, d):
    return links(s, d).groupBy("link_type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("edges_from", f"WITH {LINK} SELECT src, dst, link_type FROM link WHERE link_type IN ('justified_by', 'estimated_as')")
def _(s, d):
    return links(s, d).where(F.col("link_type").isin("justified_by", "estimated_as"))


def _walk_sql(roots: str, here: str, there: str) -> str:
    return f"""WITH RECURSIVE {LINK}, roots AS ({roots}), w(root, node, depth) AS (SELECT root, root, 0 FROM roots
        UNION SELECT root, l.{there}, depth + 1 FROM w JOIN link l ON l.{here} = w.node WHERE depth < 16)
        SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE depth > 0 GROUP BY 1, 2"""


@query("impacted_by", _walk_sql("SELECT 'R-' || r_regionkey AS root FROM region", "dst", "src"))
def _(s, d):
    return graph.walk(links(s, d), table(s, d, "region").select(F.concat(F.lit("R-"), F.col("r_regionkey").cast("string")).alias("root")))


@query("depends_on", _walk_sql("SELECT 'O-' || o_orderkey AS root FROM orders", "src", "dst"))
def _(s, d):
    return graph.walk(links(s, d), table(s, d, "orders").select(F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("root")), reverse=False)


@query("collateral_survey", f"""WITH {EST}, {OUT}, {HIST}, miss AS (SELECT 'O-' || estimate_id AS src, greatest(estimated, actual) / least(estimated, actual) AS over FROM hist
    WHERE actual > 0 AND estimated > 0 AND greatest(estimated, actual) / least(estimated, actual) >= 2.5), {LINK}
    SELECT dst, count(*) AS misses, round_even(max(over), 4) AS worst FROM miss JOIN link USING (src) GROUP BY dst""")  # fmt: skip
def _(s, d):
    h = _history(s, d).withColumn("quality", calibration.match_quality(F.col("estimated"), F.col("actual"))).where("quality = 'miss' and ratio is not null")
    over = F.greatest("estimated", "actual") / F.least("estimated", "actual")
    m = h.select(F.concat(F.lit("O-"), F.col("estimate_id").cast("string")).alias("src"), over.alias("over"))
    return m.join(links(s, d), "src").groupBy("dst").agg(F.count("*").alias("misses"), scalars.reported(F.max("over")).alias("worst"))


_PREDICATE = 'not (size >= 30 and price < 1000) or kind == "none" or price / (size - 15) > 90 and unbound < 3'


@query("predicate_eval", """SELECT p_partkey, CASE WHEN v THEN 'true' WHEN NOT v THEN 'false' ELSE 'unknown' END AS verdict FROM (SELECT p_partkey,
    NOT (p_size >= 30 AND p_retailprice < 1000) OR p_type = 'none' OR (p_retailprice / NULLIF(p_size - 15, 0) > 90 AND NULL::BOOLEAN) AS v FROM part)""")  # fmt: skip
def _(s, d):
    part = table(s, d, "part").withColumn("price", F.col("p_retailprice").cast("decimal(12,2)"))
    v = predicates.lower(predicates.parse(_PREDICATE), predicates.bind(part, {"size": "p_size", "price": "price", "kind": "p_type"}))
    return part.select("p_partkey", F.when(v, "true").when(~v, "false").otherwise("unknown").alias("verdict"))


@query("monitor_verdicts", """SELECT o_orderkey, CASE WHEN o_totalprice <= 150000 THEN CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'holding' ELSE 'holding' END
    WHEN o_totalprice > 150000 THEN 'breached' ELSE 'unchanged' END AS status, o_orderdate >= TIMESTAMP '1997-01-01' AS fired FROM orders""")  # fmt: skip
def _(s, d):
    v = predicates.lower(predicates.parse("total <= 150_000"), {"total": ("num", F.col("o_totalprice"))})
    fired = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    status = F.when(~v, "breached").when(v, "holding").when(fired, "expired").otherwise("unchanged")
    return table(s, d, "orders").select("o_orderkey", status.alias("status"), fired.alias("fired"))


@query("interval_conflicts", """WITH r AS (SELECT p_brand || '|' || p_type || '|' || CAST(p_size AS VARCHAR) AS name, p_partkey AS id, p_retailprice AS low, p_retailprice + p_size AS high FROM part)
    SELECT name, a.id AS a, b.id AS b FROM r a JOIN r b USING (name) WHERE a.id < b.id AND (greatest(a.low, b.low) > least(a.high, b.high)
        OR greatest(a.low, b.low) = least(a.high, b.high) AND NOT (greatest(a.low, b.low) > a.low OR true))""")  # fmt: skip
def _(s, d):
    p = F.col("p_retailprice")
    r = table(s, d, "part").select(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("name"), F.col("p_partkey").alias("id"), F.struct(p.alias("low"), F.lit(True).alias("low_closed"), (p + F.col("p_size")).alias("high"), F.lit(True).alias("high_closed")).alias("r"))
    pairs = r.withColumnsRenamed({"id": "a", "r": "ra"}).join(r.withColumnsRenamed({"id": "b", "r": "rb"}), "name").where("a < b")
    return pairs.where(predicates.disjoint("ra", "rb")).select("name", "a", "b")


@query("abstention_gate", """SELECT event_id, concat_ws(',', CASE WHEN value < 10 THEN 'low_value' END, CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN user_id % 5 = 0 THEN 'unverified' END) AS reasons,
    CASE WHEN value < 10 OR event_type = 'error' OR user_id % 5 = 0 THEN 'needs_human' ELSE 'emit' END AS route FROM events""")  # fmt: skip
def _(s, d):
    rules = {"low_value": F.col("value") < 10, "error": F.col("event_type") == "error", "unverified": F.col("user_id") % 5 == 0}
    failed = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return table(s, d, "events").select("event_id", F.array_join(failed, ",").alias("reasons"), F.when(F.size(failed) > 0, "needs_human").otherwise("emit").alias("route"))


@query("word_keys", "SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z][a-z0-9_]{2,})', 1), lambda w: length(w) >= 4))) AS INTEGER) AS n_keys FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(scalars.word_keys(F.col("text"))).alias("n_keys"))


@query("block_pairs", """WITH k AS (SELECT DISTINCT item_id AS id, 'word:' || unnest(list_filter(regexp_extract_all(lower(text), '([a-z][a-z0-9_]{2,})', 1), lambda w: length(w) >= 4)) AS key FROM benchmark),
    kept AS (SELECT * FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 24))
    SELECT a.id AS "left", b.id AS "right", count(*) AS words FROM kept a JOIN kept b USING (key) WHERE a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2""")  # fmt: skip
def _(s, d):
    keys = table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.explode(scalars.word_keys(F.col("text"))).alias("w")).select("id", F.concat(F.lit("word:"), "w").alias("key"))
    return blocking.pairs(keys).select("left", "right", "words")


@query("content_dedupe", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def _(s, d):
    return textops.dedupe(table(s, d, "documents"), "doc_id", "text")


@query("span_ids", "SELECT doc_id, 'SPAN-' || substr(sha256(concat_ws(chr(31), doc_id, 0, octet_length(encode(text)))), 1, 16) AS span_id FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", scalars.digest_id("SPAN", F.col("doc_id"), F.lit(0), F.octet_length("text")).alias("span_id"))


@query("text_title", "SELECT doc_id, CASE WHEN length(split_part(text, chr(10), 1)) <= 120 AND split_part(text, chr(10), 2) = '' THEN split_part(text, chr(10), 1) END AS title FROM documents")
def _(s, d):
    lines = F.split("text", "\n")
    first, second = F.get(lines, 0), F.coalesce(F.get(lines, 1), F.lit(""))
    return table(s, d, "documents").select("doc_id", F.when((F.length(first) <= 120) & (second == ""), first).alias("title"))


@query("offerings", "SELECT conv_id, turn, concat_ws('|', lag(role) OVER w, role, lead(role) OVER w) AS around FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(s, d):
    return textops.neighbourhood(table(s, d, "conversations"), "conv_id", "turn", "role", 1, 1)


_GUESS = "n_chars > 400"


@query("confusion_matrix", f"SELECT quality AS expected, CAST({_GUESS} AS INTEGER) AS reached, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def _(s, d):
    j = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select(F.col("quality").alias("expected"), F.expr(f"cast({_GUESS} as int)").alias("reached"))
    return metrics.confusion(j, "expected", "reached")


@query("prf1", f"""WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND {_GUESS}) AS tp, count(*) FILTER (quality = 0 AND {_GUESS}) AS fp, count(*) FILTER (quality = 1 AND NOT {_GUESS}) AS fn
    FROM labels JOIN documents USING (doc_id) GROUP BY 1), r AS (SELECT *, coalesce(round_even(tp::DOUBLE / NULLIF(tp + fp, 0), 4), 0) AS p, coalesce(round_even(tp::DOUBLE / NULLIF(tp + fn, 0), 4), 1) AS q FROM c)
    SELECT lang, tp, fp, fn, p AS "precision", q AS recall, coalesce(round_even(2 * p * q / NULLIF(p + q, 0), 4), 0) AS f1 FROM r""")  # fmt: skip
def _(s, d):
    guess, good = F.expr(_GUESS), F.col("quality") == 1
    c = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").groupBy("lang").agg(F.count_if(good & guess).alias("tp"), F.count_if(~good & guess).alias("fp"), F.count_if(good & ~guess).alias("fn"))
    return c.select("*", *(x.alias(k) for k, x in metrics.prf(F.col("tp"), F.col("fp"), F.col("fn")).items()))


@query("overlap_match", """WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber AS n, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS a, CAST(l_shipdate AS DATE) - DATE '1970-01-01' + l_quantity AS b FROM lineitem),
    p AS (SELECT i.l_orderkey, i.n AS item_id, c.n AS record_id, least(i.b, c.b) - greatest(i.a, c.a) AS overlap FROM l i JOIN l c USING (l_orderkey) WHERE i.n % 2 = 1 AND c.n % 2 = 0 AND least(i.b, c.b) > greatest(i.a, c.a)),
    q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY overlap DESC, item_id, record_id) AS turn FROM p),
    g AS (SELECT l_orderkey, 0::BIGINT AS turn, []::INTEGER[] AS used, NULL::INTEGER AS item_id, NULL::INTEGER AS record_id, NULL::DOUBLE AS overlap FROM (SELECT DISTINCT l_orderkey FROM p)
        UNION ALL SELECT g.l_orderkey, q.turn, CASE WHEN free THEN g.used || [q.item_id::INTEGER, q.record_id::INTEGER] ELSE g.used END, CASE WHEN free THEN q.item_id END, CASE WHEN free THEN q.record_id END, CASE WHEN free THEN q.overlap END
        FROM g JOIN (SELECT * FROM q) q ON q.l_orderkey = g.l_orderkey AND q.turn = g.turn + 1, LATERAL (SELECT NOT list_contains(g.used, q.item_id::INTEGER) AND NOT list_contains(g.used, q.record_id::INTEGER) AS free))
    SELECT l_orderkey, item_id, record_id, overlap FROM g WHERE item_id IS NOT NULL""")
def _(s, d):
    o = table(s, d, "lineitem")
    at = F.unix_date(F.col("l_shipdate").cast("date"))
    items = o.where("l_linenumber % 2 = 1").select("l_orderkey", F.col("l_linenumber").alias("item_id"), at.alias("i_start"), (at + F.col("l_quantity")).alias("i_end"))
    claims = o.where("l_linenumber % 2 = 0").select("l_orderkey", F.col("l_linenumber").alias("record_id"), at.alias("c_start"), (at + F.col("l_quantity")).alias("c_end"))
    return metrics.overlap_pairs(items, claims, ["l_orderkey"])


def _bm25_sql(terms: list[str]) -> str:
    """Counts of each document, then of the whole, then scores; terms in order."""
    held = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{n}" for n, t in enumerate(terms))
    docs = ", ".join(f"count(*) FILTER (t{n} > 0) AS f{n}" for n in range(len(terms)))
    part = " + ".join(f"ln(1 + (d - f{n} + 0.5::DOUBLE) / (f{n} + 0.5::DOUBLE)) * t{n} * 2.2::DOUBLE / (t{n} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / m))" for n in range(len(terms)))
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, {held} FROM w),
        a AS (SELECT count(*) AS d, avg(n) AS m, {docs} FROM c), r AS (SELECT doc_id, round_even({part}, 6) AS score FROM c, a)
        SELECT doc_id, score FROM r WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20"""


@query("search_bm25", _bm25_sql(["benchmark", "license", "released"]))
def _(s, d):
    return textops.bm25(table(s, d, "documents"), "doc_id", "text", ["license", "released", "benchmark"], 20)


@query("expiry_fired", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate >= TIMESTAMP '1996-01-01' WHEN 1 THEN o_orderstatus = 'F' END AS fired FROM orders""")
def _(s, d):
    k = F.col("o_orderkey") % 3
    condition = F.when(k == 0, 'after("1996-01-01 00:00:00")').when(k == 1, 'on_event("order  F")').otherwise("when(x > 1)")
    seen = F.array(F.concat(F.lit("Order "), F.col("o_orderstatus")))
    return table(s, d, "orders").select("o_orderkey", monitoring.fired(condition, F.col("o_orderdate").cast("timestamp"), seen).alias("fired"))


@query("fusion_price", f"""WITH {EST}, {OUT}, {HIST}, {FACT} SELECT estimate_id, CASE WHEN work_class = 'unclassified' THEN 'unclassified_work' WHEN estimate_id % 10 = 0 THEN 'no_subject'
    WHEN factor IS NULL THEN 'no_factor' WHEN (estimated <= 150000) = (estimated * factor <= 150000) THEN 'unchanged' WHEN estimated <= 150000 THEN 'flipped' ELSE 'relieved' END AS verdict
    FROM est LEFT JOIN facs USING (owner, work_class)""")  # fmt: skip
def _(s, d):
    f = calibration.factors(_history(s, d)).select("owner", "work_class", "factor")
    e = estimates(s, d).join(f, ["owner", "work_class"], "left")
    subject = F.when(F.col("estimate_id") % 10 != 0, F.lit("total"))
    holds = lambda x: predicates.lower(predicates.parse("total <= 150000"), {"total": ("num", x)})
    verdict = monitoring.moved(F.col("estimate_id"), F.col("work_class") == "unclassified", subject, F.col("factor"), holds(F.col("estimated")), holds(F.col("estimated") * F.col("factor")))
    return e.select("estimate_id", verdict.alias("verdict"))


_SHAPE = "p_brand || '|' || p_type || '|' || CAST(p_size AS VARCHAR)"


@query("curator_duplicates", f"""WITH s AS (SELECT p_partkey AS id, {_SHAPE} AS shape, p_retailprice AS price FROM part), l AS (SELECT *, max(id) OVER (PARTITION BY shape) AS newer FROM s)
    SELECT id AS older, newer FROM l WHERE id <> newer AND price <= 1500""")  # fmt: skip
def _(s, d):
    shapes = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("shape"), F.col("p_partkey").alias("created_at"), "p_retailprice")
    dear = shapes.where("p_retailprice > 1500").select(F.col("id").alias("older"))
    return monitoring.merges(shapes, dear.join(monitoring.merges(shapes, dear.select("older", F.col("older").alias("newer"))), "older"))


@query("breach_severity", """SELECT c_nationkey, CASE WHEN bool_or(c_mktsegment = 'BUILDING' AND c_acctbal > 9000) THEN 'critical' WHEN bool_or(c_mktsegment = 'BUILDING') THEN 'high'
    WHEN bool_or(c_mktsegment = 'MACHINERY') THEN 'medium' ELSE 'low' END AS severity FROM customer GROUP BY 1""")  # fmt: skip
def _(s, d):
    impact = F.when(F.col("c_mktsegment") == "BUILDING", "high").when(F.col("c_mktsegment") == "MACHINERY", "medium").otherwise("low")
    scope = F.when(F.col("c_acctbal") > 9000, "organisation").otherwise("team")
    return monitoring.severity(table(s, d, "customer").select("c_nationkey", impact.alias("impact"), scope.alias("scope")), "c_nationkey")


@query("finding_diff", """SELECT e.user_id, e.n, CASE WHEN o.n IS NULL THEN 'added' WHEN o.n <> e.n THEN 'revised' ELSE 'kept' END AS action
    FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) e LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND value < 60 GROUP BY 1) o USING (user_id)""")  # fmt: skip
def _(s, d):
    e = table(s, d, "events").where("event_type = 'error'")
    count = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"))
    return monitoring.finding_changes(count(e), count(e.where("value < 60")), ["user_id"], "n")


_FLAT = r"""d AS (SELECT doc_id, lang, text, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS flat FROM documents),
    b AS (SELECT item_id, text, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS flat FROM benchmark)"""


@query("quote_verify_all", f"""WITH {_FLAT} SELECT doc_id, item_id, CASE WHEN contains(d.text, b.text) THEN 'exact' ELSE 'flattened' END AS verdict
    FROM d JOIN b ON b.flat <> '' AND contains(d.flat, b.flat)""")  # fmt: skip
def _(s, d):
    """Every item against every document: the quotations found, exact or but for white space."""
    return textops.quotations(table(s, d, "documents"), table(s, d, "benchmark").select("item_id", F.col("text").alias("claim")))


@query("trace_determinism", f"WITH {TR} SELECT agent, tokens, count(*) AS asked, count(DISTINCT cost) AS answers FROM t GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return traces(s, d).groupBy("agent", "tokens").agg(F.count("*").alias("asked"), F.countDistinct("cost").alias("answers")).where("asked > 1")


@query("evidence_lists", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
def _(s, d):
    pairs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(pairs, lambda p: p["l_partkey"].cast("string")), ",").alias("parts"))


@query("orphan_edges", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') GROUP BY 1")
def _(s, d):
    """Lines as edges to orders, of which pending ones are not stored."""
    edges = table(s, d, "lineitem").select(F.col("l_orderkey").alias("dst"), F.lit("order").alias("dst_kind"), F.col("l_orderkey").alias("src"), F.lit("line").alias("src_kind"), F.lit("x").alias("link_type"))
    nodes = table(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"))
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("line").alias("kind")).distinct()
    lost = trails.endpoints_missing(edges.withColumn("link_id", F.col("dst")), nodes.unionByName(lines)).where("end = 'dst'")
    return lost.groupBy(F.col("link_id").alias("l_orderkey")).agg(F.count("*").alias("n"))


@query("citation_gate_all", f"""WITH {_FLAT}, p AS (SELECT item_id, coalesce(lang, '') <> 'de' AS offered, coalesce(d.flat, '') <> '' AS resolvable,
        coalesce(b.flat <> '' AND contains(d.flat, b.flat), false) AS hit FROM d CROSS JOIN b),
    v AS (SELECT *, bool_or(hit AND offered) OVER (PARTITION BY item_id) AS elsewhere FROM p)
    SELECT item_id, CASE WHEN NOT offered THEN 'unoffered' WHEN NOT resolvable THEN 'unresolvable' WHEN hit THEN 'cited' WHEN elsewhere THEN 'misattributed' ELSE 'fabricated' END AS verdict,
    count(*) AS n FROM v GROUP BY 1, 2""")  # fmt: skip
def _(s, d):
    """Every item cited to every document, counted by verdict."""
    claims = table(s, d, "benchmark").select("item_id", F.col("text").alias("claim"))
    return citation.gate_all(table(s, d, "documents"), claims, F.col("lang") != "de")


@query("decision_detail", f"""WITH {EST}, {OUT}, {HIST}, li AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT estimate_id, owner, work_class, coalesce(n, 0) AS lines, coalesce(parts, '') AS parts, actual IS NOT NULL AS resolved FROM hist LEFT JOIN li ON l_orderkey = estimate_id""")  # fmt: skip
def _(s, d):
    pairs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    parts = F.array_join(F.transform(pairs, lambda p: p["l_partkey"].cast("string")), ",")
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("estimate_id")).agg(parts.alias("parts"), F.count("*").alias("n"))
    return _history(s, d).join(lines, "estimate_id", "left").select(
        "estimate_id", "owner", "work_class", F.coalesce("n", F.lit(0)).alias("lines"), F.coalesce("parts", F.lit("")).alias("parts"), F.col("actual").isNotNull().alias("resolved")
    )


@query("overview", f"""WITH {EST}, {OUT}, {HIST}, {FACT} SELECT arg_max(owner || '/' || work_class, magnitude) AS loudest, count(*) AS factors,
    count(*) FILTER (verdict = 'measured') AS measured FROM facs""")  # fmt: skip
def _(s, d):
    f = calibration.factors(_history(s, d))
    return f.agg(F.max_by(F.concat_ws("/", "owner", "work_class"), "magnitude").alias("loudest"), F.count("*").alias("factors"), F.count_if(F.col("verdict") == "measured").alias("measured"))
