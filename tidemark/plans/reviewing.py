"""Queries of reviews: drill-downs, collateral, findings, candidates, edges and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import blocking, calibration, metrics, monitoring, predicates, reviews, versioned
from tidemark.plans.registry import EST, FACT, HEAD, HIST, LINK, OUT, TR, VER, query
from tidemark.plans.testviews import estimates, links, outcomes, table, traces, versions


def _history(s: SparkSession, d: str) -> DataFrame:
    return calibration.history(estimates(s, d), outcomes(s, d))


_KEYS = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '([a-z][a-z0-9_]{{2,}})', 1), lambda w: length(w) >= 4))"


@query("bias_findings", f"""WITH {EST}, {OUT}, {HIST}, {FACT} SELECT owner, work_class, subject_id, magnitude, direction, CASE WHEN magnitude >= 4 THEN 'critical' WHEN magnitude >= 2 THEN 'high' ELSE 'medium' END AS severity
    FROM facs JOIN (SELECT owner, work_class, min(estimate_id) AS subject_id FROM est GROUP BY 1, 2) USING (owner, work_class) WHERE verdict = 'measured' AND direction <> 'none'""")  # fmt: skip
def _(s, d):
    return reviews.bias_findings(calibration.factors(_history(s, d)), estimates(s, d))


@query("unit_conversion", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity / 8 WHEN 1 THEN l_quantity * 40 WHEN 2 THEN l_quantity END AS converted FROM lineitem""")
def _(s, d):
    k = F.col("l_linenumber") % 4
    unit = F.when(k == 0, "hours").when(k == 1, "weeks").otherwise("points")
    to = F.when(k == 0, "days").when(k == 1, "hours").when(k == 2, "points").otherwise("hours")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", reviews.converted(F.col("l_quantity"), unit, to).alias("converted"))


@query("outcome_rows", f"WITH {EST}, {OUT} SELECT estimate_id, CASE WHEN actual IS NULL THEN 'unresolved' ELSE 'resolved' END AS outcome FROM est LEFT JOIN outc USING (estimate_id)")
def _(s, d):
    o = outcomes(s, d).where("actual is not null").select("estimate_id", F.lit("resolved").alias("outcome"))
    return estimates(s, d).select("estimate_id").join(o, "estimate_id", "left").select("estimate_id", F.coalesce("outcome", F.lit("unresolved")).alias("outcome"))


@query("estimate_detail", f"""WITH {EST}, {OUT}, {HIST}, f AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS findings, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1)
    SELECT estimate_id, estimated, actual, coalesce(findings, 0) AS findings, coalesce(parts, 0) AS parts FROM hist LEFT JOIN f ON l_orderkey = estimate_id""")  # fmt: skip
def _(s, d):
    f = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("estimate_id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("findings"), F.countDistinct("l_partkey").alias("parts"))
    return _history(s, d).join(f, "estimate_id", "left").select("estimate_id", "estimated", "actual", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("parts", F.lit(0)).alias("parts"))


@query("collateral_walk", f"""WITH RECURSIVE {LINK}, misses AS (SELECT 'R-' || r_regionkey AS root FROM region UNION ALL SELECT 'P-' || p_partkey FROM part),
    w(root, node, depth) AS (SELECT root, root, 0 FROM misses UNION SELECT root, l.src, depth + 1 FROM w JOIN link l ON l.dst = w.node WHERE depth < 16),
    r AS (SELECT root, node, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1, 2), g AS (SELECT root, count(*) FILTER (node LIKE 'O-%') AS decisions, count(*) FILTER (node LIKE 'C-%') AS assumptions,
    min(depth) FILTER (node LIKE 'O-%') AS nearest FROM r GROUP BY 1)
    SELECT root, coalesce(decisions, 0) AS decisions, coalesce(assumptions, 0) AS assumptions, CAST(nearest AS INTEGER) AS nearest, coalesce(decisions, 0) > 0 AS damaging FROM misses LEFT JOIN g USING (root)""")  # fmt: skip
def _(s, d):
    def ids(name: str, p: str, key: str) -> DataFrame:
        return table(s, d, name).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("node"))

    misses = ids("region", "R-", "r_regionkey").unionByName(ids("part", "P-", "p_partkey")).withColumnRenamed("node", "root")
    kinds = ids("orders", "O-", "o_orderkey").withColumn("kind", F.lit("decision")).unionByName(ids("customer", "C-", "c_custkey").withColumn("kind", F.lit("assumption")))
    return reviews.collateral(misses, links(s, d), kinds)


@query("resting_on", f"WITH {LINK} SELECT dst AS id, src AS decision FROM link JOIN orders ON src = 'O-' || o_orderkey WHERE link_type = 'assumes' AND o_orderstatus <> 'F'")
def _(s, d):
    live = table(s, d, "orders").where("o_orderstatus <> 'F'").select(F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("decision"))
    return reviews.resting_on(links(s, d), live)


@query("edges_touching", f"WITH {LINK} SELECT node, count(*) AS n FROM (SELECT src AS node FROM link UNION ALL SELECT dst FROM link) GROUP BY 1")
def _(s, d):
    return reviews.touching(links(s, d)).groupBy("node").agg(F.count("*").alias("n"))


@query("edge_grammar", """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN l_linestatus = 'O' ELSE false END AS valid FROM lineitem""")
def _(s, d):
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "assumes").when(flag == "N", "supersedes").otherwise("estimated_as")
    source = F.when(flag == "R", "estimate").otherwise("decision")
    target = F.when((flag == "N") & (F.col("l_linestatus") == "O"), "decision").otherwise("assumption")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", reviews.endpoints_valid(kind, source, target).alias("valid"))


@query("record_ids", """SELECT p_partkey, id, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN p_partkey >= 1000 ELSE false END AS canonical, split_part(id, '-', 1) AS prefix FROM (SELECT p_partkey,
    CASE p_partkey % 6 WHEN 0 THEN printf('EST-%04d', p_partkey) WHEN 1 THEN 'D-' || p_partkey WHEN 2 THEN printf('A-%06d', p_partkey % 90000) WHEN 3 THEN printf('est-%04d', p_partkey) WHEN 4 THEN 'EST-' || p_partkey || 'x' ELSE 'EST' END AS id FROM part)""")
def _(s, d):
    """Ids as they are made, without their zeros, with too many, in small letters, with something behind, and bare."""
    k = F.col("p_partkey")
    ids = [scalars.sequential_id("EST", k), F.concat(F.lit("D-"), k.cast("string")), F.format_string("A-%06d", k % 90000), F.format_string("est-%04d", k), F.concat(F.lit("EST-"), k.cast("string"), F.lit("x")), F.lit("EST")]
    made = table(s, d, "part").select("p_partkey", F.element_at(F.array(*ids), (k % 6 + 1).cast("int")).alias("id"))
    return made.select("p_partkey", "id", scalars.canonical_id(F.col("id")).alias("canonical"), scalars.id_prefix(F.col("id")).alias("prefix"))


@query("retractions", f"WITH {HEAD} SELECT id, CAST(version + 1 AS INTEGER) AS version, true AS retracted, event_id, payload FROM head WHERE NOT retracted AND payload < 50")
def _(s, d):
    v = versions(s, d)
    return versioned.retract(v, versioned.standing(v).where("payload < 50").select("id"))


@query("record_exists", f"WITH {VER} SELECT c_custkey, c_custkey IN (SELECT id FROM v) AS known FROM customer")
def _(s, d):
    known = versions(s, d).select(F.col("id").alias("c_custkey")).distinct().withColumn("known", F.lit(True))
    return table(s, d, "customer").join(known, "c_custkey", "left").select("c_custkey", F.coalesce("known", F.lit(False)).alias("known"))


@query("calls_by_agent", f"WITH {TR} SELECT agent, run_id, count(*) AS calls FROM t GROUP BY 1, 2")
def _(s, d):
    return traces(s, d).groupBy("agent", "run_id").agg(F.count("*").alias("calls"))


@query("trace_index", f"WITH {TR} SELECT seq, run_id FROM t WHERE agent = 'error' ORDER BY seq DESC LIMIT 50")
def _(s, d):
    return versioned.page(traces(s, d).where("agent = 'error'"), "seq", None).select("seq", "run_id")


@query("monitor_changes", """WITH v AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'breached' WHEN 'O' THEN 'holding' ELSE 'unverified' END AS status,
    CASE WHEN o_totalprice > 150000 THEN 'breached' ELSE 'holding' END AS new_status FROM orders) SELECT * FROM v WHERE status <> new_status""")  # fmt: skip
def _(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "breached").when(F.col("o_orderstatus") == "O", "holding").otherwise("unverified")
    holds = predicates.lower(predicates.parse("total <= 150000"), {"total": ("num", F.col("o_totalprice"))})
    v = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), monitoring.status(holds, F.lit(False)).alias("new_status"))
    return monitoring.changes(v)


@query("breach_findings", """SELECT c_custkey, 'C-' || c_custkey || ' no longer holds; ' || count(*) || ' decision(s) rest on it: ' || string_agg('O-' || o_orderkey, ', ' ORDER BY o_orderkey) AS prosecution
    FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 1""")  # fmt: skip
def _(s, d):
    met = table(s, d, "customer").where("c_acctbal < 0").join(table(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    g = met.groupBy("c_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    named = F.array_join(F.transform("o", lambda x: F.concat(F.lit("O-"), x.cast("string"))), ", ")
    return g.select("c_custkey", F.concat(F.format_string("C-%d no longer holds; %d decision(s) rest on it: ", "c_custkey", F.size("o")), named).alias("prosecution"))


@query("awaited_events", "SELECT DISTINCT lower(trim(p_type)) AS event FROM part WHERE lower(trim(p_type)) NOT IN (SELECT lower(trim(c_mktsegment)) FROM customer)")
def _(s, d):
    return reviews.awaited(table(s, d, "part").select(F.col("p_type").alias("event")), table(s, d, "customer").select(F.col("c_mktsegment").alias("event")))


@query("world_layers", "SELECT CAST(user_id AS VARCHAR) AS name, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(s, d):
    return reviews.layered(table(s, d, "events").select(F.col("user_id").cast("string").alias("name"), "value", F.col("event_id").alias("layer")))


@query("derived_facts", f"""WITH {OUT} SELECT c_mktsegment AS name, arg_max(actual, (o_orderdate, o_orderkey)) AS value FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN outc ON estimate_id = o_orderkey WHERE actual IS NOT NULL AND o_orderstatus <> 'P' GROUP BY 1""")  # fmt: skip
def _(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    unit = F.when(F.col("o_orderstatus") == "P", "points").otherwise("days")
    a = o.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("subject"), unit.alias("unit"), F.col("o_orderdate").alias("created_at"))
    edges = a.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return reviews.measured_facts(a, edges, outcomes(s, d).withColumn("unit", F.lit("days")))


@query("predicate_subjects", """SELECT p_partkey, 'size <= ' || p_size || CASE WHEN p_size % 2 = 1 THEN ' and price > 5' ELSE '' END AS rendered, CASE WHEN p_size % 2 = 0 THEN 'size' END AS subject,
    CASE WHEN p_size % 2 = 1 THEN 'price,size' ELSE 'size' END AS names FROM part""")  # fmt: skip
def _(s, d):
    text = F.concat(F.lit("size<="), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 1, "  AND price > 5").otherwise(""))
    told = predicates.described(table(s, d, "part").select("p_partkey", text.alias("predicate")), "predicate")
    return told.select("p_partkey", "rendered", "subject", F.array_join("names", ",").alias("names"))


@query("predicate_reasons", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'unbound: price' WHEN p_size < 20 THEN 'unbound: age' ELSE 'bound' END AS reason FROM part")
def _(s, d):
    facts = F.when(F.col("p_size") < 10, F.create_map(F.lit("age"), F.lit(1))).when(F.col("p_size") < 20, F.create_map(F.lit("price"), F.lit(1))).otherwise(F.create_map(F.lit("price"), F.lit(1), F.lit("age"), F.lit(1)))
    missing = predicates.unbound(F.array(F.lit("price"), F.lit("age")), facts)
    return table(s, d, "part").select("p_partkey", F.when(F.size(missing) > 0, F.concat(F.lit("unbound: "), missing[0])).otherwise("bound").alias("reason"))


@query("first_conflicts", """WITH r AS (SELECT s_suppkey AS id, 's' || s_nationkey || '|' || CAST(floor(s_acctbal / 1000) AS BIGINT) AS name, s_acctbal AS v FROM supplier) SELECT a.id AS a_id, b.id AS b_id, a.name FROM r a JOIN r b USING (name) WHERE a.id < b.id AND a.v <> b.v""")
def _(s, d):
    point = F.col("s_acctbal")
    one = F.struct(F.concat(F.lit("s"), F.col("s_nationkey").cast("string"), F.lit("|"), F.floor(point / 1000).cast("string")).alias("name"), point.alias("low"), F.lit(True).alias("low_closed"), point.alias("high"), F.lit(True).alias("high_closed"), F.lit("range").alias("kind"), F.lit(None).cast("string").alias("value"))
    r = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(one).alias("ranges"))
    return predicates.conflicts(r, r).where("a_id < b_id")


@query("subject_keys", "SELECT p_partkey, ['subject:price', 'subject:' || lower(split_part(p_type, ' ', 1))] AS keys FROM part")
def _(s, d):
    names = F.array_sort(F.array(F.lit("price"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))))
    keys = F.array(F.lit("subject:price"), F.concat(F.lit("subject:"), F.array_except(names, F.array(F.lit("price")))[0]))
    return table(s, d, "part").select("p_partkey", keys.alias("keys"))


@query("strongest_pairs", f"""WITH k AS (SELECT DISTINCT item_id AS id, 'word:' || unnest({_KEYS('text')}) AS key FROM benchmark), kept AS (SELECT * FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 24))
    SELECT a.id AS "left", b.id AS "right", count(*) AS words FROM kept a JOIN kept b USING (key) WHERE a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY words DESC, "left", "right" LIMIT 60""")  # fmt: skip
def _(s, d):
    keys = table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.explode(scalars.word_keys(F.col("text"))).alias("w")).select("id", F.concat(F.lit("word:"), "w").alias("key"))
    return blocking.ranked(blocking.pairs(keys), 60).select("left", "right", "words")


@query("skipped_keys", f"""WITH k AS (SELECT DISTINCT doc_id AS id, unnest({_KEYS('text')}) AS key FROM documents) SELECT key, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 24""")
def _(s, d):
    keys = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.explode(scalars.word_keys(F.col("text"))).alias("key"))
    return blocking.buckets(keys)[1]


@query("candidate_passages", f"""WITH a AS (SELECT p_partkey AS estimate, p_partkey % 5 AS own, unnest({_KEYS("p_name || ' steel copper nickel'")}) AS word FROM part), p AS (SELECT item_id AS passage, unnest({_KEYS('text')}) AS word FROM benchmark),
    m AS (SELECT estimate, own, passage, count(*) AS words FROM a JOIN p USING (word) GROUP BY 1, 2, 3 HAVING count(*) >= 2 OR own = passage
    UNION ALL SELECT p_partkey, p_partkey % 5, item_id, 0 FROM part JOIN benchmark ON item_id = p_partkey % 5), g AS (SELECT estimate, own, passage, max(words) AS words FROM m GROUP BY 1, 2, 3)
    SELECT estimate, passage, words, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY estimate ORDER BY (own = passage) DESC, words DESC, passage) AS rank FROM g) WHERE rank <= 3""")  # fmt: skip
def _(s, d):
    words = scalars.word_keys(F.concat(F.col("p_name"), F.lit(" steel copper nickel")))
    wanted = table(s, d, "part").select(F.col("p_partkey").alias("estimate"), (F.col("p_partkey") % 5).alias("own"), words.alias("words"))
    return reviews.candidates(wanted, table(s, d, "benchmark").select(F.col("item_id").alias("passage"), scalars.word_keys(F.col("text")).alias("words")), 3, 2)


@query("new_edges", """SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_partkey = lineitem.l_partkey AND o.l_suppkey = lineitem.l_suppkey AND o.l_returnflag = 'A')""")
def _(s, d):
    lines = table(s, d, "lineitem")
    return lines.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct().join(lines.where("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"], "left_anti")


@query("rejected_options", "SELECT p_partkey, p_size % 2 = 0 AS recorded FROM part")
def _(s, d):
    """Spelling and white space aside; an option that was never put down is not recorded."""
    spelt = F.concat(F.lit("  "), F.upper(F.regexp_replace("p_type", " ", "  ")), F.lit(" "))
    option = F.when(F.col("p_size") % 2 == 0, spelt).otherwise(F.concat(spelt, F.lit("x")))
    recorded = F.exists(F.array("p_brand", "p_type"), lambda r: scalars.folded(r) == scalars.folded(option))
    return table(s, d, "part").select("p_partkey", recorded.alias("recorded"))


@query("retirements", """WITH f AS (SELECT user_id AS id, min(ts) AS first, bool_or(event_type = 'error' AND value > 95) AS watched FROM events GROUP BY 1), t AS (SELECT max(ts) AS now FROM events)
    SELECT id, CASE WHEN i < 10 THEN 'too_recent' WHEN u THEN 'still_in_use' END AS refused, i >= 10 AS idle FROM (SELECT c_custkey AS id, CAST(floor((epoch(now) - epoch(first)) / 86400) AS BIGINT) AS i,
    c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS u FROM customer JOIN f ON id = c_custkey, t WHERE c_acctbal > 0 AND NOT watched)""")  # fmt: skip
def _(s, d):
    status = F.when(F.col("c_acctbal") > 0, "unverified").otherwise("holding")
    a = table(s, d, "customer").select(F.col("c_custkey").alias("id"), status.alias("status"))
    e = table(s, d, "events")
    actor = F.when(F.expr("event_type = 'error' and value > 95"), "monitor").otherwise("writer")
    audit = e.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("occurred_at"), actor.alias("actor"))
    now = e.agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    return monitoring.retirements(a, audit, table(s, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id")), now, 10)


_FAILED = {"low_value": "value < 10", "error": "event_type = 'error'", "unverified": "user_id % 5 = 0"}


@query("abstention_rate", f"""SELECT count(*) AS total, round_even((count(*) FILTER ({' OR '.join(_FAILED.values())}))::DOUBLE / count(*), 4) AS needs_human FROM events""")
def _(s, d):
    route = F.when(F.expr(" or ".join(_FAILED.values())), "needs_human").otherwise("emit")
    return metrics.shares(table(s, d, "events").select(route.alias("route")), "route", ["needs_human"])


@query("abstention_rules", " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n FROM events WHERE {c}" for k, c in _FAILED.items()))
def _(s, d):
    failed = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in _FAILED.items())))
    return table(s, d, "events").select(F.explode(failed).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("concede_rate", "SELECT event_type, count(*) AS decided, round_even((count(*) FILTER (value < 20))::DOUBLE / count(*), 4) AS conceded FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("decided"), metrics.rate(F.count_if(F.col("value") < 20), F.count("*")).alias("conceded"))


@query("mae_improvement", """SELECT c_nationkey, round_even(a - b, 4) AS absolute, coalesce(round_even((a - b) / NULLIF(a, 0), 4), 0) AS relative FROM (SELECT c_nationkey, max(c_acctbal) AS a, min(c_acctbal) AS b FROM customer GROUP BY 1)""")
def _(s, d):
    g = table(s, d, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("a"), F.min("c_acctbal").alias("b"))
    absolute, relative = reviews.improvement(F.col("a"), F.col("b"))
    return g.select("c_nationkey", absolute.alias("absolute"), relative.alias("relative"))


@query("formal_confidence", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN l_discount * l_tax * 100 ELSE least(l_discount * l_tax * 100, 0.3) END AS confidence FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", reviews.confidence(F.col("l_returnflag") == "N", F.col("l_discount") * F.col("l_tax"), F.lit(100)).alias("confidence"))
