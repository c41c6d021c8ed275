"""Queries of grading against an answer key, and of what calls cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics, predicates, pricing
from tidemark.plans.registry import TR, query
from tidemark.plans.testviews import table, traces

_RUNGS = {1: "n_chars > 200", 2: "n_chars > 200 AND lang <> 'de'", 3: "n_chars > 200 AND lang <> 'de' AND source IS NOT NULL"}
_PRF = """coalesce(round_even(tp::DOUBLE / NULLIF(tp + fp, 0), 4), 0) AS "precision", coalesce(round_even(tp::DOUBLE / NULLIF(tp + fn, 0), 4), 1) AS recall"""
_F1 = 'coalesce(round_even(2 * "precision" * recall / NULLIF("precision" + recall, 0), 4), 0) AS f1'
_COUNTS = "count(*) FILTER (quality = 1 AND {g}) AS tp, count(*) FILTER (quality = 0 AND {g}) AS fp, count(*) FILTER (quality = 1 AND NOT ({g})) AS fn"


def _graded(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").join(table(s, d, "documents"), "doc_id")


def _counts(guess: str) -> list:
    g, good = F.coalesce(F.expr(guess), F.lit(False)), F.col("quality") == 1
    return [F.count_if(good & g).alias("tp"), F.count_if(~good & g).alias("fp"), F.count_if(good & ~g).alias("fn")]


@query("score_overall", f"WITH c AS (SELECT {_COUNTS.format(g='n_chars > 400')} FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, {_PRF} FROM c) SELECT *, {_F1} FROM r")
def _(s, d):
    return metrics.overall(_graded(s, d).groupBy("lang").agg(*_counts("n_chars > 400")))


def _ladder(s: SparkSession, d: str) -> DataFrame:
    """Each rung adds a stage to the ones before; all rungs are counted in one pass."""
    seen = _graded(s, d).select("quality", F.inline(F.array(*(F.struct(F.lit(k).alias("rung"), F.coalesce(F.expr(g), F.lit(False)).alias("g")) for k, g in _RUNGS.items()))))
    counts = seen.groupBy("rung").agg(*_counts("g"))
    return counts.select("rung", *(x.alias(k) for k, x in metrics.prf(F.col("tp"), F.col("fp"), F.col("fn")).items()))


_LADDER = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS rung, {_COUNTS.format(g=f'coalesce({g}, false)')} FROM labels JOIN documents USING (doc_id)" for k, g in _RUNGS.items())
_LADDER = f"WITH c AS ({_LADDER}), r AS (SELECT rung, {_PRF} FROM c), l AS (SELECT rung, \"precision\", recall, {_F1} FROM r)"


@query("ablation_ladder", f"{_LADDER} SELECT * FROM l")
def _(s, d):
    return _ladder(s, d)


@query("ablation_deltas", f"""{_LADDER} SELECT rung, round_even("precision" - lag("precision") OVER w, 4) AS precision_delta, round_even(recall - lag(recall) OVER w, 4) AS recall_delta,
    round_even(f1 - lag(f1) OVER w, 4) AS f1_delta FROM l WINDOW w AS (ORDER BY rung)""")  # fmt: skip
def _(s, d):
    return metrics.deltas(_ladder(s, d), "rung", ["precision", "recall", "f1"])


@query("pair_score", f"""WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), f AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'),
    c AS (SELECT count(*) FILTER (e AND f) AS tp, count(*) FILTER (f AND NOT e) AS fp, count(*) FILTER (e AND NOT f) AS fn FROM (SELECT bool_or(k = 1) AS e, bool_or(k = 2) AS f
    FROM (SELECT *, 1 AS k FROM e UNION ALL SELECT *, 2 FROM f) GROUP BY l_orderkey, l_partkey)), r AS (SELECT *, {_PRF} FROM c) SELECT *, {_F1} FROM r""")  # fmt: skip
def _(s, d):
    lines = table(s, d, "lineitem")
    return metrics.pair_score(lines.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey"), lines.where("l_linestatus = 'F'").select("l_orderkey", "l_partkey"))


@query("symmetric_pairs", "SELECT DISTINCT least(l_partkey, l_suppkey) AS l_partkey, greatest(l_partkey, l_suppkey) AS l_suppkey FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select(*metrics.unordered("l_partkey", "l_suppkey")).distinct()


@query("field_compare", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN trim(p_name) = trim(' ' || p_name) WHEN 1 THEN contains(lower(p_type), lower(trim(p_brand)))
    WHEN 2 THEN true ELSE abs(CAST(p_retailprice AS DECIMAL(28,8)) - CAST(p_size AS DECIMAL(28,8)) * 30) <= 200 END AS ok FROM part""")  # fmt: skip
def _(s, d):
    k = F.col("p_partkey") % 4
    comparison = F.when(k == 0, "exact").when(k == 1, "contains").when(k == 2, "set").otherwise("numeric")
    expected = F.when(k == 0, F.concat(F.lit(" "), "p_name")).when(k == 1, F.col("p_brand")).when(k == 2, F.concat_ws("|", "p_brand", "p_type")).otherwise((F.col("p_size") * 30).cast("string"))
    actual = F.when(k == 0, F.col("p_name")).when(k == 1, F.col("p_type")).when(k == 2, F.concat_ws(" | ", F.upper("p_type"), "p_brand", "p_type")).otherwise(F.col("p_retailprice").cast("string"))
    return table(s, d, "part").select("p_partkey", metrics.field_matches(comparison, expected, actual, F.lit(200)).alias("ok"))


@query("exact_matches", "SELECT l_orderkey, bool_and(l_quantity > 5 AND l_discount < 0.09) AS exact FROM lineitem GROUP BY 1")
def _(s, d):
    return metrics.exact_matches(table(s, d, "lineitem").select("l_orderkey", F.expr("l_quantity > 5 AND l_discount < 0.09").alias("ok")), ["l_orderkey"])


@query("missed_and_spurious", """SELECT 'missed' AS side, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'spurious', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")  # fmt: skip
def _(s, d):
    items = table(s, d, "documents").select(F.col("doc_id").alias("item_id"), F.lit(0).alias("g"))
    claims = table(s, d, "labels").select(F.col("doc_id").alias("record_id"), F.lit(0).alias("g"))
    matched = items.join(claims.drop("g"), F.col("item_id") == F.col("record_id"))
    missed, spurious = metrics.unmatched(items, claims, matched, ["g"])
    return missed.agg(F.lit("missed").alias("side"), F.count("*").alias("n")).unionByName(spurious.agg(F.lit("spurious").alias("side"), F.count("*").alias("n")))


_VERDICT = "CASE WHEN event_type = 'error' THEN 'fabricated' WHEN event_type = 'signup' THEN 'misattributed' ELSE 'cited' END"


@query("citation_integrity", f"""SELECT count(*) AS total, round_even((count(*) FILTER (v = 'cited'))::DOUBLE / count(*), 4) AS cited, round_even((count(*) FILTER (v = 'fabricated'))::DOUBLE / count(*), 4) AS fabricated,
    round_even((count(*) FILTER (v = 'misattributed'))::DOUBLE / count(*), 4) AS misattributed FROM (SELECT {_VERDICT} AS v FROM events)""")  # fmt: skip
def _(s, d):
    return metrics.shares(table(s, d, "events").select(F.expr(_VERDICT).alias("v")), "v", ["cited", "fabricated", "misattributed"])


@query("monitoring_score", f"""WITH v AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'breached' WHEN o_orderstatus = 'P' THEN 'expired' ELSE 'holding' END AS e,
    coalesce(r, 'unverified') AS r FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN bool_or(l_linestatus = 'F') THEN 'breached' ELSE 'holding' END AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
    c AS (SELECT count(*) AS graded, count(*) FILTER (e = r) AS ok, count(*) FILTER (e = 'expired' AND r = 'breached') AS aged_as_breached, count(*) FILTER (e = 'breached' AND r = 'breached') AS tp,
    count(*) FILTER (e <> 'breached' AND r = 'breached') AS fp, count(*) FILTER (e = 'breached' AND r <> 'breached') AS fn FROM v)
    SELECT graded, aged_as_breached, round_even(ok::DOUBLE / graded, 4) AS accuracy, {_PRF} FROM c""")  # fmt: skip
def _(s, d):
    status = F.col("o_orderstatus")
    expected = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(status == "F", "breached").when(status == "P", "expired").otherwise("holding").alias("expected"))
    reached = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.when(F.bool_or(F.col("l_linestatus") == "F"), "breached").otherwise("holding").alias("reached"))
    return metrics.monitoring_score(expected, reached, "id")


@query("parse_rates", "SELECT count(*) AS total, round_even((count(*) FILTER (p_size % 3 = 0))::DOUBLE / count(*), 4) AS parsed FROM part")
def _(s, d):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("size <= "), size)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("1 < size < "), size)).otherwise(F.concat(F.lit("size = "), size))
    told = predicates.described(table(s, d, "part").select(text.alias("predicate")), "predicate")
    return told.agg(F.count("*").alias("total"), metrics.rate(F.count_if("parses"), F.count("*")).alias("parsed"))


@query("classification_score", """SELECT l.lang, count(*) AS classified, count(*) FILTER (quality = 1) AS agreed, count(DISTINCT source) AS classes FROM documents l JOIN labels USING (doc_id) GROUP BY 1""")
def _(s, d):
    return _graded(s, d).groupBy("lang").agg(F.count("*").alias("classified"), F.count_if(F.col("quality") == 1).alias("agreed"), F.countDistinct("source").alias("classes"))


@query("proposed_vocabulary", "SELECT DISTINCT p_brand || ' ' || p_type AS label FROM part WHERE p_size > 40 AND p_brand || ' ' || p_type NOT IN (SELECT p_brand || ' ' || p_type FROM part WHERE p_size < 15)")
def _(s, d):
    p = table(s, d, "part").withColumn("label", F.concat_ws(" ", "p_brand", "p_type"))
    return metrics.vocabulary(p.where("p_size > 40"), p.where("p_size < 15"), "label")


@query("match_losses", """SELECT CASE WHEN actual IS NULL THEN 'no_outcome' WHEN actual < estimated THEN 'less' ELSE 'more' END AS reason, count(*) AS n
    FROM (SELECT o_totalprice AS estimated, q AS actual FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) * 1000 AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1""")  # fmt: skip
def _(s, d):
    q = table(s, d, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity") * 1000).alias("actual"))
    o = table(s, d, "orders").join(q, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    reason = F.when(F.col("actual").isNull(), "no_outcome").when(F.col("actual") < F.col("o_totalprice"), "less").otherwise("more")
    return o.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("memory_grade", """WITH f AS (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem), n AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0)
    SELECT count(DISTINCT CASE WHEN x.k IS NOT NULL AND y.k IS NOT NULL THEN least(a, b) || '-' || greatest(a, b) END) AS found, count(*) FILTER (x.k IS NULL OR y.k IS NULL) AS unnamed
    FROM f LEFT JOIN n x ON x.k = a LEFT JOIN n y ON y.k = b""")  # fmt: skip
def _(s, d):
    """Pairs in the key's own ids; edges with an end that the key does not name are counted apart."""
    key = table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"))
    edges = table(s, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    named = edges.join(key.select(F.col("k").alias("ka")), F.col("a") == F.col("ka"), "left").join(key.select(F.col("k").alias("kb")), F.col("b") == F.col("kb"), "left")
    whole = F.col("ka").isNotNull() & F.col("kb").isNotNull()
    return named.agg(F.countDistinct(F.when(whole, F.concat_ws("-", F.least("a", "b"), F.greatest("a", "b")))).alias("found"), F.count_if(~whole).alias("unnamed"))


@query("key_check", """SELECT CASE WHEN n > 1 THEN 'repeated_id' WHEN o IS NULL THEN 'dangling_link' ELSE 'ok' END AS verdict, count(*) AS n FROM
    (SELECT o_orderkey AS o, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1""")  # fmt: skip
def _(s, d):
    lines = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"))
    met = lines.join(table(s, d, "orders").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    verdict = F.when(F.col("copies") > 1, "repeated_id").when(F.col("o_orderkey").isNull(), "dangling_link").otherwise("ok")
    return met.groupBy(verdict.alias("verdict")).agg(F.sum("copies").alias("n"))


@query("expected_edges", "SELECT l_orderkey AS source, l_partkey AS target FROM lineitem WHERE l_returnflag = 'A'")
def _(s, d):
    link = F.struct(F.col("l_returnflag").alias("link_type"), F.col("l_partkey").alias("target_item_id"))
    return metrics.expected_edges(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_list(link).alias("links")), "A")


@query("call_price", f"WITH {TR} SELECT seq, CAST(3 * (tokens + 0.1 * (tokens % 7) + 1.25 * (tokens % 3)) + 15 * (tokens % 11) AS DOUBLE) AS micro_usd FROM t WHERE tokens IS NOT NULL")
def _(s, d):
    t = traces(s, d).where("tokens is not null")
    k = F.col("tokens")
    return t.select("seq", (pricing.call_cost(F.lit(3), F.lit(15), k, k % 11, k % 7, k % 3) * 1000000).cast("double").alias("micro_usd"))


@query("worst_price", "SELECT doc_id, CAST((3 * ceil(n_chars / 2.0) + 15 * 1024) / 1000000 AS DOUBLE) AS usd FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", pricing.worst_cost(F.lit(3), F.lit(15), F.col("n_chars"), F.lit(1024)).cast("double").alias("usd"))


@query("cost_per_document", f"WITH {TR} SELECT agent, round_even(CAST(sum(cost) AS DOUBLE) / (SELECT count(*) FROM documents), 6) AS cost_per_document FROM t GROUP BY 1")
def _(s, d):
    spent = traces(s, d).groupBy("agent").agg(F.sum("cost").cast("double").alias("cost"))
    return pricing.per_document(spent, table(s, d, "documents").agg(F.count("*")).scalar())


@query("projected_cost", f"WITH {TR}, p(agent, i, o) AS (VALUES ('view', 1, 5), ('click', 3, 15)) SELECT agent, CAST((i * sum(tokens) + o * count(*)) / 1000000 AS DOUBLE) AS cost FROM t JOIN p USING (agent) GROUP BY agent, i, o")
def _(s, d):
    prices = s.createDataFrame([("view", 1, 5), ("click", 3, 15)], "agent string, in_price int, out_price int")
    tokens = traces(s, d).groupBy("agent").agg(F.sum("tokens").alias("tokens_in"), F.count("*").alias("tokens_out"))
    return pricing.projected(tokens, prices).withColumn("cost", F.col("cost").cast("double"))


@query("prompt_versions", f"WITH {TR} SELECT DISTINCT run_id, tokens FROM t WHERE tokens IS NOT NULL")
def _(s, d):
    return traces(s, d).where("tokens is not null").select("run_id", "tokens").distinct()


@query("trace_sequence", f"WITH {TR} SELECT run_id, agent, max(seq) AS seq, count(*) AS attempts FROM t GROUP BY 1, 2")
def _(s, d):
    return traces(s, d).groupBy("run_id", "agent").agg(F.max("seq").alias("seq"), F.count("*").alias("attempts"))
