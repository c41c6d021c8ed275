"""Queries of segmentation, spans and quotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import segments, textops
from tidemark.plans.registry import query
from tidemark.plans.testviews import table

_INK = r"[\s\p{Z}\x{85}]+"


#: A document with a heading, lists, fenced code, a table and a quote around and inside of its text.
_MARKED_SQL = r"""'# Doc ' || doc_id || chr(10) || replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10) || '- ') || chr(10) || '```py' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '~~~' || chr(10) || '```'
    || chr(10) || '| a |' || chr(10) || '  | ü |' || chr(10) || '> q' || chr(10) || '  after'"""


def _marked(s, d):
    text = F.coalesce("text", F.lit(""))
    lists = F.replace(text, F.lit(". "), F.lit(".\n\n- "))
    return table(s, d, "documents").withColumn(
        "text", F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n"), lists, F.lit("\n```py\n"), text, F.lit("\n\n~~~\n```\n| a |\n  | ü |\n> q\n  after"))
    )


def _grid_sql() -> str:
    """Lines with their kinds, gone through one by one for what each opens or continues; then groups of lines, cut from the text and trimmed."""
    ink = r"[\s\p{Z}\x{85}]"
    kind = rf"""CASE WHEN regexp_replace(line, '{ink}+', '', 'g') = '' THEN '' WHEN regexp_matches(line, '^ {{0,3}}(`{{3,}}|~{{3,}})') THEN 'code' WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}{ink}+[^\s]') THEN 'heading'
        WHEN regexp_matches(line, '^{ink}*\|') THEN 'table' WHEN regexp_matches(line, '^{ink}*>') THEN 'quote' WHEN regexp_matches(line, '^ {{0,3}}([-*+]|\d{{1,9}}[.)]){ink}+[^\s]') THEN 'list_item' ELSE 'paragraph' END"""
    joins = "((l.kind = s.open AND l.kind IN ('table', 'quote')) OR (l.kind = 'paragraph' AND s.open IN ('paragraph', 'list_item')))"
    return rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_MARKED_SQL} AS text FROM documents),
        r AS (SELECT rid, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d),
        l AS (SELECT rid, i, line, {kind} AS kind, ltrim(line)[1] AS mark, sum(length(line) + 1) OVER (PARTITION BY rid ORDER BY i) - length(line) - 1 AS a FROM r),
        s(rid, i, open, fence, g, held) AS (SELECT rid, 0::BIGINT, '', '', 0, false FROM d
            UNION ALL SELECT s.rid, l.i, CASE WHEN s.open = 'code' THEN CASE WHEN l.kind = 'code' AND l.mark = s.fence THEN '' ELSE 'code' END WHEN {joins} THEN s.open ELSE l.kind END,
                CASE WHEN s.open = 'code' OR {joins} THEN s.fence ELSE l.mark END, CASE WHEN s.open = 'code' OR {joins} OR l.kind = '' THEN s.g ELSE s.g + 1 END, s.open = 'code' OR l.kind <> ''
                FROM s JOIN l ON l.rid = s.rid AND l.i = s.i + 1),
        b AS (SELECT rid, g, arg_min(l.kind, l.i) AS kind, min(a) AS a, max(a + length(line)) AS z FROM s JOIN l USING (rid, i) WHERE held GROUP BY 1, 2),
        c AS (SELECT rid, doc_id, g, kind, a, substr(text, CAST(a AS BIGINT) + 1, CAST(z - a AS BIGINT)) AS raw, text FROM b JOIN d USING (rid)),
        t AS (SELECT *, regexp_replace(regexp_replace(raw, '^{ink}+', ''), '{ink}+$', '') AS body, length(raw) - length(regexp_replace(raw, '^{ink}+', '')) AS lead FROM c),
        grid AS (SELECT rid, doc_id, CAST(g - 1 AS INTEGER) AS index, kind, CAST(strlen(substr(text, 1, CAST(a + lead AS BIGINT))) AS INTEGER) AS start_byte, CAST(strlen(substr(text, 1, CAST(a + lead AS BIGINT))) + strlen(body) AS INTEGER) AS end_byte, body FROM t)"""


@query("block_grid", _grid_sql() + " SELECT doc_id, index, kind, start_byte, end_byte, sha256(body) AS text_sha256 FROM grid")
def _(s, d):
    return segments.blocks(_marked(s, d)).select("doc_id", "index", "kind", "start_byte", "end_byte", F.sha2("text", 256).alias("text_sha256"))


@query("block_coverage", r"SELECT doc_id, CAST(length(regexp_replace(text, '[\s\p{Z}\x{85}]+', '', 'g')) AS BIGINT) AS ink FROM documents WHERE regexp_replace(text, '[\s\p{Z}\x{85}]+', '', 'g') <> ''")
def _(s, d):
    """Characters that are not white space, counted over blocks: none may be lost or met twice."""
    ink = F.length(F.regexp_replace("text", _INK, "")).cast("long")
    return segments.blocks(table(s, d, "documents")).groupBy("doc_id").agg(F.sum(ink).alias("ink"))


@query("block_spans", _grid_sql() + f""", k AS (SELECT rid, index // {segments.WINDOW} AS w, min(index) AS lo, max(index) AS hi FROM grid GROUP BY 1, 2),
    h(rid, w, i, hi, last, taken) AS (SELECT rid, w, lo - 1, hi, -1, false FROM k
        UNION ALL SELECT rid, w, i + 1, hi, CASE WHEN i + 1 > last AND i + 1 + (i + 1) % 3 <= hi THEN i + 1 + (i + 1) % 3 ELSE last END, i + 1 > last AND i + 1 + (i + 1) % 3 <= hi FROM h WHERE i < hi),
    t2 AS (SELECT rid, i AS first_block, i + i % 3 AS last_block FROM h WHERE taken),
    free AS (SELECT g.rid, g.index AS first_block, g.index AS last_block FROM grid g WHERE NOT EXISTS (SELECT 1 FROM t2 WHERE t2.rid = g.rid AND g.index BETWEEN t2.first_block AND t2.last_block))
    SELECT x.doc_id, CAST(first_block AS INTEGER) AS first_block, CAST(last_block AS INTEGER) AS last_block, x.start_byte, y.end_byte
    FROM (SELECT * FROM t2 UNION ALL SELECT * FROM free) p JOIN grid x ON x.rid = p.rid AND x.index = first_block JOIN grid y ON y.rid = p.rid AND y.index = last_block""")
def _(s, d):
    """Proposed from every block on: one to three blocks, inside its window of forty."""
    docs = _marked(s, d)
    grid = segments.blocks(docs)
    window = F.floor(F.col("index") / segments.WINDOW).cast("int")
    pairs = grid.select("doc_id", window.alias("window"), F.col("index").alias("first_block"), (F.col("index") + F.pmod("index", F.lit(3))).alias("last_block"))
    return segments.spans(docs, grid, segments.accepted(pairs, grid)).select("doc_id", "first_block", "last_block", "start_byte", "end_byte")


@query("span_verify", """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'out_of_bounds' WHEN doc_id % 4 = 2 THEN 'text_mismatch' WHEN doc_id % 4 = 3 AND contains(text, 'é') THEN 'split_character' ELSE 'ok' END AS verdict FROM documents WHERE text <> ''""")
def _(s, d):
    """Whole texts as spans: right ones, a byte too long, with another text, and from the middle of a letter on."""
    docs = table(s, d, "documents").where("text <> ''")
    k, n, text = F.col("doc_id") % 4, F.octet_length("text"), F.col("text")
    split = (k == 3) & F.contains(text, F.lit("é"))
    start = F.when(split, F.octet_length(F.expr("left(text, instr(text, 'é') - 1)")) + 1).otherwise(0)
    said = F.when(k == 2, F.concat(text, F.lit("x"))).otherwise(text)
    return docs.select("doc_id", textops.verify_span(text, start, F.when(k == 1, n + 1).otherwise(n), said).alias("verdict"))


@query("span_verify_many", """SELECT CASE WHEN c.doc_id IS NULL THEN 'unknown_document' WHEN b > n THEN 'out_of_bounds' ELSE 'in_bounds' END AS verdict, count(*) AS n
    FROM (SELECT doc_id + CAST(quality AS BIGINT) * 3 AS doc_id, 50 * (1 + toxic) AS b FROM labels) l LEFT JOIN (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) c USING (doc_id) GROUP BY 1""")
def _(s, d):
    size = F.octet_length("text")
    spans = table(s, d, "labels").select((F.col("doc_id") + F.col("quality") * 3).alias("doc_id"), (50 * (1 + F.col("toxic"))).alias("b"))
    met = spans.join(table(s, d, "documents").select("doc_id", size.alias("size"), F.lit(True).alias("known")), "doc_id", "left")
    verdict = F.when(F.col("known").isNull(), "unknown_document").when(F.col("b") > F.col("size"), "out_of_bounds").otherwise("in_bounds")
    return met.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("locate_quotes", """SELECT doc_id, CASE WHEN pos > 0 THEN CAST(octet_length(encode(substr(text, 1, pos - 1))) AS INTEGER) END AS start_byte,
    CASE WHEN pos > 0 THEN CAST(octet_length(encode(substr(text, 1, pos - 1))) + octet_length(encode(word)) AS INTEGER) END AS end_byte
    FROM (SELECT doc_id, text, word, strpos(text, word) AS pos FROM (SELECT *, split_part(text, ' ', 7) AS word FROM documents)) WHERE word <> ''""")
def _(s, d):
    docs = table(s, d, "documents").withColumn("word", F.split_part("text", F.lit(" "), F.lit(7))).where("word <> ''")
    start, end = textops.locate(F.col("text"), F.col("word"))
    return docs.select("doc_id", start.alias("start_byte"), end.alias("end_byte"))


@query("where_quoted", """WITH c AS (SELECT conv_id, turn AS cited, split_part(text, ' ', 3) AS quote FROM conversations),
    m AS (SELECT c.conv_id, c.cited, o.turn, c.quote <> '' AND contains(o.text, c.quote) AS hit FROM c JOIN conversations o USING (conv_id))
    SELECT conv_id || ':' || cited AS claim_id, CASE WHEN bool_or(hit AND turn = cited) THEN 'cited' WHEN bool_or(hit) THEN 'other' ELSE 'nowhere' END AS verdict,
    CASE WHEN bool_or(hit AND turn = cited) THEN max(cited) ELSE min(turn) FILTER (hit) END AS ordinal FROM m GROUP BY 1""")
def _(s, d):
    conv = table(s, d, "conversations")
    offered = conv.select(F.col("conv_id").alias("group"), F.col("turn").alias("ordinal"), "text")
    claim = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    claims = conv.select(claim.alias("claim_id"), F.col("conv_id").alias("group"), F.col("turn").alias("cited"), F.split_part("text", F.lit(" "), F.lit(3)).alias("quote"))
    return segments.where_quoted(offered, claims)


@query("spans_by_document", "SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def _(s, d):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["role"]), ">").alias("roles"))


@query("search_index", """SELECT 'customer' AS kind, c_custkey AS id, 'name' AS field, c_name AS body FROM customer WHERE trim(c_name) <> ''
    UNION ALL SELECT 'customer', c_custkey, 'segment', c_mktsegment FROM customer WHERE trim(c_mktsegment) <> '' UNION ALL SELECT 'part', p_partkey, 'name', p_name FROM part WHERE trim(p_name) <> ''""")
def _(s, d):
    def fields(kind: str, key: str, **columns: str):
        pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("body")) for f, c in columns.items()))
        return table(s, d, kind).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.inline(pairs)).where("trim(body) <> ''")

    return fields("customer", "c_custkey", name="c_name", segment="c_mktsegment").unionByName(fields("part", "p_partkey", name="p_name"))


@query("query_terms", "SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 4), ' OR ') AS terms FROM part")
def _(s, d):
    terms = F.filter(F.split(F.lower("p_name"), " "), lambda w: F.length(w) >= 4)
    return table(s, d, "part").select("p_partkey", F.array_join(terms, " OR ").alias("terms"))
