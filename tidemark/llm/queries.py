"""The corpus queries: thin digests over the operators of this package, each over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, embed_dedup, html_extract, language, lexical, merkle, mixing, ngram_join, pii, quality, secrets, sentencepiece_bpe, sharding


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The model file that ships with the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def span_text(spans: str) -> F.Column:
    """An array of (kind, start, end) as kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def of_kinds(spans: str, kinds: tuple[str, ...]) -> F.Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Virtual slots, law ``bytes``: 16 shards of near equal bytes."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def _token_digest(n: int, ids: str, decoded: str) -> tuple:
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(
        table(spark, sf_dir, "documents"), piece_model(),
        columns="n_tokens bigint, ids_sha256 string, decoded_sha256 string", derive=_token_digest,
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(table(spark, sf_dir, "documents"))
    counts = [F.size(of_kinds("spans", (k,))).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    base = found.withColumn("base", of_kinds("spans", secrets.BASE))
    return base.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(of_kinds("base", (k,))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows; of a third of them, the text is lower-cased and folded up the unchanged path."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", _UPPER, _LOWER)
    altered = merkle.record_hash(*(lowered if c == "text" else F.col(c) for c in merkle.FIELDS))
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("path"))
    told = {"proof_sha256": F.sha2(merkle.siblings(F.col("path")), 256), "folded_root": folded}
    proven = merkle.prove(docs, told, {"altered": F.when(third, altered)})
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_ann_search": op2_ann_search,
    "op3_sharding": op3_sharding,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_html_extract": op7_html_extract,
    "op8_secrets": op8_secrets,
    "op9_mixing": op9_mixing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_merkle": op11_merkle,
    "op12_language_id": op12_language_id,
    "op13_lexical_search": op13_lexical_search,
}

_REACH = """c(node, root) AS (SELECT id, id FROM nodes UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node WHERE c.root < l.b),
    m AS (SELECT node, min(root) AS component_id FROM c GROUP BY 1)"""

def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The secret rules for SQL: pattern, and what a match x must fulfil.
_SECRETS = {
    "assign": ("(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(x, '{p}', 2)) >= 12"),
    "access": ("AKIA[A-Z0-9]+", "length(x) >= 18"), "hex": ("[0-9a-f]+", "length(x) >= 16"), "github": ("gh[pousr]_[A-Za-z0-9]+", "length(x) >= 40"),
    "slack": ("xox[abprs]-[A-Za-z0-9-]+", "length(x) >= 15"), "google": ("AIza[A-Za-z0-9_-]+", "length(x) >= 39"), "private_key": (r"-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----", "true"),
}


def _secrets_sql() -> str:
    """Each rule by itself: matches and the pieces between them give the places."""
    each = " UNION ALL ".join(
        f"""SELECT rid, {k} AS k, '{kind}' AS kind, a, a + length(x) AS b FROM (SELECT rid, m[i] AS x, list_sum(list_transform(s[1:i], lambda e: length(e))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda e: length(e))), 0) AS a
            FROM (SELECT rid, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS s FROM d))) WHERE {ok.replace('{p}', p)}"""
        for k, (kind, (p, ok)) in enumerate(_SECRETS.items())
    )
    joined = lambda which: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < {which}), '')"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(secrets.BASE))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS ({each})
        SELECT any_value(doc_id) AS doc_id, {counts}, sha256({joined(3)}) AS base_sha256, {joined(99)} AS spans FROM d LEFT JOIN f USING (rid) GROUP BY rid"""


def _merkle_sql() -> str:
    """Trees as recursive tables of nodes, one row a node and level; proofs from the runs; folding over a list of steps."""
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))) + ")"
    crc = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
        lambda r, x: xor(xor(r, x) >> 1, (xor(r, x) & 1) * 3988292384))"""
    up = lambda t: f"""{t}(k, g, pos, n, h) AS (SELECT 0, g, pos, n, h FROM {t}0
        UNION ALL SELECT k + 1, g, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM {t} WHERE n > 1 GROUP BY k, g, pos // 8, n),
        {t}run AS (SELECT k, g, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM {t} WHERE n > 1 GROUP BY ALL)"""  # noqa: E731
    step = lambda at: f"{{'b': array_to_string(hs[1:{at} % 8], ''), 'a': array_to_string(hs[{at} % 8 + 2:], '')}}"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('+' || lang, '') AS g, {leaf('text')} AS leaf,
            CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS altered FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
        t0 AS (SELECT g, pos, n, leaf AS h FROM r), {up('t')},
        s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
        u0 AS (SELECT '' AS g, pos, n, subroot AS h FROM s), {up('u')}, top AS (SELECT h AS root FROM u WHERE n = 1),
        steps AS (SELECT r.g, r.pos, 0 AS part, t.k, {step('(r.pos // (8 ** t.k)::BIGINT)')} AS x FROM r JOIN trun t ON t.g = r.g AND t.run = r.pos // (8 ** (t.k + 1))::BIGINT
            UNION ALL SELECT r.g, r.pos, 1, u.k, {step('(s.pos // (8 ** u.k)::BIGINT)')} FROM r JOIN s ON s.g = r.g JOIN urun u ON u.run = s.pos // (8 ** (u.k + 1))::BIGINT),
        p AS (SELECT g, pos, list(x ORDER BY part, k) AS path FROM steps GROUP BY 1, 2),
        f AS (SELECT r.doc_id, r.leaf, s.subroot, top.root, sha256(coalesce(array_to_string(list_transform(path, lambda e: e.b || e.a), ''), '')) AS proof_sha256,
            list_reduce(list_prepend({{'b': coalesce(altered, leaf), 'a': ''}}, coalesce(path, [])), lambda h, e: {{'b': sha256(e.b || h.b || e.a), 'a': ''}}).b AS folded_root
            FROM r JOIN s USING (g) CROSS JOIN top LEFT JOIN p ON p.g = r.g AND p.pos = r.pos)
        SELECT *, folded_root = root AS verified FROM f"""


ORACLE_SQL: dict[str, str] = {
    "op11_merkle": _merkle_sql(),
    "op13_lexical_search": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS w FROM documents),
        tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
        s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS t FROM benchmark),
        x AS (SELECT item_id, rid, CAST(sum(CAST(floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * len(w) * s.n) // s.l))))) AS BIGINT) AS score
            FROM q JOIN tf USING (t) JOIN df USING (t) JOIN d USING (rid) CROSS JOIN s GROUP BY 1, 2)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x JOIN d USING (rid) WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    "op2_ann_search": """WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op8_secrets": _secrets_sql(),
    "op1_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        nodes AS (SELECT vec_id AS id FROM v), {_REACH}, k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON node = vec_id LEFT JOIN k ON a = vec_id""",
    "op10_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
        nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d JOIN m ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
