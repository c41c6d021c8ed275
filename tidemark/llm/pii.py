"""Personal data by weak-supervision aggregation, in DataFrame code only.

Strict patterns give the base spans (emails, addresses, cards, phones), which always stay. Relaxed
patterns give further candidates. Four labelers vote for or against every candidate, or abstain: the
pattern itself, gazetteers (top-level domains, issuer prefixes, calling codes, reserved addresses), cue
words in the 24 characters in front of it (back to the last match but one), and its shape. Expectation-maximisation over the counts of distinct vote patterns
estimates each labeler's reliability without labels; the posteriors then train a naive Bayes span
classifier on votes and shape features, which decides on the relaxed candidates. The table of vote
patterns is bounded by the number of possible patterns, so the model is one row, whatever the corpus.

Patterns keep the leftmost, non-overlapping matches of the plain ones but use possessive runs and
anchors, so that long runs cost linear time. Positions come from the lengths of the pieces between
matches, so they count code points; they are summed over stretches of ``STRETCH`` matches and then inside each, so
that a text with many matches costs no more a match than one with few. Defined cases: a null or empty text has no spans; whole texts are
read; without any candidate the classifier adds nothing; rows may repeat; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 15
STRETCH = 256
#: Cue words before a span of each kind, cues against any, and gazetteers.
CUES = {
    "email": "mail|contact|write|reach|address|correo|kontakt|courriel|schreib|escrib|adresse|inbox|cc:|from:|reply", "ip": "ip|host|server|address|client|login|addr|gateway|router|dns|ping|subnet|proxy|firewall|servidor|serveur|rechner",
    "card": "card|visa|credit|debit|account|pay|tarjeta|karte|carte|mastercard|amex|maestro|charge|billing|kredit|numero|nummer|pan", "phone": "phone|call|tel|mobile|fax|cell|contact|anruf|llam|appel|dial|ring|hotline|whatsapp|sms|movil|handy|portable|durchwahl",
}
AGAINST = "version|isbn|issn|doi|invoice|order|figure|section|serial|part no|build|release|chapter|table|page|rechnung|factura|facture|pedido|commande|bestell|checksum|sha|md5|commit"
TLDS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|io|ai|app|dev|co|me|tv|cc|online|site|tech|cloud|store|blog|xyz|eu|de|fr|es|it|nl|be|lu|ch|at|li|uk|ie|us|ca|mx|br|ar|cl|pe|au|nz|jp|cn|hk|tw|kr|"
    "in|pk|id|my|sg|th|vn|ph|za|ng|ke|eg|ma|tr|il|ae|sa|ru|ua|by|pl|cz|sk|hu|ro|bg|gr|hr|si|rs|se|no|dk|fi|is|ee|lv|lt|pt"
)
ISSUERS = "4|5[0-8]|2[2-7]|3[0-9]|6011|62|63|64|65|67|81|9"
CODES = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"

_STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HEX = "[0-9A-Fa-f]{1,4}+"
_DOT = r"(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))"
#: Addresses and names written so that machines miss them, cards in other groups, IPv6, national phone numbers.
_RELAXED = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": rf"(?<![A-Za-z0-9_:.\]])(?:(?:{_HEX}:){{7}}+{_HEX}|{_HEX}(?::{_HEX})*+::(?:{_HEX}(?::{_HEX})*+)?+|[0-9]{{1,3}}+{_DOT}[0-9]{{1,3}}+{_DOT}[0-9]{{1,3}}+{_DOT}[0-9]{{1,3}}+)(?![A-Za-z0-9_:])",
    "card": r"(?<![0-9./_])[0-9]{4}+(?:\x20?[./_|\x09]\x20?[0-9]{2,6}+){2,4}+(?![0-9])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9+().-])00[1-9](?:[\x20().-]{0,2}+[0-9]){7,13}+(?![0-9])",
}
_NEEDS = {"email": "@", "phone": "+"}
_RELAXED_NEEDS = {"email": "at"}

_DIGITS = "regexp_replace(x, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (t, j) -> t + "
    f"if(j % 2 = 1, cast(substr(reverse({_DIGITS}), j, 1) as int), "
    f"element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substr(reverse({_DIGITS}), j, 1) as int) + 1))) % 10 = 0"
)
_PASSES = {
    "email": "true",
    "ip": "forall(split(x, '[.]'), p -> length(trim(leading '0' from p)) <= 3 and cast(concat('0', right(trim(leading '0' from p), 3)) as int) <= 255)",
    "card": f"if(length({_DIGITS}) between 16 and 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 8 and 15",
}
_RELAXED_PASSES = _PASSES | {
    "ip": "if(rlike(x, ':'), length(regexp_replace(x, '[^:]', '')) <= 7, forall(split(regexp_replace(x, '[^0-9]+', '.'), '[.]'), p -> cast(p as int) <= 255))",
}
#: Votes: 0 against, 1 abstains, 2 for.
_GAZETTEER = {
    "email": f"if(rlike(lower(x), '[.) ](?:{TLDS})$'), 2, 0)",
    "ip": "if(rlike(x, '^0*(?:10|127|192|172|169)[^0-9]|^(?:fe80|f[cd][0-9a-f]{2}|2[0-9a-f]{3}):'), 2, if(rlike(x, '^0*[0-9][.]0*[0-9][.]0*[0-9][.]0*[0-9]$'), 0, 1))",
    "card": f"if(rlike({_DIGITS}, '^(?:{ISSUERS})'), 2, 0)",
    "phone": f"if(rlike(x, r'^{CODES}'), 2, if(rlike({_DIGITS}, '^[01]'), 0, 1))",
}


def _span_array(kind: str, n: int, strict: bool) -> str:
    """SQL for the candidates of one pattern, from its matches m and the pieces between them s."""
    m, s = f"m{n}", f"s{n}"
    x = f"element_at({m}, i)"
    start = f"a.pos + length(element_at({s}, i))"
    before = f"lower(right(concat(if(i > 1, element_at({m}, i - 1), ''), element_at({s}, i)), 24))"
    context = f"if(rlike({before}, '{AGAINST}'), 0, if(rlike({before}, '{CUES[kind]}'), 2, 1))"
    put = lambda sql: sql.replace("(x,", f"({x},").replace("(x)", f"({x})").replace("split(x", f"split({x}")
    distinct = f"size(array_distinct(split(regexp_replace({x}, '[^A-Za-z0-9]', ''), '')))"
    votes = f"array({2 if strict else 1}, {put(_GAZETTEER[kind])}, {context}, if({distinct} <= 2, 0, if({distinct} >= 6, 2, 1)))"
    shape = f"array(cast(least(3, length({x}) div 8) as int), if(rlike({x}, '[ ().-]'), 1, 0), {KINDS.index(kind)})"
    found = (
        f"named_struct('kind', {KINDS.index(kind)}, 'start', {start}, 'end', {start} + length({x}), 'strict', {str(strict).lower()}, "
        f"'votes', {votes}, 'shape', {shape})"
    )
    empty = "cast(array() as array<struct<kind: int, start: int, end: int, strict: boolean, votes: array<int>, shape: array<int>>>)"
    size = f"length(element_at({s}, i)) + length(element_at({m}, i))"
    inside = f"sequence(h * {STRETCH} + 1, least(size({m}), (h + 1) * {STRETCH}))"
    heads = (
        f"aggregate(sequence(0, cast((size({m}) - 1) div {STRETCH} as int)), named_struct('pos', 0, 'out', cast(array() as array<struct<h: int, pos: int>>)), "
        f"(b, h) -> named_struct('pos', b.pos + aggregate({inside}, 0, (t, i) -> t + {size}), "
        f"'out', concat(b.out, array(named_struct('h', h, 'pos', b.pos)))), b -> b.out)"
    )
    spans = (
        f"aggregate({inside.replace('h *', 'g.h *').replace('(h +', '(g.h +')}, named_struct('pos', g.pos, 'out', {empty}), "
        f"(a, i) -> named_struct('pos', {start} + length({x}), 'out', if({put((_PASSES if strict else _RELAXED_PASSES)[kind])}, concat(a.out, array({found})), a.out)), a -> a.out)"
    )
    return f"if(coalesce(size({m}), 0) <= 0, {empty}, flatten(transform({heads}, g -> {spans})))"


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): every candidate of every row with its votes and shape."""
    tried = [(k, p, True, _NEEDS.get(k)) for k, p in _STRICT.items()] + [(k, p, False, _RELAXED_NEEDS.get(k)) for k, p in _RELAXED.items()]
    text = F.col("text")
    out = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def where(needs: str | None, then):
        return F.when(F.contains(text, F.lit(needs)), then) if needs else then

    out = out.select("*", *(where(needs, F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"m{n}") for n, (_, p, _, needs) in enumerate(tried)))
    out = out.select("*", *(F.when(F.size(f"m{n}") > 0, F.split("text", p, -1)).alias(f"s{n}") for n, (_, p, _, _) in enumerate(tried)))
    arrays = [F.expr(_span_array(k, n, strict)) for n, (k, _, strict, _) in enumerate(tried)]
    return out.select("doc_id", F.concat(*arrays).alias("found"))


#: Values of each vote and shape feature.
_VALUES = (3, 3, 3, 3, 4, 2, 4)
_VOTES = 4


def _odds(model: str, at: str, n: int) -> str:
    """Log odds of a candidate whose feature values are the array ``at``."""
    terms = [f"ln({model}.pos[{j}][{at}[{j}]]) - ln({model}.neg[{j}][{at}[{j}]])" for j in range(n)]
    return f"ln({model}.prior) - ln(1 - {model}.prior) + " + " + ".join(terms)


def _estimate(weighted: str, n: int) -> str:
    """Prior and smoothed shares of each feature value, from patterns with weights for (wp) and against (wn)."""

    def side(w: str) -> str:
        total = f"aggregate({weighted}, 0D, (s, p) -> s + p.{w})"
        rows = [
            "array(" + ", ".join(f"(aggregate({weighted}, 0D, (s, p) -> s + if(p.at[{j}] = {v}, p.{w}, 0D)) + 1D) / ({total} + {_VALUES[j]}D)" for v in range(_VALUES[j])) + ")"
            for j in range(n)
        ]
        return "array(" + ", ".join(rows) + ")"

    total = [f"aggregate({weighted}, 0D, (s, p) -> s + p.{w})" for w in ("wp", "wn")]
    prior = f"({total[0]} + 1D) / ({total[0]} + {total[1]} + 2D)"
    return f"named_struct('prior', {prior}, 'pos', {side('wp')}, 'neg', {side('wn')})"


def fit(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row with ``model``, the span classifier trained on posteriors of the label model."""
    patterns = (
        found.select(F.explode("found").alias("c"))
        .select(F.concat("c.votes", "c.shape").alias("at"))
        .groupBy("at").agg(F.count("*").cast("double").alias("n"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("table"))
    )
    majority = "(p.at[0] + p.at[1] + p.at[2] + p.at[3] - 4D)"
    weigh = lambda odds: f"transform(table, p -> named_struct('at', p.at, 'wp', p.n / (1 + exp(-({odds}))), 'wn', p.n / (1 + exp({odds}))))"
    bind = lambda weighted, n: f"transform(array({weighted}), w -> {_estimate('w', n)})[0]"
    start = bind(weigh(majority), _VOTES)
    step = bind(weigh(_odds("m", "p.at", _VOTES)), _VOTES)
    labels = patterns.withColumn("m", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (m, r) -> {step})"))
    return labels.select(F.expr(bind(weigh(_odds("m", "p.at", _VOTES)), len(_VALUES))).alias("model"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (kind, start, end) in order of kind, then start."""
    found = materialize(candidates(df, id_col, text_col))
    scored = found.withColumn("model", fit(found).scalar())
    odds = _odds("model", "concat(c.votes, c.shape)", len(_VALUES))
    level = f"{threshold} / (1D - {threshold})"
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    named = f"c -> named_struct('kind', {names}[c.kind], 'start', c.start, 'end', c.end)"
    order = "c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end)"
    base = "filter(found, c -> c.strict)"
    fresh = f"filter(found, c -> not c.strict and not exists({base}, b -> b.kind = c.kind and b.start < c.end and c.start < b.end))"
    return scored.select(
        "doc_id",
        F.expr(f"transform(array_sort(transform({base}, {order})), {named})").alias("base"),
        F.expr(f"transform(array_sort(transform(concat({base}, filter({fresh}, c -> {odds} >= ln({level}))), {order})), {named})").alias("spans"),
    )
