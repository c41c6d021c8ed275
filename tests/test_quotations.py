"""Quotations of every claim in every document."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import citation, textops
from tidemark.plans import QUERIES

TEXTS = ["xone two\n three fourx", "one two three four", "two", "", None, "one  two", "two two two two", "onetwo"]
CLAIMS = {0: "one two three four", 41: "two", 80: "one two", 81: "one\ttwo  three", 120: " \n", 121: None, 199: "never said here at all"}


def flat(t: str | None) -> str:
    return " ".join((t or "").split())


def small(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (1, TEXTS[1])], "doc_id bigint, text string")
    return docs, spark.createDataFrame(list(CLAIMS.items()), "item_id bigint, claim string")


def test_quotations(spark):
    docs, claims = small(spark)
    want = []
    for d, t in [*enumerate(TEXTS), (1, TEXTS[1])]:
        for c, q in CLAIMS.items():
            if flat(q) and flat(q) in flat(t):
                want.append((d, c, "exact" if q in t else "flattened"))
    got = [tuple(r) for r in textops.quotations(docs, claims).collect()]
    assert sorted(got) == sorted(want) and {v for _, _, v in got} == {"exact", "flattened"}


def test_query_meets_items_numbered_40_and_up(spark, tmp_path):
    docs, claims = small(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    claims.withColumnRenamed("claim", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r["item_id"] for r in QUERIES["quote_verify_all"](spark, str(tmp_path)).collect()} == {0, 41, 80, 81}


def test_gate_over_all_documents(spark):
    """Item 41 and up are judged, whole claims are looked for in the other offered documents, a shared opening is no quotation."""
    texts = [("one two three four", "en"), ("one two three", "de"), ("something else", None), ("  ", "en"), (None, "fr"), ("one two three  four", "en")]
    claims = {7: "one two three four", 41: "one two three", 99: "one two three fore", 150: "two three four", 160: ""}
    docs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    asked = spark.createDataFrame(list(claims.items()), "item_id bigint, claim string")
    want: Counter = Counter()
    for c, q in claims.items():
        holds = [bool(flat(q)) and flat(q) in flat(t) for t, _ in texts]
        for k, (t, lang) in enumerate(texts):
            other = any(h and texts[j][1] != "de" for j, h in enumerate(holds) if j != k)
            verdict = "cited" if holds[k] else "misattributed" if other else "fabricated"
            want[c, "unoffered" if lang == "de" else "unresolvable" if not flat(t) else verdict] += 1
    got = {(r["item_id"], r["verdict"]): r["n"] for r in citation.gate_all(docs, asked, F.col("lang") != "de").collect()}
    assert got == want and {v for _, v in got} == {"unoffered", "unresolvable", "cited", "misattributed", "fabricated"}


@pytest.mark.parametrize("automaton", [10**6, 60, 20])
def test_all_ways_give_the_plain_verdicts(spark, automaton):
    """One automaton, some automata and words, words and single claims: the same quotations."""
    rng = random.Random(automaton)
    words = "ab abc b bc c ca xyz longer".split() + ["ü", "a b"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " "]) for _ in range(n))
    docs = [(k, rng.choice([None, "", text(5), text(40)])) for k in range(60)]
    docs += docs[:3]
    claims = [(k, rng.choice(["", " ", text(1), text(2).strip(), text(3), text(4).strip()[1:], "bc", "no such words here"])) for k in range(80)]
    d, c = spark.createDataFrame(docs, "doc_id int, text string").repartition(3), spark.createDataFrame(claims, "item_id int, claim string")
    flat = lambda t: re.sub(r"\s+", " ", t, flags=re.A).strip(" ")
    want = sorted((i, k, "exact" if q in t else "flattened") for i, t in docs if t is not None for k, q in claims if flat(q) and flat(q) in flat(t))
    assert sorted(map(tuple, textops.quotations(d, c, automaton=automaton).collect())) == want


def test_many_claims_run_without_a_nested_loop(spark):
    """200,000 claims, far beyond one automaton, against documents that hold a few of them."""
    claims = spark.range(200_000).selectExpr("CAST(id AS int) AS item_id", "concat('the value w', id, ' stands') AS claim")
    docs = spark.range(300).selectExpr("CAST(id AS int) AS doc_id", "concat('Here the value  w', id * 7, ' stands, and the value w', id * 5, ' stands too') AS text")
    found = textops.quotations(docs, claims)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = found.groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"flattened": 299, "exact": 300}
