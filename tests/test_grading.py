"""Rendering, described predicates, matching and prices."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, predicates, pricing


@pytest.mark.parametrize("text", [
    "a - (b - c) <= 1", "a - b - c <= 1", "not (a < 1 or b > 2) and c == \"x\\\"y\"", "(a + b) * 2 / c >= -1.5", "not not a != true",
    "a between 1 and 2_000 or b == false", "a < 1 or (b < 2 or c < 3)",
])
def test_render_round_trip(text):
    tree = predicates.parse(text)
    assert predicates.parse(predicates.render(tree)) == tree


def test_described_and_conflicts(spark):
    rows = [(1, "w <= 6"), (2, "w>7 and w < 9"), (3, "w <= 6 or w > 9"), (4, "v == 2"), (5, None), (6, "1 < 2 < 3"), (7, "w<=6")]
    df = predicates.described(spark.createDataFrame(rows, "id int, predicate string"), "predicate")
    told = {r.id: r for r in df.collect()}
    assert told[2].rendered == "w > 7 and w < 9" and told[2].subject == "w" and told[3].subject is None and told[3].names == ["w"]
    assert not told[5].parses and not told[6].parses and told[1].shape == told[7].shape
    found = predicates.conflicts(df, df).where("a_id < b_id").collect()
    assert {(r.a_id, r.b_id, r.name) for r in found} == {(1, 2, "w"), (2, 7, "w")}


def test_unbound(spark):
    df = spark.sql("select array('a', 'b') n, map('a', 1) f")
    assert df.select(predicates.unbound(F.col("n"), F.col("f"))).first()[0] == ["b"]


def test_matching_in_rounds_is_the_greedy_rule(spark):
    rnd = random.Random(4)
    side = lambda: [(g, i, s := rnd.randrange(60), s + rnd.randrange(1, 25)) for g in range(3) for i in range(12)]
    items, claims = side(), side()
    a = spark.createDataFrame(items, "g int, item_id int, i_start int, i_end int")
    b = spark.createDataFrame(claims, "g int, record_id int, c_start int, c_end int")
    want, used = set(), set()
    pairs = sorted((-(min(x[3], y[3]) - max(x[2], y[2])), x[1], y[1], x[0]) for x in items for y in claims if x[0] == y[0])
    for o, i, r, g in pairs:
        if o < 0 and not {("i", g, i), ("r", g, r)} & used:
            used |= {("i", g, i), ("r", g, r)}
            want.add((g, i, r, -o))
    assert {tuple(r) for r in metrics.overlap_pairs(a, b, ["g"]).collect()} == want
    assert metrics.overlap_pairs(a.where("false"), b, ["g"]).count() == 0


def test_fields(spark):
    rows = [("exact", " a ", "a"), ("contains", "ON", "alone"), ("set", "b|A", "a | b |"), ("numeric", "1.5", "1.6"), ("numeric", "x", "1"), ("exact", "a", None)]
    df = spark.createDataFrame(rows, "c string, e string, a string").select(metrics.field_matches(F.col("c"), F.col("e"), F.col("a"), F.lit(0.1).cast("decimal(5,2)")))
    assert [r[0] for r in df.collect()] == [True, True, True, True, False, False]


def test_price(spark):
    df = spark.range(1).select(pricing.call_cost(F.lit(3), F.lit(15), F.lit(1000), F.lit(100), F.lit(10), F.lit(8)), pricing.worst_cost(F.lit(3), F.lit(15), F.lit(5), F.lit(10)))
    assert [float(x) for x in df.first()] == [0.004533, 0.000159]
