"""Golden numbers, truth tables and properties of the operators."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import calibration, graph, metrics, predicates, textops, versioned

GOLDEN = [(5.5, 4.2), (6.0, 2.75), (6.5, 4.6), (5.0, 2.8), (5.5, 2.1), (3.6, 3.5), (3.6, 2.0), (3.1, 3.6)]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(k, "team", "agent-implementation", e, a) for k, (e, a) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "estimate_id int, owner string, work_class string, estimated double, actual double")
    return df.withColumn("ratio", calibration.ratio(F.col("actual"), F.col("estimated")))


def test_golden_factor(golden):
    r = calibration.factors(golden).first()
    assert (r["factor"], r["spread"], r["low"], r["high"], r["confidence"], r["magnitude"]) == (0.6534, 0.3749, 0.4491, 0.9506, 0.4476, 1.5305)


def test_few_outcomes_have_no_factor(golden):
    r = calibration.factors(golden.limit(4)).first()
    assert r["verdict"] == "insufficient_sample" and r["factor"] is None


def test_golden_walk(golden):
    r = calibration.walk(golden).first()
    assert (r["scored"], r["improved"], r["worsened"], r["raw_error"], r["corrected_error"]) == (3, 1, 2, 0.2552, 0.4367)


def test_cycle_returns_the_root(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "A")], "src string, dst string")
    found = graph.walk(edges, spark.createDataFrame([("A",)], "root string"))
    assert {(r["node"], r["depth"]) for r in found.collect()} == {("B", 1), ("A", 2)}


@pytest.mark.parametrize("text, expected", [
    ("x < 3 and y > 1", None), ("x > 3 and y > 1", False), ("x < 3 or y > 1", True), ("not y == 2", None), ("x between 1 and 2", True),
    ('s == "a"', True), ("s == 1", None), ('s < "b"', None), ("x / 0 > 1", None), ("-x + 3 * 2 == 4", True), ("b == true", True),
])
def test_predicates(spark, text, expected):
    bound = {"x": ("num", F.lit(2.0)), "s": ("str", F.lit("a")), "b": ("bool", F.lit(True))}
    assert spark.range(1).select(predicates.lower(predicates.parse(text), bound).alias("v")).first()["v"] is expected


@pytest.mark.parametrize("text", ["x", "x = 3", "1 < x < 3", "x <", "(x < 3", "x + 1", ""])
def test_not_predicates(text):
    assert not predicates.parses(text)


def test_ranges_are_all_or_nothing():
    assert len(predicates.ranges(predicates.parse("x < 3 and 1 <= x"))) == 2
    assert predicates.ranges(predicates.parse("x < 3 or x > 4")) == []


def test_quotes_and_spans(spark):
    df = spark.createDataFrame([("a  bé c", "b", 3, 6)], "t string, q string, a int, b int")
    r = df.select(
        textops.quoted(F.col("t"), F.lit("a bé")).alias("flat"), textops.verify_span(F.col("t"), F.col("a"), F.col("b"), F.lit("bé")).alias("ok"),
        textops.verify_span(F.col("t"), F.lit(3), F.lit(5), F.lit("b")).alias("split"), textops.locate(F.col("t"), F.lit("c"))[0].alias("at"),
    ).first()
    assert tuple(r) == ("flattened", "ok", "split_character", 7)


def test_greedy_overlap(spark):
    items = spark.createDataFrame([("h", 1, 0, 10), ("h", 2, 5, 20)], "h string, item_id int, i_start int, i_end int")
    claims = spark.createDataFrame([("h", 7, 6, 18), ("h", 8, 0, 9)], "h string, record_id int, c_start int, c_end int")
    assert {(r["item_id"], r["record_id"]) for r in metrics.overlap_pairs(items, claims, ["h"]).collect()} == {(2, 7), (1, 8)}


def test_head_and_work_class(spark):
    v = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "id int, version int, retracted boolean")
    assert {r["id"] for r in versioned.standing(v).collect()} == {2}
    w = spark.createDataFrame([("Data  Modelling",), ("?!",)], "c string").select(scalars.work_class(F.col("c")).alias("w"))
    assert [r["w"] for r in w.collect()] == ["data-modelling", "unclassified"]
