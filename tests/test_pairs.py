"""Pairs that are counted, ranked or written out by classes, against all pairs one by one."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocking, conflicting, curation, evaluation, predicates


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "b", "b", None]), i % 7) for i in range(300)]
    rows += rows[:20] + [(None, "a", 1)]  # repeated rows count once, those without an id meet nothing
    return spark.createDataFrame(rows, "id long, key string, kind long").repartition(3), [r for r in rows[:300] if r[1]]


def _all(rows):
    return [(x, y) for x, y in combinations(sorted(rows), 2) if x[1] == y[1]]


@pytest.mark.parametrize("k", [1, 5, 60, 100_000])
def test_strongest_met(records, k):
    df, rows = records
    want = sorted(_all(rows), key=lambda p: (-((p[0][2] + p[1][2]) % 7), p[0][0], p[1][0]))
    got = [(r.left, r.right, r.words, r.formed) for r in blocking.strongest_met(df, k, lambda a, b: (a + b) % 7).collect()]
    assert got == [(x[0], y[0], (x[2] + y[2]) % 7, len(want)) for x, y in want[:k]]


def test_strongest_met_forms_few_pairs(spark):
    """One key of 200,000 records makes 20 billion pairs."""
    df = spark.range(200_000).select("id", F.lit("k").alias("key"), (F.col("id") % 7).alias("kind"))
    got = blocking.strongest_met(df, 2, lambda a, b: (a + b) % 7).collect()
    assert [(r.left, r.right, r.formed) for r in got] == [(0, 6, 19_999_900_000), (0, 13, 19_999_900_000)]


def test_judged_is_contradictions_of_the_strongest(spark):
    pairs = spark.createDataFrame([(1, 2, 1, 3), (1, 3, 1, 2), (2, 3, 1, 1)], "left int, right int, subjects int, words int")
    none = spark.createDataFrame([], "id int, ranges array<struct<name:string,low:string,low_closed:boolean,high:string,high_closed:boolean,kind:string,value:string,inside:string,outside:string>>")
    rows = [sorted(map(tuple, curation.judged(p, none)[1].collect())) for p in (pairs, curation.strongest(pairs, 60))]
    assert rows[0] == rows[1] == sorted(map(tuple, curation.contradictions(pairs, none)[1].collect())) == [(1, 2, 0), (1, 3, 0), (2, 3, 0)]


def test_pair_kinds(records):
    df, rows = records
    got = {(r.kind, r.odd): r.n for r in blocking.pair_kinds(df.withColumn("odd", F.col("id") % 2 == 1), ["odd"], {"low": F.col("id") < 100, "third": F.col("id") % 3 == 0}).collect() if r.n}
    want = {}
    for x, y in _all(rows):
        for name, holds in (("low", y[0] < 100), ("third", y[0] % 3 == 0)):
            if holds:
                want[name, x[0] % 2 == 1] = want.get((name, x[0] % 2 == 1), 0) + 1
    assert got == want


def test_memory_grade_of_kinds(spark):
    """Kinds of one pair each give the grade of the pairs themselves."""
    rng, ids = random.Random(9), range(12)
    pairs = {(a, b): (rng.random() < 0.5, rng.choice(["proven", "asked"]), rng.random() < 0.5) for a, b in combinations(ids, 2)}
    names = spark.createDataFrame([(i, i) for i in ids if i % 5], "id int, item int")
    told = spark.createDataFrame([(a, b, *v, bool(a % 5 and b % 5), 1) for (a, b), v in pairs.items()], "left int, right int, expected boolean, how string, settled boolean, named boolean, n long")
    listed = evaluation.memory_grade(told.where("expected and named").select("left", "right"), told.select("left", "right", "how"), names, told.where("settled").select("left", "right"))
    assert tuple(evaluation.memory_grade_of_kinds(told).first()) == tuple(listed.first())


def test_members(spark, records):
    df, rows = records
    parts = df.where("id is not null and key is not null").select("id", F.concat("key", (F.col("id") % 2).cast("string")).alias("class")).distinct()
    classes = spark.createDataFrame([("a0", "a0"), ("b1", "b0"), ("a1", "b1")], "left string, right string")
    got = sorted(map(tuple, blocking.members(parts, classes).collect()))
    wanted = {frozenset(p) for p in [("a0",), ("b1", "b0"), ("a1", "b1")]}
    name = lambda r: f"{r[1]}{r[0] % 2}"
    assert got == [(x[0], y[0]) for x, y in combinations(sorted(rows), 2) if frozenset((name(x), name(y))) in wanted]


def test_all_conflicts_are_listed(spark):
    """Each pair with the name that the pairwise proof gives; equal predicates that rule themselves out conflict too."""
    texts = ["a < 1", "a > 2", "a < 1", 'b == "x"', 'b != "x" and a < 0', 'a > 5 and b == "x"', "a < 1 and a > 2", "a < 1 and a > 2", "a <", None]
    told = predicates.described(spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "id int, t string"), "t").select("id", "ranges")
    want = sorted(map(tuple, predicates.conflicts(told, told).where("a_id < b_id").collect()))
    assert sorted(map(tuple, conflicting.conflict_pairs(told).select("a_id", "b_id", "name").collect())) == want and len(want) > 60


def test_exclusion_conflicts_lists_pairs_over_all_parts(spark):
    from tidemark.plans import QUERIES

    got = QUERIES["exclusion_conflicts"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["a_id", "b_id", "name"] and got.where("a_id % 20 >= 5").count() > 0


def test_pairs_of_single_constraints_are_not_gathered(spark):
    """Only pairs with a predicate of several constraints are grouped; the first conflict in order names them."""
    texts = {1: "a < 1", 2: "a > 2", 3: "a > 3 and b > 9", 4: "b < 1 and a < 1", 5: 'c == "x"'}
    told = predicates.described(spark.createDataFrame(list(texts.items()), "id int, t string"), "t").select("id", "ranges")
    found = predicates.conflicts(told, told).where("a_id < b_id")
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.a_id, r.b_id): r.name for r in found.collect()} == {(1, 2): "a", (1, 3): "a", (2, 4): "a", (3, 4): "a"}


def _shuffled(spark, made):
    """Bytes written for shuffles while a table is made and gone through."""
    told = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = told()
    made().write.format("noop").mode("overwrite").save()
    return told() - before


def test_conflicts_send_a_record_once_for_like_predicates(spark):
    """200 predicates of 20 colours, 20 records each: a predicate conflicts with 190 others, which are alike by colour."""
    df = spark.sql("""SELECT id, array(named_struct('name', 'size', 'low', id % 10, 'low_closed', true, 'high', CAST(NULL AS bigint), 'high_closed', true, 'kind', 'range', 'value', CAST(NULL AS string)),
        named_struct('name', 'colour', 'low', CAST(NULL AS bigint), 'low_closed', false, 'high', CAST(NULL AS bigint), 'high_closed', false, 'kind', 'exact', 'value', CAST(id div 10 % 20 AS string))) AS ranges FROM range(4000)""")
    told = conflicting.conflict_pairs(df).agg(F.count("*"), F.count_if(F.expr("a_id < b_id AND a_id div 10 % 20 <> b_id div 10 % 20 AND name = 'colour'"))).first()
    assert tuple(told) == (7_600_000,) * 2
    assert _shuffled(spark, lambda: conflicting.conflict_pairs(df)) < 3_000_000


def test_members_move_arrays_of_ids(spark):
    """Two classes of 10,000 and one by itself; ids are sent in arrays, so that the bytes are few for each of them."""
    records = spark.range(30_000).select("id", (F.col("id") % 3).cast("string").alias("class"))
    classes = spark.createDataFrame([("0", "1"), ("2", "2")], "left string, right string")
    assert tuple(blocking.members(records, classes).agg(F.count("*"), F.count_if(F.col("left") < F.col("right"))).first()) == (149_995_000,) * 2
    assert _shuffled(spark, lambda: blocking.members(records, classes)) < 2_100_000
