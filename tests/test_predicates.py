"""Predicates over columns and by rows give the same verdicts for numbers of any size; texts of any shape harm no other row."""

import random
from decimal import Context, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import predicates


def number(rng) -> Decimal:
    """From 1e-12 to 1e20, either sign, few digits or many."""
    digits = rng.choice([1, 2, 5, 12, 20])
    return Decimal(rng.choice([1, 1, -1]) * rng.randrange(10**digits)).scaleb(rng.randint(-12, 20 - digits))


def formula(rng, depth=2) -> str:
    if depth and rng.random() < 0.3:
        return f"{formula(rng, depth - 1)} {rng.choice(['and', 'or'])} {formula(rng, depth - 1)}"
    side = lambda d: rng.choice("abcdinu") if rng.random() < 0.6 or not d else f"({side(d - 1)} {rng.choice('+-*/')} {side(d - 1) if rng.random() < 0.7 else format(number(rng), 'f')})"
    right = format(number(rng), "f") if rng.random() < 0.5 else side(2)
    return f"{'not ' if rng.random() < 0.1 else ''}{side(2)} {rng.choice(['<=', '>=', '==', '!=', '<', '>'])} {right}"


def test_columns_agree_with_rows(spark):
    """200 predicates on 50 rows each."""
    rng = random.Random(7)
    cut = lambda v, places: v.quantize(Decimal(1).scaleb(-places), context=Context(prec=60))
    rows = []
    for _ in range(50):
        a, b, c = cut(number(rng), 12), cut(number(rng), 0), cut(number(rng) % 1000 if rng.random() < 0.5 else Decimal(rng.randint(-9, 9)), 4)
        rows.append(tuple(None if rng.random() < 0.05 else x for x in (a, b, c, float(number(rng)), rng.randint(-20, 20), rng.choice([float("nan"), float("inf"), 0.1]))))
    fields = [("a", T.DecimalType(34, 12)), ("b", T.DecimalType(21, 0)), ("c", T.DecimalType(13, 4)), ("d", T.DoubleType()), ("i", T.IntegerType()), ("n", T.DoubleType())]
    df = spark.createDataFrame(rows, T.StructType([T.StructField(n, t) for n, t in fields]))
    bound = predicates.bind(df, {n: n for n, _ in fields})
    texts = [formula(rng) for _ in range(200)]
    trees = [predicates.parse(t) for t in texts]
    native = 0
    for lo in range(0, len(texts), 40):
        part = df.select(*(predicates.lower(t, bound).alias(f"p{k}") for k, t in enumerate(trees[lo : lo + 40])))
        for row, values in zip(part.collect(), rows):
            world = dict(zip([n for n, _ in fields], values))
            for k, got in enumerate(row):
                assert got == predicates.evaluate(trees[lo + k], world)[0], (texts[lo + k], world)
                native += got is not None
    assert native > 5000


@pytest.mark.parametrize("text", ["c + 0.01 <= 0.06", "c / i > 2", "c * i - 3 == c / 7", "d < 3", "b > 12345678901234567890"])
def test_narrow_types_stay_in_the_plan(spark, text):
    df = spark.sql("SELECT CAST(1 AS decimal(9,2)) c, 3 i, 2.5D d, CAST(1 AS decimal(20,0)) b")
    plan = df.select(predicates.lower(predicates.parse(text), predicates.bind(df, {c: c for c in df.columns})))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_quotients_round_as_rows_do(spark):
    """2 / 3 is 0.6667 to 28 digits only: what lies between is told apart."""
    df = spark.sql("SELECT CAST(2 AS int) a, CAST(3 AS int) b")
    for text in ("a / b == 0.6666666666666666666666666667", "a / b > 0.66666666666666666666666666665", "a / b * b == a", "a / b >= 0.6667", "a / b < 0.6667", "0.66666 < a / b"):
        tree = predicates.parse(text)
        assert df.select(predicates.lower(tree, predicates.bind(df, {"a": "a", "b": "b"}))).first()[0] == predicates.evaluate(tree, {"a": 2, "b": 3})[0]


def test_odd_texts_leave_other_rows_standing(spark):
    odd = ["(" * 3000 + "a" + ")" * 3000 + " < 1", "not " * 3000 + "a < 1", "-" * 3000 + "a < 1", " and ".join(["a < 1"] * 3000), "a < " + "+".join("1" * 3000), "a <= " + "9" * 60, "a < 1" + " " * 100_000, "", None, '"', "a < 1e5", "((a < 1)"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(odd)] + [("x", "a < 1")], "id string, t string").withColumn("a", F.lit("0.1").cast("decimal(38,18)"))
    told = {r.id: (r.parses, r.ranges) for r in predicates.described(df, "t").collect()}
    assert {k for k, (ok, _) in told.items() if ok} == {"5", "6", "x"} and told["5"][1][0].high == predicates.order_key(Decimal("9" * 60))
    held = {r.id: r.verdict for r in predicates.judged(df.withColumn("name", F.lit("a")), "t", {"name": "a"}).collect()}
    assert {k for k, v in held.items() if v} == {"5", "6", "x"}


def test_depth_that_is_allowed():
    assert predicates.parses("(" * 150 + "a" + ")" * 150 + " < 1") and predicates.parses(" and ".join(["a < 1"] * 190))
    deep = predicates.parse(" and ".join(["a < 1"] * 190))
    assert predicates.evaluate(deep, {"a": 0})[0] and len(predicates.ranges(deep)) == 190 and predicates.parse(predicates.render(deep)) == deep


def test_order_keys_sort_as_numbers():
    rng = random.Random(1)
    values = [Decimal(rng.randint(-(10**9), 10**9)).scaleb(rng.randint(-40, 40)) for _ in range(500)] + [Decimal(0), Decimal("-1.10"), Decimal("1.1"), Decimal("9" * 80)]
    assert sorted(values) == sorted(values, key=predicates.order_key) and predicates.order_key(Decimal("1.10")) == predicates.order_key(Decimal("1.1"))


def test_measured_digits_are_kept(spark):
    df = spark.createDataFrame([("1", "x == 12345678901234567.5", "x")], "id string, p string, n string").withColumn("v", F.lit("12345678901234567.5").cast("decimal(38,3)"))
    assert predicates.judged(df, "p", {"n": "v"}).first().verdict


def plain_links(rows):
    """All pairs."""
    def apart(x, y):
        if x["kind"] == y["kind"] == "range":
            low = max((v for v in (x["low"], y["low"]) if v is not None), default=None)
            high = min((v for v in (x["high"], y["high"]) if v is not None), default=None)
            if low is None or high is None:
                return False
            ends = all(r[e] != v or r[f"{e}_closed"] for r in (x, y) for e, v in (("low", low), ("high", high)))
            return low > high or (low == high and not ends)
        kinds = {x["kind"], y["kind"]}
        return (kinds == {"exact"} and x["value"] != y["value"]) or (kinds == {"exact", "excluded"} and x["value"] == y["value"])

    flat = [(i, pos, r) for i, rs in rows for pos, r in enumerate(rs)]
    return {(i, p): [j for j, q, y in flat if (i, p) != (j, q) and x["name"] == y["name"] and apart(x, y)] for i, p, x in flat}


def test_links_equal_all_pairs(spark):
    from tidemark.operators import conflicting

    rng = random.Random(4)

    def constraint():
        kind = rng.choice(["range", "range", "range", "exact", "excluded"])
        end = lambda: rng.choice([None, rng.randrange(12)])
        low, high = (end(), end()) if kind == "range" else (None, None)
        return {"name": rng.choice("xxxy"), "kind": kind, "low": low, "high": high, "low_closed": rng.random() < 0.5, "high_closed": rng.random() < 0.5, "value": None if kind == "range" else rng.choice("abc")}

    rows = [(k, [constraint() for _ in range(rng.randrange(0, 4))]) for k in range(120)]
    shape = "id int, ranges array<struct<name:string,low:int,low_closed:boolean,high:int,high_closed:boolean,kind:string,value:string>>"
    got = {(r.id, r.pos): r for r in conflicting.conflict_links(spark.createDataFrame(rows, shape).repartition(5)).collect()}
    want = plain_links(rows)
    assert {k: r.links for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(r.witness in want[k] if want[k] else r.witness is None for k, r in got.items())
    assert conflicting.conflict_links(spark.createDataFrame([], shape)).count() == 0


def test_one_hot_name_runs_in_linear_work(spark):
    """200,000 constraints of one name make 10 thousand million pairs; they are counted."""
    from tidemark.operators import conflicting

    n, none = 200_000, "CAST(NULL AS bigint)"
    half = lambda low, high: f"named_struct('name', 'cost', 'low', {low}, 'low_closed', true, 'high', {high}, 'high_closed', true, 'kind', 'range', 'value', CAST(NULL AS string))"
    df = spark.sql(f"SELECT id, array(if(id % 2 = 0, {half('id', none)}, {half(none, 'id')})) AS ranges FROM range({n})")
    told = conflicting.conflict_links(df).selectExpr("count(*)", "sum(links)", "min(witness)", "max(witness)").first()
    assert tuple(told) == (n, (n // 2) * (n // 2 - 1), 1, n - 2)


def test_described_moves_no_texts(spark):
    df = spark.createDataFrame([(1, "a < 1"), (2, None), (3, "a <"), (4, "a < 1"), (5, "(" * 3000 + "a")], "id int, t string")
    told = predicates.described(df, "t")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    rows = {r.id: r for r in told.collect()}
    assert [rows[k].parses for k in range(1, 6)] == [True, False, False, True, False] and rows[2].names is None and rows[3].names == [] and rows[4].ranges == rows[1].ranges
    with pytest.raises(predicates.PredicateError, match="nested too deeply"):
        predicates.tokens("(" * 300 + "what cannot be read: ; ; ;")
