"""Overlaps and matching against the one-by-one rule."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, overlaps
from tidemark.operators.running import running


def plain(items, claims):
    pairs = sorted((-(min(b, d) - max(a, c)), i, r, g) for g, i, a, b in items for h, r, c, d in claims if g == h and None not in (a, b, c, d) and min(b, d) > max(a, c))
    used, out = set(), []
    for minus, i, r, g in pairs:
        if ("i", g, i) not in used and ("r", g, r) not in used:
            used |= {("i", g, i), ("r", g, r)}
            out.append((g, i, r, -minus))
    return sorted(out)


def frames(spark, items, claims):
    return spark.createDataFrame(items, "g string, item_id int, i_start bigint, i_end bigint").repartition(4), spark.createDataFrame(claims, "g string, record_id int, c_start bigint, c_end bigint").repartition(3)


@pytest.mark.parametrize("island", [overlaps.ISLAND, 3])
def test_matching_equals_the_rule(spark, island):
    rng = random.Random(island)
    spans = lambda n: [(rng.choice("xyz"), k, *(lambda a: (a, a + rng.choice([0, 1, 3, 9, 40, 300, -2])))(rng.randrange(-50, 600))) for k in range(n)]
    items, claims = spans(160), spans(140)
    items += [("x", 900, None, 5), ("x", 901, 0, None), ("z", items[0][1], 5, 9), ("z", 3, 40, 60), ("z", 3, 500, 540)]
    a, b = frames(spark, items, claims)
    got = [tuple(r) for r in overlaps.greedy_pairs(a, b, ["g"], island).collect()]
    assert sorted(got) == plain(items, claims)
    found = sorted((r.g, r.item_id, r.record_id, r.overlap) for r in overlaps.overlapping(a, b, ["g"]).collect())
    assert found == sorted((g, i, r, min(y, d) - max(x, c)) for g, i, x, y in items for h, r, c, d in claims if g == h and None not in (x, y) and min(y, d) > max(x, c) and x < y and c < d)
    assert overlaps.greedy_pairs(a.where("false"), b, ["g"]).count() == 0 and overlaps.greedy_pairs(a, b.where("false"), ["g"]).count() == 0


def test_small_groups_take_neither_ladder_nor_islands(spark, monkeypatch):
    """Many groups of few ranges, with ties, repeated ids, null ends and null ids of claims, equal the rule."""
    monkeypatch.setattr(overlaps, "_of_many", None)
    rng = random.Random(4)
    spans = lambda n: [(f"g{rng.randrange(40)}", rng.randrange(6), *(lambda a: (a, a + rng.choice([0, 2, 5, 5, 9, -2])))(rng.randrange(20))) for _ in range(n)]
    items, claims = spans(300), spans(280)
    items += [("g1", 7, None, 5), ("g1", 8, 0, None)]
    a, b = frames(spark, items, claims)
    assert sorted(tuple(r) for r in overlaps.greedy_pairs(a, b, ["g"]).collect()) == plain(items, claims)
    assert overlaps.greedy_pairs(a.where("false"), b, ["g"]).count() == 0
    a, b = frames(spark, [("x", None, 0, 9), (None, 1, 0, 9)], [("x", 1, 0, 9), (None, 1, 0, 9)])
    assert overlaps.greedy_pairs(a, b, ["g"]).count() == 0


def test_a_long_chain_takes_no_rounds(spark, monkeypatch):
    """Each neighbour overlaps more than the last, so mutual best pairs settle one at a time: 10,000 of them."""
    monkeypatch.setattr(overlaps, "_in_rounds", None)
    n, at, rows = 10_000, 0, []
    for k in range(2 * n):
        rows.append((at, at + 4 * n + 3 * k))
        at = rows[-1][1] - (n + k // 2)
    items = [("x", k, *rows[k]) for k in range(0, 2 * n, 2)]
    claims = [("x", k, *rows[k]) for k in range(1, 2 * n, 2)]
    a, b = frames(spark, items, claims)
    start = time.time()
    got = metrics.overlap_pairs(a, b, ["g"]).agg(F.count("*"), F.sum("overlap")).first()
    assert time.time() - start < 60 and got[0] >= n - 1
    near = [(-(min(rows[k][1], rows[k + 1][1]) - rows[k + 1][0]), min(k, k + 1), k) for k in range(2 * n - 1)]
    used, total = set(), 0
    for minus, _, k in sorted(near, key=lambda x: (x[0], x[2] + x[2] % 2)):
        if k not in used and k + 1 not in used:
            used |= {k, k + 1}
            total -= minus
    assert got[1] == total


def test_running_over_pieces(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), k, rng.randrange(100)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(7)
    got = {(r.g, r.k): (r.s, r.m) for r in running(df, ["g"], ["k"], {"s": "v"}, {"m": "v"}).collect()}
    for g in "ab":
        own = [(k, v) for h, k, v in rows if h == g]
        for n, (k, _) in enumerate(own):
            assert got[g, k] == (sum(v for _, v in own[: n + 1]), max((v for _, v in own[:n]), default=None))
