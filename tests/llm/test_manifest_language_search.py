"""Merkle manifest, language identification and ranked search against plain versions, and the cases their docstrings define."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, lexical, merkle, queries

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    return spark.createDataFrame(rows, DOC)


# --- manifest


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r):
    said = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]]
    return H("-" if x is None else f"{len(str(x).encode())}:{x}" for x in said)


def plain_tree(leaves):
    """All levels of a tree, and for each leaf its proof: (before, after) digests by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    proofs = []
    for i in range(len(leaves)):
        path = []
        for nodes in levels[:-1]:
            run = i // 8 * 8
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
            i //= 8
        proofs.append(path)
    return levels[-1][0], proofs


def plain_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r["doc_id"]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g]), plain_tree([x[2] for x in sorted(groups[g])])) for g in order}
    root, crown = plain_tree([trees[g][1][0] for g in order])
    out = []
    for g, top in zip(order, crown):
        leaves, (subroot, proofs) = trees[g]
        out += [(x[3], x[2], subroot, root, path + top) for x, path in zip(leaves, proofs)]
    return out


@pytest.mark.parametrize("block_height, sizes", [(4, (1, 8, 9, 513, 64)), (1, (1, 7, 8, 9, 65, 600)), (2, (64, 65, 4097, 3))])
def test_proofs_equal_a_plain_tree(spark, block_height, sizes):
    rng = random.Random(block_height)
    langs = [None, "", "de", "zu", "é", "Z"]
    rows = [(rng.choice([None, rng.randrange(10**6)]) if k % 97 == 0 else rng.randrange(10**6), rng.choice(["Text " * 3, "", None, "ü"]), g, "s", 4) for n, g in zip(sizes, langs) for k in range(n)]
    rows += rows[:3]
    df = documents(spark, rows).repartition(5)
    got = sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], [(s.before, s.after) for s in r["path"]]) for r in merkle.prove(df, height=block_height).collect())
    assert got == sorted((str(x[0]), *x[1:]) for x in plain_manifest([r.asDict() for r in df.collect()]))


def test_tampered_rows_fail(spark, tmp_path):
    rows = [(k, "Plain text" if k % 2 else "lower only", "en" if k % 5 else None, "s", 10) for k in range(70)] + [(None, None, None, None, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op11_merkle(spark, str(tmp_path)).collect()}
    for k, text, *_ in rows:
        broken = k is not None and zlib.crc32(str(k).encode()) % 3 == 0 and text == "Plain text"
        assert got[k].verified == (not broken) and (got[k].folded_root == got[k].root) == got[k].verified


def test_traversal_memory_is_logarithmic():
    """Every tree of 1 to 200 leaves, and no stack that holds more than a run a level."""
    held = []

    class Watched(merkle.Treehash):
        def step(self):
            super().step()
            held.append(max(map(len, self.stack[:-1]), default=0))

    plain, merkle.Treehash = merkle.Treehash, Watched
    try:
        for n in range(1, 200):
            leaves = [b"%064d" % k for k in range(n)]
            height = merkle.levels(n, 4)
            root, proofs = plain_tree([x.decode() for x in leaves])
            assert merkle.subtree_root(leaves, height).decode() == root
            assert [[(a.decode(), b.decode()) for a, b in p] for p in map(list, merkle.traverse(leaves, height))] == proofs
    finally:
        merkle.Treehash = plain
    assert max(held) < 8


def test_manifest_of_nothing_and_of_other_columns(spark):
    assert merkle.prove(documents(spark, [])).count() == 0
    one = documents(spark, [(7, "a", "en", "s", 1)])
    told = merkle.prove(one.withColumns({"leaf": F.lit("x"), "path": F.lit(1), "pos": F.lit(2)})).collect()
    assert [(r.doc_id, r.leaf == r.root == r.subroot, r.path) for r in told] == [(7, True, [])]


# --- language


WORDS = {"en": "the of and with this that thing over under stone water".split(), "fr": "le la les avec cette où être élan rivière pierre été".split(), "de": "der die das und mit über straße wasser stein größe nicht".split()}


def speech(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n))


def plain_grams(text):
    """Distinct runs of 1 to 4 characters, as text."""
    import unicodedata

    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    kept = " " + " ".join(kept.split()) + " "
    return {kept[i : i + n] for n in range(1, 5) for i in range(len(kept) - n + 1)} if any(c.isalpha() for c in text) else set()


def test_sets_and_kernel_equal_plain_ones():
    rng = random.Random(5)
    texts = [speech(rng, g, n) + rng.choice([" 12!", "\n\n,", "", "\U0001f600 Ä"]) for g in WORDS for n in (1, 2, 7, 30)]
    code = {}
    for t in texts:
        for g in plain_grams(t):
            code.setdefault(g, len(code))
    same = collections.Counter()
    for a in texts:
        for b in texts:
            x, y = plain_grams(a), plain_grams(b)
            exact = len(x & y) / math.sqrt(len(x) * len(y)) + 1
            hashed = float(language.kernel([language.grams(a)], [language.grams(b)])[0, 0])
            same[abs(exact - hashed) < 0.02] += 1  # buckets are shared by chance
    assert same[False] == 0


def test_table_equals_the_kernel_expansion():
    """One product with the folded table is the kernel against the landmarks times their ridge weights, found by plain least squares."""
    rng = random.Random(2)
    langs = [g for _ in range(12) for g in WORDS]
    sets = [language.grams(speech(rng, g, rng.randrange(3, 30))) for g in langs]
    model = language.train(sets, langs, landmarks=15)
    k, among = language.kernel(sets, sets[:15]).astype(float), language.kernel(sets[:15], sets[:15]).astype(float)
    said = np.where(np.array(langs)[:, None] == np.array(model.languages), 1.0, -1.0)
    left = k.T @ k / 12 + language.RIDGE * among
    weights = np.linalg.solve(left + 1e-9 * np.trace(left) * np.eye(15), k.T @ said / 12)
    fresh = [language.grams(speech(rng, g, 9)) for g in WORDS]
    assert np.allclose(model.margins(fresh), language.kernel(fresh, sets[:15]) @ weights, atol=2e-3)


def test_held_out_languages(spark):
    found = queries.op12_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    out = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in found)


def test_language_cases(spark):
    rng = random.Random(3)
    rows = [(k, speech(rng, g, 8), g, "s", 1) for k, g in enumerate(list(WORDS) * 20)]
    odd = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "12 34 — !", "fr", "s", 0), (None, speech(rng, "de", 8), "de", "s", 0), (903, speech(rng, "fr", 40_000), None, "s", 0), (5, "wasser", "en", "s", 0)]
    df = documents(spark, rows + odd + rows[:5]).withColumns({"score": F.lit("x"), "turn": F.lit(1)})
    model = language.fit(df)
    got = language.identify(df, model).collect()
    assert len(got) == len(rows) + len(odd) + 5 and isinstance(got[0].score, float)
    by = {r.doc_id: r for r in got}
    assert [(by[k].lang_pred, by[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[903].lang_pred == "fr" and by[None].lang_pred == "de"
    bare = documents(spark, [(1, "hello there", None, "s", 1)])
    assert [(r.lang_pred, r.score) for r in language.identify(bare, language.fit(bare)).collect()] == [("und", 0.0)]
    assert language.identify(documents(spark, []), model).count() == 0


# --- search


def plain_terms(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_search(docs, items, k):
    held = [(i, plain_terms(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = collections.Counter(t for _, w in held for t in set(w))
    out = []
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(plain_terms(text))
    for item, terms in asked.items():
        scored = []
        for i, w in held:
            tf, m = collections.Counter(w), 50 + 50 * len(w) * n // (total or 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    if seed:
        monkeypatch.setattr(lexical, "MANY", 300)  # many runs a batch
        monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)  # many blocks of items
    words = [f"w{k}" for k in range(40)] + ["Ärger", "ärger", "A", "a", "x_y", "7€"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights=[1 + 90 // (k + 1) for k in range(len(words))], k=n))
    docs = [(rng.randrange(500) if k % 50 else None, rng.choice([None, "", "!!", text(3), text(40), text(200)])) for k in range(300)]
    docs += [docs[5]] * 70 + [(k, "w1 w2 w3") for k in range(60)]
    items = [(k, text(rng.randrange(1, 30))) for k in range(20)] + [(3, "w39 w38"), (90, None), (91, "!!"), (92, "unheard"), (None, "w1")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"n": F.lit("x"), "rank": F.lit(0)}).repartition(6)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(d, i, 25).collect()), key=repr)
    assert got == plain_search(docs, items, 25)


def test_search_of_nothing(spark):
    d, i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(d, i).count() == 0 and lexical.search(i.withColumnRenamed("item_id", "doc_id"), i.limit(0)).count() == 0


def test_radix_order_is_stable():
    keys = np.random.default_rng(1).integers(0, 1 << 32, 5000, dtype=np.uint32) & np.uint32(0x00FF00FF)
    assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
