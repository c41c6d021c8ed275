"""A stored index gives the scores of the plain search, whatever was added, replaced, removed and merged, and reads its terms only."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark import index as module
from tidemark.index import Index
from tidemark.operators import textops
from tidemark.store import Store


def texts(rng, n, words):
    return [(f"d{k:04d}", " ".join(rng.choices(words, weights=[200 // (j + 1) + 1 for j in range(len(words))], k=rng.randrange(0, 40)))) for k in range(n)]


def plain(spark, held, terms, k):
    df = spark.createDataFrame(sorted(held.items()), "id string, body string")
    return [(r.id, r.score) for r in textops.bm25(df, "id", "body", terms, k).collect()]


def test_scores_stay_those_of_the_plain_search(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Élan", "straße"]
    ix = Index(spark, str(tmp_path / "ix"))
    assert ix.search(["w1"]).count() == 0
    frame = lambda rows: spark.createDataFrame([(i, 1, t) for i, t in rows], "id string, version int, body string")
    held = dict(texts(rng, 400, words))
    ix.add(frame(held.items()))
    queries = [["w0", "w30"], ["w59"], ["elan", "W5", "w0"], ["none"], ["w0", "w1", "w2"]]
    same = lambda: all([(r.id, r.score) for r in ix.search(q, 15).collect()] == plain(spark, held, q, 15) for q in queries)
    assert same()
    change = {i: t for i, t in texts(rng, 60, words)} | {"new": "w59 w59 elan"}
    ix.add(frame(change.items()))
    held |= change
    assert same()
    ix.remove(spark.createDataFrame([(f"d{k:04d}",) for k in range(40, 90)], "id string"))
    for k in range(40, 90):
        held.pop(f"d{k:04d}")
    assert same()
    ix.merge()
    assert same() and len(ix.log.state().batches["postings"]) == 1
    ix.add(frame([("d0041", "w59 again")]))
    held["d0041"] = "w59 again"
    assert same()
    with pytest.raises(ValueError):
        ix.add(frame([("x", "a"), ("x", "b")]))


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path, monkeypatch):
    """Two thousand documents with a term, five of which hold it often: the other blocks are left out, the answer is the same."""
    ix = Index(spark, str(tmp_path / "ix"))
    held = {f"d{k:05d}": "common " + ("rare " * 9 if k % 400 == 7 else "rare " if k % 3 == 0 else "") + "filler " * (k % 11) for k in range(2000)}
    ix.add(spark.createDataFrame([(i, 1, t) for i, t in held.items()], "id string, version int, body string"))
    read = []
    real = Index._wanted

    def watched(self, blocks, *a):
        out = real(self, blocks, *a)
        read.append((blocks.count(), out.count()))
        return out

    monkeypatch.setattr(Index, "_wanted", watched)
    assert [(r.id, r.score) for r in ix.search(["rare"], 5).collect()] == plain(spark, held, ["rare"], 5)
    assert read[0][1] < read[0][0] / 3


def test_a_search_reads_the_postings_of_its_terms(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"))
    ix.add(spark.createDataFrame([(f"d{k}", 1, f"word{k} shared") for k in range(300)], "id string, version int, body string"))
    blocks = ix.postings(["word7"])
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,word7)" in plan
    assert {r.term for r in blocks.collect()} == {"word7"}
    heads = blocks.select("term", "block", "most")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<term:string,block:int,most:int>" in heads


def test_the_store_keeps_its_index(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    put = lambda *pairs: store.add("decision", spark.createDataFrame([(i, json.dumps({"title": t})) for i, t in pairs], "id string, payload string"), "t")
    put(("D-1", "Ledger backend"), ("D-2", "Migration window"))
    before = [(r.id, r.score) for r in store.search(["migration", "ledger"]).collect()]
    assert store.refresh_index() == 2 and [(r.id, r.score) for r in store.search(["migration", "ledger"]).collect()] == before
    put(("D-3", "A second migration"))
    assert {r.id for r in store.search(["migration"]).collect()} == {"D-2", "D-3"}  # not in the index yet, so found by reading
    assert store.refresh_index() == 1
    store.revise("decision", spark.createDataFrame([("D-2", 1, '{"title": "Cutover"}')], "id string, version int, payload string"), "t")
    store.retract("decision", spark.createDataFrame([("D-3",)], "id string"), "t")
    assert store.refresh_index() == 2 and store.refresh_index() == 0
    assert store.search(["migration"]).count() == 0 and [r.id for r in store.search(["cutover"]).collect()] == ["D-2"]
    assert module.plain_terms(["Élan", "elan"]) == ["elan"]


def test_postings_are_packed_before_they_are_shuffled(spark):
    """Postings move once, packed, and no range of them is looked for by doing the work twice."""
    rows = spark.createDataFrame([("a", 1, 2, ["x", "y"])], "id string, block int, len int, w array<string>")
    plan = module._posted(rows, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_chunks_lose_nothing(monkeypatch, chunk):
    """However finely blocks and segments are cut, each document has each of its words once with its newest text."""
    import pyarrow as pa

    monkeypatch.setattr(module, "CHUNK", chunk)
    rng = random.Random(5)
    docs = [(f"d{k:02d}", k % 3, rng.choices([f"w{j}" for j in range(12)] + ["ß"], k=rng.randrange(0, 9))) for k in range(30)]
    newer = [(i, b, ["w1", "new"]) for i, b, _ in docs[::4]]
    batch = lambda rows: pa.RecordBatch.from_pydict({
        "id": pa.array([r[0] for r in rows]), "block": pa.array([r[1] for r in rows], pa.int32()), "len": pa.array([len(r[2]) for r in rows], pa.int32()), "w": pa.array([r[2] for r in rows], pa.list_(pa.string())),
    })
    told = lambda packed: sorted(tuple(r[c] for c in ("term", "block", "id", "tf", "len")) for b in module._opened(packed) for r in b.to_pylist())
    want = lambda rows: sorted({(w, b, i, ws.count(w), len(ws)) for i, b, ws in rows for w in ws})
    at = lambda b, n: b.append_column("segment", pa.array([n] * b.num_rows, pa.int64()))
    old, new = ([at(b, n) for b in module._counted([batch(rows)])] for n, rows in ((1, docs), (2, newer)))
    assert told(old) == want(docs)
    names = ["block", "term", "segment", "n", "ids", "sizes", "tfs", "lens"]
    stream = [r for b in old + new for r in b.select(names).to_pylist()]
    stream += [dict.fromkeys(names) | {"block": b, "segment": 1, "ids": i.encode()} for i, b, _ in newer]
    stream.sort(key=lambda r: (r["block"], r["term"] or "", r["segment"]))
    schema = pa.schema([(n, old[0].select(names).schema.field(n).type) for n in names])
    batches = [pa.RecordBatch.from_pylist(stream[k : k + 5], schema) for k in range(0, len(stream), 5)]
    merged = [at(b, 2) for b in module._merged(batches)]
    now = {i: (i, b, ws) for i, b, ws in docs} | {i: (i, b, ws) for i, b, ws in newer}
    assert told(merged) == want(now.values())
    assert chunk < 10_000 or sum(b.num_rows for b in merged) == len({(t, b) for t, b, *_ in want(now.values())})


def test_an_index_of_another_layout_is_refused(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"))
    assert ix.log.put(1, {"added": {}, "stats": {"docs": 1, "words": 1, "stale": 0, "segment": 1}})
    with pytest.raises(RuntimeError, match="older layout"):
        ix.search(["a"])
