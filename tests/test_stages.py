"""Stages done once each, whatever stops them; reading documents by stages with answers from rules in place of a model."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark import stages as module
from tidemark.commits import Log
from tidemark.extraction import estimation, extraction
from tidemark.stages import Stage, ordered, outstanding, run
from tidemark.store import Store

DOCS = {
    "plan.md": "# Plan\n\nDecision: one ledger for everything.\n\nAssumption: the ledger holds under nine million rows.\n\nEstimate: loading the ledger backend takes alice 5 days.",
    "later.md": "# Later\n\nLoading the ledger backend took 9 days in the end.\n\nEstimate: painting the shed takes bob 2 days.",
    "empty.txt": "Nothing to see\n\nhere at all.",
}


@F.udf(StringType())
def answer(stage, offered):
    shown = json.loads(offered)
    if stage == "formalise":
        return json.dumps({"predicate": "rows < 9_000_000" if "rows" in shown["statement"] else "?", "sureness": 0.9})
    if stage == "classify":
        return json.dumps({"work_class": "Data Loading"}) if "ledger" in shown["subject"] else None
    if stage == "match":
        hit = [p for p in shown["passages"] if " took " in p["text"]]
        return json.dumps({"actual": 9, "unit": "days", "span_id": hit[0]["span_id"], "quote": "took 9 days"}) if hit else None
    out = []
    for p in shown:
        head, _, said = p["text"].partition(": ")
        cite = {"span_id": p["span_id"], "quote": said}
        if stage == "scout" and head == "Decision":
            out += [{"title": said, "impact": "high", **cite}, {"title": "made up", **cite, "quote": "not there"}, {"title": "elsewhere", **cite, "span_id": "SPAN-0"}]
        if stage == "assumptions" and head == "Assumption":
            out.append({"statement": said, "confidence": 0.8, **cite})
        if stage == "estimates" and head == "Estimate":
            subject, _, rest = said.partition(" takes ")
            owner, days, unit = rest.rstrip(".").split()
            out.append({"subject": subject, "owner": owner, "active": float(days), "unit": unit, **cite})
    return json.dumps(out)


def ask(stage, offered):
    return offered.select("id", answer(F.lit(stage), "offered").alias("answer"))


@pytest.fixture
def store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in DOCS.items():
        (tmp_path / "in" / name).write_text(text)
    s = Store(spark, str(tmp_path / "s"))
    s.ingest(str(tmp_path / "in"))
    return s


def whole(s):
    rows = s.heads().select("kind", "id", "version", "payload").collect() + s.edges().select("link_type", "src", "dst").collect() + s.refused().collect() + s.attempts().select("stage", "id").collect()
    return sorted(map(str, rows))


def test_documents_are_read_once(store):
    work = [*estimation(ask), *extraction(ask)]
    assert [s.name for s in ordered(work)] == ["scout", "assumptions", "estimates", "classify", "match", "formalise"]
    assert run(store, work) == {"scout": 3, "estimates": 3, "classify": 2, "match": 2, "assumptions": 1, "formalise": 1}
    payloads = {k: [json.loads(r.payload) for r in store.heads(k).collect()] for k in ("decision", "assumption", "estimate", "outcome")}
    assert [p["title"] for p in payloads["decision"]] == ["one ledger for everything."]
    (a,) = payloads["assumption"]
    assert a["predicate"] == "rows < 9_000_000" and abs(a["confidence"] - 0.72) < 1e-9
    assert {(p["owner"], p["work_class"]) for p in payloads["estimate"]} == {("alice", "data-loading"), ("bob", "unclassified")}
    assert {(p.get("active"), p.get("unresolved")) for p in payloads["outcome"]} == {(9.0, None), (None, "no_candidate")}
    assert {r.reason for r in store.refused().collect()} == {"not_quoted", "no_such_passage"}
    assert store.edges().select("link_type").collect()[0][0] == "assumes"
    assert [round(r.ratio, 2) for r in store.calibration_history().where("ratio is not null").collect()] == [1.8]
    seen, version = whole(store), store.version()
    assert set(run(store, work).values()) == {0} and whole(store) == seen and store.version() == version


def test_evaluation_counts_what_was_found(spark, store, tmp_path):
    """One decision found and one missed, an assumption found, an estimate right and one that is only a distraction."""
    from tidemark.evaluate import Flags, evaluate

    run(store, [*extraction(ask), *estimation(ask)])
    docs = {json.loads(r.payload)["content"]: json.loads(r.payload)["content_hash"] for r in store.heads("document").collect()}
    plan, later = next(t for t in docs if "Plan" in t), next(t for t in docs if "Later" in t)

    def item(name, text, kind, quote, fields=(), links=(), distractor=False):
        at = len(text[: text.index(quote)].encode())
        return (name, docs[text], kind, distractor, at, at + len(quote), [(*f, None) for f in fields], list(links))

    rows = [
        item("d1", plan, "decision", "one ledger", [("title", "one ledger for everything.", "exact"), ("impact", "low", "exact")], [("assumes", "a1")]),
        item("d2", later, "decision", "in the end"),
        item("a1", plan, "assumption", "nine million", [("predicate", "rows", "contains")], [("estimated_as", "e1")]),
        item("e1", plan, "estimate", "takes alice", [("owner", "alice", "exact"), ("active", "5", "numeric")]),
        item("e2", later, "estimate", "painting", distractor=True),
    ]
    shape = "item_id string, content_sha256 string, kind string, is_distractor boolean, start_byte int, end_byte int, fields array<struct<name:string,value:string,comparison:string,tolerance:string>>, links array<struct<link_type:string,target_item_id:string>>"
    verdicts = spark.createDataFrame([("a1", "breached")], "item_id string, status string")
    other = Store(spark, str(tmp_path / "graded"))
    told = {r.measure: r.value for r in evaluate(other, str(tmp_path / "in"), spark.createDataFrame(rows, shape), ask, {"rows": 10_000_000}, verdicts=verdicts).collect()}
    assert {k: told[k] for k in ("decision.precision", "decision.recall", "assumption.f1", "estimate.precision", "estimate.recall")} == {
        "decision.precision": 1.0, "decision.recall": 0.5, "assumption.f1": 1.0, "estimate.precision": 0.5, "estimate.recall": 1.0,
    }
    assert (told["all.precision"], told["all.recall"], told["fields.right"], told["items.exact"]) == (0.75, 0.75, 0.8, 0.6667)
    assert (told["assumes.precision"], told["assumes.recall"], told["estimated_as.recall"]) == (1.0, 1.0, 0.0)
    assert (told["monitoring.accuracy"], told["monitoring.recall"]) == (1.0, 1.0)
    version = other.version()
    again = evaluate(other, str(tmp_path / "in"), spark.createDataFrame(rows, shape), ask, {"rows": 10_000_000}, verdicts=verdicts, flags=Flags(estimation=False, memory=False, fusion=False, governance=False))
    assert {r.measure: r.value for r in again.collect()} == told and other.version() == version


def test_stopped_anywhere_it_ends_the_same(spark, store, tmp_path, monkeypatch):
    """The commit of each stage fails in turn; running again completes the store that an undisturbed run gives."""
    (tmp_path / "other").mkdir()
    calm = Store(spark, str(tmp_path / "calm"))
    calm.ingest(str(tmp_path / "in"))
    work = [*extraction(ask), *estimation(ask)]
    run(calm, work)
    put, fail = Log.put, [True]

    class Crash(Exception):
        pass

    def once(self, *a):
        fail[0] = not fail[0]
        if not fail[0]:
            raise Crash
        return put(self, *a)

    monkeypatch.setattr(Log, "put", once)
    crashes = 0
    for _ in range(20):
        try:
            run(store, work)
            break
        except Crash:
            crashes += 1
    assert crashes == 6 and whole(store) == whole(calm)


def test_portions_and_two_runners(spark, store):
    done = []

    def work(s, todo):
        done.extend(r.id for r in todo.collect())

    units = lambda s: s.spark.range(20).selectExpr("'u' || id AS id")
    stage = Stage("count", units, work)
    assert run(store, [stage], portions=4) == {"count": 20} and sorted(done) == sorted(set(done)) and len(done) == 20
    assert outstanding(store, stage).count() == 0 and store.attempts().count() == 20
    slow = Stage("slow", units, lambda s, todo: run(Store(spark, store.folder), [Stage("slow", units, lambda *_: None)]))
    with pytest.raises(Exception, match="written meanwhile"):
        run(store, [slow])
    assert store.attempts().where("stage = 'slow'").count() == 20
    with pytest.raises(ValueError):
        ordered([Stage("a", units, work, ("b",)), Stage("b", units, work, ("a",))])
    assert module.run(store, []) == {}


def test_commands_read_and_grade(spark, store, tmp_path, capsys):
    from tidemark.__main__ import main

    main(["extract", store.folder, "--ask", "test_stages:ask"], spark)
    main(["estimate", store.folder, "--ask", "test_stages:ask"], spark)
    main(["refresh-index", store.folder], spark)
    main(["compact", store.folder], spark)
    told = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert told[0] == {"scout": 3, "assumptions": 1, "formalise": 1} and told[1] == {"estimates": 3, "classify": 2, "match": 2} and told[2] == {"indexed": 9}
    doc = next(json.loads(r.payload) for r in store.heads("document").collect() if "Plan" in r.payload)
    text = doc["content"]
    item = lambda name, kind, quote: {"item_id": name, "kind": kind, "is_distractor": False, "start_byte": text.index(quote), "end_byte": text.index(quote) + len(quote), "quote": quote, "fields": [], "links": []}
    key = {
        "documents": [{"path": "plan.md", "source_kind": "markdown", "content_sha256": doc["content_hash"], "byte_length": len(text), "items": [item("d1", "decision", "one ledger"), item("a1", "assumption", "nine million")]}],
        "monitoring": {"facts": {"rows": "10000000"}, "events": [], "verdicts": [{"item_id": "a1", "status": "breached", "note": ""}]},
    }
    (tmp_path / "key.json").write_text(json.dumps(key))
    main(["eval", store.folder, str(tmp_path / "in"), str(tmp_path / "key.json"), "--ask", "test_stages:ask", "--out", str(tmp_path / "out")], spark)
    assert any("| decision.f1 | 1.0 |" in f.read_text() for f in (tmp_path / "out" / "report.md").glob("part-*")) and (tmp_path / "out" / "report.json").exists()
    graded = {x["measure"]: x["value"] for x in map(json.loads, capsys.readouterr().out.splitlines())}
    assert (graded["decision.f1"], graded["assumption.f1"], graded["estimate.precision"], graded["monitoring.accuracy"]) == (1.0, 1.0, 0.0, 1.0)
