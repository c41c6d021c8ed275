"""Interpreting predicates, the passes over a store, decision records."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import passes
from tidemark.operators import predicates
from tidemark.sources import documents
from tidemark.store import Store

ATOM = st.sampled_from(["a <= 1", "b > 2", 'c == "x"', "c != 3", "u < 1", "a / (b - 3) >= 0", "c < 1", "t == true", "a + b == 4"])
TREE = st.recursive(ATOM, lambda x: st.one_of(st.builds("({} and {})".format, x, x), st.builds("({} or {})".format, x, x), st.builds("not ({})".format, x)), max_leaves=5)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TREE, min_size=8, max_size=8))
def test_interpreter_agrees_with_columns(spark, texts):
    trees = [predicates.parse(t) for t in texts]
    bound = {"a": ("num", F.lit(1.0)), "b": ("num", F.lit(3.0)), "c": ("str", F.lit("x")), "t": ("bool", F.lit(True))}
    row = spark.range(1).select(*(predicates.lower(t, bound).alias(f"c{k}") for k, t in enumerate(trees))).first()
    assert list(row) == [predicates.evaluate(t, {"a": 1.0, "b": 3.0, "c": "x", "t": True})[0] for t in trees]


def test_left_reason_stands():
    assert predicates.evaluate(predicates.parse("u < 1 and v < 1"), {}) == (None, "u is not bound")
    assert predicates.evaluate(predicates.parse("u < 1 and 1 > 2"), {}) == (False, None)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    put = lambda kind, *pairs: s.add(kind, spark.createDataFrame([(i, json.dumps(p)) for i, p in pairs], "id string, payload string"), "t")
    put("decision", ("D-0001", {"impact": "high", "scope": "organisation"}))
    put("assumption", ("A-0001", {"predicate": "weeks <= 6", "n": 1.5}), ("A-0002", {"predicate": "size < 3", "expiry_condition": "when(weeks > 7)"}), ("A-0003", {"predicate": "weeks<=6"}), ("A-0004", {"predicate": "?"}))
    put("estimate", *((f"EST-{k:04d}", {"owner": "o", "work_class": "c", "active": 5.0}) for k in range(1, 7)))
    put("outcome", *((f"OUT-{k:04d}", {"estimate_id": f"EST-{k:04d}", "active": 10.0}) for k in range(1, 7)))
    edges = [("assumes", "D-0001", "decision", "A-0001", "assumption"), ("estimated_as", "A-0001", "assumption", "EST-0001", "estimate"), ("estimated_as", "A-0002", "assumption", "EST-0009", "estimate")]
    s.link(spark.createDataFrame(edges, "link_type string, src string, src_kind string, dst string, dst_kind string"))
    return s


def test_monitor_writes_once(store):
    told = {r.id: r.new_status for r in passes.monitor(store, {"weeks": 8}, []).collect()}
    assert told == {"A-0001": "breached", "A-0002": "expired", "A-0003": "breached"}
    assert passes.monitor(store, {"weeks": 8}, []).count() == 0
    found = {r.subject_id: r.severity for r in store.list_all("finding", schema="subject_id string, severity string").collect()}
    assert found == {"A-0001": "critical", "A-0003": "low"}
    assert json.loads(store.get("assumption", "A-0001").first().payload) == {"predicate": "weeks <= 6", "n": 1.5, "status": "breached"}


def test_fuse_and_govern(store):
    assert {(r.assumption, r.verdict) for r in passes.price(store).collect()} == {("A-0001", "flipped"), ("A-0002", "missing_estimate")}
    assert [r.action for r in passes.fuse(store).collect()] == ["added"] and [r.action for r in passes.fuse(store).collect()] == ["kept"]
    assert [(r.older, r.newer) for r in passes.govern(store).collect()] == [("A-0001", "A-0003")]
    assert passes.govern(store).count() == 0


def test_decision_records(spark):
    text = "# Use one store\n\n## Chosen\nOne file.\n\nMore.\n\n## Rejected\n| Option | Reason |\n| --- | --- |\n| `Two` | slow |\n\n## Assumptions\n| # | Claim | Predicate | Expiry |\n|---|---|---|---|\n| 1 | small | `rows < 10` | `when(rows > 9)` |\n"
    docs = spark.createDataFrame([("a", "markdown", text), ("b", "markdown", "no title"), ("c", "text", text), ("d", "markdown", None)], "source_uri string, source_kind string, content string")
    (r,) = documents.decision_tables(docs).collect()
    assert (r.title, r.chosen, [tuple(x) for x in r.rejected]) == ("Use one store", "One file.", [("Two", "slow")])
    assert [tuple(x) for x in r.assumptions] == [("small", "rows < 10", "when(rows > 9)")]


def test_request_digest(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "é"}',), ('{"a":"é","b":1}',), ("x",), (None,)], "r string").select(documents.request_digest("r").alias("h"))
    a, b, c, d = [r.h for r in df.collect()]
    assert a == b and len(a) == 32 and c is None and d is None


def test_commands(spark, store, tmp_path, capsys):
    from tidemark.__main__ import main

    (tmp_path / "facts.json").write_text(json.dumps({"facts": {"weeks": 8}, "events": [], "as_of": "2024-01-01T00:00:00Z"}))
    main(["fuse", "--dry-run", store.folder], spark)
    main(["monitor", store.folder, str(tmp_path / "facts.json")], spark)
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert out[0]["action"] == "added" and {r["new_status"] for r in out[1:]} == {"breached", "expired"}
    assert store.list_all("finding").count() == 2


def test_retire(store):
    at = F.current_timestamp() + F.make_dt_interval(F.lit(90))
    assert passes.retire(store).where("refused = 'too_recent'").count() == 4
    assert {(r.id, r.refused) for r in passes.retire(store, at).collect()} == {("A-0001", "still_in_use"), ("A-0002", None), ("A-0003", None), ("A-0004", None)}
    assert [(r.id, r.refused) for r in passes.retire(store, at).collect()] == [("A-0001", "still_in_use")]


def test_contradiction_counts(spark, store, capsys):
    from tidemark.__main__ import main

    store.add("assumption", spark.createDataFrame([("A-0005", '{"predicate": "weeks > 6"}'), ("A-0006", '{"predicate": "weeks == 7 and size >= 3"}')], "id string, payload string"), "t")
    main(["contradiction-counts", store.folder], spark)
    told = {(x["id"], x["name"]): (x["links"], x["witness"]) for x in map(json.loads, capsys.readouterr().out.splitlines())}
    assert told == {
        ("A-0001", "weeks"): (2, "A-0006"), ("A-0003", "weeks"): (2, "A-0006"), ("A-0005", "weeks"): (2, "A-0001"), ("A-0006", "weeks"): (2, "A-0001"),
        ("A-0002", "size"): (1, "A-0006"), ("A-0006", "size"): (1, "A-0002"),
    }


def test_govern_is_one_pass(spark, store):
    """Challenge, merge, retire and route in one commit; what was said once is not written again."""
    store.add("finding", spark.createDataFrame([("F-1", json.dumps({"finding_kind": "k", "subject_id": "A-0001", "prosecution": "p", "confidence": 0.9})), ("F-2", json.dumps({"finding_kind": "k", "subject_id": "A-0004", "prosecution": "p", "confidence": 0.2}))], "id string, payload string"), "t")
    asked = []

    def judge(findings):
        rows = findings.collect()
        asked.extend(r.id for r in rows)
        return spark.createDataFrame([(r.id, "overturned", "no case") for r in rows], "id string, verdict string, rebuttal string")

    before = store.version()
    at = F.current_timestamp() + F.make_dt_interval(F.lit(90))
    told = passes.governed(store, judge, at)
    assert store.version() == before + 1 and asked == ["F-1"]
    assert [(r.id, r.verdict, r.action) for r in told.challenged.collect()] == [("F-1", "overturned", "revised")]
    assert [(r.older, r.newer, r.outcome) for r in told.merges.collect()] == [("A-0001", "A-0003", "duplicate")]
    assert {r.id for r in told.retired.where("refused is null").collect()} == {"A-0002", "A-0003", "A-0004"}
    assert {r.id: (r.route, r.reasons) for r in told.routes.collect()} == {"F-1": ("dropped", ""), "F-2": ("needs_human", "undecided,unsure,subject_withdrawn")}
    assert json.loads(store.get("finding", "F-1").first().payload)["challenge"] == "no case"
    again = passes.governed(store, judge, at)
    assert store.version() == before + 1 and asked == ["F-1"] and again.challenged.count() == 0 and again.merges.count() == 0


def test_curation_refuses_one_time_and_one_document(spark, store):
    put = lambda i, span: store.add("assumption", spark.createDataFrame([(i, json.dumps({"predicate": f"x == {int(i[-1])}", "span_id": span}))], "id string, payload string"), "t")
    for i, span in (("A-0011", "S-1"), ("A-0012", "S-2"), ("A-0013", "S-3")):
        put(i, span)
    store._write("spans", spark.createDataFrame([("S-1", "D1", 0, 1, "a"), ("S-2", "D1", 1, 2, "b"), ("S-3", "D2", 0, 1, "c")], "id string, doc_id string, start_byte int, end_byte int, text string"))
    assert passes.contradictions(store, dry=False).count() == 3
    outcome = {(r.older, r.newer): r.outcome for r in passes.curate(store).where("older like 'A-001%'").collect()}
    assert outcome == {("A-0011", "A-0012"): "same_document", ("A-0011", "A-0013"): "revision", ("A-0012", "A-0013"): "revision"}
    assert set(map(tuple, passes.govern(store).collect())) == {("A-0001", "A-0003"), ("A-0011", "A-0013"), ("A-0012", "A-0013")}
    assert store.get("assumption", "A-0011").first().retracted is False


def test_predicates_are_judged_where_their_rows_are(spark):
    df = spark.createDataFrame([("a", "x < 2", 1.0, "s"), ("b", "x < 2", 3.0, None), ("c", "?", 1.0, "t"), ("d", None, None, "u"), (None, "x < 2", 1.0, "v")], "id string, predicate string, v double, kept string")
    told = predicates.judged(df.withColumn("name", F.lit("x")).withColumn("at", F.timestamp_seconds("v")), "predicate", {"name": "v"})
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {(r.id, r.verdict, r.reason, r.kept, r["at"] is None) for r in told.collect()} == {
        ("a", True, None, "s", False), ("b", False, None, None, False), ("c", None, "not a predicate", "t", False), ("d", None, "not a predicate", "u", True)
    }


def test_passes_sort_nothing(store):
    """Prices and verdicts come from records in no order."""
    for told in (passes.price(store), passes.verdicts(store, {"weeks": 8}, [], F.current_timestamp()), passes._assumptions(store)):
        assert "rangepartitioning" not in told._jdf.queryExecution().executedPlan().toString()
