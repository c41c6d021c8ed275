"""Sources, monitoring verdicts and streams."""

import json

from pyspark.sql import functions as F

from tidemark.operators import monitoring
from tidemark.sources import documents
from tidemark.streaming import heads


def test_files_become_documents(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿# Título #\r\nbody é\r".encode())
    (tmp_path / "b.txt").write_text("First\n\nrest")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/c.json").write_text(json.dumps({"title": "T", "x": {"y": [1, {}]}}))
    (tmp_path / "d.pdf").write_text("no")
    (tmp_path / "e.txt").write_bytes(b"\xff")
    (tmp_path / "f.txt").write_text(" \n")
    good, bad = documents.read_documents(spark, str(tmp_path))
    got = {r["source_uri"].rsplit("/", 1)[1]: r for r in good.collect()}
    assert got["a.md"]["title"] == "Título" and got["a.md"]["content"] == "# Título #\nbody é\n"
    assert got["b.txt"]["title"] == "First" and got["c.json"]["content"] == "title: T\n\nx.y.0: 1\n\nx.y.1: {}" and got["c.json"]["title"] == "T"
    assert {r["source_uri"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()} == {"d.pdf": "unknown_suffix", "e.txt": "not_utf8", "f.txt": "empty"}


def test_facts_and_lines(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"facts": {"n": 1.5, "t": "2", "b": True, "s": "x"}, "events": []}))
    got = {r["name"]: r for r in documents.read_facts(spark, str(tmp_path / "f.json")).collect()}
    assert float(got["t"]["num"]) == 2 and got["b"]["bool"] is True and got["s"]["str"] == "x" and got["s"]["num"] is None
    (tmp_path / "r.jsonl").write_text('# header\n{"a": 1}\n')
    assert [r["a"] for r in documents.read_jsonl(spark, str(tmp_path / "r.jsonl"), "a int").collect()] == [1]


def test_expiry_is_open_and_closed(spark):
    df = spark.createDataFrame([('after("2020-01-01")',), ('on_event("Go  Live")',), ('on_event("never")',), ("x",)], "c string")
    got = df.select(monitoring.fired(F.col("c"), F.lit("2021-01-01").cast("timestamp"), F.array(F.lit("go live"))).alias("v")).collect()
    assert [r["v"] for r in got] == [True, True, False, None]


def test_second_pass_writes_nothing(spark):
    new = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 3, "c")], "kind string, subject int, text string")
    old = spark.createDataFrame([("k", 1, "a"), ("k", 2, "x")], "kind string, subject int, text string")
    got = monitoring.finding_changes(new, old, ["kind", "subject"], "text")
    assert {r["subject"]: r["action"] for r in got.collect()} == {1: "kept", 2: "revised", 3: "added"}
    assert {r["action"] for r in monitoring.finding_changes(new, new, ["kind", "subject"], "text").collect()} == {"kept"}


def test_heads_in_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "id int, version int, retracted boolean").write.parquet(str(tmp_path / "v"))
    stream = heads.running_heads(spark.readStream.schema("id int, version int, retracted boolean").parquet(str(tmp_path / "v")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("heads").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["id"], r["version"], r["retracted"]) for r in spark.table("heads").collect()} == {(1, 2, True), (2, 1, False)}


def test_report_files(spark, tmp_path):
    import pytest

    from tidemark.sources import reports

    df = spark.createDataFrame([("b", 2.0), ("a|c", None)], "measure string, value double")
    sections = {"Grades": (df, ["measure", "value"]), "Again": (df.limit(0), ["measure"])}
    reports.write_markdown(str(tmp_path / "r.md"), "Run", sections)
    (text,) = [f.read_text() for f in (tmp_path / "r.md").glob("part-*")]
    assert text == "# Run\n\n## Grades\n\n| measure | value |\n| --- | --- |\n| a\\|c |  |\n| b | 2.0 |\n\n## Again\n\n| measure |\n| --- |\n"
    reports.write_json(str(tmp_path / "r.json"), sections)
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "r.json")).select("section", "measure", "value").collect()), key=str) == [("Grades", "a|c", None), ("Grades", "b", 2.0)]
    with pytest.raises(ValueError):
        reports.report_lines("x", {"Long": (spark.range(reports.MOST + 1), ["id"])})


def test_only_texts_that_need_it_go_to_workers(spark):
    """Plain and JSON texts are told apart before a worker sees them; the text is what NFC of all of it gives."""
    import unicodedata

    from tidemark.sources import documents

    texts = ["plain", "été", "e\u0301te\u0301", "\u1100\u1161", "\u212b", "", None, "\u02ff\u0300", "\U0001d15e"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.t for r in df.select("k", "t").transform(lambda x: documents.composed(x, "t")).orderBy("k").collect()]
    assert got == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    seen = []
    documents.documents_of(spark.createDataFrame([("/a.txt", bytearray(b"x"))], "path string, content binary"), lambda c: seen.append(str(c)) or documents.rendered_json(c))
    assert "CASE WHEN" in seen[0]
