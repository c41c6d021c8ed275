"""Commits are whole or not there; of two writers of one record one wins; snapshots are read in place of what they cover."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import passes
from tidemark.commits import Log
from tidemark.store import Conflict, Refused, Store

EDGE = "link_type string, src string, src_kind string, dst string, dst_kind string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows(spark, *ids, **payload):
    return spark.createDataFrame([(i, json.dumps(payload)) for i in ids], "id string, payload string")


def whole(s):
    """All that a reader sees."""
    return sorted(map(str, [*s.records().drop("created_at").collect(), *s.edges().drop("created_at").collect(), *s.spans().collect(), *s.audit().drop("occurred_at", "ordinal").collect()]))


class Crash(Exception):
    pass


def test_a_crash_between_any_two_writes_leaves_the_old_version(spark, store, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# One\n\nFirst text.\n\nSecond text.")
    store.add("decision", rows(spark, "D-0001"), "t")
    edge = spark.createDataFrame([("assumes", "D-0001", "decision", "A-0001", "assumption")], EDGE)
    before = whole(store)

    def work():
        with store.transaction():
            store.ingest(str(tmp_path / "in"))
            store.add("assumption", rows(spark, "A-0001"), "t")
            store.link(edge)

    stage, put, left = Log.stage, Log.put, [0]

    def breaking(real):
        def step(*a, **k):
            if left[0] == 0:
                raise Crash
            left[0] -= 1
            return real(*a, **k)

        return step

    monkeypatch.setattr(Log, "stage", breaking(stage))
    monkeypatch.setattr(Log, "put", breaking(put))
    crashes = 0
    while True:
        left[0] = crashes
        try:
            work()
            break
        except Crash:
            crashes += 1
            assert whole(Store(spark, store.folder)) == before and store.version() == 1
    assert crashes == 7  # two tables of documents, spans, two of assumptions, edges, the commit
    monkeypatch.undo()
    assert store.version() == 2 and store.spans().count() == 3 and passes.doctor(store).count() == 0
    assert whole(Store(spark, store.folder, at=1)) == before
    seen = whole(store)
    assert Log(spark, store.folder).vacuum() == 0 and Log(spark, store.folder).vacuum(-60) == 21 and whole(store) == seen


def test_two_writers_of_one_record(spark, store):
    store.add("decision", rows(spark, "D-0001", "D-0002"), "t")
    other = Store(spark, store.folder)
    change = lambda i: spark.createDataFrame([(i, 1, "{}")], "id string, version int, payload string")
    with pytest.raises(Conflict):
        with store.transaction():
            store.revise("decision", change("D-0001"), "a")
            other.revise("decision", change("D-0001"), "b")
    assert [r.created_by for r in store.versions("decision", "D-0001").collect()] == ["t", "b"]
    with store.transaction():
        store.revise("decision", change("D-0002"), "a")
        other.add("decision", rows(spark, "D-0003"), "b")
    assert store.version() == 4 and {r.id for r in store.heads("decision").collect()} == {"D-0001", "D-0002", "D-0003"}
    ordinals = [r.ordinal for r in store.audit().collect()]
    assert len(set(ordinals)) == len(ordinals) == 5 and passes.doctor(store).count() == 0
    assert [r.id for r in store.audit().orderBy(F.desc("ordinal")).limit(2).collect()] == ["D-0002", "D-0003"]  # as committed
    edge = spark.createDataFrame([("assumes", "D-0001", "decision", "A-1", "assumption")], EDGE)
    with pytest.raises(Conflict):
        with store.transaction():
            store.link(edge)
            other.link(edge)
    assert store.edges().count() == 1


def test_put_is_once(spark, store):
    log = Log(spark, store.folder)
    assert log.put(1, {"added": {}}) and not log.put(1, {"added": {"records": ["x"]}}) and log.state().batches == {}
    assert log.versions() == [1]


def test_a_transaction_reads_what_it_wrote_and_joins(spark, store):
    with pytest.raises(Refused):
        with store.transaction():
            store.add("decision", rows(spark, "D-0001"), "t")
            with store.transaction():
                assert store.exists("decision", "D-0001")
                store.add("decision", rows(spark, "D-0001"), "t")
    assert store.version() == 0 and store.heads().count() == 0
    with store.transaction():
        pass
    assert store.version() == 0


def test_heads_read_the_snapshot_and_what_came_after(spark, store):
    """After many batches a head reads one snapshot and one batch; old versions stay."""
    for k in range(12):
        store.add("decision", rows(spark, *(f"D-{k:02d}{j}" for j in range(3)), k=k), "t")
    store.retract("decision", spark.createDataFrame([("D-000",)], "id string"), "t")
    plain = sorted(map(str, store.heads().collect()))
    assert store.compact() == 14 and sorted(map(str, store.heads().collect())) == plain
    assert all("heads=" in f for f in store.heads("decision").inputFiles())
    store.revise("decision", spark.createDataFrame([("D-001", 1, '{"new": 1}')], "id string, version int, payload string"), "t")
    files = store.heads("decision").inputFiles()
    assert len({f.split("/records/")[1].split("/")[0] for f in files}) == 2
    assert store.get("decision", "D-001").first().payload == '{"new": 1}' and store.get("decision", "D-000").first().retracted
    plan = store.get("decision", "D-001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,D-001)" in plan  # files whose ids do not meet it are skipped
    assert Store(spark, store.folder, at=13).heads().count() == 36 and store.compact() == 16 and store.compact() == 16
    assert store.versions("decision", "D-001").count() == 2 and store.log.state().snapshots.keys() == {"records"}
    store.log._read.clear()
    store.log.state()
    assert set(store.log._read) == {16}  # older commits need not be read


def test_other_file_systems_put_once_too(spark, tmp_path):
    """Through a file system that is not local by name."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.kept.link./in", f"file://{tmp_path}")
    conf.set("fs.AbstractFileSystem.viewfs.impl", "org.apache.hadoop.fs.viewfs.ViewFs")
    log = Log(spark, "viewfs://kept/in/s")
    assert log.put(1, {"added": {}}) and not log.put(1, {"added": {"records": ["x"]}})
    assert log.state().version == 1
