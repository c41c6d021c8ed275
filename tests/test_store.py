"""The versioned store: writes, refusals, walks, search and the command line."""

import json

import pytest

from tidemark.store import Refused, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows(spark, *pairs):
    return spark.createDataFrame([(i, json.dumps(p)) for i, p in pairs], "id string, payload string")


@pytest.fixture
def world(spark, store):
    store.add("decision", rows(spark, ("D-0001", {"title": "Ledger backend"}), ("D-0002", {"title": "Migration window"})), "t")
    store.add("assumption", rows(spark, ("A-0001", {"statement": "the migration takes six weeks"})), "t")
    store.add("estimate", rows(spark, ("EST-0001", {"owner": "o", "work_class": "c", "active": 6.5})), "t")
    store.add("outcome", rows(spark, ("OUT-0001", {"estimate_id": "EST-0001", "active": 9.0})), "t")
    edges = [("assumes", "D-0001", "decision", "A-0001", "assumption"), ("estimated_as", "A-0001", "assumption", "EST-0001", "estimate"), ("justified_by", "D-0002", "decision", "EST-0001", "estimate")]
    store.link(spark.createDataFrame(edges, "link_type string, src string, src_kind string, dst string, dst_kind string"))
    return store


def test_walk_history_and_search(world):
    assert [(r.node, r.depth) for r in world.impacted_by("EST-0001").collect()] == [("A-0001", 1), ("D-0002", 1), ("D-0001", 2)]
    assert {r.node for r in world.depends_on("D-0001").collect()} == {"A-0001", "EST-0001"}
    assert [round(r.ratio, 4) for r in world.calibration_history().collect()] == [1.3846]
    assert [r.id for r in world.search(["Migration"]).collect()] == ["D-0002", "A-0001"]
    assert [r.decision for r in world.why("Why not a longer migration?").collect()] == ["D-0002", "D-0001"] and world.why("why").count() == 0
    assert world.links("EST-0001").count() == 2 and world.links("EST-0001", types=[]).count() == 0
    assert {(r.what, r.name): r.n for r in world.stats().collect()}[("record", "decision")] == 2


def test_versions(spark, world):
    change = spark.createDataFrame([("D-0001", 1, "{}")], "id string, version int, payload string")
    world.revise("decision", change, "t")
    with pytest.raises(Refused):
        world.revise("decision", change, "t")
    with pytest.raises(Refused):
        world.add("decision", rows(spark, ("D-0001", {})), "t")
    world.retract("decision", spark.createDataFrame([("D-0001",)], "id string"), "t")
    assert [(r.version, r.retracted) for r in world.versions("decision", "D-0001").collect()] == [(1, False), (2, False), (3, True)]
    assert [r.id for r in world.list_all("decision").collect()] == ["D-0002"]
    assert world.get("decision", "D-0001").first().retracted and world.exists("decision", "D-0001") and not world.exists("decision", "D-9")
    assert {r.node for r in world.impacted_by("EST-0001").collect()} == {"A-0001", "D-0002"}
    assert world.next_id("decision", "D") == "D-0003"


def test_edges_keep_to_the_grammar(spark, world):
    with pytest.raises(Refused):
        world.link(spark.createDataFrame([("assumes", "A-0001", "assumption", "D-0001", "decision")], "link_type string, src string, src_kind string, dst string, dst_kind string"))


def test_empty_store(store):
    assert store.list_all("decision").count() == 0 and store.impacted_by("X").count() == 0 and store.next_id("estimate", "EST") == "EST-0001"


def test_command_line(spark, world, tmp_path, capsys):
    from tidemark.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Plan\n\nWe migrate in six weeks.")
    (tmp_path / "in" / "b.bin").write_bytes(b"\x00")
    for _ in range(2):
        main(["ingest", world.folder, str(tmp_path / "in")], spark)
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[0] == {"added": 1, "refused": 1} and lines[1] == {"added": 0, "refused": 1}
    main(["impacted-by", world.folder, "EST-0001"], spark)
    assert [json.loads(x)["node"] for x in capsys.readouterr().out.splitlines()] == ["A-0001", "D-0002", "D-0001"]
    main(["calibrate", world.folder], spark)
    assert json.loads(capsys.readouterr().out)["verdict"] == "insufficient_sample"


def test_estimate_detail(spark, world, capsys):
    from tidemark.__main__ import main

    world.add("finding", rows(spark, ("F-1", {"subject_id": "EST-0001", "severity": "high"}), ("F-2", {"subject_id": "A-0001", "severity": "low"})), "t")
    seen = [(r.section, r.item, r.place) for r in world.estimate_detail("EST-0001").orderBy("section", "place", "item").collect()]
    assert seen == [("assumption", "A-0001", 1), ("finding", "F-1", 2), ("impacted", "A-0001", 1), ("impacted", "D-0002", 1), ("impacted", "D-0001", 2), ("outcome", "OUT-0001", 1)]
    world.retract("assumption", spark.createDataFrame([("A-0001",)], "id string"), "t")
    main(["estimate-detail", world.folder, "EST-0001"], spark)
    assert {json.loads(x)["section"] for x in capsys.readouterr().out.splitlines()} == {"finding", "impacted", "outcome"}
    assert world.estimate_detail("EST-9").count() == 0
