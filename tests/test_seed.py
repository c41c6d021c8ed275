"""Seeding is one commit and happens once."""

import json

import pytest

from tidemark.commits import Log
from tidemark.seed import seed
from tidemark.store import Store

RECORD = """# Use one store

## Chosen

One file for everything.

## Rejected

| Option | Reason |
| --- | --- |
| Two | slow |

## Assumptions

| # | Claim | Predicate | Expiry |
|---|---|---|---|
| 1 | stays small | `rows < 10` | `when(rows > 9)` |
| 2 | one writer | `writers == 1` |  |
"""


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "adr").mkdir()
    (tmp_path / "adr" / "one.md").write_text(RECORD)
    (tmp_path / "adr" / "note.txt").write_text("Just a note\n\nwith text.")
    (tmp_path / "e.jsonl").write_text('# log\n{"id": "e1", "subject": "s", "owner": "o", "work_class": "Agent Work", "quantity": 4, "unit": "hours"}\n{"id": "e2", "subject": "t", "owner": "o", "work_class": "x", "active_quantity": 2, "quantity": 9, "unit": "hours"}\n')
    (tmp_path / "o.jsonl").write_text('{"id": "o1", "estimate_id": "e1", "active_quantity": 6, "unit": "hours"}\n{"id": "o9", "estimate_id": "nobody", "active_quantity": 6, "unit": "hours"}\n')
    return tmp_path


def test_seed_is_one_commit(spark, corpus, capsys):
    store = Store(spark, str(corpus / "s"))
    args = [str(corpus / "adr"), str(corpus / "e.jsonl"), str(corpus / "o.jsonl")]
    assert seed(store, *args) == {"documents": 2, "decisions": 1, "assumptions": 2, "links": 2, "estimates": 2, "outcomes": 2, "unresolved": 1}
    assert store.version() == 1
    (d,) = store.list_all("decision", schema="title string, chosen string, rejected array<struct<option:string,reason:string>>, span_id string").collect()
    assert (d.title, d.chosen, [tuple(x) for x in d.rejected]) == ("Use one store", "One file for everything.", [("Two", "slow")])
    assert store.spans().where(f"id = '{d.span_id}'").first().text == "One file for everything."
    assert {r.expiry_condition for r in store.list_all("assumption", schema="expiry_condition string").collect()} == {"when(rows > 9)", None}
    assert [(r.work_class, r.estimated, r.actual) for r in store.calibration_history().collect()] == [("agent-work", 4.0, 6.0), ("x", 2.0, None)]
    assert set(seed(store, *args).values()) == {0, 1} and store.version() == 1

    from tidemark.__main__ import main

    main(["seed", str(corpus / "t"), *args], spark)
    main(["doctor", str(corpus / "t")], spark)
    assert json.loads(capsys.readouterr().out)["decisions"] == 1


def test_a_half_seeded_store_cannot_be_reached(spark, corpus, monkeypatch):
    store = Store(spark, str(corpus / "s"))
    real, left = Log.stage, [5]

    def stage(self, *a, **k):
        left[0] -= 1
        if left[0] < 0:
            raise OSError("disk")
        return real(self, *a, **k)

    monkeypatch.setattr(Log, "stage", stage)
    with pytest.raises(OSError):
        seed(store, str(corpus / "adr"))
    assert store.version() == 0 and store.heads().count() == 0 and store.spans().count() == 0
