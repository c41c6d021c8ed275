"""Three steps over one folder: old files are read through them, altered and unknown steps are refused."""

from dataclasses import replace

import pytest

from tidemark.commits import Log
from tidemark.migrations import Migrated, SchemaError, Step

STEPS = [
    Step(1, "claims", {"claims": {"id": ("bigint", None), "days": ("double", None)}, "notes": {"id": ("bigint", None)}}),
    Step(2, "hours and an owner", {"claims": {"id": ("bigint", None), "hours": ("double", "days * 8"), "owner": ("string", "concat('o', id % 2)")}}),
    Step(3, "one name", {"claims": {"id": ("bigint", None), "hours": ("decimal(10,1)", None), "team": ("string", "upper(owner)")}}),
]


def test_old_files_are_read_through_the_steps(spark, tmp_path):
    log = Log(spark, str(tmp_path / "m"))
    early, middle, late = (Migrated(log, STEPS[:n]) for n in (1, 2, 3))
    with pytest.raises(SchemaError):
        early.read("claims")
    assert early.migrate() == 1 and early.migrate() == 0
    early.write("claims", spark.sql("SELECT 1L id, 2.0D days UNION ALL SELECT 2, null"))
    early.write("notes", spark.sql("SELECT 7L id"))
    assert middle.migrate() == 1
    with pytest.raises(SchemaError, match="step 2 is unknown"):
        early.read("claims")
    middle.write("claims", spark.sql("SELECT 3L id, 5.5D hours, 'x' owner"))
    assert late.migrate() == 1 and log.state().version == 6
    late.write("claims", spark.sql("SELECT 4L id, 1 hours, 'T' team"))
    got = late.read("claims")
    assert got.dtypes == [("id", "bigint"), ("hours", "decimal(10,1)"), ("team", "string")]
    assert sorted((r.id, None if r.hours is None else float(r.hours), r.team) for r in got.collect()) == [(1, 16.0, "O1"), (2, None, "O0"), (3, 5.5, "X"), (4, 1.0, "T")]
    assert [r.id for r in late.read("notes").collect()] == [7]
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,3)]" in got.where("id = 3")._jdf.queryExecution().executedPlan().toString()  # steps do not hide files from filters

    state = log.state()
    assert log.put(state.version + 1, state.kept()) and late.read("claims").count() == 4  # a commit that lists all carries the steps on


def test_a_step_that_reads_otherwise_is_refused(spark, tmp_path):
    log = Log(spark, str(tmp_path / "m"))
    Migrated(log, STEPS).migrate()
    altered = Migrated(log, [STEPS[0], replace(STEPS[1], name="other"), STEPS[2]])
    assert altered.problems() == [(2, "altered")]
    for act in (altered.migrate, lambda: altered.read("claims"), lambda: altered.write("claims", spark.range(1))):
        with pytest.raises(SchemaError):
            act()
    assert Migrated(log, [STEPS[1]]).problems()[0] == (1, "misplaced")
    assert Migrated(log, STEPS).problems() == [] and Migrated(log, STEPS).read("claims").count() == 0
