"""Stages over a store that may be stopped at any point and run again.

A stage names its units (ids) and works on those that it has not attempted yet, portion by portion. What a portion writes and the
rows that say it was attempted are one commit of the store, so a unit is done with all it left behind, or it is still to do; two
runners that meet on a unit cannot both commit it. A unit that is done without a result counts as attempted too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rounds import settled
from tidemark.store import Store


@dataclass(frozen=True)
class Stage:
    """``units``: (id) of all there is to work on; ``work``: writes what comes of the given ids; ``after``: stages that come first."""

    name: str
    units: Callable[[Store], DataFrame]
    work: Callable[[Store, DataFrame], None]
    after: tuple[str, ...] = ()


def ordered(stages: list[Stage]) -> list[Stage]:
    """Each stage after those it names, else as listed."""
    names = {s.name for s in stages}
    out: list[Stage] = []
    left = list(stages)
    while left:
        done = {s.name for s in out}
        ready = [s for s in left if all(a in done or a not in names for a in s.after)]
        if not ready:
            raise ValueError(f"stages wait for each other: {', '.join(s.name for s in left)}")
        out.append(ready[0])
        left.remove(ready[0])
    return out


def outstanding(store: Store, stage: Stage) -> DataFrame:
    """(id) of the units that the stage has not attempted."""
    done = store.attempts().where(F.col("stage") == stage.name).select("id")
    return stage.units(store).select("id").distinct().join(done, "id", "left_anti")


def run(store: Store, stages: list[Stage], portions: int = 1) -> dict[str, int]:
    """How many units each stage worked on. More ``portions`` are more and smaller commits; a crash loses the one under way."""
    counts = {}
    for stage in ordered(stages):
        counts[stage.name] = 0
        for portion in range(portions):
            with store.transaction():
                todo = outstanding(store, stage).where(F.pmod(F.xxhash64("id"), F.lit(portions)) == portion)
                todo = settled(todo)
                n = todo.count()
                if n:
                    stage.work(store, todo)
                    store.attempted(stage.name, todo)
            counts[stage.name] += n
    return counts
