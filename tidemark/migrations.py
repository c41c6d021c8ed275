"""Schemas that change over the life of a folder of tables, without rewriting what is there.

A step gives some tables a new schema, and for each new column an SQL expression over the old ones. ``migrate`` applies steps in order, each by
a commit that records its number, name and checksum; files stay as they were written and are read through the steps that came after them. A
step that was applied and reads otherwise now is refused, and so is a folder that knows more steps than the program does.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.commits import Log, State


class SchemaError(ValueError):
    """The folder and the program do not agree on its schema."""


@dataclass(frozen=True)
class Step:
    """``tables``: name to {column: (type, expression over the columns before the step)}; a table's first step needs no expressions."""

    number: int
    name: str
    tables: dict[str, dict[str, tuple[str, str | None]]]

    @property
    def checksum(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def record(self) -> dict:
        return {"number": self.number, "name": self.name, "checksum": self.checksum}


@dataclass(frozen=True)
class Migrated:
    """Tables of a commit log under a ladder of steps, numbered from 1."""

    log: Log
    steps: list[Step]

    def problems(self, state: State | None = None) -> list[tuple[int, str]]:
        """(step, altered, unknown or misplaced) of what is applied against what the program has."""
        own = {s.number: s.record() for s in self.steps}
        out = [(n, "misplaced") for n, s in enumerate(self.steps, 1) if s.number != n]
        for applied in (state or self.log.state()).steps:
            if applied["number"] not in own:
                out.append((applied["number"], "unknown"))
            elif own[applied["number"]] != applied:
                out.append((applied["number"], "altered"))
        return out

    def _sound(self) -> State:
        state = self.log.state()
        found = self.problems(state)
        if found:
            raise SchemaError(", ".join(f"step {n} is {what}" for n, what in found))
        return state

    def migrate(self) -> int:
        """Apply the steps that are not applied yet; how many there were."""
        done = 0
        while len((state := self._sound()).steps) < len(self.steps):
            step = self.steps[len(state.steps)]
            marks = {t: [*state.marks.get(t, []), len(state.batches.get(t, []))] for t in step.tables} | {t: m for t, m in state.marks.items() if t not in step.tables}
            if self.log.put(state.version + 1, {"steps": [*state.steps, step.record()], "marks": marks}):
                done += 1
        return done

    def _shapes(self, table: str, upto: int) -> list[dict[str, tuple[str, str | None]]]:
        return [s.tables[table] for s in self.steps[:upto] if table in s.tables]

    def write(self, table: str, rows: DataFrame) -> None:
        """Rows in the newest applied schema, as one commit."""
        state = self._sound()
        shapes = self._shapes(table, len(state.steps))
        if not shapes:
            raise SchemaError(f"no step has made {table}")
        name = self.log.stage(table, rows.select(*(F.col(c).cast(kind).alias(c) for c, (kind, _) in shapes[-1].items())))
        while not self.log.put(state.version + 1, {"added": {table: [name]}}):
            now = self._sound()
            if len(now.steps) != len(state.steps):
                raise SchemaError("the schema changed while rows were written")
            state = now

    def read(self, table: str) -> DataFrame:
        """All rows in the newest applied schema: batches of each age through the steps after them."""
        state = self._sound()
        shapes, batches = self._shapes(table, len(state.steps)), state.batches.get(table, [])
        if not shapes:
            raise SchemaError(f"no step has made {table}")
        starts = [*state.marks[table], len(batches)]
        aged = []
        for k, shape in enumerate(shapes):
            own = batches[starts[k] : starts[k + 1]]
            if own or k == len(shapes) - 1:
                rows = self.log.rows(table, ", ".join(f"{c} {kind}" for c, (kind, _) in shape.items()), own)
                for later in shapes[k + 1 :]:
                    rows = rows.select(*(F.expr(told or c).cast(kind).alias(c) for c, (kind, told) in later.items()))
                aged.append(rows)
        return reduce(DataFrame.unionByName, aged)
