"""A versioned store: append-only Parquet tables of records, edges, spans and audit rows in a shared folder.

Every write is a batch of one kind and appends; nothing is changed in place. What a call or a ``transaction`` writes
becomes visible by one commit. A writer that finds the store moved on meanwhile wins only if the others wrote other records and
edges than it did. A record's payload is a JSON object, so one layout holds all kinds and a kind's own schema is applied on reading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.commits import Log, State
from tidemark.functions.scalars import digest_id
from tidemark.index import LAYOUT, Index
from tidemark.operators import calibration, graph, reviews, segments, textops, trails, versioned
from tidemark.operators.rounds import settled

RECORD = "kind string, id string, version int, retracted boolean, created_at timestamp, created_by string, payload string"
AUDIT = "ordinal bigint, occurred_at timestamp, actor string, action string, kind string, id string, version int, run_id string, reason string"
SPAN = "id string, doc_id string, start_byte int, end_byte int, text string"
EDGE = "id string, link_type string, src string, src_kind string, dst string, dst_kind string, version int, retracted boolean, created_at timestamp"


class Refused(ValueError):
    """A batch that would break the ledger; nothing of it was written."""


class Conflict(Refused):
    """Another writer committed the same records or edges first; nothing of this commit was written."""


ATTEMPT = "stage string, id string, at timestamp"
REFUSED = "source_uri string, reason string"
_SCHEMAS = {"records": RECORD, "edges": EDGE, "audit": AUDIT, "spans": SPAN, "refused": REFUSED, "attempts": ATTEMPT}
#: What makes a row of a table one and the same.
_KEYS = {"records": ["kind", "id"], "edges": ["id"], "attempts": ["stage", "id"]}


@dataclass
class Pending:
    """A transaction: what it started from, and the batches it will add."""

    base: State
    added: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Store:
    """``at``: an older version to read."""

    spark: SparkSession
    folder: str
    at: int | None = None
    _open: list[Pending] = field(default_factory=list, compare=False, repr=False)
    _logs: list[Log] = field(default_factory=list, compare=False, repr=False)

    @property
    def log(self) -> Log:
        if not self._logs:
            self._logs.append(Log(self.spark, self.folder))
        return self._logs[0]

    def _state(self) -> State:
        """The version that reads see; inside a transaction, its base and what it added."""
        if not self._open:
            return self.log.state(self.at)
        pending = self._open[-1]
        return pending.base.after(pending.base.version, {"added": pending.added})

    @contextmanager
    def transaction(self) -> Iterator[Pending]:
        """All writes inside become visible together when the block ends, or not at all; one inside another joins it."""
        if self._open:
            yield self._open[-1]
            return
        pending = Pending(self.log.state())
        self._open.append(pending)
        try:
            yield pending
        finally:
            self._open.pop()
        self._commit(pending)

    def _commit(self, pending: Pending) -> None:
        seen = pending.base
        while pending.added and not self.log.put(seen.version + 1, {"added": pending.added}):
            now = self.log.state()
            for table, key in _KEYS.items():
                theirs, mine = now.batches.get(table, [])[len(seen.batches.get(table, [])) :], pending.added.get(table, [])
                rows = lambda names: self.log.rows(table, _SCHEMAS[table], names)  # noqa: B023, E731
                if theirs and mine:
                    self._refuse(rows(mine).join(rows(theirs).select(*key).distinct(), key, "left_semi"), "written meanwhile", Conflict)
            if "audit" in pending.added:
                pending.added["audit"] = [self._renumbered(pending.added["audit"], now)]
            seen = now

    def _renumbered(self, names: list[str], now: State) -> str:
        """Audit rows again, numbered after those that were committed first."""
        last = self._last_ordinal(now)
        mine = self.log.rows("audit", AUDIT, names)
        least = mine.agg(F.min("ordinal")).first()[0] or 0
        return self.log.stage("audit", mine.withColumn("ordinal", F.col("ordinal") - least + last + 1))

    def _last_ordinal(self, state: State) -> int:
        return self.log.rows("audit", AUDIT, state.batches.get("audit", [])).agg(F.max("ordinal")).first()[0] or 0

    def _write(self, table: str, rows: DataFrame) -> None:
        with self.transaction() as pending:
            name = self.log.stage(table, rows, "kind" if table == "records" else None)
            pending.added.setdefault(table, []).append(name)

    def version(self) -> int:
        return self._state().version

    def _read(self, name: str) -> DataFrame:
        return self.log.rows(name, _SCHEMAS[name], self._state().batches.get(name, []))

    def records(self, kind: str | None = None) -> DataFrame:
        """All versions; a kind is a partition, so one kind reads its own files only."""
        rows = self._read("records")
        return rows if kind is None else rows.where(F.col("kind") == kind)

    def edges(self) -> DataFrame:
        return self._read("edges")

    def audit(self) -> DataFrame:
        return self._read("audit")

    def spans(self) -> DataFrame:
        return self._read("spans")

    def refused(self) -> DataFrame:
        """Files that a stream could not read, or answers of a stage that do not stand, and why."""
        return self._read("refused").distinct()

    def attempts(self) -> DataFrame:
        """Which units each stage has worked on."""
        return self._read("attempts")

    def attempted(self, stage: str, units: DataFrame) -> None:
        self._write("attempts", units.select(F.lit(stage).alias("stage"), "id", F.current_timestamp().alias("at")))

    def _current(self, table: str, kind: str | None = None) -> DataFrame:
        """The newest version of each key: from the last snapshot and what was committed after it."""
        state, schema, key = self._state(), _SCHEMAS[table], _KEYS[table]
        rows = self.log.rows(table, schema, state.fresh(table))
        if table in state.snapshots:
            rows = rows.unionByName(self.log.rows(table, schema, [state.snapshots[table][0]]))
        if kind is not None:
            rows = rows.where(F.col("kind") == kind)
        rest = [c for c in rows.columns if c not in (*key, "version")]
        best = rows.groupBy(*key).agg(F.max_by(F.struct("version", *rest), "version").alias("r"))
        return best.select(*key, "r.*").select(*rows.columns)

    def heads(self, kind: str | None = None) -> DataFrame:
        """The current version of each record, retracted ones too."""
        return self._current("records", kind)

    def standing_edges(self) -> DataFrame:
        return self._current("edges").where("not retracted")

    def compact(self) -> int:
        """A snapshot of the current records and edges, sorted by key, as a version of its own; all versions stay readable."""
        state = self.log.state()
        made = {}
        for table in ("records", "edges"):
            key = _KEYS[table]
            if state.fresh(table):
                rows = Store(self.spark, self.folder, state.version)._current(table).repartitionByRange(*key).sortWithinPartitions(*key)
                made[table] = (self.log.stage(table, rows, "kind" if table == "records" else None, "heads"), len(state.batches[table]))
        while made and not self.log.put(state.version + 1, state.kept() | {"snapshots": {**state.snapshots, **made}}):
            state = self.log.state()
        return self.log.state().version

    def _append(self, rows: DataFrame, action: str, run_id: str | None = None, reason: str | None = None) -> None:
        """The rows and, for each, an audit row; ordinals only grow, but leave gaps, since no task counts the whole batch."""
        fresh = settled(rows.select("kind", "id", "version", "retracted", "created_at", "created_by", "payload"))
        if fresh.isEmpty():
            return
        with self.transaction():
            last = self._last_ordinal(self._state())
            self._write("records", fresh)
            told = fresh.select(
                (F.monotonically_increasing_id() + last + 1).alias("ordinal"), F.col("created_at").alias("occurred_at"), F.col("created_by").alias("actor"), F.lit(action).alias("action"),
                "kind", "id", "version", F.lit(run_id).cast("string").alias("run_id"), F.lit(reason).cast("string").alias("reason"),
            )
            self._write("audit", told)

    def timeline(self, before: int | None = None, size: int | None = None) -> DataFrame:
        """A page of audit rows, newest first, with where the next page starts and how many rows there are."""
        return trails.timeline(self.audit(), before, size)

    def audit_of(self, kind: str, id_: str) -> DataFrame:
        return self.audit().where((F.col("kind") == kind) & (F.col("id") == id_)).orderBy("ordinal")

    def audit_in_run(self, run_id: str) -> DataFrame:
        return trails.in_run(self.audit(), "run_id", run_id, "ordinal")

    @staticmethod
    def _refuse(bad: DataFrame, why: str, kind: type[Refused] = Refused) -> None:
        first = bad.select("id").limit(3).collect()
        if first:
            raise kind(f"{why}: {', '.join(str(r.id) for r in first)}")

    def _stamped(self, rows: DataFrame, kind: str, by: str) -> DataFrame:
        return rows.withColumns({"kind": F.lit(kind), "created_by": F.lit(by), "created_at": F.current_timestamp()})

    def add(self, kind: str, rows: DataFrame, by: str, run_id: str | None = None, reason: str | None = None) -> None:
        """New records (id, payload) as version 1; ids that exist or repeat are refused."""
        with self.transaction():
            self._refuse(rows.groupBy("id").count().where("count > 1"), "repeated")
            self._refuse(rows.join(self.heads(kind).select("id"), "id", "left_semi"), "already stored")
            self._append(self._stamped(rows.select("id", "payload"), kind, by).withColumns({"version": F.lit(1), "retracted": F.lit(False)}), "add", run_id, reason)

    def revise(self, kind: str, rows: DataFrame, by: str, run_id: str | None = None, reason: str | None = None) -> None:
        """(id, version, payload) against the head; a batch with a stale version, or an id twice, is refused."""
        with self.transaction():
            self._refuse(rows.groupBy("id").count().where("count > 1"), "repeated")
            met = versioned.revisions(rows.select("id", "version"), self.heads(kind).select("id", "version"))
            self._refuse(met.where("conflict"), "not the current version")
            self._append(self._stamped(rows.select("id", (F.col("version") + 1).alias("version"), "payload"), kind, by).withColumn("retracted", F.lit(False)), "revise", run_id, reason)

    def retract(self, kind: str, ids: DataFrame, by: str, run_id: str | None = None, reason: str | None = None) -> None:
        """A last version of each listed standing record; its payload is kept."""
        with self.transaction():
            gone = versioned.retract(self.heads(kind).drop("kind"), ids)
            self._append(self._stamped(gone, kind, by), "retract", run_id, reason)

    def get(self, kind: str, id_: str, version: int | None = None) -> DataFrame:
        """The current or a given version, retracted or not."""
        if version is None:
            return self.heads(kind).where(F.col("id") == id_)
        return self.records(kind).where((F.col("id") == id_) & (F.col("version") == version))

    def versions(self, kind: str, id_: str) -> DataFrame:
        return self.records(kind).where(F.col("id") == id_).orderBy("version")

    def exists(self, kind: str, id_: str) -> bool:
        return not self.records(kind).where(F.col("id") == id_).isEmpty()

    def list_all(self, kind: str, retracted: bool = False, schema: str | None = None) -> DataFrame:
        """Current records, oldest first; with ``schema`` the payload's fields as columns."""
        rows = self.heads(kind)
        rows = (rows if retracted else rows.where("not retracted")).orderBy("created_at", "id")
        return rows if schema is None else _with_fields(rows, schema)

    def standing(self, kind: str, schema: str | None = None) -> DataFrame:
        """``list_all`` in no order, for what joins or groups them: no sort of the whole kind, nor the pass that finds its ranges."""
        rows = self.heads(kind).where("not retracted")
        return rows if schema is None else _with_fields(rows, schema)

    def next_id(self, kind: str, prefix: str) -> str:
        """One more than the largest number in use, four digits or more."""
        number = F.regexp_extract("id", r"^[A-Z]+-([0-9]+)$", 1).try_cast("bigint")
        top = self.records(kind).agg(F.max(number)).first()[0] or 0
        return f"{prefix}-{top + 1:04d}"

    def link(self, edges: DataFrame) -> None:
        """(link_type, src, src_kind, dst, dst_kind); an edge that the grammar forbids refuses the batch, stored ones are skipped."""
        named = settled(edges.withColumn("id", digest_id("LINK", F.col("link_type"), F.col("src"), F.col("dst"))))
        self._refuse(named.where(~reviews.endpoints_valid(F.col("link_type"), F.col("src_kind"), F.col("dst_kind"))), "edge not allowed")
        with self.transaction():
            fresh = settled(named.dropDuplicates(["id"]).join(self._current("edges").select("id"), "id", "left_anti"))
            if not fresh.isEmpty():
                fresh = fresh.withColumns({"version": F.lit(1), "retracted": F.lit(False), "created_at": F.current_timestamp()})
                self._write("edges", fresh.select("id", "link_type", "src", "src_kind", "dst", "dst_kind", "version", "retracted", "created_at"))

    def links(self, id_: str, ends: tuple[str, ...] = ("src", "dst"), types: list[str] | None = None) -> DataFrame:
        """Current edges with the record at one of ``ends``; an empty list of types finds nothing."""
        here = F.lit(False)
        for end in ends:
            here = here | (F.col(end) == id_)
        rows = self.standing_edges().where(here)
        return rows if types is None else rows.where(F.col("link_type").isin(types))

    def dependencies(self) -> DataFrame:
        return self.standing_edges().where(F.col("link_type").isin("assumes", "justified_by", "estimated_as")).select("src", "dst", "link_type")

    def _walk(self, id_: str, depth: int, reverse: bool) -> DataFrame:
        found = graph.walk(self.dependencies(), self.spark.createDataFrame([(id_,)], "root string"), reverse, depth)
        live = self.heads().where("not retracted").select(F.col("id").alias("node"), "kind")
        return found.join(live, "node").select("node", "kind", "depth").orderBy("depth", "node")

    def impacted_by(self, id_: str, depth: int = graph.MAX_DEPTH) -> DataFrame:
        """What rests on a record, nearest first; retracted records are passed through, not returned."""
        return self._walk(id_, depth, True)

    def depends_on(self, id_: str, depth: int = graph.MAX_DEPTH) -> DataFrame:
        return self._walk(id_, depth, False)

    def _bodies(self) -> DataFrame:
        """(id, version, body) of current records, the texts of their payloads."""
        body = F.array_join(F.map_values(F.from_json("payload", "map<string,string>")), " ")
        return self.heads().where("not retracted").select("id", "version", body.alias("body"))

    def index(self) -> Index:
        return Index(self.spark, f"{self.folder}/index{LAYOUT}")

    def refresh_index(self) -> int:
        """Bring the index to the present version: only records that are new, changed or gone since are read. How many these were."""
        index, seen = self.index(), self.version()
        known = index.lengths().where("len is not null").select("id", F.col("version").alias("known"))
        changed = settled(self._bodies().join(known, "id", "left").where("known is null or known <> version").drop("known"))
        gone = settled(known.join(self.heads().where("not retracted").select("id"), "id", "left_anti").select("id"))
        n = changed.count() + gone.count()
        index.add(changed)
        index.remove(gone)
        index.log.note("store_version", seen)
        return n

    def search(self, terms: list[str], limit: int = 20) -> DataFrame:
        """The best current records for any of the terms, over the text of their payloads; by the index if it is of this version, else by reading all."""
        index = self.index()
        if not self._open and self.at is None and index.log.noted("store_version") == self.version():
            return index.search(terms, limit)
        return textops.bm25(self._bodies(), "id", "body", [t.lower() for t in terms], limit)

    def why(self, question: str, limit: int = 8, hits: int = 50) -> DataFrame:
        """(decision, score): decisions a question may be about, best first; an assumption that matches leads to
        every decision that assumes it. Words of under four letters do not count."""
        terms = list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", question.lower()) if len(w) >= 4))
        if not terms:
            return self.spark.createDataFrame([], "decision string, score double")
        found = self.search(terms, hits).join(self.heads().select("id", "kind"), "id")
        direct = found.where("kind = 'decision'").select(F.col("id").alias("decision"), "score")
        assumes = self.standing_edges().where("link_type = 'assumes'").select("dst", F.col("src").alias("decision"))
        led = found.where("kind = 'assumption'").join(assumes, F.col("id") == F.col("dst")).select("decision", "score")
        return direct.unionByName(led).groupBy("decision").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "decision").limit(limit)

    def calibration_history(self) -> DataFrame:
        return self.calibration_rows().orderBy("owner", "work_class", "estimate_id")

    def calibration_rows(self) -> DataFrame:
        """``calibration_history`` in no order."""
        e = self.standing("estimate", schema="owner string, work_class string, active double").select(F.col("id").alias("estimate_id"), "owner", "work_class", F.col("active").alias("estimated"))
        o = self.standing("outcome", schema="estimate_id string, active double").select("estimate_id", F.col("active").alias("actual"))
        return calibration.history(e, o)

    def estimate_detail(self, id_: str) -> DataFrame:
        """(estimate, section, item, place): the outcome of an estimate, assumptions that it was, what rests on it and what was found against it."""
        estimate = self.list_all("estimate").where(F.col("id") == id_)
        outcomes = self.list_all("outcome", schema="estimate_id string").select("id", "estimate_id")
        findings = self.list_all("finding", schema="subject_id string, severity string").select("id", "subject_id", "severity")
        live = self.heads().where("not retracted").select("id", "kind")
        return trails.estimate_details(estimate, outcomes, self.standing_edges(), live, findings)

    def stats(self) -> DataFrame:
        """(what, name, n): current records by kind, edges by type, and all versions."""
        records = self.heads().groupBy("kind").agg(F.count("*").alias("n"))
        edges = self.standing_edges().groupBy("link_type").agg(F.count("*").alias("n"))
        return (
            records.select(F.lit("record").alias("what"), F.col("kind").alias("name"), "n")
            .unionByName(edges.select(F.lit("edge").alias("what"), F.col("link_type").alias("name"), "n"))
            .unionByName(self.records().agg(F.lit("version").alias("what"), F.lit("all").alias("name"), F.count("*").alias("n")))
        )

    def ingest(self, folder: str, by: str = "ingest") -> tuple[int, DataFrame]:
        """(documents added, refused files): files below a folder as documents, and each block of them that verifies as a span;
        content that is stored already is skipped."""
        return self.ingest_files(self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), by)

    def ingest_files(self, files: DataFrame, by: str = "ingest") -> tuple[int, DataFrame]:
        """``ingest`` of whole files (path, content), in one commit; the same files again add nothing."""
        from tidemark.sources.documents import documents_of, rendered_json

        good, refused = documents_of(files, rendered_json)
        fields = ["source_uri", "source_kind", "title", "content", "content_hash"]
        first = good.groupBy("content_hash").agg(F.min_by(F.struct(*fields), "source_uri").alias("r")).select("r.*")
        rows = first.select(digest_id("DOC", F.col("content_hash")).alias("id"), F.to_json(F.struct(*fields)).alias("payload"))
        with self.transaction():
            fresh = settled(rows.join(self.heads("document").select("id"), "id", "left_anti"))
            n = fresh.count()
            if n:
                self.add("document", fresh, by)
                docs = fresh.select(F.col("id").alias("doc_id"), F.get_json_object("payload", "$.content").alias("text"))
                self._write("spans", _sound_spans(docs))
        return n, refused


def _with_fields(rows: DataFrame, schema: str) -> DataFrame:
    return rows.withColumn("r", F.from_json("payload", schema)).select("id", "version", "r.*")


def _sound_spans(docs: DataFrame) -> DataFrame:
    """Each block of (doc_id, text) that verifies, as a span."""
    grid = segments.blocks(docs).select("doc_id", "start_byte", "end_byte", "text")
    sound = grid.join(docs.withColumnRenamed("text", "content"), "doc_id").where(textops.verify_span(F.col("content"), F.col("start_byte"), F.col("end_byte"), F.col("text")) == "ok")
    id_ = digest_id("SPAN", F.col("doc_id"), F.col("start_byte"), F.col("end_byte")).alias("id")
    return sound.select(id_, "doc_id", F.col("start_byte").cast("int").alias("start_byte"), F.col("end_byte").cast("int").alias("end_byte"), "text")
