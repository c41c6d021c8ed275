"""Command line: ``python -m tidemark COMMAND ...``; rows are printed as JSON lines."""

from __future__ import annotations

import argparse
import importlib
import json
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import passes
from tidemark.operators import calibration
from tidemark.sources.reports import write_json, write_markdown
from tidemark.store import Store

MOST = 500


def _show(df: DataFrame, limit: int) -> None:
    """A page for a reader, at most ``MOST`` rows; whole results are written by ``run --out``."""
    for line in df.limit(max(1, min(limit, MOST))).toJSON().collect():
        print(line)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--limit", type=int, default=50)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        return c

    command("queries")
    command("run", "query", "tables").add_argument("--out")
    for name in ("stats", "calibrate", "backtest", "timeline", "routes", "estimates", "contradictions", "contradiction-counts", "doctor"):
        command(name, "store")
    command("ingest", "store", "folder").add_argument("--stream", metavar="CHECKPOINT")
    command("seed", "store", "records", "estimates", "outcomes")
    for name in ("extract", "estimate"):
        command(name, "store").add_argument("--ask", required=True, metavar="MODULE:FUNCTION", help="what answers in place of a model")
    grade = command("eval", "store", "folder", "key")
    grade.add_argument("--ask", required=True, metavar="MODULE:FUNCTION")
    grade.add_argument("--out", metavar="FOLDER", help="where to put report.md and report.json")
    command("compact", "store")
    command("refresh-index", "store")
    command("list", "store", "kind")
    command("get", "store", "kind", "id")
    command("impacted-by", "store", "id")
    command("estimate-detail", "store", "id")
    command("depends-on", "store", "id")
    command("monitor", "store", "facts")
    for name in ("fuse", "govern", "retire"):
        command(name, "store").add_argument("--dry-run", action="store_true")
    command("why", "store").add_argument("question", nargs="+")
    command("search", "store").add_argument("terms", nargs="+")
    return p


def _monitor(spark: SparkSession, store: Store, path: str) -> DataFrame:
    """One facts file: {"facts": {}, "events": [], "as_of": time}; it is small and read whole."""
    (text,) = spark.read.text(path, wholetext=True).first()
    world = json.loads(text)
    now = F.lit(world["as_of"]).cast("timestamp") if world.get("as_of") else None
    return passes.monitor(store, world.get("facts", {}), world.get("events", []), now)


def _function(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _written(store: Store, a: argparse.Namespace) -> dict:
    from tidemark import extraction, seed, stages

    if a.command == "seed":
        return seed.seed(store, a.records, a.estimates, a.outcomes)
    if a.command in ("compact", "refresh-index"):
        return {"version": store.compact()} if a.command == "compact" else {"indexed": store.refresh_index()}
    return stages.run(store, (extraction.extraction if a.command == "extract" else extraction.estimation)(_function(a.ask)))


def _graded(store: Store, a: argparse.Namespace) -> DataFrame:
    from tidemark.evaluate import evaluate
    from tidemark.operators import evaluation

    key = evaluation.read_key(store.spark, a.key)
    world = key.select("monitoring.*").first()
    facts = {k: json.loads(v) if v in ("true", "false") else _number(v) for k, v in (world.facts or {}).items()} if world else {}
    verdicts = key.select(F.inline("monitoring.verdicts")).select("item_id", "status")
    now = F.lit(world.as_of) if world and world.as_of else None
    graded = evaluate(store, a.folder, evaluation.key_items(key), _function(a.ask), facts, list(world.events or []) if world else [], now, verdicts)
    if a.out:
        sections = {"Grades": (graded, ["measure", "value"]), "Store": (store.stats(), ["what", "name", "n"])}
        write_markdown(f"{a.out}/report.md", "Evaluation", sections)
        write_json(f"{a.out}/report.json", sections)
    return graded


def _number(v: str) -> Decimal | str:
    try:
        return Decimal(v)
    except InvalidOperation:
        return v


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    from tidemark.plans import QUERIES

    if a.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return
    if spark is None:
        from tidemark.session import session

        spark = session()
    if a.command == "run":
        df = QUERIES[a.query](spark, a.tables)
        if a.out:
            df.write.mode("errorifexists").parquet(a.out)
        else:
            _show(df, a.limit)
        return
    store = Store(spark, a.store)
    if a.command == "ingest" and a.stream:
        from tidemark.streaming.ingest import ingest_stream

        ingest_stream(store, a.folder, a.stream).awaitTermination()
        print(json.dumps({"documents": store.heads("document").count(), "refused": store.refused().count()}))
        return
    if a.command == "ingest":
        added, refused = store.ingest(a.folder)
        print(json.dumps({"added": added, "refused": refused.count()}))
        return
    if a.command in ("seed", "extract", "estimate", "compact", "refresh-index"):
        print(json.dumps(_written(store, a)))
        return
    views = {
        "eval": lambda: _graded(store, a).orderBy("measure"),
        "stats": lambda: store.stats().orderBy("what", "name"),
        "calibrate": lambda: calibration.factors(store.calibration_history()).orderBy("owner", "work_class"),
        "backtest": lambda: calibration.walk(store.calibration_history()).orderBy("owner", "work_class"),
        "timeline": lambda: store.timeline(size=a.limit),
        "routes": lambda: passes.routes(store).orderBy("id"),
        "estimates": lambda: store.calibration_history(),
        "contradictions": lambda: passes.contradictions(store).orderBy("a_id", "b_id"),
        "contradiction-counts": lambda: passes.contradiction_counts(store).orderBy(F.desc("links"), "id", "name"),
        "doctor": lambda: passes.doctor(store).orderBy("id", "problem"),
        "list": lambda: store.list_all(a.kind),
        "get": lambda: store.get(a.kind, a.id),
        "estimate-detail": lambda: store.estimate_detail(a.id).orderBy("section", "place", "item"),
        "impacted-by": lambda: store.impacted_by(a.id),
        "depends-on": lambda: store.depends_on(a.id),
        "monitor": lambda: _monitor(spark, store, a.facts),
        "fuse": lambda: passes.fuse(store, a.dry_run),
        "govern": lambda: passes.govern(store, a.dry_run),
        "retire": lambda: passes.retire(store, dry=a.dry_run),
        "why": lambda: store.why(" ".join(a.question)),
        "search": lambda: store.search(a.terms, a.limit),
    }
    _show(views[a.command](), a.limit)


if __name__ == "__main__":
    main()
