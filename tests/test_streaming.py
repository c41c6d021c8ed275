"""A stream over a folder yields the rows of a batch, each content once, also after a crash between commit and checkpoint."""

import json

import pytest

from tidemark.store import Store
from tidemark.streaming import ingest as module
from tidemark.streaming.ingest import ingest_stream


def told(store):
    docs = {(r.id, json.loads(r.payload)["content_hash"]) for r in store.heads("document").collect()}
    return docs, {tuple(r) for r in store.spans().collect()}


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "in"
    (place / "deep").mkdir(parents=True)
    for k in range(5):
        (place / f"{k}.md").write_text(f"# Title {k % 3}\n\nBlock one of {k % 3}.\n\nBlock two.")
    (place / "deep" / "a.txt").write_text("Some title\n\nText.")
    (place / "bad.bin").write_bytes(b"\x00\xff")
    return place


def drain(store, folder, tmp_path, **more):
    ingest_stream(store, str(folder), str(tmp_path / "checkpoint"), **more).awaitTermination()


def test_a_restarted_stream_yields_the_rows_of_a_batch(spark, tmp_path, folder, monkeypatch):
    streamed, batch = Store(spark, str(tmp_path / "streamed")), Store(spark, str(tmp_path / "batch"))
    drain(streamed, folder, tmp_path, files_at_once=2)
    assert streamed.heads("document").count() == 4
    (folder / "late.md").write_text("# Late\n\nNew text.")
    (folder / "same.md").write_text((folder / "0.md").read_text())

    real = Store.ingest_files

    class Crash(Exception):
        pass

    put = module.Store.transaction

    def crashing(self):
        manager = put(self)

        class Wrapped:
            def __enter__(self):
                return manager.__enter__()

            def __exit__(self, *what):
                manager.__exit__(*what)
                raise Crash("after the commit")

        return Wrapped() if not self._open and self.folder == streamed.folder else manager

    with monkeypatch.context() as m:
        m.setattr(Store, "transaction", crashing)
        with pytest.raises(Exception, match="after the commit"):
            drain(streamed, folder, tmp_path)
    assert real is Store.ingest_files and streamed.heads("document").count() == 5  # committed, and not known to the stream
    drain(streamed, folder, tmp_path)
    drain(streamed, folder, tmp_path)
    batch.ingest(str(folder))
    assert told(streamed) == told(batch) and len(told(batch)[0]) == 5
    assert [(r.source_uri.rsplit("/")[-1], r.reason) for r in streamed.refused().collect()] == [("bad.bin", "unknown_suffix")]
    assert streamed.audit().count() == 5


def test_stream_from_the_command_line(spark, tmp_path, folder, capsys):
    from tidemark.__main__ import main

    for _ in range(2):
        main(["ingest", str(tmp_path / "s"), str(folder), "--stream", str(tmp_path / "c")], spark)
    assert [json.loads(x) for x in capsys.readouterr().out.splitlines()] == [{"documents": 4, "refused": 1}] * 2
