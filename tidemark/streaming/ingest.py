"""A folder that is read as files arrive in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.sources.documents import FILES
from tidemark.store import Store


def ingest_stream(store: Store, folder: str, checkpoint: str, files_at_once: int = 10_000, every: str | None = None) -> StreamingQuery:
    """Files below ``folder`` as documents and spans of ``store``, each content once, whatever fails and starts again.

    A micro-batch is one commit of the store. Spark repeats a batch that it does not know to be done, and documents are told by their
    content, so a batch that was committed just before a crash adds nothing the second time. Refused files are kept with their
    reason. Without ``every`` (a processing time such as ``1 minute``) the stream takes what is there and ends.
    """

    def batch(files: DataFrame, number: int) -> None:
        own = Store(files.sparkSession, store.folder)
        kept = files.persist()
        try:
            with own.transaction():
                _, refused = own.ingest_files(kept, "stream")
                if not refused.isEmpty():
                    own._write("refused", refused)
        finally:
            kept.unpersist()

    source = store.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(folder)
    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
