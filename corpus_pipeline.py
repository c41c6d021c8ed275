"""A corpus pipeline: low quality goes, near copies go, secrets are masked, sources are mixed, the rest is encoded.

Defined cases: a null or empty text is scored, masked and encoded like any other, and leaves with the mix, which takes
words only. Rows without a doc_id are never dropped as copies, since groups are named by ids. Rows that share a doc_id
are told apart by their texts: of equal ones a single row stays, different ones stay side by side. Empty tables
pass through every stage. Columns of documents beyond the five of the table are left behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, ngram_join, quality, secrets, sentencepiece_bpe
from tidemark.llm.common import discard, materialize, small
from tidemark.llm.queries import piece_model, table

#: Rows of ids, some 40 bytes each, that are broadcast to the texts; where there are more, texts are shuffled to them once.
KNOWN = 500_000
#: Rows that travel to Python at once: texts are long, and a batch stands several times in a task's memory.
BATCH = 1_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.5 or more); it is fitted on the given documents' labels."""
    _small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).where("score >= 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by shingle similarity; ungrouped ones all stay."""
    _small_batches(spark)
    groups = ngram_join.components(docs)
    one = groups.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") != F.col("component_id")).alias("_copy"), (F.count("*") > 1).alias("_shared"))
    marks = materialize(one.where("_copy or _shared"))
    marked = docs.select(*COLUMNS).join(small(marks, KNOWN), "doc_id", "left").where(~F.coalesce("_copy", F.lit(False)))
    if marks.where("_shared and not _copy").isEmpty():
        return marked.select(*COLUMNS)
    marked = materialize(marked)
    shared = F.coalesce("_shared", F.lit(False))
    return marked.where(~shared).unionByName(marked.where(shared).dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked; n_chars follows the text."""
    _small_batches(spark)
    return secrets.redact_documents(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes their words.

    A document of which the mix takes f times its words appears floor(f + u) times, where u in [0, 1) is a
    hash of its id and text: rows by source come near the targets, reruns agree, and no text is cut.
    Documents without words go.
    """
    taken = mixing.mix(docs).where("size > 0")
    u = F.pmod(F.xxhash64(F.lit(2), "doc_id", "text_hash"), F.lit(1 << 20)) / float(1 << 20)
    times = (
        taken.groupBy("doc_id", "text_hash").agg(F.avg(F.col("taken") / F.col("size")).alias("f"))
        .select(F.col("doc_id").alias("id"), "text_hash", F.floor(F.col("f") + u).cast("int").alias("times")).where("times > 0")
    )
    keyed = docs.select(*COLUMNS).withColumn("h", F.xxhash64("text"))
    times = small(materialize(times), KNOWN)
    rows = keyed.join(times, (keyed["h"] == times["text_hash"]) & keyed["doc_id"].eqNullSafe(times["id"]))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of the text, their number, and the text they decode to."""
    _small_batches(spark)
    ids = sentencepiece_bpe.encode_documents(docs, piece_model(), columns="ids array<int>, decoded string")
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("ngram_jaccard", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written, and those of the stage before it go."""
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
