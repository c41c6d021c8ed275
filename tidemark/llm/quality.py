"""Supervised subword embeddings for quality.

Every whitespace-separated word and every run of 3 to 5 characters inside a word (with its borders)
hashes to a learned vector; a document is the mean of its features' vectors, and a softmax over two
classes gives the score. Training is stochastic gradient descent in numpy, in one task, on at most
``MAX_LABELLED`` labelled documents (chosen by a hash of the id, whole texts); the driver gets the model only. Scoring covers every
row. The model is linear in the mean vector, so for scoring it folds into one number a bucket.

Defined cases: a null or empty text has only the end-of-text feature; labels that disagree on a
document, or are null, are left out; a labelled doc_id that several rows hold is trained on once, with the text of
the smallest hash, so the training task gets ``MAX_LABELLED`` rows at most, each of one pair of numbers a bucket at most;
without labels of both classes every score is 0.5; rows may repeat, and each is scored; an input column named
``score`` gives way to the score; other input columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 4000
BITS = 16
DIMS = 10
EPOCHS = 8
RATE = 0.5
_R = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(6)]
_POWERS = np.array([pow(0xD1B54A32D192ED03, k, 1 << 64) for k in range(64)], dtype=np.uint64)


def _buckets(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Bucket numbers of a text's features, with repeats; the last is the end of the text."""
    end = np.array([0], dtype=np.int64)
    if not text:
        return end
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    blank = (c == 32) | ((c >= 9) & (c <= 13))
    c = np.where(blank, np.uint64(1), c)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    c = np.concatenate(([np.uint64(1)], c[keep], [np.uint64(1)]))
    border = c == 1
    starts = np.flatnonzero(border[:-1] & ~border[1:]) + 1
    if not len(starts):
        return end
    inside = np.flatnonzero(~border)
    size = np.diff(np.append(np.searchsorted(inside, starts), len(inside)))
    first = np.cumsum(size) - size
    place = (np.arange(len(inside)) - np.repeat(first, size)) & 63
    found = [_buckets(np.add.reduceat(c[inside] * _POWERS[place], first), 77)]
    gap = np.concatenate(([0], np.cumsum(border)))
    h = c[:-1] * _R[0] + c[1:] * _R[1]
    for n in (3, 4, 5):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] + c[n - 1 :] * _R[n - 1]
        ok = gap[n - 1 : len(c)] == gap[1 : len(c) - n + 2]
        found.append(_buckets(h[ok], n))
    return np.concatenate([*found, end])


@dataclass(frozen=True)
class Model:
    """``weights[bucket]``: what one occurrence adds to the mean log-odds of class 1."""

    weights: np.ndarray

    def score(self, text: str | None) -> float:
        z = float(self.weights[features(text)].mean(dtype=np.float64))
        return float(1 / (1 + np.exp(-z)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 3) -> Model:
    """``rows``: distinct buckets, their shares (summing to 1) and the label of each document."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (1 << BITS, DIMS)).astype(np.float32)
    out = np.zeros((2, DIMS), dtype=np.float32)
    if len({y for _, _, y in rows}) < 2:
        return Model(np.zeros(1 << BITS, dtype=np.float32))
    total, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            ids, share, y = rows[k]
            rate = np.float32(RATE * (1 - done / total))
            done += 1
            own = vectors[ids]
            mean = share @ own
            z = out @ mean
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            vectors[ids] = own - (rate * share)[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32))


def held_out(doc_id) -> F.Column:
    """A third of the ids, never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Trains on labelled documents that are not held out."""
    known = (
        labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(target).alias("y"), F.max(target).alias("y2"))
        .where("y = y2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id", "y")
    )
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
        .groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shares = [], []
            for t in batch.column(2):
                b, n = np.unique(features(t.as_py()), return_counts=True)
                ids.append(b.astype(np.uint32).tobytes())
                shares.append((n / n.sum()).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int32()), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())],
                names=["doc_id", "y", "ids", "shares"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        got.sort(key=lambda r: r[0])
        model = train([(np.frombuffer(ids, np.uint32), np.frombuffer(shares, np.float32), y) for _, y, ids, shares in got])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary())], names=["weights"])

    counted = texts.mapInArrow(run, "doc_id string, y int, ids binary, shares binary")
    learned = counted.repartition(1).mapInArrow(learn, "weights binary").collect()
    return Model(np.frombuffer(learned[0]["weights"], np.float32) if learned else np.zeros(1 << BITS, dtype=np.float32))


def score_documents(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``score``, the probability of label 1, in place of any column of that name."""
    from pyspark.sql import types as T

    df = df.drop("score")
    schema = T.StructType(df.schema.fields + [T.StructField("score", T.DoubleType())])
    where = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own, out = Model(shared.value), to_arrow_schema(schema)
        for batch in batches:
            cols = [c.cast(f.type) for c, f in zip(batch.columns, out)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([own.score(t.as_py()) for t in batch.column(where)], pa.float64())], schema=out)

    return df.mapInArrow(run, schema)
