"""Language identification by a string kernel.

Method: blended-spectrum presence kernel. A text is the set of its runs of 1 to ``LONGEST`` characters, all of them together, whether
it has them once or often; every run hashes to one of 2**``BITS`` buckets. Characters are lower-cased, and what is neither letter nor mark counts as a
blank, many as one. The kernel of two texts is the cosine of their sets, plus one for a constant. Nyström: the kernel is
taken against ``LANDMARKS`` texts only, and ridge regression, one language against the rest, finds the weights of the landmarks from at most ``MAX_LABELLED``
texts in which every language weighs the same. Scoring takes texts in batches: their sets as a matrix, times the landmarks' sets times
their weights (one product, made once), over the texts' norms.

Whole texts are read, for learning and for scoring; what reaches the driver is one bit a bucket for each text learned from. The table of weights
has a column for each language: 256 kB each, to every task.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so are all if nothing was learned; a row without an id is never
learned from and not held out; learned from are distinct pairs of id and language, of several texts the one of smallest hash;
languages take turns, so the bound on texts leaves none out while there are fewer than it; ties go to the language that sorts first;
input columns named ``lang_pred`` and ``score`` give way to the results.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LABELLED = 4000
LANDMARKS = 256
BITS = 16
LONGEST = 4
RIDGE = 1e-3
#: Texts whose sets are held as one matrix: 16 MB.
ROWS = 64
UNKNOWN = "und"
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(LONGEST)], dtype=np.uint64)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point, whether it is a letter, and whether it is a letter or a mark."""
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    return kinds == "L", (kinds == "L") | (kinds == "M")


def grams(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's runs of characters; none if it has no letter."""
    letter, kept = _letters()
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not letter[codes].any():
        return np.empty(0, dtype=np.int64)
    codes = np.concatenate(([32], np.where(kept[codes], codes, 32), [32])).astype(np.uint64)
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    there = np.zeros(1 << BITS, dtype=bool)
    run = np.zeros(len(codes), dtype=np.uint64)
    for n in range(LONGEST):
        if len(codes) <= n:
            break
        run = run[: len(codes) - n] + codes[n:] * _POWERS[n]
        mixed = (run ^ np.uint64(n + 1)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
        mixed *= np.uint64(0xC4CEB9FE1A85EC53)
        there[mixed >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(there)


def sets_matrix(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of zeros and ones, and their norms."""
    out = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    for row, ids in zip(out, texts):
        row[ids] = 1
    return out, np.sqrt(np.array([max(1, len(ids)) for ids in texts], dtype=np.float32))


def kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Cosine of sets, plus one, in blocks of rows."""
    right, norms = sets_matrix(b)
    rows = []
    for lo in range(0, len(a), ROWS):
        left, own = sets_matrix(a[lo : lo + ROWS])
        rows.append((left @ right.T) / own[:, None] / norms[None, :] + 1)
    return np.concatenate(rows) if rows else np.empty((0, len(b)))


@dataclass(frozen=True)
class Model:
    """``table``: landmarks' sets times their weights, a column a language; ``bias``: the sum of the weights, from the constant."""

    languages: list[str] = field(default_factory=list)
    table: np.ndarray | None = None
    bias: np.ndarray | None = None

    def margins(self, texts: list[np.ndarray]) -> np.ndarray:
        """Near 1 where a text is of the language, near -1 where it is not."""
        sets, norms = sets_matrix(texts)
        return (sets @ self.table) / norms[:, None] + self.bias

    def predict(self, texts: list[np.ndarray]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for lo in range(0, len(texts), ROWS):
            part = texts[lo : lo + ROWS]
            if not self.languages:
                names, scores = names + [UNKNOWN] * len(part), scores + [0.0] * len(part)
                continue
            found = self.margins(part)
            best = found.argmax(axis=1)
            top = np.clip((found[np.arange(len(part)), best] + 1) / 2, 0, 1)
            names += [self.languages[k] if len(ids) else UNKNOWN for k, ids in zip(best, part)]
            scores += [float(s) if len(ids) else 0.0 for s, ids in zip(top, part)]
        return names, scores


def train(texts: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS) -> Model:
    """Ridge weights of the first ``landmarks`` texts, and the table they give. Languages should take turns among the texts."""
    if not texts:
        return Model()
    languages = sorted(set(langs))
    own = np.array([languages.index(x) for x in langs])
    said = np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = 1 / np.bincount(own)[own]
    marks = texts[:landmarks]
    among, to = kernel(marks, marks).astype(np.float64), kernel(texts, marks).astype(np.float64)
    left = (to * share[:, None]).T @ to + RIDGE * among
    weights = np.linalg.solve(left + 1e-9 * np.trace(left) * np.eye(len(marks)), (to * share[:, None]).T @ said)
    sets, norms = sets_matrix(marks)
    return Model(languages, (sets.T @ (weights / norms[:, None]).astype(np.float32)), weights.sum(axis=0).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_labelled: int = MAX_LABELLED, landmarks: int = LANDMARKS) -> Model:
    """Learns from texts with a language whose ids are not held out; only ids travel until the texts are chosen."""
    known = docs.select("doc_id", "lang", "text").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").distinct().withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= max_labelled)
    chosen = ids.orderBy("turn", "lang").limit(max_labelled)
    texts = (
        known.join(F.broadcast(chosen), ["doc_id", "lang"])
        .groupBy("doc_id", "lang", "turn").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .select("turn", "lang", "text")
    )

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for t in b.column(2):
                there = np.zeros(1 << BITS, dtype=bool)
                there[grams(t.as_py())] = True
                held.append(np.packbits(there).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held, pa.binary())], names=["turn", "lang", "bits"])

    got = sorted(texts.mapInArrow(bits, "turn int, lang string, bits binary").collect(), key=lambda r: (r["turn"], r["lang"]))
    sets = [np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))) for r in got]
    return train(sets, [r["lang"] for r in got], landmarks)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    df = docs.drop("lang_pred", "score")
    schema = T.StructType(df.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    where = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own, out = shared.value, to_arrow_schema(schema)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                names, scores = own.predict([grams(t.as_py()) for t in part.column(where)])
                cols = [c.cast(f.type) for c, f in zip(part.columns, out)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=out)

    return df.mapInArrow(run, schema)
