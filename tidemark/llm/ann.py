"""Maximum inner product search by score-aware (anisotropic) quantisation.

Vectors are cut into sub-vectors of two components, each coded by 4 bits. Codebooks and codes minimise
a loss that weighs the part of the residual parallel to the vector more than the rest, since that part
moves the inner products that matter (Guo et al., 2020). Codebooks are fitted on at most ``SAMPLE``
vectors, chosen by a hash; every row is coded, once, and kept with its codes in a table. Queries meet all rows in
blocks: a query's table of partial products is summed over the codes (two codes a byte), the best ``SHORTLIST`` rows of
the block are scored exactly in double precision, and the best of all blocks are kept. The shortlist is one for each
block, so that recall does not fall as rows grow.

Each length of vectors is searched on its own, by a quantiser of its own, in one plan; lengths are taken to be few.

Defined cases: null or zero vectors, and those with null or non-finite components, take no part; ties go to
the smaller id; rows with the query's own id are never its candidates; rows of equal id and vector count once, as query
and as candidate; an id with different vectors asks with each and is found by each, but is listed once for a query, with
its best score; fewer candidates than asked for give fewer rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, finish, materialize

SAMPLE = 8192
SHORTLIST = 256
#: Rows and queries of a block.
ROWS, QUERIES_AT_ONCE = 16_384, 32_768
#: Weight of the parallel part over the rest.
ETA = 4.0
ROUNDS = 6


def matrix(column: pa.ChunkedArray | pa.Array | list[bytes], kind: str = "f8") -> np.ndarray:
    """Packed vectors as rows of doubles."""
    blobs = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)


def packed_kind(df: DataFrame, vec_col: str) -> str:
    """Vectors travel in their own precision: four bytes for floats, else doubles."""
    return "f4" if df.schema[vec_col].dataType.elementType.typeName() == "float" else "f8"


def packed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, dims): usable vectors packed in ``packed_kind``; vec is null for the others."""
    kind = packed_kind(df, vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, dims = [], []
            for v in batch.column(1):
                x = None
                if v.is_valid and len(v) and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    x = x if np.isfinite(x).all() and x.any() else None
                vecs.append(None if x is None else x.tobytes())
                dims.append(None if x is None else len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "vec", "dims"])

    return df.select(id_col, vec_col).mapInArrow(run, "vec_id bigint, vec binary, dims int")


class Quantiser:
    def __init__(self, sample: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        n, d = sample.shape
        self.parts = (d + 1) // 2
        x = self._split(sample)
        self.books = np.zeros((self.parts, 16, 2))
        for s in range(self.parts):
            book = x[rng.permutation(n)[:16], s] if n >= 16 else np.resize(x[:, s], (16, 2))
            for _ in range(8):
                near = ((x[:, s, None] - book) ** 2).sum(2).argmin(1)
                size = np.bincount(near, minlength=16)[:, None]
                total = np.stack([np.bincount(near, x[:, s, k], 16) for k in (0, 1)], 1)
                book = np.where(size > 0, total / np.maximum(size, 1), book)
            self.books[s] = book
        for _ in range(ROUNDS):
            codes = self._codes(x)
            unit = x / np.sqrt((x**2).sum((1, 2), keepdims=True))
            left = x - self._decoded(codes)
            along = (left * unit).sum((1, 2))
            for s in range(self.parts):
                u, own = unit[:, s], codes[:, s]
                rest = along - (left[:, s] * u).sum(1)
                a = np.eye(2) + (ETA - 1) * u[:, :, None] * u[:, None, :]
                b = x[:, s] + (ETA - 1) * u * (rest + (x[:, s] * u).sum(1))[:, None]
                lhs = np.stack([[np.bincount(own, a[:, i, j], 16) for j in (0, 1)] for i in (0, 1)]).transpose(2, 0, 1)
                rhs = np.stack([np.bincount(own, b[:, i], 16) for i in (0, 1)], 1)
                used = np.bincount(own, minlength=16) > 0
                self.books[s][used] = np.linalg.solve(lhs[used], rhs[used][:, :, None])[:, :, 0]
                left[:, s] = x[:, s] - self.books[s][own]
                along = rest + (left[:, s] * u).sum(1)

    def _split(self, vectors: np.ndarray) -> np.ndarray:
        if vectors.shape[1] % 2:
            vectors = np.pad(vectors, ((0, 0), (0, 1)))
        return vectors.reshape(len(vectors), -1, 2)

    def _decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.parts), codes]

    def _codes(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Nearest codes, then coordinate descent on the anisotropic loss."""
        codes = np.stack([((x[:, s, None] - self.books[s]) ** 2).sum(2).argmin(1) for s in range(self.parts)], 1)
        unit = x / np.sqrt((x**2).sum((1, 2), keepdims=True))
        along = ((x - self._decoded(codes)) * unit).sum((1, 2))
        at = np.arange(len(x))
        for _ in range(rounds):
            for s in range(self.parts):
                left = x[:, s, None] - self.books[s]
                part = (left * unit[:, s, None]).sum(2)
                rest = along - part[at, codes[:, s]]
                codes[:, s] = ((left**2).sum(2) + (ETA - 1) * (rest[:, None] + part) ** 2).argmin(1)
                along = rest + part[at, codes[:, s]]
        return codes

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Two 4-bit codes a byte, one row of bytes for each pair of parts."""
        codes = self._codes(self._split(vectors)).astype(np.uint8)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return np.ascontiguousarray((codes[:, ::2] << 4 | codes[:, 1::2]).T)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Partial inner products by byte."""
        t = (self.books * self._split(query[None])[0][:, None]).sum(2)
        if len(t) % 2:
            t = np.concatenate([t, np.zeros((1, 16))])
        return (t[::2, :, None] + t[1::2, None, :]).reshape(-1, 256).astype(np.float32)


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed from the first component on, so that every plan gives the same last digit."""
    out = np.zeros(len(vectors))
    for column in vectors.T * query[:, None]:
        out += column
    return out


def search_block(q: Quantiser, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, shortlist: int):
    """(query index, row index, score) of the best k ids of this block for every query; ``codes`` has a row for each byte of codes."""
    out = []
    repeats = len(np.unique(ids)) < len(ids)
    for i, query in enumerate(queries):
        tables = q.tables(query)
        rough = tables[0][codes[0]]
        for t, c in zip(tables[1:], codes[1:]):
            rough += t[c]
        near = np.argpartition(-rough, shortlist)[:shortlist] if len(ids) > shortlist else np.arange(len(ids))
        near = near[ids[near] != query_ids[i]]
        score = _products(vectors[near], query)
        best = np.lexsort((ids[near], -score))
        if repeats:
            best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])]
        best = best[:k]
        out.append((np.full(len(best), i), near[best], score[best]))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def search(
    df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shortlist: int = SHORTLIST,
    sample: int = SAMPLE, rows: int = ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest other rows of its length by inner product."""
    spark, kind = df.sparkSession, packed_kind(df, vec_col)
    vectors = materialize(packed(df, id_col, vec_col).where(F.col("vec").isNotNull() & F.col("vec_id").isNotNull()).distinct())
    asks = vectors.select(F.col("vec_id").alias(id_col), "dims").withColumn("asks", is_query)
    lengths = asks.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).where("asked > 0").orderBy("dims").collect()
    if not lengths:
        discard(vectors)
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    each, used = [], [vectors]
    for r in lengths:
        found, coded = _found(vectors.where(F.col("dims") == r["dims"]).select("vec_id", "vec"), is_query, r["n"], r["asked"], kind, k, id_col, shortlist, sample, rows)
        each.append(found)
        used.append(coded)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    listed = reduce(DataFrame.unionByName, each).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = listed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return finish(ranked.select("query_id", "rank", "vec_id", "score"), *used)


def _found(
    vectors: DataFrame, is_query: Column, n: int, n_asked: int, kind: str, k: int, id_col: str, shortlist: int, sample: int, rows: int
) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score): the k best of every block for the queries among n vectors of one length; and the coded rows."""
    spark = vectors.sparkSession
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).collect()
    shared = spark.sparkContext.broadcast(Quantiser(matrix([r["vec"] for r in drawn], kind)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes = np.ascontiguousarray(shared.value.encode(matrix(batch.column(1), kind)).T)
                blobs = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, blobs], names=["vec_id", "vec", "codes"])

    coded = materialize(vectors.mapInArrow(encoded, "vec_id bigint, vec binary, codes binary"))
    asked = coded.withColumnRenamed("vec_id", id_col).where(is_query).select(F.col(id_col).alias("vec_id"), "vec")
    row_blocks = max(1, -(-n // rows))
    query_blocks = max(1, -(-n_asked // QUERIES_AT_ONCE))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    spread = lambda m: F.pmod(F.xxhash64("vec_id", "vec"), F.lit(m)).cast("int")
    right = coded.select("vec_id", "vec", "codes", spread(row_blocks).alias("r"), every(query_blocks).alias("q"))
    left = asked.select("vec_id", "vec", F.lit(None).cast("binary").alias("codes"), every(row_blocks).alias("r"), spread(query_blocks).alias("q"))

    def run(table: pa.Table) -> pa.Table:
        asks = table["codes"].is_null().to_numpy()
        ids, vecs = table["vec_id"].to_numpy(), matrix(table["vec"], kind)
        if not asks.any() or asks.all():
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        blobs = [c for c in table["codes"].to_pylist() if c is not None]
        codes = np.ascontiguousarray(np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1).T)
        i, j, score = search_block(shared.value, ids[~asks], vecs[~asks], codes, ids[asks], vecs[asks], k, shortlist)
        return pa.table({"query_id": ids[asks][i], "vec_id": ids[~asks][j], "score": score})

    return right.unionByName(left).groupBy("r", "q").applyInArrow(run, "query_id bigint, vec_id bigint, score double"), coded
