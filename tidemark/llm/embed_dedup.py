"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= t differ by a squared distance of 2 - 2 t at most. Vectors are rotated (to
the principal axes of a bounded sample) and cut into blocks of few dimensions; each block gets a part
of the squared distance in proportion to its variance. A pair within the whole budget is within budget
in at least one block. Each block is range-joined on cells of a k-d tree: a vector is at home in one
cell and visits the later cells that its block radius reaches. In a cell, pairs within the block's
budget are candidates and are verified exactly, in double precision on the original vectors.

A pair is counted only by the first block that finds it; block distances are computed on coordinates
rounded to integers, so every task decides alike. Cells with many rows are cut into pieces that meet
pairwise. Tasks return link counts and a spanning forest, never pairs. Equal vectors count once, with
their multiplicity.

Defined cases: null or zero vectors, and those with null or non-finite components, link with nothing;
so do rows with a null id; vectors of different lengths never link; rows with equal ids are one node
but keep their own counts; finite doubles whose squares overflow or vanish are scaled first and link as others do; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ann import matrix, packed, packed_kind
from tidemark.llm.common import connected_components, discard, finish, materialize

BLOCKS = 4
SAMPLE = 20_000
CELL = 8192
PIECE = 8192
TILE = 1024
#: Grid units of a unit length: sums of squares stay below 2 ** 24, so single precision is exact.
GRID = 1024.0


class Plan:
    """Rotation, blocks, budgets (in grid units) and a k-d tree for each block."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, blocks: int, cell: int):
        unit = _unit(sample)
        d = unit.shape[1]
        self.axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
        spread = ((unit @ self.axes) ** 2).mean(0)
        self.cuts = [c for c in np.array_split(np.arange(d), min(blocks, d)) if len(c)]
        share = np.array([spread[c].sum() for c in self.cuts]) + 1e-3
        share /= share.sum()
        # rounding moves each coordinate difference by one grid unit at most
        self.budget = [(np.sqrt((2 - 2 * threshold) * s) * GRID + np.sqrt(len(c)) + 0.1) ** 2 for s, c in zip(share, self.cuts)]
        self.depth = max(0, int(np.ceil(np.log2(max(1, rows) / cell))))
        grid = self.grid(unit)
        self.trees = [self._split(grid[:, c], self.depth) for c in self.cuts]

    def grid(self, unit: np.ndarray) -> np.ndarray:
        return np.rint(unit @ self.axes * GRID).astype(np.float32)

    def _split(self, x: np.ndarray, depth: int):
        if depth == 0:
            return None
        dim = int(x.var(0).argmax()) if len(x) else 0
        at = float(np.median(x[:, dim])) if len(x) else 0.0
        return dim, at, self._split(x[x[:, dim] <= at], depth - 1), self._split(x[x[:, dim] > at], depth - 1)

    def cells(self, block: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, at home) for every cell within the block's radius of a row."""
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        self._visit(x, self.trees[block], block, out)
        return (
            np.concatenate([o[0] for o in out]), np.concatenate([np.full(len(o[0]), o[1]) for o in out]), np.concatenate([o[2] for o in out])
        )

    def _visit(self, x: np.ndarray, tree, block: int, out: list) -> None:
        todo = [(tree, 0, np.arange(len(x)), np.zeros_like(x), np.ones(len(x), dtype=bool))]
        while todo:
            tree, cell, idx, gap, home = todo.pop()
            if not len(idx):
                continue
            if tree is None:
                out.append((idx, cell, home))
                continue
            dim, at, low, high = tree
            v = x[idx, dim]
            for k, child in enumerate((low, high)):
                inside = v > at if k else v <= at
                away = gap.copy()
                away[:, dim] = np.where(inside, away[:, dim], np.maximum(away[:, dim], np.abs(v - at)))
                near = (away**2).sum(1) <= self.budget[block]
                todo.append((child, cell * 2 + k, idx[near], away[near], (home & inside)[near]))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def join_tile(plan: Plan, block: int, ga: np.ndarray, gb: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the tile that this block is the first to find and that truly link."""

    def within(b: int) -> np.ndarray:
        x, y = ga[:, plan.cuts[b]], gb[:, plan.cuts[b]]
        most = np.float32(plan.budget[b] // 1)
        far = np.hstack([2 * x, most - (x * x).sum(1, keepdims=True), np.full((len(x), 1), -1, np.float32)])
        return far @ np.hstack([y, np.ones((len(y), 1), np.float32), (y * y).sum(1, keepdims=True)]).T >= 0

    found = within(block)
    if not found.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    many = np.count_nonzero(found) * 64 > found.size
    if many:
        for b in range(block):
            found &= ~within(b)
    i, j = np.divmod(np.flatnonzero(found), found.shape[1])
    if not many:
        for b in range(block):
            c = plan.cuts[b]
            fresh = ((ga[i][:, c] - gb[j][:, c]) ** 2).sum(1) > plan.budget[b] // 1
            i, j = i[fresh], j[fresh]
    if len(i) * 16 > found.size:
        cos = ua @ ub.T
        close = cos[i, j]
    else:
        close = np.einsum("ij,ij->i", ua[i], ub[j])
    sure = np.abs(close - threshold) > 1e-12
    keep = close >= threshold
    for p in np.flatnonzero(~sure):
        keep[p] = float((ua[i[p]] * ub[j[p]]).sum()) >= threshold
    return i[keep], j[keep]


def _join(plan_b, threshold: float, kind: str):
    def run(table: pa.Table) -> pa.Table:
        plan, block = plan_b.value, table["block"][0].as_py()
        one = table["i"][0].as_py() == table["j"][0].as_py()
        side, rep, key, times = (table[c].to_numpy() for c in ("side", "rep", "key", "times"))
        unit = _unit(matrix(table["vec"], kind))
        grid = plan.grid(unit)
        left = np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        count, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a in range(0, len(left), TILE):
            x = left[a : a + TILE]
            for b in range(a if one else 0, len(right), TILE):
                y = right[b : b + TILE]
                i, j = join_tile(plan, block, grid[x], grid[y], unit[x], unit[y], threshold)
                if one and a == b:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                i, j = x[i], y[j]
                np.add.at(count, i, times[j])
                np.add.at(count, j, times[i])
                tops = np.array([find(k) for k in np.concatenate([np.unique(i), np.unique(j)])])
                names = dict(zip(np.concatenate([np.unique(i), np.unique(j)]).tolist(), tops.tolist()))
                pairs = np.unique(np.stack([[names[k] for k in i.tolist()], [names[k] for k in j.tolist()]], 1), axis=0)
                for p, q in pairs.tolist():
                    p, q = find(p), find(q)
                    if p != q:
                        root[max(p, q)] = min(p, q)
        hit = np.flatnonzero(count)
        top = np.array([find(k) for k in hit.tolist()], dtype=np.int64)
        return pa.table({"key": key[hit], "rep": rep[hit], "links": count[hit], "root": rep[top] if len(hit) else np.zeros(0, np.int64)})

    return run


def near_duplicates(
    df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", blocks: int = BLOCKS,
    sample: int = SAMPLE, cell: int = CELL, piece: int = PIECE,
) -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    spark = df.sparkSession
    kind = packed_kind(df, vec_col)
    rows = packed(df, id_col, vec_col)
    base = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("vec")).alias("vec"))
    usable = rows.where("vec is not null and vec_id is not null")
    distinct = materialize(usable.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("dims").alias("dims")).withColumn("key", F.xxhash64("vec")))
    parts, tables = [], [distinct]
    for length in distinct.groupBy("dims").count().orderBy("dims").collect():
        own = distinct.where(F.col("dims") == length["dims"]).select("vec", "rep", "times", "key")
        drawn = own.orderBy("key", "vec").limit(sample).collect()
        plan = Plan(matrix([r["vec"] for r in drawn], kind), length["count"], threshold, blocks, cell)
        parts.append(_block_joins(own, spark.sparkContext.broadcast(plan), len(plan.cuts), threshold, piece, kind, tables))
    if not parts:
        discard(distinct)
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = materialize(found)
    linked = connected_components(found.select("rep", "root"), "rep", "root")
    counts = found.groupBy("key", "rep").agg(F.sum("links").alias("links"))
    named = (
        distinct.select("key", "vec", "rep", "times")
        .join(counts, ["key", "rep"], "left")
        .join(linked, F.col("rep") == F.col("node"), "left")
        .select("vec", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = base.join(named, "vec", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return finish(out, found, linked, *tables)


def _block_joins(own: DataFrame, plan, blocks: int, threshold: float, piece: int, kind: str, tables: list[DataFrame]) -> DataFrame:
    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            grid = plan.value.grid(_unit(matrix(batch.column(0), kind)))
            for b in range(blocks):
                row, cell, home = plan.value.cells(b, grid[:, plan.value.cuts[b]])
                base = np.full(len(batch), -1)
                base[row[home]] = cell[home]
                keep = home | (cell > base[row])
                at = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in batch.columns), pa.array(np.full(keep.sum(), b), pa.int32()), pa.array(cell[keep], pa.int64()), pa.array(home[keep])],
                    names=["vec", "rep", "times", "key", "block", "cell", "home"],
                )

    schema = "vec binary, rep bigint, times bigint, key bigint, block int, cell bigint, home boolean"
    sent = own.mapInArrow(routed, schema)
    sizes = materialize(
        sent.groupBy("block", "cell").agg(
            F.ceil(F.count_if("home") / F.lit(piece)).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / F.lit(piece)).cast("int").alias("visits")
        )
    )
    tables.append(sizes)
    h = F.pmod(F.xxhash64("key"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits"))).cast("int")
    meets = F.expr("""
        if(home,
           concat(transform(sequence(0, homes - 1), x -> named_struct('i', least(h, x), 'j', greatest(h, x), 'side', if(x < h, 1, 0))),
                  if(visits = 0, array(), transform(sequence(0, visits - 1), x -> named_struct('i', h, 'j', homes + x, 'side', 0)))),
           if(homes = 0, array(), transform(sequence(0, homes - 1), x -> named_struct('i', x, 'j', homes + h, 'side', 1))))
    """)
    placed = sent.join(sizes, ["block", "cell"]).withColumn("h", h).withColumn("meets", meets)
    return (
        placed.select("vec", "rep", "times", "key", "block", "cell", F.inline("meets"))
        .groupBy("block", "cell", "i", "j")
        .applyInArrow(_join(plan, threshold, kind), "key bigint, rep bigint, links bigint, root bigint")
    )
