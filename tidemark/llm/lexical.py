"""Ranked lexical search: every item's best documents under whole-number BM25 weights.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased.

Method: sort-based accumulation. One pass over the texts counts each document's terms and keeps, of the items' terms, how
often it holds them: the postings, a table. Counts over that table give the weights. A second pass takes the postings some
documents at a time: each posting meets the items that have its term, the (item, document, impact) arrays are concatenated, items
and documents packed into one key, the keys radix sorted and the impacts of equal keys summed by ``reduceat``; of each item's
sums, those that can still be among its best go onto a heap of ``k``. Every task hands on its heaps, and their entries are
range-partitioned by item, cut into cells first, so that no task holds what all tasks found for an item.

What is broadcast are the items' terms, at most about ``BLOCK_TERMS`` of them: more items are searched in blocks, each over all documents.

Defined cases: an item is the terms of all rows of its id; items without terms find nothing; a null text has no terms, and
a document without terms counts nowhere; rows of ``docs`` are documents of their own, whatever their id; among equal scores a null id
comes last; a table without terms gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, finish, materialize

#: Item terms searched at once: what a task holds of the items, some tens of bytes each.
BLOCK_TERMS = 200_000
#: Impacts that are sorted together, and documents; a single document may bring more impacts, one for each item term at most.
MANY = 2_000_000
DOCUMENTS = 1 << 16
#: Cells that an item's entries are cut into before they meet.
CELLS = 64

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For UTF-8: ASCII letters lower-cased, ASCII digits and all other bytes of characters beyond ASCII kept, the rest blank.
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: Column) -> Column:
    """All terms of a text, with repeats."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_TERM), F.lit(0)), F.array().cast("array<string>"))


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every row with a term: the number of its terms, and how often it holds each term of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = known.value
        for b in batches:
            sizes, kept, ends, terms, tfs = [], [], [0], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                words = text.translate(_BYTES).split()
                if not words:
                    continue
                got, often = np.unique(np.fromiter((ids[w] for w in words if w in ids), np.int32), return_counts=True)
                kept.append(row), sizes.append(len(words)), ends.append(ends[-1] + len(got)), terms.append(got), tfs.append(often)
            flat = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
            held = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), held(flat(terms, np.int32)), held(flat(tfs, np.int64))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


@dataclass
class Weighed:
    """The items of a block as arrays by term: which items have it, and its weight; and the sizes that weigh documents."""

    items: list
    starts: np.ndarray
    holders: np.ndarray
    weights: np.ndarray
    documents: int
    words: int

    def lengths(self, sizes: list[int]) -> np.ndarray:
        return np.array([50 + 50 * n * self.documents // self.words for n in sizes], dtype=np.int64)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of 32-bit keys, by their lower and then their upper half."""
    low = np.argsort((keys & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    return low[np.argsort((keys >> np.uint32(16)).astype(np.uint16)[low], kind="stable")]


def accumulate(docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, index: Weighed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of all pairs that share a term, by item, then document. Documents are numbers below 65,536, as are items."""
    fan = index.starts[terms + 1] - index.starts[terms]
    first = np.cumsum(fan) - fan
    at = np.arange(fan.sum()) - np.repeat(first - index.starts[terms], fan)
    keys = (index.holders[at].astype(np.uint32) << np.uint32(16)) | np.repeat(docs, fan).astype(np.uint32)
    order = radix_order(keys)
    keys = keys[order]
    edges = np.flatnonzero(np.concatenate(([len(keys) > 0], keys[1:] != keys[:-1])))
    sums = np.add.reduceat(np.repeat(impacts, fan)[order], edges) if len(edges) else np.empty(0, np.int64)
    keys = keys[edges]
    return (keys >> np.uint32(16)).astype(np.int64), (keys & np.uint32(0xFFFF)).astype(np.int64), sums


class Heaps:
    """The ``k`` best documents of each item so far; of equal scores, smaller ids first and null last."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]

    def add(self, items: np.ndarray, ids: list, scores: np.ndarray) -> None:
        """Entries by ascending item. Of an item's new entries only those that reach its ``k``-th best go near the heap."""
        edges = np.flatnonzero(np.concatenate(([len(items) > 0], items[1:] != items[:-1])))
        for lo, hi in zip(edges, [*edges[1:], len(items)]):
            heap, part = self.heaps[items[lo]], scores[lo:hi]
            least = max(1, heap[0][0] if len(heap) == self.k else 0)
            if hi - lo > self.k:
                least = max(least, np.partition(part, hi - lo - self.k)[hi - lo - self.k])
            for j in np.flatnonzero(part >= least):
                x = ids[lo + j]
                entry = (int(part[j]), x is not None, -(x or 0))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)

    def entries(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.heaps):
            for score, known, minus in heap:
                yield item, -minus if known else None, score


def _cuts(cost: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents whose impacts can be sorted together."""
    out, lo, held = [], 0, 0
    for k, c in enumerate(cost):
        if k > lo and (held + c > MANY or k - lo == DOCUMENTS):
            out.append((lo, k))
            lo, held = k, 0
        held += c
    return [*out, (lo, len(cost))] if len(cost) else out


def best_in(batches: Iterator[pa.RecordBatch], index: Weighed, k: int) -> Iterator[pa.RecordBatch]:
    """The heaps of one task's documents."""
    heaps = Heaps(len(index.items), k)
    fans = np.diff(index.starts)
    for b in batches:
        held = b.column("terms")
        ends = held.offsets.to_numpy().astype(np.int64)
        terms = held.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
        tfs = b.column("tfs").values.to_numpy()[ends[0] : ends[-1]]
        ends = ends - ends[0]
        row = np.repeat(np.arange(b.num_rows), np.diff(ends))
        lengths, ids = index.lengths(b.column("n").to_pylist()), b.column("doc_id").to_pylist()
        impacts = index.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * lengths[row]))
        cost = np.concatenate(([0], np.cumsum(fans[terms])))
        for lo, hi in _cuts(np.diff(cost[ends])):
            part = slice(ends[lo], ends[hi])
            items, docs, scores = accumulate(row[part] - lo, terms[part], impacts[part], index)
            heaps.add(items, [ids[lo + d] for d in docs], scores)
    found = list(heaps.entries())
    yield pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())],
        names=["slot", "doc_id", "score"],
    )


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), once each."""
    return items.select(F.col(id_col).alias("item_id"), F.explode(terms_of(F.col(text_col))).alias("term")).distinct()


def _search_block(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """One block of (item_id, term) against all documents."""
    spark = docs.sparkSession
    pairs = wanted.collect()
    items = list(dict.fromkeys(p.item_id for p in pairs))
    words = list(dict.fromkeys(p.term for p in pairs))
    if len(items) > DOCUMENTS:
        raise ValueError("too many items in one block")
    slots, numbers = {x: i for i, x in enumerate(items)}, {w: i for i, w in enumerate(words)}
    held = materialize(postings(docs, {w.encode(): i for w, i in numbers.items()}, id_col, text_col))
    size = held.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    df = np.zeros(len(words), dtype=np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    order = sorted((numbers[p.term], slots[p.item_id]) for p in pairs)
    starts = np.searchsorted(np.array([t for t, _ in order]), np.arange(len(words) + 1)) if order else np.zeros(1, np.int64)
    weights = np.floor(1000 * np.log((2.0 * size.n + 2) / (2.0 * df + 1))).astype(np.int64)
    index = Weighed(items, starts, np.array([s for _, s in order], dtype=np.int64), weights, size.n, size.words or 1)
    shared = spark.sparkContext.broadcast(index)
    found = materialize(held.mapInArrow(lambda batches: best_in(batches, shared.value, k), "slot int, doc_id bigint, score bigint"))
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    celled = found.withColumn("cell", F.pmod(F.spark_partition_id(), F.lit(CELLS))).repartitionByRange("slot", "cell")
    first = celled.withColumn("rank", F.row_number().over(best("slot", "cell"))).where(F.col("rank") <= k).drop("rank", "cell")
    last = first.repartitionByRange("slot").withColumn("rank", F.row_number().over(best("slot"))).where(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(items)), f"slot int, item_id {wanted.schema['item_id'].dataType.simpleString()}")
    return finish(last.join(F.broadcast(named), "slot").select("item_id", "rank", "doc_id", "score"), held, found)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents of all."""
    wanted = materialize(item_terms(items, item_col, item_text))
    size = wanted.agg(F.count("*").alias("terms"), F.approx_count_distinct("item_id").alias("items")).first()
    blocks = 1 + max(size.terms // BLOCK_TERMS, 2 * size.items // DOCUMENTS)
    out = None
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else wanted
        found = _search_block(docs, part, k, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    discard(wanted)
    return out
