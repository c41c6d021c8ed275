"""A stored inverted index: postings of texts in segments, for ranked search that reads the postings of its terms only.

``add`` and ``remove`` commit a segment each: postings by term, every one documents of one block of ids that hold the term, with how
often and how long these documents are, and each document's length. Texts are brought together by block before their words are counted, so that a
term's documents of a block meet in one task; a block of many words is cut into several rows of a term. Postings are packed: a row's ids are one
run of bytes with their sizes, and sizes, counts and lengths are 32-bit integers, so that rows are moved and written whole, not value by value. A later segment replaces what earlier ones say of a
document; ``merge`` writes all segments as one, without what was replaced. Counts of documents and words travel with the commits.

A search first reads, of its terms, each block's largest count and shortest document, which bound what a document of the block can
score. The best blocks' postings of the rarest term give a score that the ``k``-th best reaches at least; then only blocks whose bounds add up to
that are read. Where texts were replaced since the last merge, blocks are not skipped, as what bounds them may be gone.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.commits import Log, State
from tidemark.operators.rounds import settled, stored
from tidemark.operators.textops import search_words

PACKED = "term string, block int, n int, ids binary, sizes binary, tfs binary, lens binary, most int, shortest int"
POSTING = PACKED + ", segment bigint, bucket int"
LENGTH = "id string, segment bigint, version int, len int"
#: Folders that terms are dealt to, and blocks of ids that a posting list is cut into.
BUCKETS, BLOCKS = 64, 256
#: Files that a folder of terms is cut into, and words or postings that a task packs at a time.
SLICES, CHUNK = 4, 2_000_000
#: How postings are written; an index of another layout has to be built anew.
LAYOUT = 2
K1, B = 1.2, 0.75


def plain_terms(terms: list[str]) -> list[str]:
    """Search terms as the index spells them, sorted."""
    return sorted({"".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)) for t in terms})


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _block(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BLOCKS)).cast("int")


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str

    @property
    def log(self) -> Log:
        return Log(self.spark, self.folder)

    def _stats(self, state: State) -> dict:
        """(docs, words, stale, segment) as the last commit has them."""
        stats = self.log.manifest(state.version)["stats"] if state.version else {"docs": 0, "words": 0, "stale": 0, "segment": 0, "layout": LAYOUT}
        if stats.get("layout") != LAYOUT:
            raise RuntimeError(f"the index in {self.folder} is of an older layout and has to be built anew")
        return stats

    def lengths(self, state: State | None = None) -> DataFrame:
        """(id, segment, version, len) of what the index holds of each document now; a removed one has no length."""
        state = state or self.log.state()
        rows = self.log.rows("lengths", LENGTH, state.batches.get("lengths", []))
        return rows.groupBy("id").agg(F.max_by(F.struct("segment", "version", "len"), "segment").alias("r")).select("id", "r.*")

    def add(self, docs: DataFrame) -> None:
        """(id, version, body): new documents, or new texts of known ones. One writer at a time wins; another has to start anew."""
        texts = docs.select(F.col("id").cast("string").alias("id"), F.col("version").cast("int").alias("version"), "body").withColumn("block", _block(F.col("id")))
        words = texts.repartition("block").sortWithinPartitions("block").select("id", "version", "block", search_words(F.col("body")).alias("w"))
        self._commit(words.select("id", "version", "block", F.coalesce(F.size("w"), F.lit(0)).alias("len"), "w"))

    def remove(self, ids: DataFrame) -> None:
        gone = ids.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("int").alias("version"))
        self._commit(gone.select("id", "version", _block(F.col("id")).alias("block"), F.lit(None).cast("int").alias("len"), F.array().cast("array<string>").alias("w")))

    def _commit(self, rows: DataFrame) -> None:
        state = self.log.state()
        stats = self._stats(state)
        segment = stats["segment"] + 1
        rows = stored(rows.withColumn("segment", F.lit(segment).cast("bigint")))  # lengths are read without the words
        if rows.isEmpty():
            return
        met = rows.select("id", F.col("len").alias("new")).join(self.lengths(state).select("id", F.col("len").alias("old")), "id", "left")
        n = met.agg(
            *(F.count(c).alias(f"{c}_docs") for c in ("new", "old")), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_words") for c in ("new", "old")), F.count("*").alias("all"), F.count_distinct("id").alias("ids")
        ).first()
        if n["all"] != n["ids"]:
            raise ValueError("an id stands twice in one batch")
        stats = {"docs": stats["docs"] + n["new_docs"] - n["old_docs"], "words": stats["words"] + n["new_words"] - n["old_words"], "stale": stats["stale"] + n["old_docs"], "segment": segment, "layout": LAYOUT}
        added = {"lengths": [self.log.stage("lengths", rows.select("id", "segment", "version", "len"))], "postings": [self.log.stage("postings", _posted(rows, segment), "bucket")]}
        if not self.log.put(state.version + 1, {"added": added, "stats": stats}):
            raise RuntimeError("another writer changed the index meanwhile")

    def _live(self, state: State, postings: DataFrame) -> DataFrame:
        """One row a document and term, of the newest segment of each document."""
        each = _inlined(postings)
        if not self._stats(state)["stale"]:
            return each
        now = self.lengths(state).where("len is not null").select("id", "segment")
        return each.join(now, ["id", "segment"], "left_semi")

    def merge(self) -> None:
        """All segments as one."""
        state = self.log.state()
        if len(state.batches.get("lengths", [])) < 2:
            return
        stats = self._stats(state)
        segment = F.lit(stats["segment"]).cast("bigint").alias("segment")
        rows = self.log.rows("postings", POSTING, state.batches["postings"]).select("block", "term", "segment", "n", "ids", "sizes", "tfs", "lens")
        if stats["stale"]:
            live = self.lengths(state).where("len is not null").select("id", "segment")
            dead = self.log.rows("lengths", LENGTH, state.batches["lengths"]).select("id", "segment").join(live, ["id", "segment"], "left_anti")
            rows = rows.unionByName(dead.select(_block(F.col("id")).alias("block"), "segment", F.col("id").cast("binary").alias("ids")), True)
        # what was replaced in a block comes before its postings, as rows without a term
        met = rows.repartition("block").sortWithinPartitions("block", "term", "segment").mapInArrow(_merged, PACKED)
        every = {
            "lengths": [self.log.stage("lengths", self.lengths(state).where("len is not null").withColumn("segment", segment))],
            "postings": [self.log.stage("postings", _laid(met.select("*", segment)), "bucket")],
        }
        stats = stats | {"stale": 0}
        if not self.log.put(state.version + 1, {"all": every, "stats": stats}):
            raise RuntimeError("another writer changed the index meanwhile")

    def postings(self, terms: list[str], state: State | None = None) -> DataFrame:
        """Posting blocks of some terms: folders of other terms are not listed, and row groups of others skipped."""
        state = state or self.log.state()
        rows = self.log.rows("postings", POSTING, state.batches.get("postings", []))
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("t")).select(_bucket(F.col("t"))).collect()]
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def search(self, terms: list[str], k: int = 20) -> DataFrame:
        """(id, score): the ``k`` best documents for any of the terms by BM25, ties to the smaller id."""
        state, listed = self.log.state(), plain_terms(terms)
        stats = self._stats(state)
        if not listed or not stats["docs"]:
            return self.spark.createDataFrame([], "id string, score double")
        blocks = self.postings(listed, state)
        if stats["stale"]:
            held = settled(self._live(state, blocks))
            found = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}
        else:
            heads = settled(blocks.select("term", "block", "most", "shortest", "n"))  # the postings themselves stay on disk
            found = {r["term"]: r["n"] for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        mean = stats["words"] / stats["docs"] or 1.0
        idf = {t: math.log(1 + (stats["docs"] - n + 0.5) / (n + 0.5)) for t, n in found.items()}
        if not idf:
            return self.spark.createDataFrame([], "id string, score double")
        part = lambda tf, length: _weight(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        if not stats["stale"]:
            held = self._live(state, self._wanted(blocks, heads, idf, part, k))
        # terms in order, so that sums do not depend on how rows meet
        scored = held.groupBy("id").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("term", part(F.col("tf"), F.col("len")).alias("s")))), F.lit(0.0), lambda a, x: a + x["s"]).alias("score"))
        return scored.select("id", F.bround("score", 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)

    def _wanted(self, blocks: DataFrame, heads: DataFrame, idf: dict[str, float], part, k: int) -> DataFrame:
        """The posting blocks that can hold one of the ``k`` best."""
        each = heads.groupBy("term", "block").agg(F.max(part(F.col("most"), F.col("shortest"))).alias("bound"))  # a block may be several rows
        bound = settled(each.groupBy("block").agg(F.sum("bound").alias("bound")))
        best = [r["block"] for r in bound.orderBy(F.desc("bound"), "block").limit(4).collect()]
        some = _inlined(blocks.where(F.col("block").isin(best)))
        sure = some.groupBy("id").agg(F.sum(part(F.col("tf"), F.col("len"))).alias("score")).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        if sure["n"] < k:
            return blocks
        likely = [r["block"] for r in bound.where(F.col("bound") >= sure["least"] - 1e-6).select("block").collect()]  # at most BLOCKS
        return blocks.where(F.col("block").isin(likely))


def _weight(idf: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in idf.items() for x in pair)), F.col("term"))


def _inlined(postings: DataFrame) -> DataFrame:
    """A row a document and term."""
    return postings.select("term", "block", "segment", "n", "ids", "sizes", "tfs", "lens").mapInArrow(_opened, "term string, block int, segment bigint, id string, tf int, len int")


def _posted(rows: DataFrame, segment: int) -> DataFrame:
    packed = rows.select("id", "block", "len", "w").mapInArrow(_counted, PACKED)
    return _laid(packed.withColumn("segment", F.lit(segment).cast("bigint")))


def _laid(packed: DataFrame) -> DataFrame:
    """Postings as they are written: a term's blocks side by side, a folder's terms in some files."""
    place = F.pmod(F.shiftright(F.xxhash64("term"), 6), F.lit(SLICES))
    rows = packed.select("*", _bucket(F.col("term")).alias("bucket"))
    return rows.repartition("bucket", place).sortWithinPartitions("bucket", "term", "block")


def _bytes(column: pa.Array) -> np.ndarray:
    """The values of a binary column, one after another."""
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def _ints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(_bytes(column).tobytes(), "<i4")


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _ids(rows: pa.RecordBatch) -> pa.Array:
    sizes = _ints(rows.column("sizes"))
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(_starts(sizes).astype(np.int32)), pa.py_buffer(_bytes(rows.column("ids")).tobytes()))


def _packed(terms: pa.Array, block: np.ndarray, ids: pa.Array, tf: np.ndarray, length: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings in order as rows of one term and block each, which begin at ``starts``; handed on some thousand at a time."""
    if not len(starts):
        return
    bounds, sizes = np.append(starts, len(tf)), pc.binary_length(ids).to_numpy()
    binary = lambda ends, data: pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    ints = lambda values: binary(bounds * 4, values.astype("<i4").tobytes())
    out = {
        "term": terms, "block": pa.array(block.astype(np.int32)), "n": pa.array(np.diff(bounds).astype(np.int32)), "ids": binary(_starts(sizes)[bounds], _bytes(ids.cast(pa.binary())).tobytes()),
        "sizes": ints(sizes), "tfs": ints(tf), "lens": ints(length), "most": pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)), "shortest": pa.array(np.minimum.reduceat(length, starts).astype(np.int32)),
    }
    rows = pa.RecordBatch.from_pydict(out)
    for at in range(0, rows.num_rows, 10_000):
        yield rows.slice(at, 10_000)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows as a row for each document, some hundred thousand at a time."""
    for batch in batches:
        ends = np.cumsum(batch.column("n").to_numpy())
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK // 10, "right")) - at)
            rows, at = batch.slice(at, n), at + n
            each = pa.array(np.repeat(np.arange(n), rows.column("n").to_numpy()))
            told = {c: rows.column(c).take(each) for c in ("term", "block", "segment")}
            yield pa.RecordBatch.from_pydict(told | {"id": _ids(rows), "tf": pa.array(_ints(rows.column("tfs"))), "len": pa.array(_ints(rows.column("lens")))})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, block, len, w): the words of documents as postings, ``CHUNK`` words at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")) - at)
            docs, at = batch.slice(at, n), at + n
            w = docs.column("w")
            words = pc.list_flatten(w).dictionary_encode()
            order = pc.sort_indices(pa.table({"block": docs.column("block"), "id": docs.column("id")}), [("block", "ascending"), ("id", "ascending")])
            rank = np.empty(n, np.int64)
            rank[order.to_numpy()] = np.arange(n)
            key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n + rank[pc.list_parent_indices(w).to_numpy()], return_counts=True)
            word, doc = key // n, key % n
            block = docs.column("block").take(order).to_numpy()[doc]
            starts = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])][: len(key)])
            lens = pc.fill_null(docs.column("len"), 0).take(order).to_numpy()[doc]
            yield from _packed(words.dictionary.take(pa.array(word[starts])), block[starts], docs.column("id").take(order).take(pa.array(doc)), tf, lens, starts)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of all segments, by block and term, as one row a term and block, without the (ids, segment) that rows without a term
    name. The last row is kept back until the next ``CHUNK``, unless it is one by itself; of what was replaced, one block's is held."""
    held, gone, size = [], [], 0
    for batch in batches:
        named = batch.column("term").is_valid()
        held.append(batch.filter(named))
        gone.append(batch.filter(pc.invert(named)).select(["block", "segment", "ids"]))
        size += pc.sum(held[-1].column("n")).as_py() or 0
        if size >= CHUNK:
            held = [(yield from _joined(pa.concat_batches(held), pa.concat_batches(gone), False))]
            size = pc.sum(held[0].column("n")).as_py() or 0
            last = batch.column("block")[0] if not held[0].num_rows else held[0].column("block")[0]
            gone = [g.filter(pc.greater_equal(g.column("block"), last)) for g in gone]
    if held:
        yield from _joined(pa.concat_batches(held), pa.concat_batches(gone), True)


def _joined(rows: pa.RecordBatch, gone: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
    rest = rows.slice(rows.num_rows)
    if not rows.num_rows:
        return rest
    word, block = rows.column("term").dictionary_encode(), rows.column("block").to_numpy()
    code = word.indices.to_numpy()
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
    if not last and len(first) > 1:
        rows, rest, first = rows.slice(0, first[-1]), rows.slice(first[-1]), first[:-1]
    row = np.repeat(np.arange(rows.num_rows), rows.column("n").to_numpy())
    ids, stays = _ids(rows), np.ones(len(row), bool)
    if gone.num_rows:
        maybe = np.flatnonzero(pc.is_in(ids, value_set=gone.column("ids").cast(pa.string())).to_numpy(zero_copy_only=False))
        pair = lambda i, s: pc.binary_join_element_wise(i, s.cast(pa.string()), "\0")
        of = pair(ids.take(pa.array(maybe)), rows.column("segment").take(pa.array(row[maybe])))
        stays[maybe] = ~pc.is_in(of, value_set=pair(gone.column("ids").cast(pa.string()), gone.column("segment"))).to_numpy(zero_copy_only=False)
    left = np.flatnonzero(stays)
    group = np.searchsorted(first, row[left], "right") - 1
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(left)])
    of = first[group[starts]]
    yield from _packed(word.dictionary.take(pa.array(code[of])), block[of], ids.take(pa.array(left)), _ints(rows.column("tfs"))[left], _ints(rows.column("lens"))[left], starts)
    return rest
