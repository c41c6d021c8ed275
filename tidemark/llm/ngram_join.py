"""N-gram Jaccard join with a count-vector R-tree.

Documents are sets of five-word shingles. Two facts cut the corpus down without losing
a link: a document's partner shares at least three quarters of its shingles, so a document with fewer
shingles that occur in a second text has no partner; and two partners share a shingle among the
quarter (plus one) that comes first in a fixed order, rarest first. Texts that share such a shingle, and are of one
class of size or of adjacent ones, fall into one candidate group (partners differ in size by a third at most, which
is the width of a class).

Inside a group, shingles are hashed into groups of tokens and each text becomes the point of its group
counts. The points go into an R-tree. Two subtrees are compared only if the sum over coordinates of
the smaller upper corner reaches the overlap that their smallest sizes need; pairs of points that pass
the same bound are verified on the shingles themselves. Pairs already known to be connected are not
looked at again, and only a spanning forest leaves a task, never all pairs.

A large group is cut by size class, hash and weight into pieces. First each piece is joined in itself, then one text of
every part found so far with its like. What then hangs together with the most texts of the group, as nearly all
of a group of copies does, need not meet itself again: only the other texts meet each other and the rest, piece by piece.
So no task holds more than two pieces, and a group of copies costs a few times its size, not the square.

Exact copies (equal shingle sets) count once throughout. A shingle is told from others by 40 bits of a 64-bit hash
and the number of its partition, a set by a sum of 64-bit hashes; the words are not compared again.

Defined cases: a null, empty or blank text has no shingles and links with nothing; under five words
the whole sequence is one shingle; words split at ASCII white space, only A-Z fold; rows with equal
ids stay apart but share a node; a null id never names a group; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, discard, finish, materialize, small

WORDS = 5
PERCENT = 75
#: Texts and shingles in a piece of a candidate group.
PIECE, WEIGHT = 512, 1 << 21
LEAF = 32
DIMS = 128
#: Input that one part of the hash space may stand for; its shingles take a few times as much.
PART_BYTES = 32 << 20
_CHUNK = 4 << 20
_FLUSH = 1 << 19
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NEAR = np.array([pow(0xD1B54A32D192ED03, k, 1 << 64) for k in range(4096)], dtype=np.uint64)
_FAR = np.uint64(pow(0xD1B54A32D192ED03, 4096, 1 << 64))
_PLACE = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 40) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    inside = np.flatnonzero(~((b == 32) | ((b >= 9) & (b <= 13))))
    if not len(inside):
        return np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate(([True], inside[1:] != inside[:-1] + 1)))
    size = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, size)
    power = _NEAR[place & 4095]
    if size.max() > 4096:
        far = np.array([pow(int(_FAR), k, 1 << 64) for k in range((int(size.max()) >> 12) + 1)], dtype=np.uint64)
        power = power * far[place >> 12]
    return _mix(np.add.reduceat(_BYTE[b[inside]] * power, first))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    data = text.encode("utf-8", "surrogatepass").lower()
    if len(data) <= _CHUNK:
        w = _words(data)
    else:
        parts, at, blank = [], 0, re.compile(rb"[\t-\r ]")
        while at < len(data):
            cut = blank.search(data, at + _CHUNK)
            end = cut.end() if cut else len(data)
            parts.append(_words(data[at:end]))
            at = end
        w = np.concatenate(parts)
    n = len(w)
    if n == 0:
        return w
    if n < WORDS:
        return _mix((w * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
    h = w[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        h = h + w[k : n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(_mix(h))


def _pack(fps: np.ndarray, counts: np.ndarray, tokens: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    """Fingerprints, counts (2 bytes each where they fit), and 40 bits a token (and a byte of ``extra``)."""
    wide = int(counts.max(initial=0) > 65535)
    parts = [np.uint32(len(fps) << 1 | wide).tobytes(), fps.tobytes(), counts.astype(np.uint32 if wide else np.uint16).tobytes()]
    parts += [(tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (tokens >> np.uint64(32)).astype(np.uint8).tobytes()]
    return b"".join(parts + ([extra.astype(np.uint8).tobytes()] if extra is not None else []))


def _unpack(blob: bytes, extra: bool = False) -> tuple[np.ndarray, ...]:
    head = int(np.frombuffer(blob, np.uint32, 1)[0])
    d, kind = head >> 1, np.uint32 if head & 1 else np.uint16
    fps, counts = np.frombuffer(blob, np.int64, d, 4), np.frombuffer(blob, kind, d, 4 + 8 * d).astype(np.int64)
    at, t = 4 + (8 + np.dtype(kind).itemsize) * d, int(counts.sum())
    tokens = np.frombuffer(blob, np.uint32, t, at).astype(np.uint64)
    tokens |= np.frombuffer(blob, np.uint8, t, at + 4 * t).astype(np.uint64) << np.uint64(32)
    return (fps, counts, tokens, np.frombuffer(blob, np.uint8, t, at + 5 * t)) if extra else (fps, counts, tokens)


def _runs(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts), dtype=np.int32), counts)


_DEALT = "part int, doc_id bigint, fp bigint, n bigint, blob binary"


def _deal(parts: int):
    """Rows of documents, and their shingles packed by part of the hash space; one copy of each set a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
        seen: set[int] = set()
        docs: list[int] = []
        sets: list[np.ndarray] = []
        held = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs, sets, held
            if sets:
                tokens = np.concatenate(sets)
                names = np.array(docs, np.int64)
                part = ((tokens >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
                owner = _runs(np.array([len(s) for s in sets]))
                place = part * len(docs) + owner
                order = np.argsort(place, kind="stable")
                tokens, place = tokens[order] & _LOW, place[order]
                heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                counts = np.diff(np.append(heads, len(place)))
                where, who = np.divmod(place[heads], len(docs))
                firsts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
                blobs = []
                for x, y in zip(firsts, np.append(firsts[1:], len(where))):
                    own = counts[x:y]
                    blobs.append(_pack(names[who[x:y]], own, tokens[heads[x] : heads[x] + own.sum()]))
                where = where[firsts]
                empty = pa.nulls(len(where), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), empty, empty, empty, pa.array(blobs, pa.binary())], schema=schema)
            docs, sets, held = [], [], 0

        for batch in batches:
            fps, ns = [], []
            for text in batch.column(1):
                s = shingles(text.as_py())
                fp = int(_mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0
                fps.append(fp)
                ns.append(len(s))
                if len(s) and fp not in seen:
                    seen.add(fp)
                    docs.append(fp)
                    sets.append(s)
                    held += len(s)
                    if held >= _FLUSH:
                        yield from flush()
            where = pa.array((np.arange(rows, rows + len(fps)) % parts).astype(np.int32))
            rows += len(fps)
            yield pa.RecordBatch.from_arrays(
                [where, batch.column(0).cast(pa.int64()), pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.nulls(len(fps), pa.binary())], schema=schema
            )
        yield from flush()

    return run


def _find_shared(parts: int):
    """In one part of the hash space: the shingles that occur in two texts or more, packed by text."""

    def run(table: pa.Table) -> pa.Table:
        docs = table.filter(pa.compute.is_null(table["blob"]))
        got = [_unpack(b.as_py()) for b in table["blob"] if b.is_valid]
        out_part, out_blob = [], []
        if got:
            fps, counts, tokens = (np.concatenate([g[k] for g in got]) for k in range(3))
            first = np.zeros(len(fps), dtype=bool)
            first[np.unique(fps, return_index=True)[1]] = True
            owner, keep = _runs(counts), np.repeat(first, counts)
            owner, tokens = owner[keep], tokens[keep]
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            heads = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            times = np.diff(np.append(heads, len(tokens)))
            times = np.repeat(times, times).astype(np.int32)
            shared = times > 1
            owner, tokens, times = owner[shared], tokens[shared], times[shared]
            bucket = ((fps >> 7) % parts)[owner]
            order = np.lexsort((owner, bucket))
            owner, tokens, bucket = owner[order], tokens[order], bucket[order]
            level = np.minimum(255, np.floor(8 * np.log2(times[order]))).astype(np.uint8)
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
            for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                own, counts = np.unique(owner[a:b], return_counts=True)
                out_part.append(int(bucket[a]))
                out_blob.append(_pack(fps[own], counts, tokens[a:b], level[a:b]))
        part = table["part"][0].as_py() if len(table) else 0
        found = pa.table({
            "part": pa.array(out_part, pa.int32()), "doc_id": pa.array([part] * len(out_part), pa.int64()),
            "fp": pa.nulls(len(out_part), pa.int64()), "n": pa.nulls(len(out_part), pa.int64()), "blob": pa.array(out_blob, pa.binary()),
        })
        return pa.concat_tables([docs.select(found.column_names).cast(found.schema), found])

    return run


def _assemble(table: pa.Table) -> pa.Table:
    """Texts with enough shared shingles: these in order, rarest first, and how many of them lead."""
    got = [(p.as_py(), _unpack(b.as_py(), True)) for p, b in zip(table["doc_id"], table["blob"]) if b.is_valid]
    known = table.filter(pa.compute.is_null(table["blob"]))
    if not got:
        got = [(0, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)))]
    fps, counts = (np.concatenate([g[k] for _, g in got]) for k in (0, 1))
    tokens = np.concatenate([g[2] | np.uint64(p << 40) for p, g in got])
    level = np.concatenate([g[3] for _, g in got])
    names, inverse = np.unique(fps, return_inverse=True)
    size = dict(zip(known["fp"].to_pylist(), known["n"].to_pylist()))
    n = np.array([size[f] for f in names.tolist()], np.int64)
    shared = np.bincount(inverse, weights=counts, minlength=len(names)).astype(np.int64)
    owner = np.repeat(inverse, counts)
    enough = 100 * shared >= PERCENT * n
    keep = enough[owner]
    owner, tokens, level = owner[keep], tokens[keep], level[keep]
    order = np.lexsort((tokens, level, owner))
    tokens = tokens[order]
    kept = np.flatnonzero(enough)
    ends = np.cumsum(shared[kept])
    lead = n - (PERCENT * n + 99) // 100 + 1 - (n - shared)
    return pa.table({
        "fp": pa.array(names[kept], pa.int64()), "n": pa.array(n[kept], pa.int64()), "lead": pa.array(lead[kept], pa.int64()),
        "tokens": pa.array([tokens[e - c : e].tobytes() for e, c in zip(ends, shared[kept])], pa.binary()),
    })


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [np.frombuffer(t.as_py(), np.int64)[: k.as_py()] for k, t in zip(batch.column(2), batch.column(3))]
        size = [len(h) for h in heads]
        fps, ns = (pa.array(np.repeat(batch.column(k).to_numpy(), size), pa.int64()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads) if heads else [], pa.int64()), fps, ns], names=["token", "fp", "n"])


class RTree:
    """Bulk-loaded by halving along the widest coordinate; a node is (lower, upper, children or members).

    Coordinate 0 is the size of the set, the others are counts of its tokens by group.
    """

    def __init__(self, points: np.ndarray, members: np.ndarray):
        self.points = points
        self.root = self._build(members)

    def _build(self, members: np.ndarray) -> tuple:
        p = self.points[members]
        low, high = p.min(0), p.max(0)
        if len(members) <= LEAF:
            return low, high, None, members
        wide = int((high - low).argmax())
        order = members[np.argsort(p[:, wide], kind="stable")]
        half = len(order) // 2
        return low, high, (self._build(order[:half]), self._build(order[half:])), members

    @staticmethod
    def may_link(a: tuple, b: tuple) -> bool:
        """No pair below can link if the sizes are too far apart or the corners' minima sum to too little."""
        (la, ha), (lb, hb) = a[:2], b[:2]
        if 100 * ha[0] < PERCENT * lb[0] or 100 * hb[0] < PERCENT * la[0]:
            return False
        return (100 + PERCENT) * int(np.minimum(ha[1:], hb[1:]).sum()) >= PERCENT * (la[0] + lb[0])


def link_group(n: np.ndarray, tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, known: np.ndarray) -> np.ndarray:
    """The root (an index) of each text, by links inside ``left`` (``right`` None) or between both; texts with equal ``known`` are linked already."""
    local = np.unique(np.concatenate(tokens), return_inverse=True)[1]
    cuts = np.cumsum([len(t) for t in tokens])[:-1]
    own = np.split(local, cuts)
    points = np.zeros((len(n), DIMS + 1), dtype=np.int64)
    points[:, 0] = n
    np.add.at(points, (_runs(np.array([len(t) for t in tokens])), 1 + (_mix(np.concatenate(tokens).astype(np.uint64)) % np.uint64(DIMS)).astype(np.int64)), 1)
    root = np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    marks = np.zeros((LEAF, int(local.max(initial=0)) + 1), dtype=np.uint8)

    def leaves(a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = np.array([find(i) for i in a]), np.array([find(j) for j in b])
        apart = ra[:, None] != rb[None, :]
        if not apart.any():
            return
        need = PERCENT * (n[a][:, None] + n[b][None, :])
        bound = np.minimum(points[a][:, None, 1:], points[b][None, :, 1:]).sum(2)
        likely = apart & ((100 + PERCENT) * bound >= need)
        if not likely.any():
            return
        rows = np.flatnonzero(likely.any(1))
        for r in rows:
            marks[r, own[a[r]]] = 1
        for c in np.flatnonzero(likely.any(0)):
            j = b[c]
            overlap = marks[: len(a), own[j]].sum(1, dtype=np.int64)
            for r in np.flatnonzero(likely[:, c] & ((100 + PERCENT) * overlap >= need[:, c])):
                x, y = find(a[r]), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
        for r in rows:
            marks[r, own[a[r]]] = 0

    def join(a: tuple, b: tuple) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if not RTree.may_link(a, b):
                continue
            if a[2] is None and b[2] is None:
                leaves(a[3], b[3])
            elif a is b:
                todo += [(a[2][0], a[2][1]), (a[2][0], a[2][0]), (a[2][1], a[2][1])]
            elif b[2] is None or (a[2] is not None and len(a[3]) >= len(b[3])):
                todo += [(x, b) for x in a[2]]
            else:
                todo += [(a, x) for x in b[2]]

    first = RTree(points, left).root
    join(first, first if right is None else RTree(points, right).root)
    return np.array([find(i) for i in range(len(n))])


def _link(table: pa.Table) -> pa.Table:
    """Links of one task: inside of its only piece (``inside``), or between the pieces of its two sides."""
    fps, side = table["fp"].to_numpy(), table["side"].to_numpy()
    tokens = [np.frombuffer(t.as_py(), np.int64) for t in table["tokens"]]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    inside = table["inside"][0].as_py()
    if not inside and not (len(left) and len(right)):
        return pa.table({"fp": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    root = link_group(table["n"].to_numpy(), tokens, left, None if inside else right, table["known"].to_numpy())
    moved = root != np.arange(len(root))
    return pa.table({"fp": pa.array(fps[moved], pa.int64()), "root": pa.array(fps[root[moved]], pa.int64())})


_LINKS = "fp bigint, root bigint"


def _size_class(n: str):
    """Partners are in one class or in adjacent ones."""
    return F.floor(F.log(F.col(n)) / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int")


def _cuts(rows: DataFrame, piece: int, weight: int, *by: str) -> DataFrame:
    """Into how many pieces the rows of each group are cut, by number and by shingles."""
    return rows.groupBy(*by).agg(
        F.greatest(F.ceil(F.count("*") / F.lit(piece)), F.ceil(F.sum("n") / F.lit(weight))).cast("int").alias("k")
    )


def _alone(rows: DataFrame, piece: int, weight: int, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tasks (grp, c, h) with their rows: each piece, to be joined inside. ``held`` makes tables and keeps account of them."""
    cut = small(held(_cuts(rows, piece, weight, "grp", "c").where("k > 1").select("grp", "c", "k")))
    h = F.pmod(F.xxhash64("fp"), F.coalesce("k", F.lit(1))).cast("int")
    return rows.join(cut, ["grp", "c"], "left").select("grp", "c", h.alias("h"), "fp", F.col("fp").alias("known"), F.lit(0).alias("side"), F.lit(True).alias("inside"))


def _apart(members: DataFrame, piece: int, weight: int, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tasks (grp, c, d, i, j, kind) with their rows: each two pieces that may hold a link not known yet.

    ``members`` has (grp, fp, n, c, known, other); ``other`` says that a row does not hang together with the most of its group.
    Rows of kind 0 are pieces of others with each other, of kind 1 pieces of others (side 0) with pieces of the rest.
    """
    cuts = held(_cuts(members, piece, weight, "grp", "c", "other"))
    own = {o: cuts.where(F.col("other") == o).select("grp", "c", "k") for o in (True, False)}
    beside = lambda o, by, name: small(own[o].select("grp", (F.col("c") - by).alias("c"), F.col("k").alias(name)))
    left = members.where("other").join(small(own[True]), ["grp", "c"])
    for o, by, name in ((True, 1, "up"), (True, -1, "down"), (False, -1, "r0"), (False, 0, "r1"), (False, 1, "r2")):
        left = left.join(beside(o, by, name), ["grp", "c"], "left")
    right = members.where("not other").join(small(own[False]), ["grp", "c"])
    for by, name in ((-1, "o0"), (0, "o1"), (1, "o2")):
        right = right.join(beside(True, by, name), ["grp", "c"], "left")
    h = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    task = lambda c, d, i, j, side, kind: f"named_struct('c', {c}, 'd', {d}, 'i', {i}, 'j', {j}, 'side', {side}, 'kind', {kind}, 'inside', {c} = {d} and {i} = {j} and {kind} = 0)"
    each = lambda k, made: f"if({k} is null, array(), transform(sequence(0, {k} - 1), x -> {made}))"
    from_left = [
        each("k", task("c", "c", "least(h, x)", "greatest(h, x)", "if(x < h, 1, 0)", 0)), each("up", task("c", "c + 1", "h", "x", 0, 0)), each("down", task("c - 1", "c", "x", "h", 1, 0)),
        *(each(f"r{n}", task("c", f"c + {n - 1}", "h", "x", 0, 1)) for n in range(3)),
    ]
    from_right = [each(f"o{n}", task(f"c + {n - 1}", "c", "x", "h", 1, 1)) for n in range(3)]
    parts = [
        rows.withColumn("h", h).select("grp", "fp", "known", F.expr(f"inline(concat({', '.join(made)}))")) for rows, made in ((left, from_left), (right, from_right))
    ]
    return parts[0].unionByName(parts[1])


def _parts(df: DataFrame) -> int:
    """Parts of the hash space: as many as shuffles have partitions, more where that makes a part of over ``PART_BYTES`` of input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 22, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES if size < 1 << 60 else 0))


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, weight: int = WEIGHT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    parts, tables = _parts(df), []

    def held_table(rows: DataFrame) -> DataFrame:
        tables.append(materialize(rows))
        return tables[-1]

    def joined(edges: DataFrame, a: str, b: str) -> DataFrame:
        tables.append(connected_components(edges, a, b))
        return tables[-1]

    dealt = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(_deal(parts), _DEALT)
    found = materialize(dealt.groupBy("part").applyInArrow(_find_shared(parts), _DEALT))
    docs = held_table(found.where(F.col("blob").isNull()).select("doc_id", "fp", "n"))
    known = docs.where("n > 0").groupBy("fp").agg(F.first("n").alias("n")).select(
        F.pmod(F.shiftright("fp", 7), F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("long").alias("doc_id"), "fp", "n",
        F.lit(None).cast("binary").alias("blob"),
    )
    texts = held_table(
        found.where(F.col("blob").isNotNull()).unionByName(known).groupBy("part").applyInArrow(_assemble, "fp bigint, n bigint, lead bigint, tokens binary")
    )
    discard(found)

    postings = texts.select("fp", "n", "lead", "tokens").mapInArrow(_postings, "token bigint, fp bigint, n bigint").withColumn("c", _size_class("n"))
    leads = postings.groupBy("token", "c").agg(F.min("fp").alias("lead"), F.max("fp").alias("last"))
    next_up = leads.select("token", (F.col("c") - 1).alias("c"), F.col("lead").alias("up"))
    same = postings.join(leads.where("lead < last").select("token", "c", "lead"), ["token", "c"]).where("fp <> lead").select("fp", "lead")
    across = leads.join(next_up, ["token", "c"]).where("lead <> up").select(F.col("lead").alias("fp"), F.col("up").alias("lead"))
    near = joined(same.unionByName(across), "fp", "lead").select(F.col("node").alias("fp"), F.col("component").alias("grp"))

    sized = held_table(near.join(texts.select("fp", "n"), "fp"))
    big = held_table(_cuts(sized, piece, weight, "grp").where("k > 1").select("grp", F.lit(True).alias("big")))
    members = sized.join(small(big), "grp", "left").select("grp", "fp", "n", F.when(F.col("big"), _size_class("n")).otherwise(-1).alias("c"))
    link = lambda rows, *task: rows.join(texts.select("fp", "n", "tokens"), "fp").groupBy(*task).applyInArrow(_link, _LINKS)
    first = held_table(link(_alone(members, piece, weight, held_table), "grp", "c", "h"))
    links = first
    if not big.isEmpty():
        large = held_table(members.where("c >= 0"))
        parted = large.join(first.select("fp", "root"), "fp", "left").where("root is null").drop("root")
        second = held_table(link(small(held_table(_alone(parted, piece, weight, held_table))), "grp", "c", "h"))
        so_far = joined(first.join(large.select("fp"), "fp", "left_semi").unionByName(second), "fp", "root")
        held = held_table(large.join(so_far.select(F.col("node").alias("fp"), "component"), "fp", "left").select("grp", "fp", "n", "c", F.coalesce("component", "fp").alias("known")))
        most = held.groupBy("grp", "known").agg(F.count("*").alias("size")).groupBy("grp").agg(F.max_by("known", F.struct("size", "known")).alias("main"))
        told = held_table(held.join(small(held_table(most)), "grp").select("grp", "fp", "n", "c", "known", (F.col("known") != F.col("main")).alias("other")))
        unsettled = held_table(told.where("other").select("grp").distinct())
        tasks = held_table(_apart(told.join(small(unsettled), "grp", "left_semi"), piece, weight, held_table))
        links = held_table(first.unionByName(second).unionByName(link(small(tasks), "grp", "kind", "c", "d", "i", "j")))
    linked = joined(links, "fp", "root")

    classes = docs.where("n > 0").groupBy("fp", "n").agg(F.min("doc_id").alias("class_id"))
    joined = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "n", "class_id", "component")
    lowest = joined.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("class_id").alias("lowest"))
    named = joined.join(lowest, "component", "left").select("fp", "n", F.coalesce("lowest", "class_id").alias("class_id"))
    out = docs.join(named, ["fp", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("component_id")
    )
    return finish(out, *tables)
