"""Merkle manifest of a table, with a proof for every row.

Every row is a leaf: the SHA-256 of its fields, each written as its length in bytes and its value. The leaves of a group
(here, a language) ascend by id; runs of eight nodes hash to their parent until one node, the group's subroot, is left, and
the subroots, in order of their groups, hash to the root in the same way. A proof of a row is, level by level, what stands
left and right of its node in the run.

Method: Merkle traversal scheduling. Leaves are numbered by a range partition on (group, id) and cut into aligned blocks of
``ARITY ** HEIGHT``, so that a subtree never crosses a block. Within a block, a treehash stack for each level
builds the next run of siblings, one leaf a step, while the present run serves its leaves: when the traversal reaches the next
run its nodes are ready, and a block needs a number of nodes that grows with the logarithm of its leaves. Block roots
are the leaves of the next layer, in the same way, up to the subroots and the root; each block then gets the path of its root as
one row and appends it to the paths of its leaves. Leaves are digests when they are shuffled, texts never are; no task holds
more than a block, and the driver holds counts only.

Defined cases: a null field is ``-``; null groups and null ids come first; rows of one id stand in order of their leaves, so
equal rows have equal leaves in neighbouring places; an empty table gives no rows; other columns of the table are ignored, and
are not covered by the hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, finish, materialize, small

ARITY = 8
#: Levels of an aligned block, which so holds 512 leaves: proofs of one block are a megabyte or two.
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<before:string,after:string>>"


def record_hash(*fields: Column) -> Column:
    """SHA-256 over the fields, each as byte count, colon and value, or ``-`` where null."""
    said = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a proof in one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def hash_run(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


class Treehash:
    """Nodes of one level from the leaves of ``lo`` to ``hi``, taken one at a time; below them, each level holds one unfinished run."""

    def __init__(self, leaves, level: int, lo: int, hi: int):
        self.leaves, self.level, self.at, self.hi = leaves, level, lo, min(hi, len(leaves))
        self.stack: list[list[bytes]] = [[] for _ in range(level + 1)]

    def step(self) -> None:
        """Take the next leaf; hash every run that it ends. The last leaf ends all."""
        if self.at >= self.hi:
            return
        stack, last = self.stack, self.at + 1 == self.hi
        stack[0].append(self.leaves[self.at])
        self.at += 1
        for k in range(self.level):
            if stack[k] and (last or len(stack[k]) == ARITY):
                stack[k + 1].append(hash_run(stack[k]))
                stack[k] = []
            elif not last:
                break

    def nodes(self) -> list[bytes]:
        while self.at < self.hi:
            self.step()
        return self.stack[self.level]


def subtree_root(leaves, height: int) -> bytes:
    """The node that stands ``height`` levels above the leaves of one block."""
    return Treehash(leaves, height, 0, len(leaves)).nodes()[0]


def traverse(leaves, height: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf of a block in turn, what stands before and after its node at each level below ``height``."""
    spans = [ARITY ** (k + 1) for k in range(height)]
    now = [Treehash(leaves, k, 0, spans[k]).nodes() for k in range(height)]
    ahead = [Treehash(leaves, k, spans[k], 2 * spans[k]) for k in range(height)]
    path: list[tuple[bytes, bytes]] = [(b"", b"")] * height
    for i in range(len(leaves)):
        for k in range(height):
            below = ARITY**k
            if i % below:
                break
            if i and i % spans[k] == 0:
                now[k], ahead[k] = ahead[k].nodes(), Treehash(leaves, k, i + spans[k], i + 2 * spans[k])
            place = i // below % ARITY
            path[k] = b"".join(now[k][:place]), b"".join(now[k][place + 1 :])
        yield path
        for hash_ahead in ahead:
            hash_ahead.step()


def levels(n: int, height: int) -> int:
    """Levels of a block in a group of ``n`` nodes: all of them if there are other blocks, else as many as leave one node."""
    needed = 0
    while needed < height and ARITY**needed < n:
        needed += 1
    return needed


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Nodes of (named, grp, ...) with ``pos``, their number in the group, and ``n``, the group's size: a running number in a range partition.

    Rows equal in all of ``order`` are dealt by chance, so that no partition grows with them. The counts have a row
    for each partition and group that meet.
    """
    dealt = nodes.withColumn("_deal", F.rand(11)).repartitionByRange("named", "grp", *order, "_deal")
    ran = materialize(dealt.sortWithinPartitions("named", "grp", *order).drop("_deal").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    held = ran.groupBy("named", "grp", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_held"))
    each = Window.partitionBy("named", "grp")
    starts = materialize(
        held.select(
            "named", "grp", "_part", "_first", F.sum("_held").over(each).alias("n"),
            (F.sum("_held").over(each.orderBy("_part")) - F.col("_held")).alias("_before"),
        )
    )
    placed = ran.withColumn("_part", part).join(small(starts), ["named", "grp", "_part"])
    placed = placed.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    return finish(placed.drop("_at", "_first", "_before", "_part"), ran, starts)


_KEY = ["named", "grp", "block"]
_NODE = ["named", "grp", "pos", "n", "digest"]


def _in_blocks(nodes: DataFrame, height: int, *more: str) -> DataFrame:
    return nodes.select(*_NODE, F.expr(f"pos div {ARITY**height}").alias("block"), *more)


def _digests(rows: pa.Table) -> list[bytes]:
    return rows["digest"].cast(pa.binary()).to_pylist()


def _block_root(height: int):
    def root_of(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n = rows["n"][0].as_py()
        root = subtree_root(_digests(rows), levels(n, height))
        return pa.table({**{k: rows[k].slice(0, 1) for k in _KEY}, "n": pa.array([-(-n // ARITY**height)], pa.int64()), "digest": pa.array([root.decode()])})

    return root_of


def layers_above(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes`` and, until every group has one node, the block roots of the layer below, each layer a table of its own."""
    layers, largest = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        roots = _in_blocks(layers[-1], height).groupBy(*_KEY).applyInArrow(_block_root(height), "named boolean, grp string, block bigint, n bigint, digest string")
        layers.append(materialize(roots.withColumnRenamed("block", "pos")))
        largest = -(-largest // ARITY**height)
    return layers


def _path_array(paths: list[list[tuple[bytes, bytes]]]) -> pa.Array:
    ends = [0]
    for p in paths:
        ends.append(ends[-1] + len(p))
    sides = [pa.array([step[k] for p in paths for step in p], pa.binary()).cast(pa.string()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, ["before", "after"]))


def _block_proofs(names: list[str], above: list[str], height: int):
    def proofs(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        told = upper.to_pylist()[0]
        shared = [(step["before"].encode(), step["after"].encode()) for step in told["path"]]
        paths = [[*path, *shared] for path in traverse(_digests(rows), levels(rows["n"][0].as_py(), height))]
        same = {k: pa.array([told[k]] * rows.num_rows, pa.string()) for k in above}
        return pa.table({**{k: rows[k] for k in names}, **same, "path": _path_array(paths)})

    return proofs


def descend(layers: list[DataFrame], top: DataFrame, above: list[str], keep: list[str], height: int) -> DataFrame:
    """The lowest layer's nodes with their paths, and the texts ``above`` of their group; ``top`` has both for the one node of each group.

    From the top down, the path of a block's root is the upper part of the paths of all in the block.
    """
    upper = top.select("named", "grp", F.lit(0).cast("bigint").alias("pos"), *above, "path")
    for k, nodes in reversed(list(enumerate(layers[:-1]))):
        names = ["named", "grp", "pos", "digest", *(keep if k == 0 else [])]
        shape = ", ".join([f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in names] + [f"`{c}` string" for c in above] + [f"path {_PATH}"])
        both = _in_blocks(nodes, height, *names[4:]).groupBy(*_KEY).cogroup(upper.select("named", "grp", F.col("pos").alias("block"), *above, "path").groupBy(*_KEY))
        upper = both.applyInArrow(_block_proofs(names, above, height), shape)
    return upper if len(layers) > 1 else layers[0].join(upper.drop("pos"), ["named", "grp"])


def prove(
    docs: DataFrame, told: dict[str, Column] | None = None, keep: dict[str, Column] | None = None,
    fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", height: int = HEIGHT,
) -> DataFrame:
    """For each row its ``order`` value, ``leaf``, ``subroot``, ``root`` and ``path``, its proof: ``fold(leaf, path)`` is the root while nothing is changed.

    ``keep`` names columns to make from a row before it is hashed. ``told`` replaces the path by columns made from all of these,
    where whole proofs (some kilobytes a row) are not wanted as a table.
    """
    keep = keep or {}
    nodes = docs.select(
        F.col(group).isNotNull().alias("named"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"),
        F.col(order).alias("_order"), record_hash(*(F.col(c) for c in fields)).alias("digest"), *(c.alias(f"_keep_{k}") for k, c in keep.items()),
    )
    hashed = materialize(nodes)
    leaves = numbered(hashed, ["_order", "digest"])
    trees = layers_above(leaves, height)
    subroots = trees[-1].select(F.lit(True).alias("named"), F.lit("").alias("grp"), F.col("named").alias("_named"), F.col("grp").alias("_grp"), "digest")
    roots = numbered(subroots, ["_named", "_grp"])
    crown = layers_above(roots, height)
    peak = crown[-1].select("named", "grp", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    tops = descend(crown, peak, ["root"], ["_named", "_grp"], height)
    tops = materialize(tops.select(F.col("_named").alias("named"), F.col("_grp").alias("grp"), F.col("digest").alias("subroot"), "root", "path"))
    proven = descend(trees, tops, ["subroot", "root"], ["_order", *(f"_keep_{k}" for k in keep)], height)
    proven = proven.withColumnRenamed("digest", "leaf").withColumnsRenamed({f"_keep_{k}": k for k in keep})
    out = proven.select(F.col("_order").alias(order), "leaf", "subroot", "root", *([c.alias(k) for k, c in told.items()] if told else [*keep, "path"]))
    return finish(out, hashed, *trees, *crown, tops)
