"""Blocks and spans of documents: where a text can be cut, and which cuts a plan may make."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WINDOW = 40
LONGEST = 12
#: Characters of blocks that a worker holds before it hands them on.
PIECE = 500_000

_START = re.compile(r" {0,3}(?:(?P<code>`{3,}|~{3,})|(?P<heading>#{1,6}\s+\S)|(?P<list_item>(?:[-*+]|\d{1,9}[.)])\s+\S))")
_BLOCK = StructType().add("index", "integer").add("kind", "string").add("start_byte", "integer").add("end_byte", "integer").add("text", "string")


def _line_kind(line: str) -> tuple[str, str]:
    """(kind, fence character) of a line on its own; a blank one has no kind."""
    bare = line.strip()
    if not bare:
        return "", ""
    m = _START.match(line)
    if m and m.lastgroup in ("code", "heading"):
        return m.lastgroup, (m["code"] or "")[:1]
    if bare[0] in "|>":
        return ("table" if bare[0] == "|" else "quote"), ""
    return (m.lastgroup if m else "paragraph"), ""


def scan(text: str) -> list[tuple[int, str, int, int, str]]:
    """(index, kind, start_byte, end_byte, text) in order; every character that is not white space lies in one block.

    Fenced code runs to the next fence of its character, or to the end. Rows of a table and lines of a quote
    stay together; a paragraph or list item takes the plain lines below it. Offsets are in UTF-8 bytes.
    """
    groups: list[list] = []  # kind, first character, end character
    open_kind = fence = ""
    at = 0
    for line in text.split("\n"):
        kind, mark = _line_kind(line)
        end = at + len(line)
        if open_kind == "code":
            groups[-1][2] = end
            open_kind = "" if kind == "code" and mark == fence else "code"
        elif kind and ((kind == open_kind and kind in ("table", "quote")) or (kind == "paragraph" and open_kind in ("paragraph", "list_item"))):
            groups[-1][2] = end
        else:
            open_kind, fence = kind, mark
            if kind:
                groups.append([kind, at, end])
        at = end + 1
    out, seen, byte = [], 0, 0
    for kind, first, last in groups:
        raw = text[first:last]
        body = raw.strip()
        start = first + len(raw) - len(raw.lstrip())
        byte += len(text[seen:start].encode())
        size = len(body.encode())
        out.append((len(out), kind, byte, byte + size, body))
        seen, byte = start + len(body), byte + size
    return out


def grid_batches(batches: Iterator[pa.RecordBatch], piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The blocks of (id, text) rows, about ``piece`` characters of them at a time, however many rows a batch has."""
    types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    for b in batches:
        ids, texts = b.columns
        at, found, size = [], [], 0
        for n in range(b.num_rows):
            new = scan(texts[n].as_py() or "")
            at += [n] * len(new)
            found += new
            size += sum(len(x[4]) for x in new)
            if found and (size >= piece or n == b.num_rows - 1):
                columns = (pa.array(c, k) for c, k in zip(zip(*found), types))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *columns], [b.schema.names[0], *_BLOCK.names])
                at, found, size = [], [], 0


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, index, kind, start_byte, end_byte, text); a null or blank text has no blocks."""
    rows = docs.select(id_col, F.col(text_col).alias("_text"))
    return rows.mapInArrow(grid_batches, StructType([rows.schema[id_col], *_BLOCK]))


def accepted(groups: DataFrame, grid: DataFrame, id_col: str = "doc_id", window: int = WINDOW, longest: int = LONGEST) -> DataFrame:
    """Proposed (id, window, first_block, last_block) with ``reason``: null if honoured.

    A group stays inside the blocks its window offered, runs forwards, covers at most ``longest`` blocks and
    starts after the last one honoured before it. Groups are taken by first, then last block.
    """
    offered = grid.groupBy(id_col, F.floor(F.col("index") / window).cast("integer").alias("window")).agg(F.min("index").alias("lo"), F.max("index").alias("hi"))
    a, b = F.col("first_block"), F.col("last_block")
    outside = F.col("lo").isNull() | ~(a.between(F.col("lo"), F.col("hi")) & b.between(F.col("lo"), F.col("hi")))
    judged = groups.join(offered, [id_col, "window"], "left").withColumn(
        "reason", F.when(outside, "not_offered").when(b < a, "backwards").when(b - a + 1 > longest, "too_long")
    )
    # One window offers at most ``window`` blocks, so its distinct sound groups are bounded whatever was proposed.
    sound = judged.where("reason is null").groupBy(id_col, "window").agg(F.array_sort(F.collect_set(F.struct("first_block", "last_block"))).alias("g"))
    kept = F.aggregate("g", F.slice("g", 1, 0), lambda acc, x: F.when((F.size(acc) == 0) | (x["first_block"] > F.element_at(acc, -1)["last_block"]), F.concat(acc, F.array(x))).otherwise(acc))
    honoured = sound.select(id_col, "window", F.inline(kept)).withColumn("kept", F.lit(True))
    keys = [id_col, "window", "first_block", "last_block"]
    reason = F.coalesce("reason", F.when(F.col("kept").isNull(), "overlaps"))
    return judged.join(honoured, keys, "left").select(*keys, reason.alias("reason"))


def spans(docs: DataFrame, grid: DataFrame, honoured: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_block, last_block, start_byte, end_byte, text): one span a honoured group, one for each block left over."""
    taken = honoured.where("reason is null").select(id_col, "first_block", "last_block").distinct()
    cells = taken.select(id_col, "first_block", "last_block", F.explode(F.sequence("first_block", "last_block")).alias("index"))
    placed = grid.join(cells, [id_col, "index"], "left").withColumns(
        {"first_block": F.coalesce("first_block", "index"), "last_block": F.coalesce("last_block", "index")}
    )
    ranged = placed.groupBy(id_col, "first_block", "last_block").agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"))
    text = F.substring(F.col(text_col).cast("binary"), F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")).cast("string")
    return ranged.join(docs.select(id_col, text_col), id_col).select(id_col, "first_block", "last_block", "start_byte", "end_byte", text.alias("text"))


def elided(text: Column, most: int = 1200) -> Column:
    """Text for display only, cut with a mark."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(" ..."))).otherwise(text)


def where_quoted(offered: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, verdict): ``claims`` (claim_id, group, cited, quote) against spans (group, ordinal, text) offered with them.

    The cited span comes first, then the first other one that holds the quote; an empty quote is nowhere.
    """
    met = claims.join(offered, "group", "left").withColumn("hit", (F.trim("quote") != "") & F.contains("text", "quote"))
    own = F.bool_or(F.col("hit") & (F.col("ordinal") == F.col("cited")))
    return met.groupBy("claim_id").agg(
        F.when(own, "cited").when(F.bool_or("hit"), "other").otherwise("nowhere").alias("verdict"),
        F.when(own, F.max("cited")).otherwise(F.min(F.when(F.col("hit"), F.col("ordinal")))).alias("ordinal"),
    )
