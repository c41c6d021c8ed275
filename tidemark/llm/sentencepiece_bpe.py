"""SentencePiece encoding and decoding for merge-type vocabularies.

Pieces and scores are read from the model file; the merging is our own: an agenda (heap) of adjacent
symbol pairs, best score first, then leftmost. A boundary that no piece spans splits a text into
segments that merge independently, so each worker keeps the ids of segments it has met, and beside them
what those ids decode to: a text's decoding is put together from the decodings of its ids, never from the
text. What is kept is bounded in characters, and long segments are not kept. Documents travel in
Arrow batches. Defined cases: a null or empty text has no ids and decodes to an empty text; a
character without a piece falls back to its UTF-8 bytes (or the unknown id, if the model has no byte
pieces); rows may repeat; other input columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: What a worker remembers in each of two generations, in characters (with ``ENTRY`` for each segment); the older one
#: goes when the newer is full. Segments longer than ``LONG`` are coded anew each time.
REMEMBERED, ENTRY, LONG = 64_000_000, 250, 200
#: Rows of an output batch.
ROWS = 512


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class MergeModel:
    """A merge-type model: ``encode(text) -> ids`` and ``decode(ids) -> text``."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, model_file: str):
        import struct

        with open(model_file, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        trainer: dict = {}
        normal: dict = {}
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, self.NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                if kind == self.NORMAL:
                    self.rank[piece] = -score
                    self.ids[piece] = len(self.pieces)
                self.pieces.append(piece)
                self.kinds.append(kind)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3) != 2:
            raise ValueError("not a merge-type (BPE) model")
        if normal.get(2) or {self.USER, self.UNUSED} & set(self.kinds):
            raise ValueError("models with a character map, user-defined or unused pieces are not handled")
        if normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("models that trim spaces, keep plain spaces or treat them as suffixes are not handled")
        self.prefix = SPACE if normal.get(3, 1) else ""
        self.unknown = self.kinds.index(self.UNKNOWN)
        self.unknown_text = trainer[44].decode() if 44 in trainer else " ⁇ "
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == self.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self._segments = re.compile(self._safe_splits()).findall
        self._known: dict[str, tuple[str, str]] = {}
        self._older: dict[str, tuple[str, str]] = {}
        self._held = 0
        self._build_pairs()

    def _safe_splits(self) -> str:
        """A pattern whose matches split a text only where no piece reaches across.

        A split between two characters is safe if no piece holds them side by side: before a run of
        spaces, around line ends, and between a Latin letter and marks that no piece puts after one.
        """
        beside = {(p[k - 1], p[k]) for p in self.rank for k in range(1, len(p))}
        if any(b == SPACE != a for a, b in beside) or any("\n" in pair for pair in beside):
            return r"(?s).+"
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        latin = re.compile(f"[{letters}]")
        marks = "".join(re.escape(q) for q in ".,!?%&#*$;:\"" if not any(b == q and latin.match(a) for a, b in beside))
        other = f"[^{letters}{SPACE}\n]*+"
        more = f"(?:[{letters}]++(?:[^{letters}{marks}{SPACE}\n]{other})?+)"
        return f"{SPACE}++{other}{more}*+|[^{letters}{SPACE}\n]++{more}*+|{more}++|\n"

    def _build_pairs(self) -> None:
        """Numbers for symbols (pieces, then characters that only occur inside pieces) and the mergeable pairs.

        ``pairs[left << 20 | right]`` is ``order << 20 | merged``: order ranks pieces by score, best first.
        """
        symbols = list(self.rank) + sorted({c for p in self.rank for c in p} - set(self.rank))
        self.symbol = {p: i for i, p in enumerate(symbols)}
        scores = {r: i for i, r in enumerate(sorted(set(self.rank.values())))}
        self.output = [self._own_ids(p) for p in symbols]
        self.pairs = {}
        for piece, r in self.rank.items():
            merged = scores[r] << 20 | self.symbol[piece]
            for k in range(1, len(piece)):
                left, right = self.symbol.get(piece[:k]), self.symbol.get(piece[k:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = merged

    def _own_ids(self, symbol: str) -> tuple[int, ...]:
        if symbol in self.ids:
            return (self.ids[symbol],)
        return tuple(self.bytes[b] for b in symbol.encode()) if self.bytes else (self.unknown,)

    def _ids(self, segment: str) -> tuple[int, ...]:
        """Ids of the symbols left when no adjacent pair of the segment makes a piece."""
        number, pair = self.symbol.get, self.pairs.get
        symbols = [number(c, -1) for c in segment]
        last = len(symbols) - 1
        agenda = []
        for i in range(last):
            m = pair(symbols[i] << 20 | symbols[i + 1])
            if m is not None:
                agenda.append((m >> 20) << 40 | i)
        if agenda:
            push, pop = heapq.heappush, heapq.heappop
            heapq.heapify(agenda)
            before, after = list(range(-1, last)), list(range(1, last + 1)) + [-1]
            while agenda:
                best = pop(agenda)
                i = best & 0xFFFFFFFFFF
                j = after[i]
                if symbols[i] is None or j < 0:
                    continue
                m = pair(symbols[i] << 20 | symbols[j])
                if m is None or m >> 20 != best >> 40:
                    continue
                now = symbols[i] = m & 0xFFFFF
                symbols[j] = None
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    m = pair(now << 20 | symbols[k])
                    if m is not None:
                        push(agenda, (m >> 20) << 40 | i)
                h = before[i]
                if h >= 0:
                    m = pair(symbols[h] << 20 | now)
                    if m is not None:
                        push(agenda, (m >> 20) << 40 | h)
        out: list[int] = []
        for at, s in enumerate(symbols):
            if s is not None:
                out += self.output[s] if s >= 0 else self._own_ids(segment[at])
        return tuple(out)

    def _coded_segment(self, segment: str) -> tuple[str, str]:
        """The segment's ids as decimal text and what they decode to; remembered if the segment is short."""
        entry = self._known.get(segment) or self._older.get(segment)
        if entry is None:
            ids = self._ids(segment)
            entry = ",".join(map(str, ids)), self._text(ids)
        if len(segment) <= LONG:
            if self._held >= REMEMBERED:
                self._older, self._known, self._held = self._known, {}, 0
            self._known[segment] = entry
            self._held += ENTRY + len(segment) + len(entry[0]) + len(entry[1])
        return entry

    def _text(self, ids) -> str:
        """Pieces as text, before the leading space that encoding adds is taken off."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            kind = self.kinds[i]
            if kind == self.UNKNOWN:
                out.append(self.unknown_text)
            elif kind == self.NORMAL:
                out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def coded(self, text: str | None) -> tuple[str, str]:
        """The ids of a text as decimals joined by commas, and the text they decode to."""
        if not text:
            return "", ""
        known, make = self._known.get, self._coded_segment
        coded = [known(s) or make(s) for s in self._segments(self.prefix + text.replace(" ", SPACE))]
        return ",".join([ids for ids, _ in coded]), "".join([said for _, said in coded])[len(self.prefix) :]

    def encode(self, text: str | None) -> list[int]:
        ids = self.coded(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        text = self._text(ids)
        first = next((i for i in ids if self.kinds[i] != self.CONTROL), None)
        strip = self.prefix and first is not None and self.kinds[first] == self.NORMAL and self.pieces[first].startswith(SPACE)
        return text[1:] if strip else text


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that starts no valid character becomes one replacement character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=4)
def load(model_file: str) -> MergeModel:
    return MergeModel(model_file)


def encode_documents(
    df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", columns: str = "ids array<int>, decoded string",
    derive: Callable[[list[int], str, str], tuple] | None = None,
) -> DataFrame:
    """Per row its id, and the ids of its text and their decoded text.

    ``derive(n, ids_text, decoded)`` may put other columns (named in ``columns``) in their place inside
    the same pass, so that long id lists need not leave the worker: n is the number of ids, ids_text
    the decimal ids joined by commas.
    """
    from pyspark.sql import types as T

    key = df.select(id_col).schema[0]
    schema = T.StructType([T.StructField("doc_id", key.dataType)] + T._parse_datatype_string(columns).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        model, out = load(model_file), to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                coded = [model.coded(t.as_py()) for t in batch.column(1)]
                if derive:
                    rows = [derive(ids.count(",") + 1 if ids else 0, ids, text) for ids, text in coded]
                    cols = [pa.array([r[k] for r in rows], out.field(k + 1).type) for k in range(len(out) - 1)]
                else:
                    ids = [np.fromstring(i, dtype=np.int32, sep=",") for i, _ in coded]
                    ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                    cols = [lists.cast(out.field(1).type), pa.array([t for _, t in coded], out.field(2).type)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), *cols], schema=out)

    return df.select(id_col, text_col).mapInArrow(run, schema)
