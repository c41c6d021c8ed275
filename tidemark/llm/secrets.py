"""Secret scans with one deterministic automaton for all rules.

Rules are written in a small regex dialect (literals, classes, groups, ``|``, ``?``, ``*``, ``+``,
``{m,}``, ``{m,n}``), turned into one nondeterministic automaton, determinised by subset construction,
minimised by partition refinement and stored as a flat transition array over bytes. A document is
read once, byte by byte, for all rules together; that pass tells where the matches of each rule end. From an
end, the rule read backwards (a small automaton of the same kind) goes back over the match to its leftmost
start. Matches of a rule never overlap, and a match that ``keep`` refuses still takes its place, as if each rule
were searched for by itself, leftmost and longest first. Rules match ASCII, so bytes of other characters only
end matches.

A rule must be such that a match, once it is complete, grows byte by byte (it ends in a run of one class, or has one
length); else its ends would not tell its matches apart.

Defined cases: a null or empty text has no spans; whole texts are read, whatever their length; spans
count code points, end exclusive; rows may repeat; other input columns are ignored; an input column named
``spans`` gives way to the spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    """``pattern`` gives the match; ``keep`` says if it counts."""

    kind: str
    pattern: str
    fold: bool = False
    keep: Callable[[bytes], bool] | None = None


def _assigned(match: bytes) -> bool:
    """The value after the first : or = (and blanks, a quote) has 12 characters at least."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[at + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value) >= 12


#: The base rules, then rules for well-known public token formats. The first three come first in ties.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, _assigned),
    Rule("access", r"AKIA[A-Z0-9]+", keep=lambda m: len(m) >= 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", keep=lambda m: len(m) >= 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", keep=lambda m: len(m) >= 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", keep=lambda m: len(m) >= 39),
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
)
BASE = ("assign", "access", "hex")


class _Nfa:
    """Thompson construction; ``edges[s]`` lists (byte set as int mask, target), ``free[s]`` empty moves."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def turned(self) -> _Nfa:
        """The automaton of the patterns read backwards."""
        out = _Nfa()
        for _ in self.edges:
            out.state()
        for s, moves in enumerate(self.edges):
            for mask, t in moves:
                out.edges[t].append((mask, s))
        for s, moves in enumerate(self.free):
            for t in moves:
                out.free[t].append(s)
        return out

    def add(self, pattern: str, fold: bool) -> tuple[int, int]:
        self.p, self.at, self.fold = pattern, 0, fold
        out = self._either()
        if self.at != len(pattern):
            raise ValueError(f"cannot read {pattern!r} at {self.at}")
        return out

    def _either(self) -> tuple[int, int]:
        parts = [self._run()]
        while self.at < len(self.p) and self.p[self.at] == "|":
            self.at += 1
            parts.append(self._run())
        if len(parts) == 1:
            return parts[0]
        a, b = self.state(), self.state()
        for x, y in parts:
            self.free[a].append(x)
            self.free[y].append(b)
        return a, b

    def _run(self) -> tuple[int, int]:
        a = b = self.state()
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            start = self.at
            x, y = self._atom()
            end = self.at
            low, high = self._times()
            after = self.at

            def again() -> tuple[int, int]:
                self.at = start
                got = self._atom()
                assert self.at == end
                return got

            copies = [(x, y)] + [again() for _ in range(max(low, high or low, 1) - 1)]
            self.at = after
            for k, (x, y) in enumerate(copies):
                self.free[b].append(x)
                if k >= low:
                    self.free[b].append(y)
                if high is None and k == len(copies) - 1:
                    self.free[y].append(x)
                b = y
        return a, b

    def _times(self) -> tuple[int, int | None]:
        c = self.p[self.at : self.at + 1]
        if c and c in "?*+":
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            end = self.p.index("}", self.at)
            low, comma, high = self.p[self.at + 1 : end].partition(",")
            self.at = end + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def _byte(self) -> int:
        c = self.p[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.p[self.at - 2 : self.at], 16)
        return ord(c)

    def _mask(self, byte: int) -> int:
        twin = byte ^ 32 if self.fold and chr(byte).isalpha() else byte
        return 1 << byte | 1 << twin

    def _atom(self) -> tuple[int, int]:
        c = self.p[self.at]
        if c == "(":
            self.at += 1
            out = self._either()
            self.at += 1
            return out
        if c == "[":
            self.at += 1
            mask = 0
            while self.p[self.at] != "]":
                low = high = self._byte()
                if self.p[self.at] == "-" and self.p[self.at + 1] != "]":
                    self.at += 1
                    high = self._byte()
                for byte in range(low, high + 1):
                    mask |= self._mask(byte)
            self.at += 1
        else:
            mask = self._mask(self._byte())
        a, b = self.state(), self.state()
        self.edges[a].append((mask, b))
        return a, b


class Automaton:
    """Minimal deterministic automaton of ``(pattern, fold)`` alternatives, read backwards if ``backward``.

    ``table[state * 256 + byte]`` is the next state times 256. Dead is state 0 when ``anywhere`` is
    false; else every position may start a match. States from ``hits`` on (times 256) accept, and
    ``tags`` says which alternatives.
    """

    def __init__(self, patterns: list[tuple[str, bool]], anywhere: bool, backward: bool = False):
        nfa, starts, ends = _Nfa(), [], {}
        for k, (pattern, fold) in enumerate(patterns):
            a, b = nfa.add(pattern, fold)
            if backward:
                a, b = b, a
            starts.append(a)
            ends[b] = k
        if backward:
            nfa = nfa.turned()

        def closed(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        start = closed(starts)
        sets = [frozenset()] if not anywhere else []
        number = {s: i for i, s in enumerate(sets)}
        number.setdefault(start, len(sets))
        if len(sets) == number[start]:
            sets.append(start)
        moves: list[list[int]] = []
        classes = self._classes(nfa)
        one = {c: byte for byte, c in enumerate(classes)}
        at = 0
        while at < len(sets):
            row = []
            for c in range(len(one)):
                to = closed({t for s in sets[at] for mask, t in nfa.edges[s] if mask >> one[c] & 1} | (set(starts) if anywhere else set()))
                if to not in number:
                    number[to] = len(sets)
                    sets.append(to)
                row.append(number[to])
            moves.append(row)
            at += 1
        tags = [frozenset(ends[x] for x in s if x in ends) for s in sets]
        self._minimise(moves, tags, number[start], classes)

    @staticmethod
    def _classes(nfa: _Nfa) -> list[int]:
        """Bytes that no edge tells apart share a class."""
        masks = sorted({mask for e in nfa.edges for mask, _ in e})
        seen: dict[tuple, int] = {}
        return [seen.setdefault(tuple(m >> byte & 1 for m in masks), len(seen)) for byte in range(256)]

    def _minimise(self, moves: list[list[int]], tags: list[frozenset], start: int, classes: list[int]) -> None:
        groups: dict = {}
        part = [groups.setdefault(t, len(groups)) for t in tags]
        while True:
            keys: dict = {}
            new = [keys.setdefault((part[s], tuple(part[t] for t in moves[s])), len(keys)) for s in range(len(moves))]
            if len(keys) == len(set(part)):
                break
            part = new
        first = {}
        for s, p in enumerate(part):
            first.setdefault(p, s)
        order = sorted(first, key=lambda p: (bool(tags[first[p]]), first[p]))
        place = {p: i for i, p in enumerate(order)}
        self.table = [place[part[moves[first[p]][c]]] * 256 for p in order for c in classes]
        self.tags = {i * 256: tags[first[p]] for i, p in enumerate(order) if tags[first[p]]}
        self.hits = min(self.tags, default=len(order) * 256)
        self.start = place[part[start]] * 256
        self.states = len(order)
        self.dead = {place[p] * 256 for p in order if not tags[first[p]] and all(part[t] == p for t in moves[first[p]])}


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton([(r.pattern, r.fold) for r in rules], anywhere=True)
        self.back = [Automaton([(r.pattern, r.fold)], anywhere=False, backward=True) for r in rules]

    def ends(self, data: bytes) -> dict[int, list[int]]:
        """One pass over the bytes for all rules: by rule, the last byte (exclusive) of each stretch in which it matches."""
        table, hits, tags, state = self.all.table, self.all.hits, self.all.tags, self.all.start
        found: dict[int, list[int]] = {}
        for at, byte in enumerate(data, 1):
            state = table[state + byte]
            if state >= hits:
                for k in tags[state]:
                    own = found.setdefault(k, [])
                    if own and own[-1] == at - 1:
                        own[-1] = at
                    else:
                        own.append(at)
        return found

    def _start(self, k: int, data: bytes, end: int, low: int) -> int:
        """The leftmost start, from ``low`` on, of a match of the rule that ends at ``end``; -1 if there is none."""
        a, best = self.back[k], -1
        table, hits, dead, state = a.table, a.hits, a.dead, a.start
        for at in range(end - 1, low - 1, -1):
            state = table[state + data[at]]
            if state in dead:
                break
            if state >= hits:
                best = at
        return best

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then rule order."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found = []
        for k, ends in self.ends(data).items():
            low, keep = 0, self.rules[k].keep
            for end in ends:
                start = self._start(k, data, end, low)
                if start >= 0:
                    low = end
                    if keep is None or keep(data[start:end]):
                        found.append((start, k, end))
        found.sort()
        if found and len(data) != len(text):
            place, at, count = {}, 0, 0
            for p in sorted({p for a, _, b in found for p in (a, b)}):
                count += len(data[at:p].decode("utf-8", "surrogatepass"))
                place[p] = count
                at = p
            found = [(place[a], k, place[b]) for a, k, b in found]
        return [(self.rules[k].kind, a, b) for a, k, b in found]


@lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


SPANS = "array<struct<kind: string, start: int, end: int>>"


def scan_documents(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``spans``: every secret of the whole text."""
    from pyspark.sql import types as T

    keep = tuple(c for c in keep if c.lower() != "spans")
    out_schema = T.StructType(df.select(*keep).schema.fields + [T.StructField("spans", T._parse_datatype_string(SPANS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        scan, out = scanner().spans, to_arrow_schema(out_schema)
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py())] for t in batch.column(0)]
            cols = [batch.column(i + 1).cast(out.field(i).type) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, out.field(len(keep)).type)], schema=out)

    return df.select(df[text_col].alias("_text"), *keep).mapInArrow(run, out_schema)


def redact_documents(df: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``df`` with each secret of ``text_col`` replaced by ``mask``; spans that overlap are masked once."""
    schema = df.schema
    where = df.columns.index(text_col)

    def masked(text: str | None) -> str | None:
        spans = scanner().spans(text)
        if not spans:
            return text
        parts, at = [], 0
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if a >= at:
                parts += [text[at:a], mask]
            at = max(at, b)
        return "".join(parts) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            cols = [c.cast(f.type) for c, f in zip(batch.columns, out)]
            cols[where] = pa.array([masked(t.as_py()) for t in batch.column(where)], out.field(where).type)
            yield pa.RecordBatch.from_arrays(cols, schema=out)

    return df.mapInArrow(run, schema)
