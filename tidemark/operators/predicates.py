"""A small total predicate language, lowered to nullable columns.

``or`` binds least, then ``and``, ``not``, comparisons (``<= >= == != < >``, ``between a and b``), sums,
products, signs. True, false and unknown are SQL's true, false and null. A name that is not bound, values of unlike kinds and
failed arithmetic are unknown. Parsing happens once on the driver.

Numbers are decimals of 28 digits, rounded half to even, whether a predicate runs over a column (``lower``) or each row has its own
(``judged``). A column works in Spark's decimals where its digits before and after the point are known and every step
provably needs no rounding, a quotient being compared by multiplying across; every other comparison is decided by the row evaluator,
in Arrow batches. So both give the same verdicts for all values. A text that nests deeper than ``MAX_DEPTH`` is not a predicate.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_LEX = re.compile(r'\s*(?:(?P<num>\d[\d_]*(?:\.\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|==|!=|[<>+\-*/()]))')
#: Words of the language, and what follows a backslash in a string.
KEYWORDS = frozenset("and or not between true false".split())
ESCAPES = {"n": "\n", "t": "\t"}
#: Digits that arithmetic keeps.
DIGITS = 28
#: Levels of brackets, and of operators within operators.
MAX_DEPTH = 200
_ROUNDED, _FULL = Context(prec=DIGITS), Context(prec=10**6)


class PredicateError(ValueError):
    """The text is not a predicate."""


@dataclass(frozen=True)
class Lit:
    value: Decimal | bool | str


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, open_ = [], 0, 0
    while m := _LEX.match(text, at):
        at, kind = m.end(), m.lastgroup
        word = m[kind]
        if kind == "op" and word in "()":
            open_ += 1 if word == "(" else -1
            if open_ > MAX_DEPTH:
                raise PredicateError("nested too deeply")
        if kind == "name" and word.lower() in KEYWORDS:
            kind, word = "key", word.lower()
        out.append((kind, word))
    rest = text[at:].strip()
    if rest:
        raise PredicateError("equality is written ==" if rest.startswith("=") else f"cannot read {rest[:80]!r}")
    return out


def unquoted(word: str) -> str:
    """What a quoted string says."""
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S)


#: How tightly each operator binds.
_TIGHT = {"or": 1, "and": 2, "not": 3, "between": 4, "<=": 4, ">=": 4, "==": 4, "!=": 4, "<": 4, ">": 4, "+": 5, "-": 5, "*": 6, "/": 6}


class _Parser:
    """Operators by how tightly they bind; ``floor`` is the loosest that the caller's place allows."""

    def __init__(self, words: list[tuple[str, str]]):
        self.t, self.i, self.depth = words, 0, 0

    def next_word(self) -> str | None:
        return self.t[self.i][1] if self.i < len(self.t) and self.t[self.i][0] in ("op", "key") else None

    def need(self, word: str) -> None:
        if self.next_word() != word:
            raise PredicateError(f"{word} expected")
        self.i += 1

    def read(self, floor: int = 1):
        left, compared = self.operand(floor), False
        while (op := self.next_word()) != "not" and _TIGHT.get(op, 0) >= floor:
            level = _TIGHT[op]
            if level == 4 and compared:
                raise PredicateError("comparisons do not chain")
            compared = level == 4
            self.i += 1
            right = self.read(level + 1)
            if op == "between":
                self.need("and")
                left = Op("and", (Op(">=", (left, right)), Op("<=", (left, self.read(level + 1)))))
            else:
                left = Op(op, (left, right))
        return left

    def operand(self, floor: int):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise PredicateError("nested too deeply")
        word = self.next_word()
        if word == "not" and floor <= 3:
            self.i += 1
            out = Op("not", (self.read(3),))
        elif word in ("+", "-"):
            self.i += 1
            x = self.operand(7)
            if word == "-":
                x = Lit(-x.value) if isinstance(x, Lit) and isinstance(x.value, Decimal) else Op("-", (Lit(Decimal(0)), x))
            out = x
        elif word == "(":
            self.i += 1
            out = self.read()
            self.need(")")
        else:
            out = self.leaf()
        self.depth -= 1
        return out

    def leaf(self):
        if self.i >= len(self.t):
            raise PredicateError("the predicate ends too early")
        kind, word = self.t[self.i]
        self.i += 1
        if kind == "num":
            return Lit(Decimal(word.replace("_", "")))
        if kind == "str":
            return Lit(unquoted(word))
        if kind == "name":
            return Name(word)
        if word in ("true", "false"):
            return Lit(word == "true")
        raise PredicateError(f"{word} is out of place")


def _deep(x) -> bool:
    """Whether operators stand in operators beyond ``MAX_DEPTH``; told without recursion."""
    level = [x]
    for _ in range(MAX_DEPTH):
        level = [a for y in level if isinstance(y, Op) for a in y.args]
        if not level:
            return False
    return True


_COMPARE = ("<=", ">=", "==", "!=", "<", ">")


def _formula(x) -> bool:
    if isinstance(x, Op) and x.op in ("and", "or", "not"):
        return all(map(_formula, x.args))
    return isinstance(x, Op) and x.op in _COMPARE and not any(isinstance(a, Op) and a.op in (*_COMPARE, "and", "or", "not") for a in x.args)


def parse(text: str):
    return parse_words(tokens(text))


def parse_words(words: list[tuple[str, str]]):
    p = _Parser(words)
    node = p.read()
    if _deep(node):
        raise PredicateError("nested too deeply")
    if p.i != len(p.t) or not _formula(node):
        raise PredicateError("a predicate compares something and ends there")
    return node


def parses(text: str) -> bool:
    try:
        parse(text)
    except PredicateError:
        return False
    return True


def names(x) -> set[str]:
    if isinstance(x, Name):
        return {x.name}
    return set().union(*map(names, x.args)) if isinstance(x, Op) else set()


def bind(df: DataFrame, columns: dict[str, str]) -> dict[str, tuple[str, Column, str]]:
    """What ``lower`` takes, for names told by columns of ``df``: kind, column and type."""
    kind = lambda t: {"boolean": "bool", "string": "str"}.get(t, "num")
    types = {c: df.select(c).schema[0].dataType.simpleString() for c in columns.values()}
    return {name: (kind(types[c]), df[c], types[c]) for name, c in columns.items()}


def lower(x, bound: dict[str, tuple]) -> Column:
    """A nullable boolean column. ``bound``: name to (kind, column) or (kind, column, type); kinds are num, bool and str.

    Arithmetic stays in the plan where the types of all its columns are given and are whole numbers or decimals narrow enough.
    """
    if x.op == "not":
        return ~lower(x.args[0], bound)
    if x.op in ("and", "or"):
        a, b = (lower(part, bound) for part in x.args)
        return a & b if x.op == "and" else a | b
    kinds = [_kind_in(part, bound) for part in x.args]
    if kinds[0] is None or kinds[0] != kinds[1] or (kinds[0] != "num" and x.op not in ("==", "!=")):
        return F.lit(None).cast("boolean")
    if kinds[0] != "num":
        return _RELATIONS[x.op](*(_plain(part, bound) for part in x.args))
    return _compared(x, bound)


def _kind_in(x, bound) -> str | None:
    if isinstance(x, Lit):
        return _kind(x.value)
    if isinstance(x, Name):
        return bound[x.name][0] if x.name in bound else None
    return "num" if all(_kind_in(a, bound) == "num" for a in x.args) else None


def _plain(x, bound) -> Column:
    return bound[x.name][1] if isinstance(x, Name) else F.lit(x.value)


@dataclass(frozen=True)
class _Exact:
    """A number that a decimal column holds without rounding: of so many digits before and after the point, at most."""

    column: Column
    whole: int
    places: int

    def joined(self, op: str, other: _Exact) -> _Exact | None:
        whole, places = (self.whole + other.whole, self.places + other.places) if op == "*" else (max(self.whole, other.whole) + 1, max(self.places, other.places))
        return _Exact(_ARITHMETIC[op](self.column, other.column), whole, places) if whole + places <= DIGITS else None


_ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul}
#: Digits of the whole types.
_WHOLE = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def _as_exact(x, bound) -> _Exact | None:
    """``x`` in Spark's decimals; None where its types are not known to allow that."""
    if isinstance(x, Op):
        sides = [_as_exact(a, bound) for a in x.args]
        return sides[0].joined(x.op, sides[1]) if x.op in _ARITHMETIC and all(sides) else None
    if isinstance(x, Lit):
        _, digits, exponent = x.value.as_tuple()
        places, whole = max(0, -exponent), max(1, len(digits) + exponent)
        column = F.lit(x.value) if whole + places <= DIGITS else None
    else:
        _, column, told = (*bound[x.name], "")[:3]
        sized = re.fullmatch(r"decimal\((\d+),(\d+)\)", told)
        places = int(sized[2]) if sized else 0
        whole = int(sized[1]) - places if sized else _WHOLE.get(told, DIGITS + 1)
    return _Exact(column.cast(f"decimal({whole + places},{places})"), whole, places) if column is not None and whole + places <= DIGITS else None


def _quotient(x, bound) -> tuple[_Exact | None, _Exact | None]:
    if isinstance(x, Op) and x.op == "/":
        return _as_exact(x.args[0], bound), _as_exact(x.args[1], bound)
    return _as_exact(x, bound), _as_exact(Lit(Decimal(1)), bound)


def _compared(x: Op, bound) -> Column:
    divided = any(isinstance(a, Op) and a.op == "/" for a in x.args)
    (n, d), (m, e) = (_quotient(a, bound) for a in x.args)
    if all((n, d, m, e)):
        left, right = (n.joined("*", e), m.joined("*", d)) if divided else (n, m)
        # two digits short of the rounding, which then cannot make a quotient equal to what it is not
        if left and right and (not divided or max(left.whole, right.whole) + max(left.places, right.places) <= DIGITS - 2):
            holds = _RELATIONS[x.op](left.column, right.column)
            if not divided:
                return holds
            turned = _RELATIONS[_FLIPPED[x.op]](left.column, right.column)
            return F.when((d.column == 0) | (e.column == 0), F.lit(None).cast("boolean")).when((d.column < 0) != (e.column < 0), turned).otherwise(holds)
    if not any(isinstance(a, Op) for a in x.args) and all(_short(a, bound) for a in x.args):
        return _RELATIONS[x.op](*(_finite(a, bound) for a in x.args))
    return _by_rows(x, bound)


def _short(x, bound) -> bool:
    """Whether a comparison with doubles is right: a double is the number it is written as, and literals have digits to spare."""
    return isinstance(x, Name) and not (*bound[x.name], "")[2].startswith("decimal") or isinstance(x, Lit) and len(x.value.as_tuple().digits) <= 15


def _finite(x, bound) -> Column:
    column = _plain(x, bound)
    return F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column) if isinstance(x, Name) and (*bound[x.name], "")[2] in ("double", "float") else column


def _by_rows(x: Op, bound) -> Column:
    """One comparison, decided row by row where Spark's decimals might round or overflow."""
    told = sorted(names(x))
    if not told:
        return F.lit(evaluate(x, {})[0]).cast("boolean")

    @F.arrow_udf("boolean")
    def decided(*columns: pa.Array) -> pa.Array:
        return pa.array([evaluate(x, dict(zip(told, row)))[0] for row in zip(*(c.to_pylist() for c in columns))], pa.bool_())

    return decided(*(bound[name][1] for name in told))


@dataclass(frozen=True)
class Range:
    """What one comparison says of a name: a range of numbers (an open end is None), or a value it is (``exact``) or is not (``excluded``)."""

    name: str
    low: Decimal | None = None
    low_closed: bool = False
    high: Decimal | None = None
    high_closed: bool = False
    kind: str = "range"
    value: str | None = None


_FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}


def _conjuncts(x) -> list:
    todo, out = [x], []
    while todo:
        y = todo.pop()
        if isinstance(y, Op) and y.op == "and":
            todo += reversed(y.args)
        else:
            out.append(y)
    return out


def _constraint(x) -> Range | None:
    """``name op literal``, either way round, as what it says of the name."""
    if not isinstance(x, Op) or x.op not in _FLIPPED:
        return None
    (a, b), op = x.args, x.op
    if isinstance(a, Lit):
        a, b, op = b, a, _FLIPPED[op]
    if not (isinstance(a, Name) and isinstance(b, Lit)):
        return None
    if op == "!=":
        return Range(a.name, kind="excluded", value=render(b))
    if not isinstance(b.value, Decimal):
        return Range(a.name, kind="exact", value=render(b)) if op == "==" else None
    below, above = op in ("<", "<=", "=="), op in (">", ">=", "==")
    return Range(a.name, b.value if above else None, above and "=" in op, b.value if below else None, below and "=" in op)


def ranges(x) -> list[Range]:
    """Constraints of a conjunction of ``name op literal``; nothing at all if any part is something else."""
    said = [_constraint(y) for y in _conjuncts(x)]
    return [] if None in said else said


def incompatible(a: str, b: str) -> Column:
    """Whether two constraints on the same name cannot hold together: ranges apart, two exact values, or one value both said and ruled out."""
    kind = lambda r, k: F.col(f"{r}.kind") == k
    same = F.col(f"{a}.value") == F.col(f"{b}.value")
    ruled_out = ((kind(a, "exact") & kind(b, "excluded")) | (kind(a, "excluded") & kind(b, "exact"))) & same
    return F.coalesce((kind(a, "range") & kind(b, "range") & disjoint(a, b)) | (kind(a, "exact") & kind(b, "exact") & ~same) | ruled_out, F.lit(False))


def witness(r: Range, inside: bool) -> Decimal | None:
    """A number inside (or outside) of a range with one end, or of a point; None where the constraint has no numbers."""
    end, closed, up = (r.low, r.low_closed, 1) if r.low is not None else (r.high, r.high_closed, -1)
    if r.kind != "range" or end is None:
        return None
    if inside:
        return end if closed else _FULL.add(end, up)
    return _FULL.subtract(end, up) if closed else end


def disjoint(a: str, b: str) -> Column:
    """Whether two range structs on the same name share no number."""
    low = F.greatest(F.col(f"{a}.low"), F.col(f"{b}.low"))
    high = F.least(F.col(f"{a}.high"), F.col(f"{b}.high"))
    ends = lambda end, v: F.coalesce((F.col(f"{a}.{end}") != v) | F.col(f"{a}.{end}_closed"), F.lit(True)) & F.coalesce((F.col(f"{b}.{end}") != v) | F.col(f"{b}.{end}_closed"), F.lit(True))
    return F.coalesce((low > high) | ((low == high) & ~(ends("low", low) & ends("high", high))), F.lit(False))


def _level(x) -> int:
    return _TIGHT[x.op] if isinstance(x, Op) else 7


def _written(v: Decimal) -> str:
    """A decimal in full, without needless zeros."""
    return format(v.normalize(_FULL) if v else Decimal(0), "f")


def render(x) -> str:
    """The shortest text with that meaning: brackets only where a part binds looser than its place needs."""
    if isinstance(x, Name):
        return x.name
    if isinstance(x, Lit):
        v = x.value
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return '"' + re.sub(r'(["\\])', r"\\\1", v).replace("\n", "\\n").replace("\t", "\\t") + '"'
        return _written(v)
    here = _level(x)
    parts = [f"({text})" if _level(a) < here + k else text for k, a in enumerate(x.args) for text in [render(a)]]
    return f"not {parts[0]}" if x.op == "not" else f" {x.op} ".join(parts)


def shape(x) -> list[str]:
    """Sorted constraints of a conjunction; two predicates of one shape say the same."""
    end = lambda v, closed: "" if v is None else f"{_written(v)}{'=' if closed else ''}"
    said = lambda r: f"{end(r.low, r.low_closed)}:{end(r.high, r.high_closed)}" if r.kind == "range" else f"{r.kind}:{r.value}"
    return sorted(f"{r.name}:{said(r)}" for r in ranges(x))


def subject(x) -> str | None:
    """The one name that a conjunction of constraints is about, if it is about one."""
    about = {r.name for r in ranges(x)}
    return about.pop() if len(about) == 1 else None


def order_key(v: Decimal) -> str:
    """A text that sorts as the number does, whatever its size: sign, place of the first digit, digits; all turned round below zero."""
    if not v:
        return "5"
    sign, digits, exponent = v.normalize(_FULL).as_tuple()
    text = f"{len(digits) + exponent + 5_000_000:07d}" + "".join(map(str, digits))
    return "4" + "".join(str(9 - int(c)) for c in text) + ":" if sign else "6" + text


_TOLD = (
    "parses boolean, rendered string, names array<string>, subject string, shape array<string>, "
    "ranges array<struct<name:string,low:string,low_closed:boolean,high:string,high_closed:boolean,kind:string,value:string,inside:string,outside:string>>"
)


def _row(r: Range) -> dict:
    key = lambda v: None if v is None else order_key(v)
    said = {side: _written(v) for side, v in (("inside", witness(r, True)), ("outside", witness(r, False))) if v is not None}
    return {**vars(r), "low": key(r.low), "high": key(r.high), "inside": None, "outside": None, **said}


def _told(text: str | None) -> tuple:
    try:
        x = parse(text or "")
    except PredicateError:
        return False, None, [], None, [], []
    return True, render(x), sorted(names(x)), subject(x), shape(x), [_row(r) for r in ranges(x)]


def described(df: DataFrame, column: str) -> DataFrame:
    """``df`` with what its predicates say: parses, rendered, names, subject, shape, ranges. Each distinct text of a batch is parsed once, where its row is: texts are neither shuffled nor broadcast.

    The ends of ranges are ``order_key`` texts, which compare as their numbers do; ``inside`` and ``outside`` are numbers in and out of a range.
    """
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(_TOLD).fields])
    where = df.columns.index(column)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        told = pa.struct([types.field(k) for k in range(len(df_columns), len(types))])
        for b in parts:
            texts = pc.dictionary_encode(b.column(where))
            said = pa.array([dict(zip(told.names, _told(t))) for t in texts.dictionary.to_pylist()], told).take(texts.indices)
            said = [pc.struct_field(said, [k]) for k in range(told.num_fields)]
            said[0] = pc.fill_null(said[0], False)
            yield pa.RecordBatch.from_arrays([*(c.cast(t.type) for c, t in zip(b.columns, types)), *said], schema=types)

    df_columns = df.columns
    return df.mapInArrow(batches, schema)


def unbound(names_: Column, facts: Column) -> Column:
    """Names that a map of facts does not hold."""
    return F.array_except(names_, F.map_keys(facts))


def conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, name): the first conflicting pair of constraints, in order of the left, then the right predicate.

    Both sides have id and ranges; only constraints on the same name meet.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        each = df.select(F.col("id").alias(f"{p}_id"), F.posexplode("ranges").alias(f"{p}_pos", f"r{p}")).withColumn("name", F.col(f"r{p}.name"))
        return each.withColumn(f"{p}_one", F.count("*").over(Window.partitionBy(f"{p}_id")) == 1)

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, "name").where((F.col("a_id") != F.col("b_id")) & incompatible("ra", "rb"))

    a, b = side(a, "a"), side(b, "b")
    # two predicates of one constraint each meet once, so only the others' pairs have to be gathered
    once = met(a.where("a_one"), b.where("b_one")).select("a_id", "b_id", "name")
    more = met(a.where("not a_one"), b).unionByName(met(a.where("a_one"), b.where("not b_one")))
    return once.unionByName(more.groupBy("a_id", "b_id").agg(F.min_by("name", F.struct("a_pos", "b_pos")).alias("name")))


def _kind(v) -> str | None:
    return None if v is None else "bool" if isinstance(v, bool) else "str" if isinstance(v, str) else "num"


def _number(v):
    """A number as the decimal it is written as; nothing if it is not finite."""
    if v is None or isinstance(v, bool | str):
        return v
    v = v if isinstance(v, Decimal) else Decimal(str(v))
    return v if v.is_finite() else None


def _value(x, world: dict) -> tuple[object, str | None]:
    if isinstance(x, Lit):
        return x.value, None
    if isinstance(x, Name):
        v = _number(world.get(x.name))
        return v, f"{x.name} is not bound" if v is None else None
    (a, why), (b, also) = (_value(arg, world) for arg in x.args)
    if a is None or b is None:
        return None, why or also
    if _kind(a) != "num" or _kind(b) != "num":
        return None, f"{x.op} takes numbers"
    try:
        return {"+": _ROUNDED.add, "-": _ROUNDED.subtract, "*": _ROUNDED.multiply, "/": _ROUNDED.divide}[x.op](a, b), None
    except ArithmeticError:
        return None, f"{render(x)} has no value"


def evaluate(x, world: dict) -> tuple[bool | None, str | None]:
    """(verdict, reason) in a world of decimals, booleans and strings: the same three values as ``lower`` gives; of two unknown sides the left one's reason stands."""
    if x.op in ("and", "or"):
        (a, why), (b, also) = (evaluate(arg, world) for arg in x.args)
        settles = x.op == "or"
        if a is settles or b is settles:
            return settles, None
        return (None, why or also) if a is None or b is None else (not settles, None)
    if x.op == "not":
        v, why = evaluate(x.args[0], world)
        return (None if v is None else not v), why
    (a, why), (b, also) = (_value(arg, world) for arg in x.args)
    if a is None or b is None:
        return None, why or also
    if _kind(a) != _kind(b):
        return None, "values of unlike kinds"
    if _kind(a) != "num" and x.op not in ("==", "!="):
        return None, f"{x.op} takes numbers"
    return _RELATIONS[x.op](a, b), None


_RELATIONS = {"<=": operator.le, ">=": operator.ge, "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt}


def judged(df: DataFrame, column: str, bound: dict[str, str] | None = None, world: dict | None = None) -> DataFrame:
    """``df`` (with a unique ``id``) plus ``verdict`` and ``reason`` of each row's own predicate.

    ``world`` holds facts common to all rows, one file's worth; ``bound`` maps further names, told by a
    column, to number columns. A text that does not parse is unknown. Rows are judged where they are and handed on whole, so nothing is joined.
    """
    bound, world = bound or {}, world or {}
    rows = df.where("id is not null").select("id", *(c for c in df.columns if c != "id"))
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("verdict boolean, reason string").fields])
    used, width = [rows.columns.index(c) for c in (column, *bound, *bound.values())], len(rows.columns)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        types = to_arrow_schema(schema)
        for b in parts:
            verdicts, reasons = [], []
            for text, *rest in zip(*(b.column(k).to_pylist() for k in used)):
                if text not in trees:
                    if len(trees) > 10_000:
                        trees.clear()
                    trees[text] = parse(text) if text and parses(text) else None
                n = len(rest) // 2
                here = world | {k: v for k, v in zip(rest[:n], rest[n:]) if k is not None and v is not None}
                verdict, reason = evaluate(trees[text], here) if trees[text] is not None else (None, "not a predicate")
                verdicts.append(verdict), reasons.append(reason)
            kept = [c.cast(t.type) for c, t in zip(b.columns, types)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(verdicts, types.field(width).type), pa.array(reasons, types.field(width + 1).type)], schema=types)

    return rows.mapInArrow(batches, schema)
