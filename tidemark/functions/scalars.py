"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reported(x: Column, places: int = 4) -> Column:
    """Half-even rounding, applied once at the end of a computation."""
    return F.bround(x, places)


def flattened(x: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


#: Lower-case letters that case folding turns into others of one letter.
_PLAIN = {chr(c): chr(c).casefold() for c in range(0x80, 0x2000) if chr(c) == chr(c).lower() and len(chr(c).casefold()) == 1 and chr(c).casefold() != chr(c)}


def casefolded(x: Column) -> Column:
    """Lower case for comparing: ß and ss, long and round s, both forms of sigma are the same."""
    out = F.translate(F.lower(x), "".join(_PLAIN), "".join(_PLAIN.values()))
    for c in ("ß", "ŉ", "ǰ", "ΐ", "ΰ", "և"):
        out = F.replace(out, F.lit(c), F.lit(c.casefold()))
    return out


def folded(x: Column) -> Column:
    """White space and letter case aside."""
    return casefolded(flattened(x))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def digest_id(prefix: str, *parts: Column) -> Column:
    """A content-addressed id: prefix and 16 hex digits over the parts."""
    joined = F.concat_ws("\u001f", *(p.cast("string") for p in parts))
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 16))


def sequential_id(prefix: str, n: Column) -> Column:
    return F.format_string(prefix + "-%04d", n)


def work_class(label: Column) -> Column:
    """Kebab-case class of work; what cannot be one is ``unclassified``."""
    kebab = F.regexp_replace(F.lower(F.trim(label)), r"\s+", "-")
    return F.when(kebab.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), kebab).otherwise(F.lit("unclassified"))


def word_keys(text: Column) -> Column:
    """Distinct identifiers of four characters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9_]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4))


def id_prefix(x: Column) -> Column:
    return F.substring_index(x, "-", 1)


def canonical_id(x: Column) -> Column:
    """Whether an id is what rendering its own number gives back."""
    number = F.regexp_extract(x, r"^[A-Z]+-([0-9]{1,18})$", 1)
    return F.when(number == "", False).otherwise(x == F.format_string("%s-%04d", id_prefix(x), number.try_cast("bigint")))
