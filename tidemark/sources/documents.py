"""Text sources: Markdown, plain text and JSON files as documents; facts and JSON lines."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tidemark.functions.scalars import content_hash

#: Kinds by file suffix, keys that hold a title, its greatest length, and the name of a document's root.
TITLE_KEYS, TITLE, ROOT = ("title", "subject", "name", "summary"), 120, "value"
KINDS = {".md": "markdown", ".markdown": "markdown", ".txt": "text", ".text": "text", "": "text", ".json": "json"}


def source_kind(path: Column) -> Column:
    """Kind by suffix, null where the suffix is not known."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    out = F.lit(None).cast("string")
    for ending, kind in KINDS.items():
        out = F.when(suffix == ending, kind).otherwise(out)
    return out


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(df: DataFrame, column: str) -> DataFrame:
    """``column`` in NFC; a text whose characters all lie below U+0300 is that already, and no worker gets it."""
    apart = df.withColumn("_other", F.when(F.col(column).rlike(r"[^\x{0}-\x{2FF}]"), F.col(column)))
    return apart.withColumn(column, F.coalesce(nfc("_other"), column)).drop("_other")


def normalised(raw: Column) -> Column:
    """UTF-8 text without a byte order mark, with line feeds, not composed yet; null for other bytes."""
    text = F.when(F.is_valid_utf8(raw), raw.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def json_leaves(value, path: str = "", place: str = "[{}]") -> Iterator[tuple[str, str]]:
    """(path, scalar) in document order, with dots before keys and places of a list written as ``place``; empty containers are leaves."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from json_leaves(v, f"{path}.{k}" if path else k, place)
    elif isinstance(value, list) and value:
        for k, v in enumerate(value):
            yield from json_leaves(v, path + place.format(k), place)
    else:
        yield path, value if isinstance(value, str) else json.dumps(value)


def _rendered(text: str) -> str | None:
    try:
        leaves = [(p or ROOT, v) for p, v in json_leaves(json.loads(text))]
    except ValueError:
        return None
    return "\n\n".join(f"{p}:\n{v}" if "\n" in v else f"{p}: {v}" for p, v in leaves) + "\n"


@F.pandas_udf(StringType())
def rendered_json(texts: pd.Series) -> pd.Series:
    """A block for each leaf, a value of several lines below its path, and a line feed at the end; null for text that is not JSON."""
    return texts.map(_rendered, na_action="ignore")


@F.pandas_udf(StringType())
def compact_json(texts: pd.Series) -> pd.Series:
    """A line for each leaf, places of lists after dots; null for text that is not JSON."""
    def one(t: str) -> str | None:
        try:
            return "\n\n".join(f"{p}: {v}" for p, v in json_leaves(json.loads(t), place=".{}"))
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


@F.pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType())])))
def leaves_of(texts: pd.Series) -> pd.Series:
    """The leaves of a JSON text in order; null for text that is not JSON."""
    def one(t: str) -> list | None:
        try:
            return [{"path": p or ROOT, "value": v} for p, v in json_leaves(json.loads(t))]
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


def title(kind: Column, text: Column) -> Column:
    heading = F.regexp_extract(text, r"(?m)^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$", 1)
    lines = F.split(text, "\n", 3)
    first, second = F.trim(F.get(lines, 0)), F.trim(F.coalesce(F.get(lines, 1), F.lit("")))
    named = F.coalesce(*(F.nullif(F.trim(F.get_json_object(text, f"$.{k}")), F.lit("")) for k in TITLE_KEYS))
    found = F.when(kind == "markdown", heading).when(kind == "json", named).otherwise(F.when(second == "", first))
    return F.when((F.length(found) > 0) & (F.length(found) <= TITLE), found)


#: What Spark's reader of whole files gives, as a stream has to be told beforehand.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def documents_of(files: DataFrame, rendering=compact_json) -> tuple[DataFrame, DataFrame]:
    """(documents, refused) of whole files (path, content), JSON as ``rendering`` puts it; refused ones with the reason."""
    read = files.select(F.col("path").alias("source_uri"), source_kind(F.col("path")).alias("source_kind"), normalised(F.col("content")).alias("raw"))
    read = composed(read, "raw")
    kind, raw = F.col("source_kind"), F.col("raw")
    content = F.when(kind == "json", rendering(F.when(kind == "json", raw))).otherwise(raw)  # other texts go to no worker
    read = read.select("*", title(kind, raw).alias("title"), content.alias("content"))
    reason = (
        F.when(kind.isNull(), "unknown_suffix").when(raw.isNull(), "not_utf8").when(F.col("content").isNull(), "not_json")
        .when(F.trim(F.regexp_replace("content", r"\s+", " ")) == "", "empty")
    )
    judged = read.withColumn("reason", reason)
    good = judged.where("reason is null").select(
        "source_uri", "source_kind", "title", "content", content_hash(F.col("content")).alias("content_hash"), F.octet_length("content").alias("byte_length")
    )
    return good, judged.where("reason is not null").select("source_uri", "reason")


def read_documents(spark: SparkSession, folder: str, rendering=compact_json) -> tuple[DataFrame, DataFrame]:
    """(documents, refused): every file below ``folder``, as ``documents_of`` tells them."""
    return documents_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), rendering)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """(name, num, bool, str): facts of a JSON file; numeric text counts as a number."""
    raw = spark.read.schema("facts map<string,string>, events array<string>, as_of timestamp").json(path, multiLine=True)
    v = F.col("value")
    return raw.select(F.explode("facts").alias("name", "value")).select(
        "name", F.expr("try_cast(value as decimal(38,10))").alias("num"), F.when(v.isin("true", "false"), v == "true").alias("bool"),
        F.when(F.expr("try_cast(value as decimal(38,10)) is null") & ~v.isin("true", "false"), v).alias("str"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a comment on the first line is skipped."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def decision_tables(docs: DataFrame) -> DataFrame:
    """(source_uri, title, chosen, rejected, assumptions) of Markdown decision records; null titles or choices are left out.

    ``rejected`` are option and reason rows below their heading, ``assumptions`` numbered rows of claim, predicate
    and expiry; code marks around a cell are dropped.
    """
    def cells(rows: Column) -> Column:
        return F.transform(rows, lambda r: F.transform(F.slice(F.split(r, r"(?<!\\)\|"), 2, 20), lambda c: F.regexp_replace(F.trim(c), "^`(.*)`$", "$1")))

    def section(name: str) -> Column:
        return F.regexp_extract("content", rf"(?s)(?:^|\n)## {name}[^\n]*\n(.*?)(?=\n## |$)", 1)

    rows = lambda text: F.filter(F.split(text, "\n"), lambda r: F.trim(r).startswith("|"))
    bare = lambda c: F.regexp_replace(c, r"[\s:-]", "") == ""
    options = F.filter(cells(rows(section("Rejected"))), lambda c: (F.size(c) >= 2) & ~bare(c[0]) & ~bare(c[1]) & (c[0] != "Option"))
    numbered = F.filter(cells(rows(F.col("content"))), lambda c: (F.size(c) >= 4) & c[0].rlike("^[0-9]+$") & (c[1] != "") & (c[2] != ""))
    bare_ends = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    chosen = bare_ends(F.split_part(bare_ends(section("Chosen")), F.lit("\n\n"), F.lit(1)))
    out = docs.where("source_kind = 'markdown'").select(
        "source_uri", F.nullif(F.trim(F.regexp_extract("content", r"(?m)^#\s+(.+?)\s*$", 1)), F.lit("")).alias("title"), F.nullif(chosen, F.lit("")).alias("chosen"),
        F.transform(options, lambda c: F.struct(c[0].alias("option"), c[1].alias("reason"))).alias("rejected"),
        F.transform(numbered, lambda c: F.struct(c[1].alias("claim"), c[2].alias("predicate"), c[3].alias("expiry"))).alias("assumptions"),
    )
    return out.where("title is not null and chosen is not null")


@F.pandas_udf(StringType())
def request_digest(requests: pd.Series) -> pd.Series:
    """32 hex digits over a JSON request with sorted keys; null for text that is not JSON."""
    import hashlib

    def one(t: str) -> str | None:
        try:
            value = json.loads(t)
        except ValueError:
            return None
        return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:32]

    return requests.map(one, na_action="ignore")
