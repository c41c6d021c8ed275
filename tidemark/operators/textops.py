"""Quotations, spans, deduplication and search over documents."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import content_hash, flattened
from tidemark.operators.rounds import settled


def dedupe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(content_hash, id, copies): the lowest id of each content."""
    return docs.groupBy(content_hash(F.col(text_col)).alias("content_hash")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def quoted(text: Column, claim: Column) -> Column:
    """exact, flattened (white space aside) or absent; an empty claim is absent."""
    return (
        F.when(F.trim(claim) == "", "absent").when(F.contains(text, claim), "exact")
        .when(F.contains(flattened(text), flattened(claim)), "flattened").otherwise("absent")
    )


#: Characters of claims that one automaton is made from: some hundred bytes each, in every worker.
AUTOMATON = 1_000_000


def quotations(
    docs: DataFrame, claims: DataFrame, id_col: str = "doc_id", text_col: str = "text", claim_id: str = "item_id", claim_col: str = "claim", automaton: int = AUTOMATON
) -> DataFrame:
    """(id, claim id, verdict) of every claim, in every document that holds it, exact or flattened; what is not listed is absent.

    Claims of ``automaton`` characters in all become one automaton, and each text is scanned once for all of them. Where there are more, a
    claim of three words or more meets the documents that hold its longest inner word, which stands there whole since a quotation may
    only start and end within a word; only words and row keys meet, texts are fetched for these. Shorter claims are scanned for, an automaton at a time.
    """
    words = F.split("flat_claim", " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("word"))))["word"]
    asked = claims.select(F.col(claim_id).alias("_claim"), F.col(claim_col).alias("claim"), flattened(F.col(claim_col)).alias("flat_claim")).where("flat_claim <> ''")
    asked = settled(asked.withColumn("word", longest))
    size = asked.agg(F.sum(F.length("flat_claim")).alias("all"), F.sum(F.when(F.col("word").isNull(), F.length("flat_claim"))).alias("short")).first()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    if (size["all"] or 0) <= automaton:
        found = _scanned(rows, asked)
    else:
        found = _met_by_word(rows, asked.where("word is not null"))
        parts = -(-(size["short"] or 0) // automaton)
        for part in range(parts):
            few = asked.where(F.col("word").isNull() & (F.pmod(F.xxhash64("flat_claim"), F.lit(parts)) == part))
            found = found.unionByName(_scanned(rows, few))
    return found.select(F.col("_id").alias(id_col), F.col("_claim").alias(claim_id), "verdict")


def _met_by_word(rows: DataFrame, asked: DataFrame) -> DataFrame:
    keyed = rows.withColumn("_row", F.xxhash64("_id", "text"))
    worded = keyed.select("_row", F.explode(F.array_distinct(F.split(flattened(F.col("text")), " "))).alias("word"))
    near = worded.join(asked.select("_claim", "claim", "flat_claim", "word"), "word").select("_row", "_claim", "claim", "flat_claim").distinct()
    met = keyed.join(near, "_row").where(F.contains(flattened(F.col("text")), F.col("flat_claim")))
    return met.select("_id", "_claim", F.when(F.contains("text", "claim"), "exact").otherwise("flattened").alias("verdict"))


def _scanned(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Each text once, for all the claims: (_id, _claim, verdict)."""
    listed = asked.select("_claim", "claim", "flat_claim").distinct().collect()  # within ``AUTOMATON``
    told = rows.sparkSession.createDataFrame([(n, r["_claim"]) for n, r in enumerate(listed)], f"n int, _claim {asked.schema['_claim'].dataType.simpleString()}")
    patterns = rows.sparkSession.sparkContext.broadcast([(r["claim"], r["flat_claim"]) for r in listed])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine, spellings = ahocorasick.Automaton(), {}
        for n, (_, flat) in enumerate(patterns.value):
            spellings.setdefault(flat, []).append(n)
        for flat, own in spellings.items():
            machine.add_word(flat, own)
        machine.make_automaton()
        for b in batches:
            where, which, exact = [], [], []
            for row, (text, flat) in enumerate(zip(b.column("text").to_pylist(), b.column("flat").to_pylist())):
                if spellings:
                    for n in sorted({n for _, own in machine.iter(flat) for n in own}):
                        where.append(row), which.append(n), exact.append(patterns.value[n][0] in text)
            verdicts = pa.array(["exact" if e else "flattened" for e in exact], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(where, pa.int64())), pa.array(which, pa.int32()), verdicts], names=["_id", "n", "verdict"])

    kind = rows.schema["_id"].dataType.simpleString()
    hits = rows.withColumn("flat", flattened(F.col("text"))).mapInArrow(scan, f"_id {kind}, n int, verdict string")
    return hits.join(F.broadcast(told), "n").select("_id", "_claim", "verdict")


def verify_span(content: Column, start: Column, end: Column, text: Column) -> Column:
    """ok, out_of_bounds, split_character or text_mismatch, for byte ranges with exclusive end."""
    raw = content.cast("binary")
    piece = F.substring(raw, start + 1, end - start)
    return (
        F.when((start < 0) | (end <= start) | (end > F.octet_length(content)), "out_of_bounds")
        .when(~F.is_valid_utf8(piece), "split_character").when(piece.cast("string") != text, "text_mismatch").otherwise("ok")
    )


def locate(text: Column, quote: Column) -> tuple[Column, Column]:
    """Byte range of the first occurrence, null where absent."""
    at = F.instr(text, quote)
    start = F.when(at > 0, F.octet_length(F.left(text, at - 1)))
    return start, start + F.octet_length(quote)


#: What a letter with marks becomes without them: by decomposition, for the Latin, Greek and Cyrillic blocks.
_MARKED = {chr(c): base for c in range(0xC0, 0x530) for base in [unicodedata.normalize("NFD", chr(c))[0]] if base != chr(c)}


def unaccented(text: Column) -> Column:
    """Letters without their marks, composed or combining."""
    return F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), "".join(_MARKED), "".join(_MARKED.values()))


def search_words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, without marks; a text of ASCII has none, and is cut by a plainer pattern."""
    ascii = F.octet_length(text) == F.char_length(text)
    parts = F.when(ascii, F.split(F.lower(text), "[^a-z0-9]+")).otherwise(F.split(unaccented(F.lower(text)), r"[^\p{L}\p{N}]+"))
    return F.filter(parts, lambda w: w != "")


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents for any of the terms, ties to the smaller id; marks on letters do not tell words apart.

    One pass over the texts leaves a row of counts for each, and everything else is taken from these.
    """
    listed = sorted({"".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)) for t in terms})
    words = docs.select(id_col, search_words(F.col(text_col)).alias("w"))
    is_term = lambda t: lambda x: x == F.lit(t)
    counts = [F.size(F.filter("w", is_term(t))).alias(f"tf{n}") for n, t in enumerate(listed)]
    sized = settled(words.select(id_col, F.size("w").alias("len"), *counts))
    told = sized.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{n}") > 0).alias(f"df{n}") for n in range(len(listed)))).first()
    score = F.lit(0.0)
    for n in range(len(listed)):
        idf = math.log(1 + (told["docs"] - told[f"df{n}"] + 0.5) / (told[f"df{n}"] + 0.5))
        tf = F.col(f"tf{n}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / (told["mean"] or 1.0)))
    return sized.select(id_col, F.bround(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(k)


def snippet(text: Column, terms: list[str], words: int = 12) -> Column:
    """``words`` words from the first that is one of the terms on, the terms in brackets, dots where the text goes on; null without any."""
    listed = F.array(*map(F.lit, terms))
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    plain = lambda w: F.regexp_replace(unaccented(F.lower(w)), r"[^\p{L}\p{N}]+", "")
    hits = F.transform(parts, lambda w: F.array_contains(listed, plain(w)))
    at = F.array_position(hits, True).cast("int")
    shown = F.transform(F.slice(parts, F.greatest(at, F.lit(1)), words), lambda w: F.when(F.array_contains(listed, plain(w)), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    cut = F.concat(F.when(at > 1, "... ").otherwise(""), F.array_join(shown, " "), F.when(at + words - 1 < F.size(parts), " ...").otherwise(""))
    return F.when(at > 0, cut)


def neighbourhood(rows: DataFrame, by: str, order: str, value: str, behind: int, ahead: int) -> DataFrame:
    """Each row with the values around it, in order."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-behind, ahead)
    return rows.select(by, order, F.concat_ws("|", F.collect_list(value).over(w)).alias("around"))
