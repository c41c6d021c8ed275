"""The citation gate: what a cited quotation is worth, first reason first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import flattened
from tidemark.operators.textops import quotations


def gate(offered: Column, resolvable: Column, in_cited: Column, in_other: Column) -> Column:
    """unoffered, unresolvable, cited, misattributed (quoted from another offered span) or fabricated."""
    return (
        F.when(~offered, "unoffered").when(~resolvable, "unresolvable").when(in_cited, "cited")
        .when(in_other, "misattributed").otherwise("fabricated")
    )


def gate_all(docs: DataFrame, claims: DataFrame, offered: Column, text_col: str = "text", claim_id: str = "item_id", claim_col: str = "claim") -> DataFrame:
    """(claim id, verdict, n): the gate over every claim cited to every document, as the number of documents a verdict.

    The documents of ``offered`` are one listing, and other spans are its other documents. A document without
    text does not resolve. A quotation counts with white space aside. Claim ids are taken to be unique.
    """
    judged = docs.select(
        F.coalesce(offered, F.lit(True)).alias("offered"), F.coalesce(flattened(F.col(text_col)) != "", F.lit(False)).alias("resolvable"), F.col(text_col).alias("text")
    )
    sizes = judged.groupBy("offered", "resolvable").agg(F.count("*").alias("size"))
    found = quotations(judged.where("resolvable"), claims, "offered", "text", claim_id, claim_col)
    held = found.groupBy(claim_id).agg(F.count_if("offered").alias("inside"), F.count_if(~F.col("offered")).alias("outside"))
    grid = claims.select(claim_id).join(F.broadcast(sizes)).join(held, claim_id, "left")
    quoting = F.when(F.col("resolvable"), F.coalesce(F.when(F.col("offered"), F.col("inside")).otherwise(F.col("outside")), F.lit(0))).otherwise(0)
    parts = F.array(F.struct(F.lit(True).alias("cites"), quoting.alias("n")), F.struct(F.lit(False).alias("cites"), (F.col("size") - quoting).alias("n")))
    cells = grid.select(claim_id, "offered", "resolvable", F.coalesce(F.col("inside") > 0, F.lit(False)).alias("elsewhere"), F.inline(parts)).where("n > 0")
    verdict = gate(F.col("offered"), F.col("resolvable"), F.col("cites"), F.col("elsewhere"))
    return cells.groupBy(claim_id, verdict.alias("verdict")).agg(F.sum("n").alias("n"))
