"""What calls cost: prices by tokens, worst cases, shares per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cached token's price as a multiple of an input token's.
CACHE_READ = "0.1"
CACHE_WRITE = "1.25"


def _money(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("decimal(18,4)")


def call_cost(in_price: Column, out_price: Column, tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column) -> Column:
    """Dollars of one call, exact to nine places; prices are per million tokens."""
    cached = _money(CACHE_READ) * cache_read.cast("decimal(12,0)") + _money(CACHE_WRITE) * cache_write.cast("decimal(12,0)")
    units = _money(in_price) * (tokens_in.cast("decimal(12,0)") + cached).cast("decimal(18,4)") + _money(out_price) * tokens_out.cast("decimal(12,0)")
    return (units.cast("decimal(24,6)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,9)")


def worst_cost(in_price: Column, out_price: Column, chars: Column, max_tokens: Column) -> Column:
    """The most a call can cost: a token for every two characters begun, and all output it may give."""
    return call_cost(in_price, out_price, F.ceil(chars / 2), max_tokens, F.lit(0), F.lit(0))


def per_document(spent: DataFrame, documents: Column) -> DataFrame:
    """(agent, cost_per_document) at six places; nothing if there are no documents."""
    return spent.where(documents > 0).select("agent", F.bround(F.col("cost") / documents, 6).alias("cost_per_document"))


def projected(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """(agent, cost) of tokens at the routed price. ``prices`` (agent, in_price, out_price) is a closed list; agents without a route go."""
    cost = call_cost(F.col("in_price"), F.col("out_price"), F.col("tokens_in"), F.col("tokens_out"), F.lit(0), F.lit(0))
    return tokens.join(prices, "agent").select("agent", cost.alias("cost"))
