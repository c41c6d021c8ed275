"""Calibration: how far estimates miss their outcomes, by owner and class of work, in log space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import reported

THRESHOLD = 5
NEUTRAL = 0.05
STRETCH = 1_000_000


def ratio(actual: Column, estimated: Column) -> Column:
    """Actual over estimated, null unless both are above zero."""
    return F.when((actual > 0) & (estimated > 0), actual / estimated)


def history(estimates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each estimate beside its outcome; an unresolved outcome keeps its row."""
    return estimates.join(outcomes, "estimate_id").select(
        "estimate_id", "owner", "work_class", "estimated", "actual", ratio(F.col("actual"), F.col("estimated")).alias("ratio")
    )


def factors(rows: DataFrame, by: tuple[str, ...] = ("owner", "work_class"), threshold: int = THRESHOLD) -> DataFrame:
    """One row a group: verdict and, only where measured, factor, spread, band, confidence, direction and magnitude."""
    ln = F.log("ratio")
    g = rows.groupBy(*by).agg(
        F.count("*").alias("considered"), F.count("actual").alias("resolved"), F.count("ratio").alias("n"),
        F.avg(ln).alias("mean"), F.coalesce(F.stddev_samp(ln), F.lit(0.0)).alias("sd"),
    )
    verdict = (
        F.when(F.col("work_class") == "unclassified", "unclassified") if "work_class" in by else F.when(F.lit(False), "")
    ).when(F.col("resolved") == 0, "no_resolved_outcomes").when(F.col("n") < threshold, "insufficient_sample").otherwise("measured")
    g = g.withColumn("verdict", verdict)
    told = lambda x: F.when(F.col("verdict") == "measured", reported(x))
    central, sd, n = F.exp("mean"), F.col("sd"), F.col("n")
    out = g.select(
        *by, "considered", "resolved", "n", (F.col("resolved") - n).alias("excluded"), "verdict",
        told(central).alias("factor"), told(sd).alias("spread"), told(central / F.exp(sd)).alias("low"),
        told(central * F.exp(sd)).alias("high"), told(n / (n + threshold) / (1 + sd)).alias("confidence"),
    )
    f = F.col("factor")
    return out.withColumns({
        "direction": F.when(f > 1 + NEUTRAL, "under").when(f < 1 - NEUTRAL, "over").when(f.isNotNull(), "none"),
        "magnitude": F.when(f >= 1, f).otherwise(reported(1 / f)),
    })


def calibrate(estimates: DataFrame, found: DataFrame) -> DataFrame:
    """Scaled quantities with their band; groups without a factor pass through. Negative quantities are ``refusals``."""
    joined = estimates.where("estimated >= 0 or estimated is null").join(found.select("owner", "work_class", "factor", "low", "high"), ["owner", "work_class"], "left")
    q = F.col("estimated")
    scaled = lambda f: F.when(F.col("factor").isNull() | (q <= 0), q).otherwise(F.greatest(reported(q.cast("decimal(18,4)") * F.col(f).cast("decimal(10,4)")).cast("double"), F.lit(0.0001)))
    return joined.select(
        "estimate_id", "owner", "work_class", q.alias("quantity"), scaled("factor").alias("calibrated"),
        scaled("low").alias("band_low"), scaled("high").alias("band_high"), F.col("factor").isNotNull().alias("applied"),
    )


def refusals(estimates: DataFrame) -> DataFrame:
    """(estimate_id, quantity): what cannot be calibrated, since no work takes less than nothing."""
    return estimates.where("estimated < 0").select("estimate_id", F.col("estimated").alias("quantity"))


def narrowed(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows of the wanted values; a column without one does not narrow."""
    for column, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def match_quality(estimated: Column, actual: Column) -> Column:
    big, small = F.greatest(estimated, actual), F.least(estimated, actual)
    r = big / small
    return (
        F.when(actual.isNull(), "unresolved").when(estimated == actual, "exact").when(small <= 0, "miss")
        .when(r < 1.10, "exact").when(r < 1.50, "close").when(r < 2.50, "partial").otherwise("miss")
    )


def walk(rows: DataFrame, by: tuple[str, ...] = ("owner", "work_class"), order: str = "estimate_id", threshold: int = THRESHOLD) -> DataFrame:
    """Prequential backtest: each usable row is corrected by the factor of the usable rows before it.

    With a whole number to order by, a group is cut into stretches of ``STRETCH`` numbers; counts and sums run inside each,
    and on top of what the stretches before it hold, so no task orders a whole group.
    """
    usable = rows.where(F.col("ratio").isNotNull() & (F.col("work_class") != "unclassified")).select(*by, order, "ratio", F.log("ratio").alias("_ln"))
    cut = F.floor(F.col(order) / STRETCH) if usable.schema[order].dataType.typeName() in ("long", "integer") else F.lit(0)
    usable = usable.withColumn("_cut", cut.cast("long"))
    groups, cuts = Window.partitionBy(*by), Window.partitionBy(*by, "_cut")
    back = lambda w, o: w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    heads = usable.groupBy(*by, "_cut").agg(F.count("*").alias("_n"), F.sum("_ln").alias("_s")).select(
        *by, "_cut", zero(F.sum("_n").over(back(groups, "_cut"))).cast("long").alias("_n0"), zero(F.sum("_s").over(back(groups, "_cut"))).alias("_s0")
    )
    prior = F.col("_n0") + F.count("*").over(back(cuts, order))
    usable = usable.join(heads, [*by, "_cut"]).select(
        *by, order, "ratio", prior.alias("prior"), reported(F.exp(F.try_divide(F.col("_s0") + zero(F.sum("_ln").over(back(cuts, order))), prior))).alias("factor")
    )
    raw, corrected = F.abs(F.log("ratio")), F.abs(F.log(F.try_divide("ratio", "factor")))
    gain = raw - corrected
    scored = usable.where(F.col("prior") >= threshold).withColumns({"raw": raw, "corrected": corrected, "gain": gain})
    return scored.groupBy(*by).agg(
        F.count("*").alias("scored"), F.count_if(F.col("gain") > 0.0001).alias("improved"), F.count_if(F.col("gain") < -0.0001).alias("worsened"),
        reported(F.avg("raw")).alias("raw_error"), reported(F.avg("corrected")).alias("corrected_error"),
    )


def walk_total(groups: DataFrame) -> DataFrame:
    """Counts add; rounded group errors are weighted by how many rows they scored."""
    weighted = lambda c: reported(F.try_divide(F.sum(F.col(c) * F.col("scored")), F.sum("scored")))
    return groups.agg(
        F.sum("scored").alias("scored"), F.sum("improved").alias("improved"), F.sum("worsened").alias("worsened"),
        weighted("raw_error").alias("raw_error"), weighted("corrected_error").alias("corrected_error"),
        F.coalesce(reported(F.try_divide(F.sum("improved"), F.sum("scored"))), F.lit(0.0)).alias("score"),
    )
