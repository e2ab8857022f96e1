"""Can the guarantee's effect be identified? Input columns: amount, share, method, bad."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions.scalar import flag, ratio


def treatment_r2(df: DataFrame, width: float, max_amount: float) -> DataFrame:
    """1 - within-cell / total sum of squares of the share over (method, amount cell).

    Cells carry (count, mean, centred sum of squares) from one aggregate; the total follows from
    them by the variance decomposition, so rows are never joined back to their means.
    """
    cells = (
        df.where(F.col("share").isNotNull() & F.col("method").isNotNull() & (F.col("amount") < max_amount))
        .groupBy("method", F.floor(F.col("amount") / width).alias("cell"))
        .agg(F.count(F.lit(1)).alias("c"), F.avg("share").alias("mu"),
             (F.var_pop("share") * F.count(F.lit(1))).alias("ss"))
    )
    # Cell means are centred on the lowest of them before they are squared, so close means keep their digits.
    cells = cells.withColumn("mu", F.col("mu") - cells.agg(F.min("mu")).scalar())
    grand = cells.agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("cells"), F.sum("ss").alias("within"),
        # between = sum c * (mu - grand mean)^2, the population variance of the cell means by weight
        F.sum(F.col("c") * F.col("mu")).alias("_s"), F.sum(F.col("c") * F.col("mu") * F.col("mu")).alias("_q"),
    ).withColumn("between", F.col("_q") - F.col("_s") * F.col("_s") / F.col("n"))
    r2 = F.lit(1.0) - F.col("within") / F.nullif(F.col("within") + F.col("between"), F.lit(0.0))
    return grand.select("n", "cells", F.round(r2, 4).alias("r2")).withColumn(
        "identifiable", F.col("r2") < 0.90)


def level_mass(df: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Distinct share levels at 4 decimals, and percent of rows on the frequent ones."""
    known = df.where(F.col("share").isNotNull())
    per = known.groupBy(F.round("share", 4).alias("level")).agg(
        F.count(F.lit(1)).alias("c"),
        F.sum(flag(F.round("share", 2).isin([float(x) for x in levels]))).alias("on"))
    return per.agg(
        F.count("level").alias("levels"),
        F.round(100.0 * F.sum("on") / F.sum("c"), 2).alias("pct_on_levels"))


def density_at_threshold(df: DataFrame, threshold: float, windows: Sequence[float]) -> DataFrame:
    """Per window around the threshold: rows, rows exactly on it, percent; usable if under 10 in the narrowest."""
    away, on = F.abs(F.col("amount") - F.lit(float(threshold))), F.col("amount") == F.lit(float(threshold))
    near = df.where(away <= float(max(windows)))
    cells = [
        F.struct(
            F.lit(float(w)).alias("window"),
            F.sum(flag(away <= float(w))).cast("bigint").alias("n"),
            F.sum(flag(on)).cast("bigint").alias("n_at_threshold"))
        for w in windows
    ]
    pct = F.round(100.0 * F.col("n_at_threshold") / F.nullif(F.col("n"), F.lit(0)), 2)
    return near.agg(F.array(*cells).alias("_c")).select(F.inline("_c")).select(
        "*", pct.alias("pct_at_threshold"))


def gradient_by_size(
    df: DataFrame, low: float, high: float, width: float, max_amount: float, min_n: int
) -> DataFrame:
    """Per size bin: bad rate at the two share levels and their difference, where both have min_n rows."""
    lo, hi = F.round("share", 2) == low, F.round("share", 2) == high
    return (
        df.where((lo | hi) & (F.col("amount") < max_amount))
        .groupBy((F.floor(F.col("amount") / width) * width).cast("double").alias("amount_from"))
        .agg(
            F.sum(flag(lo)).cast("bigint").alias("n_low"), F.sum(flag(hi)).cast("bigint").alias("n_high"),
            (100.0 * F.avg(F.when(lo, F.col("bad")))).alias("rate_low"),
            (100.0 * F.avg(F.when(hi, F.col("bad")))).alias("rate_high"))
        .where((F.col("n_low") >= min_n) & (F.col("n_high") >= min_n))
        .withColumn("difference_pp", F.round(F.col("rate_high") - F.col("rate_low"), 2))
        .withColumn("rate_low", F.round("rate_low", 2)).withColumn("rate_high", F.round("rate_high", 2))
    )


def gradient_decompose(df: DataFrame, low: float, high: float, width: float, max_amount: float, min_n: int) -> DataFrame:
    """Raw difference between the two levels, the within-size difference, and the share size explains."""
    lo, hi = F.round("share", 2) == low, F.round("share", 2) == high
    raw = df.where(lo | hi).agg(F.round(
        100.0 * F.avg(F.when(hi, F.col("bad"))) - 100.0 * F.avg(F.when(lo, F.col("bad"))), 2).alias("x"))
    bins = gradient_by_size(df, low, high, width, max_amount, min_n)
    n = F.col("n_low") + F.col("n_high")
    inside = bins.agg(
        F.coalesce(F.round(F.sum(F.col("difference_pp") * n) / F.sum(n), 2), F.lit(0.0)).alias("within_pp"),
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_comparable"))
    return inside.withColumn("raw_pp", raw.scalar()).withColumn(
        "explained_by_size",
        F.coalesce(F.round(F.lit(1.0) - ratio(F.col("within_pp"), F.col("raw_pp")), 4), F.lit(0.0)))
