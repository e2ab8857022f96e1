"""Category vocabularies: harmonising an old scheme to a new one and measuring support."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.scalar import as_col, lookup

UNKNOWN = "UNKNOWN"

# Old business-age categories and the newer category each one falls into.
BUSINESS_AGE_MAP = {
    "Existing, 5 or more years": "Existing or more than 2 years old",
    "Less than 5 years old but at least 4": "Existing or more than 2 years old",
    "Less than 4 years old but at least 3": "Existing or more than 2 years old",
    "Less than 3 years old but at least 2": "Existing or more than 2 years old",
    "New, Less than 1 Year old": "New Business or 2 years or less",
    "New Business or Less than 2 Years Old": "New Business or 2 years or less",
    "Startup, Loan Funds will Open Business": "Startup, Loan Funds will Open Business",
    "Existing or more than 2 years old": "Existing or more than 2 years old",
    "New Business or 2 years or less": "New Business or 2 years or less",
    "Change of Ownership": "Change of Ownership",
}
BUSINESS_AGE_ORPHANS = ("Change of Ownership",)


def harmonise(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Newer category, UNKNOWN where the mapping is silent."""
    return F.coalesce(lookup(as_col(c), mapping), F.lit(UNKNOWN))


def supported(train: DataFrame, category: str, min_support: float) -> DataFrame:
    """(category, share) of training categories with at least the minimal share."""
    counts = train.where(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c")).scalar()
    return counts.select(category, (F.col("_c") / total).alias("share")).where(F.col("share") >= min_support)


def coverage(
    population: DataFrame, train: DataFrame, *, year: str, category: str,
    mapping: Mapping[str, str], orphans: Sequence[str], min_support: float,
) -> DataFrame:
    """Per year: share of rows in categories the training data supports, raw and harmonised.

    Harmonised support is the summed share of the categories that fall together. Rows are counted
    per (year, category) first, so the joins below see summaries only.
    """
    cells = population.where(F.col(year).isNotNull()).groupBy(year, category).agg(
        F.count(F.lit(1)).alias("_n"))
    target = lookup(category, mapping)
    raw = supported(train, category, min_support).select(category, F.lit(1).alias("_raw"))
    merged = (
        train.where(F.col(category).isNotNull())
        .select(harmonise(category, mapping).alias("_target"))
    )
    merged_ok = (
        supported(merged, "_target", min_support).where(F.col("_target") != UNKNOWN)
        .select("_target", F.lit(1).alias("_merged"))
    )
    marked = (
        cells.join(raw, category, "left")
        .withColumn("_target", target).join(merged_ok, "_target", "left")
    )

    def share(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("_n")).otherwise(0)) / F.sum("_n")

    return marked.groupBy(year).agg(
        F.sum("_n").alias("n"),
        share(F.col("_raw") == 1).alias("supported_raw"),
        share(F.col("_merged") == 1).alias("supported_harmonised"),
        share(F.col(category).isin(list(orphans))).alias("orphan_share"),
    )
