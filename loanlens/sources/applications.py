"""Application panel from the raw text table, sampling, and the event-study panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.config import Settings
from loanlens.functions.scalar import flag, log_amount, lookup, ratio, to_double, to_int

# Midpoints of the reported ranges.
DTI_MIDPOINTS = {"<20%": 15.0, "20%-<30%": 25.0, "30%-<36%": 33.0, "50%-60%": 55.0, ">60%": 65.0}
AGE_MIDPOINTS = {
    "<25": 22.0, "25-34": 30.0, "35-44": 40.0, "45-54": 50.0, "55-64": 60.0, "65-74": 70.0, ">74": 80.0,
}


def dti(c: str = "debt_to_income_ratio") -> Column:
    """Midpoint of a range, or the exact figure."""
    return F.coalesce(lookup(c, DTI_MIDPOINTS), to_double(c))


def age(c: str = "applicant_age") -> Column:
    """Midpoint of an age range; 8888 and anything else unknown is null."""
    return lookup(c, AGE_MIDPOINTS)


def income_dollars(c: str = "income") -> Column:
    return to_double(c) * F.lit(1000.0)


def application_panel(raw: DataFrame) -> DataFrame:
    """Typed panel; keeps positive amounts with a reported income, which may be negative."""
    amount, income = to_double("loan_amount"), income_dollars()
    renamed = (
        ("state_code", "state_code"), ("loan_type", "loan_type"), ("loan_purpose", "loan_purpose"),
        ("lien_status", "lien_status"), ("occupancy_type", "occupancy_type"),
        ("construction_method", "construction_method"),
        ("conforming_loan_limit", "conforming_loan_limit"), ("preapproval", "preapproval"),
        ("open-end_line_of_credit", "open_end_line"),
        ("business_or_commercial_purpose", "business_purpose"),
        ("derived_dwelling_category", "dwelling_category"),
        ("derived_loan_product_type", "loan_product_type"),
        ("submission_of_application", "submission_of_application"),
    )
    return raw.where((amount > 0) & to_double("income").isNotNull()).select(
        to_int("activity_year").alias("activity_year"),
        flag(F.col("action_taken") == "3").alias("is_denied"),
        F.col("derived_race").alias("race"),
        F.col("derived_ethnicity").alias("ethnicity"),
        F.col("derived_sex").alias("sex"),
        F.col("applicant_age").alias("age_bucket"),
        age().alias("age"),
        amount.alias("loan_amount"),
        income.alias("income"),
        dti().alias("dti"),
        to_double("loan_to_value_ratio").alias("ltv"),
        to_double("property_value").alias("property_value"),
        ratio(amount, income).alias("loan_to_income"),
        log_amount(amount).alias("log_loan_amount"),
        to_double("tract_to_msa_income_percentage").alias("tract_to_msa_income_percentage"),
        to_double("tract_owner_occupied_units").alias("tract_owner_occupied_units"),
        to_double("ffiec_msa_md_median_family_income").alias("msa_median_income"),
        *[F.col(f"`{src}`").alias(name) for src, name in renamed],
    )


def draw_of(key: Sequence[str], seed: int) -> Column:
    """48 bits of the key's MD5, a digest that other engines compute alike."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")


def sample_fraction(
    df: DataFrame, key: Sequence[str], pct: float, seed: int
) -> DataFrame:
    """Streaming Bernoulli sample that depends on the row key only, not on the file layout."""
    return df.where(draw_of(key, seed) % 1_000_000 < F.lit(int(round(pct * 10_000))))


def sample_split(
    df: DataFrame, windows: Sequence[tuple[str, int, int]], pct: dict[str, float],
    key: Sequence[str], seed: int, year: str = "activity_year",
) -> DataFrame:
    """Declared share of each split, one pass."""
    draw = draw_of(key, seed) % 1_000_000
    split, keep = F.lit(None).cast("string"), F.lit(0)
    for name, first, last in windows:
        inside = F.col(year).between(first, last)
        split = F.when(inside, name).otherwise(split)
        keep = F.when(inside, int(round(pct[name] * 10_000))).otherwise(keep)
    return df.withColumn("split", split).where(F.col("split").isNotNull() & (draw < keep))


def sample_n(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows chosen by hashed key: a top-n per task, then one merge of n rows per task.

    Rows that repeat a key are ordered by all their columns.
    """
    return df.orderBy(draw_of(key, seed), *df.columns).limit(n)


def event_panel(raw: DataFrame, cfg: Settings) -> DataFrame:
    """Declared years, county known."""
    year = to_int("activity_year")
    return raw.where(
        year.isin(list(cfg.event_years))
        & F.col("county_code").isNotNull() & ~F.col("county_code").isin("", "NA")
    ).select(
        year.alias("year"),
        flag(F.col("action_taken") == "3").alias("denied"),
        F.col("derived_race").alias("race"),
        F.col("derived_ethnicity").alias("ethnicity"),
        "county_code", "loan_purpose", "lien_status", "occupancy_type",
        to_double("loan_amount").alias("loan_amount"),
        income_dollars().alias("income"),
    )
