"""Label maturity by cohort. Input: the resolution view (fy, approved_on, status, resolved_on)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.config import Settings
from loanlens.functions.scalar import calendar_months, flag, to_double, to_int

MAX_MONTHS = 400  # fixed value: longer spans are date errors


def months(df: DataFrame) -> DataFrame:
    return df.withColumn("months", calendar_months("approved_on", "resolved_on"))


def resolution(raw: DataFrame, cfg: Settings) -> DataFrame:
    """Per fiscal year: loans, percent resolved, percent charged off among the resolved."""
    status = F.trim("LoanStatus")
    known, bad = flag(status.isin(list(cfg.resolved_statuses))), flag(status == cfg.bad_status)
    return (
        raw.where(to_double("GrossApproval") > 0).withColumn("fy", to_int("ApprovalFY"))
        .where(F.col("fy").isNotNull()).groupBy("fy").agg(
            F.count(F.lit(1)).alias("n"),
            F.round(100.0 * F.sum(known) / F.count(F.lit(1)), 1).alias("pct_resolved"),
            F.round(100.0 * F.sum(bad) / F.nullif(F.sum(known), F.lit(0)), 2).alias("pct_bad_of_resolved"),
        )
    )


def _charge_offs(res: DataFrame, cfg: Settings) -> DataFrame:
    return months(res.where(F.col("status") == cfg.bad_status)).where(
        F.col("months").between(0, MAX_MONTHS))


def emergence(res: DataFrame, cfg: Settings, first: int, last: int) -> DataFrame:
    """Share of a cohort's charge-offs already visible after M months."""
    return _charge_offs(res, cfg).where(F.col("fy").between(first, last)).groupBy("fy").agg(
        F.count(F.lit(1)).alias("n_chargeoffs"),
        *[
            F.round(100.0 * F.sum(flag(F.col("months") <= m)) / F.count(F.lit(1)), 1).alias(f"pct_{m}m")
            for m in cfg.emergence_months
        ],
    )


def months_to_event(res: DataFrame, cfg: Settings) -> DataFrame:
    """Exact percentiles of the months to charge-off. At most 401 distinct values are held."""
    q = F.percentile("months", F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    return _charge_offs(res, cfg).agg(F.count(F.lit(1)).alias("n"), q.alias("_q")).select(
        "n", *[F.round(F.col("_q")[i], 1).alias(c) for i, c in enumerate(("p10", "p25", "p50", "p75", "p90"))])


def observability(res: DataFrame, as_of: Column) -> DataFrame:
    """Per cohort: last approval and whole calendar months from it to the as-of date."""
    return (
        res.where(F.col("approved_on").isNotNull() & F.col("fy").isNotNull())
        .groupBy("fy").agg(F.max("approved_on").alias("last_approval"))
        .withColumn("months_observable", calendar_months(F.col("last_approval"), as_of))
    )


def matched_maturity(
    res: DataFrame, as_of: Column, windows: Sequence[int], first_fy: int, bad_status: str
) -> DataFrame:
    """(fy, window): resolved and charged off within the window; null where it is not observable.

    All windows come out of one aggregate: a row is counted per window by condition, not copied.
    The cohort's last approval rides along in the same pass.
    """
    dated = months(res.where(F.col("approved_on").isNotNull() & F.col("fy").isNotNull()))
    within = F.col("resolved_on").isNotNull()
    bad = F.col("status") == bad_status
    sums = [F.max("approved_on").alias("last_approval"), F.count("resolved_on").alias("_dated")]
    for m in windows:
        seen = within & (F.col("months") <= m)
        sums += [F.sum(flag(seen)).cast("bigint").alias(f"_r{m}"),
                 F.sum(flag(seen & bad)).cast("bigint").alias(f"_b{m}")]
    wide = dated.where(F.col("fy") >= first_fy).groupBy("fy").agg(*sums).where(F.col("_dated") > 0)
    long = wide.select(
        "fy", calendar_months(F.col("last_approval"), as_of).alias("_obs"),
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("window"), F.col(f"_r{m}").alias("resolved"),
                     F.col(f"_b{m}").alias("bad")) for m in windows])).alias("_w"),
    )
    seen = F.col("_obs") >= F.col("_w.window")

    def shown(c: Column) -> Column:
        return F.when(seen, c)

    return long.select(
        "fy", F.col("_w.window").alias("window_months"),
        shown(F.col("_w.resolved")).alias("n_resolved"), shown(F.col("_w.bad")).alias("n_chargeoffs"),
        shown(100.0 * F.col("_w.bad") / F.nullif(F.col("_w.resolved"), F.lit(0))).alias("rate"),
        seen.alias("observable"),
    )


def reference_rates(
    res: DataFrame, windows: Sequence[int], first: int, last: int, bad_status: str
) -> DataFrame:
    """(window, rate): pooled rate of the training cohorts."""
    df = months(res.where(F.col("fy").between(first, last)
                          & F.col("approved_on").isNotNull() & F.col("resolved_on").isNotNull()))
    cells = []
    for m in windows:
        seen = F.col("months") <= m
        cells.append(F.struct(
            F.lit(m).alias("window_months"),
            F.round(100.0 * F.sum(flag(seen & (F.col("status") == bad_status)))
                    / F.nullif(F.sum(flag(seen)), F.lit(0)), 2).alias("rate")))
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c")).where(F.col("rate").isNotNull())
