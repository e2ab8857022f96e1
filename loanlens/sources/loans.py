"""Loan panel from the raw text file, and the loan-resolution view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.config import Settings
from loanlens.functions.scalar import (
    code_prefix, flag, log_amount, presence_flag, ratio, to_date, to_double, to_int,
)

PANEL_COLUMNS = (
    "is_chargeoff", "chargeoff_amount", "approval_fy", "gross_approval", "sba_guaranteed",
    "initial_rate", "jobs_supported", "guarantee_pct", "log_gross_approval", "naics_sector",
    "has_franchise", "business_type", "business_age", "revolver_status", "collateral_ind",
    "rate_type", "processing_method", "borrower_state",
)


def population(cfg: Settings, *, resolved: bool) -> Column:
    """Rows the panel keeps. Booked-but-open loans only count when outcomes are not read."""
    status = F.trim("LoanStatus")
    known = (
        status.isin(list(cfg.resolved_statuses)) if resolved
        else ~status.isin(list(cfg.not_booked_statuses))
    )
    return (
        known & (to_double("GrossApproval") > 0) & (to_double("TermInMonths") > 0)
        & ~F.trim("Program").isin(list(cfg.excluded_programs))
    )


def loan_panel(raw: DataFrame, cfg: Settings, *, resolved: bool = True) -> DataFrame:
    """Typed panel, one row per loan with a readable fiscal year. Term is filtered on, never kept."""
    gross, guaranteed = to_double("GrossApproval"), to_double("SBAGuaranteedApproval")
    panel = raw.where(population(cfg, resolved=resolved)).select(
        flag(F.trim("LoanStatus") == cfg.bad_status).alias("is_chargeoff"),
        to_double("GrossChargeOffAmount").alias("chargeoff_amount"),
        to_int("ApprovalFY").alias("approval_fy"),
        gross.alias("gross_approval"),
        guaranteed.alias("sba_guaranteed"),
        to_double("InitialInterestRate").alias("initial_rate"),
        to_double("JobsSupported").alias("jobs_supported"),
        ratio(guaranteed, gross).alias("guarantee_pct"),
        log_amount(gross).alias("log_gross_approval"),
        code_prefix("NaicsCode").alias("naics_sector"),
        presence_flag("FranchiseCode").alias("has_franchise"),
        *[F.trim(src).alias(name) for src, name in (
            ("BusinessType", "business_type"), ("BusinessAge", "business_age"),
            ("RevolverStatus", "revolver_status"), ("CollateralInd", "collateral_ind"),
            ("FixedorVariableInterestInd", "rate_type"),
            ("ProcessingMethod", "processing_method"), ("BorrState", "borrower_state"),
        )],
    )
    return panel.where(F.col("approval_fy").isNotNull())


def originations(raw: DataFrame, cfg: Settings, first: int, last: int) -> DataFrame:
    """All booked loans of the given years, outcome columns removed."""
    return (
        loan_panel(raw, cfg, resolved=False)
        .where(F.col("approval_fy").between(first, last))
        .drop("is_chargeoff", "chargeoff_amount")
    )


def with_split(df: DataFrame, cfg: Settings, year: str = "approval_fy") -> DataFrame:
    """Out-of-time split by year window; rows outside every window get null."""
    split = F.lit(None).cast("string")
    for name, first, last in reversed(cfg.split_windows()):
        split = F.when(F.col(year).between(first, last), name).otherwise(split)
    return df.withColumn("split", split)


def resolutions(raw: DataFrame, cfg: Settings) -> DataFrame:
    """Resolved loans with approval and resolution date."""
    status = F.trim("LoanStatus")
    return raw.where((to_double("GrossApproval") > 0) & status.isin(cfg.bad_status, cfg.paid_status)).select(
        to_int("ApprovalFY").alias("fy"),
        to_date("ApprovalDate").alias("approved_on"),
        status.alias("status"),
        F.when(status == cfg.bad_status, to_date("ChargeOffDate"))
        .otherwise(to_date("PaidInFullDate")).alias("resolved_on"),
    )
