"""Data contracts, leakage and missingness audits, comparisons of result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.scalar import flag, ratio, to_double
from loanlens.operators.ranking import exact_quantiles

# Fixed values: (check, column, kind, low, high) of the loan panel.
LOAN_RULES = (
    ("is_chargeoff in {0,1}", "is_chargeoff", "range", 0, 1),
    ("chargeoff_amount >= 0", "chargeoff_amount", "null_or_range", 0, None),
    ("approval_fy in 1991..2100", "approval_fy", "range", 1991, 2100),
    ("gross_approval > 0", "gross_approval", "positive", None, None),
    ("sba_guaranteed >= 0", "sba_guaranteed", "null_or_range", 0, None),
    ("initial_rate in 0..50", "initial_rate", "null_or_range", 0, 50),
    ("jobs_supported >= 0", "jobs_supported", "null_or_range", 0, None),
    ("guarantee_pct in 0..1.5", "guarantee_pct", "null_or_range", 0, 1.5),
    ("has_franchise in {0,1}", "has_franchise", "range", 0, 1),
)


def _broken(column: str, kind: str, low: float | None, high: float | None) -> Column:
    c = F.col(column)
    if kind == "positive":
        ok = c > 0
    else:
        ok = F.lit(True) if low is None else c >= low
        if high is not None:
            ok = ok & (c <= high)
    if kind == "null_or_range":
        return c.isNotNull() & ~ok
    return c.isNull() | ~ok


def contract_check(df: DataFrame, rules: Sequence[tuple] = LOAN_RULES) -> DataFrame:
    """(check, n_bad) of every rule, all from one pass."""
    cells = [
        F.struct(F.lit(name).alias("check"),
                 F.coalesce(F.sum(flag(_broken(*rule))), F.lit(0)).cast("bigint").alias("n_bad"))
        for name, *rule in rules
    ]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c")).withColumn("ok", F.col("n_bad") == 0)


def strict_columns(df: DataFrame, declared: Sequence[str]) -> None:
    """A missing or extra column is an error. Reads the schema only."""
    missing, extra = set(declared) - set(df.columns), set(df.columns) - set(declared)
    if missing or extra:
        raise ValueError(f"panel columns: missing {sorted(missing)}, not declared {sorted(extra)}")


def base_rate(df: DataFrame, y: str, low: float, high: float, banned: str) -> DataFrame:
    """Is the base rate plausible, and is the contaminated column absent?"""
    rate = F.avg(y)
    return df.agg(
        F.count(F.lit(1)).alias("n"), rate.alias("base_rate"),
        rate.between(low, high).alias("plausible"),
        F.lit(banned not in df.columns).alias("clean"))


def nullity_gap(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """Per column: share of nulls in each class, gap in points, and `review` beyond 5. One pass."""
    cells = []
    for c in columns:
        gone = flag(F.col(c).isNull())
        cells.append(F.struct(
            F.lit(c).alias("column"),
            F.avg(F.when(F.col(y) == 0, gone)).alias("null_rate_negative"),
            F.avg(F.when(F.col(y) == 1, gone)).alias("null_rate_positive")))
    gap = (F.col("null_rate_positive") - F.col("null_rate_negative")) * 100.0
    return (
        df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
        .withColumn("gap_pp", gap)
        .withColumn("verdict", F.when(F.abs("gap_pp") > 5, "review").otherwise("ok"))
    )


# Candidate fields of the raw loan file and the multiple a contract value lies on.
LOAN_MODULI = {
    "TermInMonths": 6.0, "InitialInterestRate": 0.25, "GrossApproval": 1000.0,
    "SBAGuaranteedApproval": 1000.0, "JobsSupported": 1.0,
}


def contamination_audit(
    raw: DataFrame, moduli: Mapping[str, float], first_fy: int, last_fy: int,
    control: str = "CANCLD", bad: str = "CHGOFF", paid: str = "P I F",
) -> DataFrame:
    """Fields edited after the outcome: charge-offs lose roundness that never-disbursed loans keep.

    All candidate fields go through one scan; medians are exact and computed by bucketed rank.
    """
    status = F.trim("LoanStatus")
    kept = raw.where(F.col("ApprovalFY").try_cast("int").between(first_fy, last_fy)
                     & status.isin(control, paid, bad))
    long = kept.select(
        status.alias("status"),
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), to_double(f).alias("v"), F.lit(float(m)).alias("m"))
            for f, m in moduli.items()])).alias("_x"),
    ).select("status", "_x.*").where(F.col("v") > 0)
    off = F.abs(F.col("v") - F.col("m") * F.round(F.col("v") / F.col("m"))) >= 1e-6
    shares = long.groupBy("field", "status").agg(
        F.count(F.lit(1)).alias("n"), F.round(100.0 * F.avg(flag(off)), 1).alias("odd"))
    medians = exact_quantiles(long, "v", [0.5], ["field", "status"])
    both = shares.join(medians, ["field", "status"])

    def of(name: str, s: str) -> Column:
        return F.max(F.when(F.col("status") == s, F.col(name)))

    table = both.groupBy("field").agg(
        (of("value", bad) / F.nullif(of("value", control), F.lit(0.0))).alias("median_ratio"),
        of("odd", control).alias("odd_control"), of("odd", bad).alias("odd_bad"),
    ).where(F.col("median_ratio").isNotNull())
    gap = F.col("odd_bad") - F.col("odd_control")
    return table.withColumn("odd_gap", gap).withColumn(
        "verdict",
        F.when(gap > 25.0, "CONTAMINATED")
        .when(F.abs(F.col("median_ratio") - 1.0) > 0.30, "predictive").otherwise("ok"))


def exclusion_rates(df: DataFrame, group: str, kept: Column, y: str) -> DataFrame:
    """Per group: share the cleaning filter removes, and the outcome rate with and without it."""
    k = flag(kept)
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(1 - k).alias("excluded_share"),
        F.avg(y).alias("rate_all"),
        F.avg(F.when(k == 1, F.col(y))).alias("rate_kept"))


def compare_outputs(
    a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str], tol: float = 1e-6
) -> DataFrame:
    """Row counts, unmatched keys and worst relative difference per metric of two result tables."""
    left = a.select(*keys, F.struct(*[F.col(m).cast("double").alias(m) for m in metrics]).alias("_a"))
    right = b.select(*keys, F.struct(*[F.col(m).cast("double").alias(m) for m in metrics]).alias("_b"))
    joined = left.join(right, list(keys), "full_outer")
    counts = [
        F.count("_a").alias("rows_a"), F.count("_b").alias("rows_b"),
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
    ]
    worst = [
        F.max(F.abs(F.col(f"_a.{m}") - F.col(f"_b.{m}")) / F.greatest(F.abs(F.col(f"_a.{m}")), F.lit(1.0)))
        for m in metrics
    ]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_w{i}").alias("worst")) for i, m in enumerate(metrics)])
    return (
        joined.agg(*counts, *[w.alias(f"_w{i}") for i, w in enumerate(worst)])
        .select("rows_a", "rows_b", "only_a", "only_b", F.inline(cells))
        .withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0)
                    & (F.coalesce("worst", F.lit(0.0)) <= tol))
    )


def compare_runs(before: DataFrame, after: DataFrame, tol: float = 1e-4) -> DataFrame:
    """Differences of two long (model, metric, value) tables: absent on one side or beyond the tolerance."""
    a = before.select("model", "metric", F.col("value").alias("before"))
    b = after.select("model", "metric", F.col("value").alias("after"))
    gone = F.col("before").isNull() | F.col("after").isNull()
    return a.join(b, ["model", "metric"], "full_outer").select(
        "model", "metric", "before", "after",
        F.when(gone, "absent").when(F.abs(F.col("before") - F.col("after")) > tol, "changed")
        .otherwise("same").alias("verdict"))


__all__ = [
    "base_rate", "compare_outputs", "compare_runs", "contamination_audit", "contract_check",
    "exclusion_rates", "nullity_gap", "ratio", "strict_columns",
]
