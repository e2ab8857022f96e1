"""Aggregations (survey 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.config import NON_GROUPS, TESTBED as CFG
from loanlens.functions import scalar as S
from loanlens.operators import cohorts, economics, fairness, features, identification, notices, vocabulary
from loanlens.plans.cleaning import PARTIAL_MAP
from loanlens.plans.registry import n, query, r, rounded
from loanlens.sources import loans as L
from loanlens.sources.files import stage, vintage_as_of
from loanlens.sources.testbed import LOANS_SQL, RAW_APPLICATIONS_SQL, RAW_LOANS_SQL, loans, raw_applications, raw_loans

RESOLUTION_FIELDS = (
    "LoanStatus", "GrossApproval", "ApprovalFY", "ApprovalDate", "ChargeOffDate", "PaidInFullDate")
# calendar months, spelled out so that both engines count the same way
RES_SQL = f"""{RAW_LOANS_SQL}, res as (select *, (year(resolved_on) - year(approved_on)) * 12 + month(resolved_on) - month(approved_on) mths from (
 select try_cast("ApprovalFY" as integer) fy, try_cast("ApprovalDate" as date) approved_on, trim("LoanStatus") status,
  case when trim("LoanStatus") = 'CHGOFF' then try_cast("ChargeOffDate" as date) else try_cast("PaidInFullDate" as date) end resolved_on
 from raw_loans where try_cast("GrossApproval" as double) > 0 and trim("LoanStatus") in ('P I F', 'CHGOFF'))),
 as_of as (select max(try_cast("AsOfDate" as date)) d from raw_loans)"""
IDENT_SQL = f"""{LOANS_SQL}, base as (select gross_approval amount, guaranteed / nullif(gross_approval, 0) share,
 processing_method as method, is_bad bad from loans where status in ('P I F', 'CHGOFF'))"""


def resolutions(spark, d):
    return L.resolutions(raw_loans(spark, d, *RESOLUTION_FIELDS), CFG)


def as_of(spark, d):
    return vintage_as_of(raw_loans(spark, d, "AsOfDate")).scalar()


def identification_base(spark, d):
    df = loans(spark, d, "status", "gross_approval", "guaranteed", "processing_method", "is_bad")
    return df.where(F.col("status").isin(list(CFG.resolved_statuses))).select(
        F.col("gross_approval").alias("amount"),
        S.ratio(F.col("guaranteed"), F.col("gross_approval")).alias("share"),
        F.col("processing_method").alias("method"), F.col("is_bad").alias("bad"))


FEATURE_SQL = f"""with {RAW_APPLICATIONS_SQL}, b as (
 select try_cast(activity_year as integer) as year, state_code state, derived_race race, try_cast(loan_amount as double) amount,
  try_cast(income as double) * 1000 income, case when action_taken = '3' then 1 else 0 end denied from raw_applications)
 select year, state, race, case when amount < 150000 then 'low' when amount < 400000 then 'medium' else 'high' end band,
  count(*) n, round(avg(denied), 6) denial_rate, round(avg(amount), 4) mean_amount, round(avg(income), 4) mean_income,
  round(avg(amount / nullif(income, 0)), 6) mean_loan_to_income
 from b where amount > 0 and income > 0 group by all"""


@query("feature_job", FEATURE_SQL)
def feature_job(spark, d):
    raw = raw_applications(spark, d, "activity_year", "state_code", "derived_race", "loan_amount", "income", "action_taken")
    return features.feature_job(raw).select(
        "year", "state", "race", "band", "n", r("denial_rate").alias("denial_rate"),
        r("mean_amount", 4).alias("mean_amount"), r("mean_income", 4).alias("mean_income"),
        r("mean_loan_to_income").alias("mean_loan_to_income"))


@query("denial_rates_by", f"""with {RAW_APPLICATIONS_SQL} select derived_race "group", count(*) n,
 round(avg(case when action_taken = '3' then 1e0 else 0 end), 6) denial_rate,
 round(median(try_cast(income as double)) * 1000e0, 4) median_income, round(median(try_cast(loan_amount as double)), 4) median_amount
 from raw_applications where derived_race is not null and derived_race not in ('Race Not Available', 'Joint', 'Free Form Text Only')
 group by 1 having count(*) >= 5000""")
def denial_rates_by(spark, d):
    raw = stage(raw_applications(spark, d, "derived_race", "action_taken", "income", "loan_amount"), "applications")
    t = fairness.denial_rates_by(raw, "derived_race", NON_GROUPS, 5000)
    return t.select("group", "n", r("denial_rate").alias("denial_rate"), *[r(c, 4).alias(c) for c in ("median_income", "median_amount")])


@query("disparity_over_time", f"""with {RAW_APPLICATIONS_SQL}, g as (select try_cast(activity_year as integer) as year, derived_race grp, count(*) n,
  avg(case when action_taken = '3' then 1e0 else 0 end) rate from raw_applications
  where derived_race not in ('Race Not Available', 'Joint', 'Free Form Text Only') group by 1, 2 having count(*) >= 200)
 select year, count(*) groups, round(min(1 - rate) / nullif(max(1 - rate), 0), 6) four_fifths_ratio, arg_max(grp, rate) most_denied,
  round((max(rate) - min(rate)) * 100, 6) gap_pp from g group by 1""")
def disparity_over_time(spark, d):
    raw = raw_applications(spark, d, "derived_race", "action_taken", "activity_year")
    return rounded(fairness.disparity_over_time(raw, "derived_race", NON_GROUPS, 200))


@query("cohort_resolution", f"""with {RAW_LOANS_SQL}, t as (select try_cast("ApprovalFY" as integer) fy, trim("LoanStatus") s from raw_loans
  where try_cast("GrossApproval" as double) > 0)
 select fy, count(*) n, round(100e0 * sum(case when s in ('P I F', 'CHGOFF') then 1 else 0 end) / count(*), 1) pct_resolved,
 round(100e0 * sum(case when s = 'CHGOFF' then 1 else 0 end) / nullif(sum(case when s in ('P I F', 'CHGOFF') then 1 else 0 end), 0), 2) pct_bad_of_resolved
 from t where fy is not null group by 1""")
def cohort_resolution(spark, d):
    return cohorts.resolution(raw_loans(spark, d, "LoanStatus", "GrossApproval", "ApprovalFY"), CFG)


_EMERGE = ", ".join(
    f"round(100e0 * sum(case when mths <= {m} then 1 else 0 end) / count(*), 1) pct_{m}m" for m in CFG.emergence_months)


@query("emergence_curve", f"with {RES_SQL} select fy, count(*) n_chargeoffs, {_EMERGE} from res "
       "where status = 'CHGOFF' and mths between 0 and 400 and fy between 1995 and 2000 group by 1")
def emergence_curve(spark, d):
    return cohorts.emergence(resolutions(spark, d), CFG, 1995, 2000)


@query("months_to_event", f"""with {RES_SQL} select count(*) n, {", ".join(
    f"round(quantile_cont(mths, {p}), 1) {c}" for p, c in ((0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90")))}
 from res where status = 'CHGOFF' and mths between 0 and 400""")
def months_to_event(spark, d):
    return cohorts.months_to_event(resolutions(spark, d), CFG)


OBS_SQL = """select fy, max(approved_on) last_approval, cast((year((select d from as_of)) - year(max(approved_on))) * 12
 + month((select d from as_of)) - month(max(approved_on)) as integer) months_observable
 from res where approved_on is not null and fy is not null group by 1"""


@query("observability", f"with {RES_SQL} {OBS_SQL}")
def observability(spark, d):
    return cohorts.observability(resolutions(spark, d), as_of(spark, d))


MATCHED_SQL = f"""{RES_SQL}, obs as ({OBS_SQL}), cells as (select fy, cast(w as integer) window_months,
  cast(sum(case when mths <= w then 1 else 0 end) as bigint) nr, cast(sum(case when mths <= w and status = 'CHGOFF' then 1 else 0 end) as bigint) nb
  from res, unnest([12, 24, 36, 48, 60]) t(w) where approved_on is not null and resolved_on is not null and fy >= 1995 group by 1, 2),
 matched as (select c.fy, window_months, case when o.months_observable >= window_months then nr end n_resolved,
  case when o.months_observable >= window_months then nb end n_chargeoffs,
  case when o.months_observable >= window_months then round(100e0 * nb / nullif(nr, 0), 6) end rate,
  o.months_observable >= window_months observable from cells c join obs o on c.fy = o.fy)"""


def matched(spark, d):
    return cohorts.matched_maturity(resolutions(spark, d), as_of(spark, d), CFG.maturity_windows, CFG.maturity_from, CFG.bad_status)


@query("matched_maturity", f"with {MATCHED_SQL} select * from matched")
def matched_maturity(spark, d):
    return rounded(matched(spark, d))


REFERENCE_SQL = """select cast(w as integer) window_months, round(100e0 * sum(case when mths <= w and status = 'CHGOFF' then 1 else 0 end)
  / nullif(sum(case when mths <= w then 1 else 0 end), 0), 2) rate
 from res, unnest([12, 24, 36, 48, 60]) t(w) where approved_on is not null and resolved_on is not null and fy between 1995 and 1997 group by 1"""


@query("reference_rates", f"with {RES_SQL} {REFERENCE_SQL}")
def reference_rates(spark, d):
    return cohorts.reference_rates(resolutions(spark, d), CFG.maturity_windows, *CFG.train, CFG.bad_status)


@query("treatment_r2", f"""with {IDENT_SQL}, b as (select *, floor(amount / 10000) cell from base where share is not null and method is not null and amount < 5000000),
 c as (select method, cell, avg(share) mu from b group by 1, 2), j as (select b.*, c.mu, (select avg(share) from b) g from b join c using (method, cell)),
 o as (select count(*) n, (select count(*) from c) cells, round(1 - sum(power(share - mu, 2)) / sum(power(share - g, 2)), 4) r2 from j)
 select *, r2 < 0.90 identifiable from o""")
def treatment_r2(spark, d):
    return identification.treatment_r2(identification_base(spark, d), 10_000, 5_000_000)


@query("level_mass", f"""with {IDENT_SQL} select count(distinct round(share, 4)) levels,
 round(100e0 * sum(case when round(share, 2) in (0.50, 0.75, 0.85, 0.90) then 1 else 0 end) / count(*), 2) pct_on_levels from base where share is not null""")
def level_mass(spark, d):
    return identification.level_mass(identification_base(spark, d), (0.50, 0.75, 0.85, 0.90))


# Test amounts stop near 105,000, so the threshold and its windows are scaled down.
@query("density_at_threshold", f"""with {IDENT_SQL} select cast(w as double) as "window", count(*) n, cast(sum(case when m = 50000 then 1 else 0 end) as bigint) n_at_threshold,
 round(100e0 * sum(case when m = 50000 then 1 else 0 end) / nullif(count(*), 0), 2) pct_at_threshold
 from (select round(amount / 500) * 500 m from base) x, unnest([500, 1000, 2500, 5000]) t(w) where abs(m - 50000) <= w group by 1""")
def density_at_threshold(spark, d):
    snapped = identification_base(spark, d).withColumn("amount", F.round(F.col("amount") / 500) * 500)
    return identification.density_at_threshold(snapped, 50_000, (500, 1000, 2500, 5000))


@query("gradient_decompose", f"""with {IDENT_SQL}, b as (select cast(floor(amount / 25000) as bigint) * 25000 amount_from, round(share, 2) g, bad from base
  where round(share, 2) in (0.75, 0.85) and amount < 1000000),
 t as (select amount_from, sum(case when g = 0.75 then 1 else 0 end) nl, sum(case when g = 0.85 then 1 else 0 end) nh,
  round(100e0 * avg(case when g = 0.85 then bad end) - 100e0 * avg(case when g = 0.75 then bad end), 2) dp from b group by 1
  having sum(case when g = 0.75 then 1 else 0 end) >= 200 and sum(case when g = 0.85 then 1 else 0 end) >= 200),
 w as (select coalesce(round(sum(dp * (nl + nh)) / sum(nl + nh), 2), 0) within_pp, cast(coalesce(sum(nl + nh), 0) as bigint) n_comparable from t),
 c as (select round(100e0 * avg(case when round(share, 2) = 0.85 then bad end) - 100e0 * avg(case when round(share, 2) = 0.75 then bad end), 2) raw_pp
  from base where round(share, 2) in (0.75, 0.85))
 select raw_pp, within_pp, n_comparable, coalesce(round(1 - within_pp / nullif(raw_pp, 0), 4), 0) explained_by_size from w, c""")
def gradient_decompose(spark, d):
    return identification.gradient_decompose(identification_base(spark, d), 0.75, 0.85, 25_000, 1_000_000, 200)


COVERAGE_SQL = f"""{LOANS_SQL}, cells as (select approval_fy fy, business_age a, count(*) n from loans group by 1, 2),
 tr as (select business_age a, count(*) * 1e0 / sum(count(*)) over () share from loans where approval_fy between 1995 and 1997 group by 1),
 mp as (select * from (values ('NEW-OLDER','NEW-OLDER'),('OLD-5PLUS','NEW-OLDER'),('OLD-3TO5','NEW-OLDER'),('OLD-2TO3','NEW-OLDER')) v(a, t)),
 ok as (select a from tr where share >= 0.005),
 okm as (select t from (select coalesce(mp.t, 'UNKNOWN') t, sum(share) s from tr left join mp using (a) group by 1) where s >= 0.005 and t <> 'UNKNOWN')"""


@query("vocab_coverage", f"""with {COVERAGE_SQL} select fy, cast(sum(n) as bigint) n,
 round(sum(case when a in (select a from ok) then n else 0 end) / sum(n), 6) supported_raw,
 round(sum(case when (select max(t) from mp where mp.a = cells.a) in (select t from okm) then n else 0 end) / sum(n), 6) supported_harmonised,
 round(sum(case when a in ('NEW-OLDER') then n else 0 end) / sum(n), 6) orphan_share from cells group by 1""")
def vocab_coverage(spark, d):
    df = loans(spark, d, "approval_fy", "business_age")
    train = df.where(F.col("approval_fy").between(*CFG.train))
    return rounded(vocabulary.coverage(
        df, train, year="approval_fy", category="business_age", mapping=PARTIAL_MAP,
        orphans=("NEW-OLDER",), min_support=CFG.min_support)).withColumnRenamed("approval_fy", "fy")


PORTFOLIO_SQL = f"""{LOANS_SQL}, book as (select loan_id, is_bad y, gross_approval exposure, is_bad * loss_if_bad loss,
 least(greatest(coalesce(guaranteed / nullif(gross_approval, 0), 0.75e0), 0e0), 1e0) share, score_a, score_b, initial_rate, jobs_supported, approval_fy
 from loans where status in ('P I F', 'CHGOFF') and split = 'test')"""


def portfolio(spark, d, *extra):
    """Resolved loans of the test window with exposure, realised loss and guaranteed share."""
    df = loans(spark, d, "loan_id", "status", "split", "is_bad", "gross_approval", "guaranteed", "loss_if_bad", "score_a", "score_b", *extra)
    return df.where(F.col("status").isin(list(CFG.resolved_statuses)) & (F.col("split") == "test")).select(
        "loan_id", F.col("is_bad").alias("y"), F.col("gross_approval").alias("exposure"),
        economics.loss_on_bad(F.col("is_bad"), F.col("loss_if_bad")).alias("loss"),
        economics.share_or_default(S.ratio(F.col("guaranteed"), F.col("gross_approval")), CFG.default_guarantee).alias("share"),
        "score_a", "score_b", *extra)


@query("portfolio_totals", f"""with {PORTFOLIO_SQL} select count(*) n, cast(sum(y) as bigint) n_bad, round(sum(exposure), 2) lent, round(sum(loss), 4) loss,
 round(avg(share), 6) mean_share, round(sum(loss * share), 2) loss_guarantor, round(sum(loss * (1 - share)), 2) loss_lender,
 round(sum(loss) / sum(exposure), 6) breakeven_gross, round(sum(loss * (1 - share)) / sum(exposure), 6) breakeven_lender from book""")
def portfolio_totals(spark, d):
    t = economics.portfolio_totals(portfolio(spark, d), "y", "exposure", "loss", "share")
    return t.select("n", "n_bad", r("loss", 4).alias("loss"), *[r(c, 2).alias(c) for c in ("lent", "loss_guarantor", "loss_lender")],
                    *[r(c).alias(c) for c in ("mean_share", "breakeven_gross", "breakeven_lender")])


CATEGORY_SQL = """select feature, coalesce(category, 'NULO') category, count(*) n, round(count(*) * 1e0 / sum(count(*)) over (partition by feature), 6) share"""


@query("category_shares", f"""with {RAW_LOANS_SQL}, long as (
 select 'rate_type' feature, trim("FixedorVariableInterestInd") category from raw_loans
 union all select 'business_type', trim("BusinessType") from raw_loans union all select 'franchise', "FranchiseCode" from raw_loans)
 {CATEGORY_SQL} from long group by 1, 2""")
def category_shares(spark, d):
    from loanlens.operators.drift import category_shares as shares

    raw = raw_loans(spark, d, "FixedorVariableInterestInd", "BusinessType", "FranchiseCode").select(
        F.trim("FixedorVariableInterestInd").alias("rate_type"), F.trim("BusinessType").alias("business_type"),
        F.col("FranchiseCode").alias("franchise"))
    return rounded(shares(raw, ("rate_type", "business_type", "franchise")))


ARMS_SQL = """cases as (select doc_id, lang, source arm, length(text) n_letters, coalesce(quality, 0) quality, coalesce(toxic, 0) toxic
 from documents left join labels using (doc_id))"""


def arm_cases(spark, d):
    """Each document is one measured case, its source the arm; labels give the flags."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", F.length("text").alias("n_letters"))
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "lang", F.col("source").alias("arm"), "n_letters",
        F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("arm_summary", f"""with {ARMS_SQL} select arm, count(*) cases, round(avg(quality), 4) quality, round(avg(toxic), 4) toxic,
 round(avg(n_letters), 4) n_letters from cases group by 1""")
def arm_summary(spark, d):
    return notices.arm_summary(arm_cases(spark, d), "arm", ("quality", "toxic", "n_letters"), "quality")


@query("mode_value", f"""with {ARMS_SQL}, c as (select arm, lang, count(*) k from cases group by 1, 2)
 select arm, lang most_common from c qualify row_number() over (partition by arm order by k desc, lang) = 1""")
def mode_value(spark, d):
    return notices.most_common(arm_cases(spark, d), "arm", "lang").withColumnRenamed("lang", "most_common")


__all__ = ["n"]
