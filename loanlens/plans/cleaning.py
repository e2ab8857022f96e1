"""Projections, filters and cleaning (survey 2.2), and the panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.config import APPLICATION_CATEGORICAL, APPLICATION_NUMERIC, PROTECTED, TESTBED as CFG
from loanlens.functions import scalar as S
from loanlens.operators import features
from loanlens.plans.registry import n, query, r, rounded
from loanlens.sources import applications as A
from loanlens.sources import loans as L
from loanlens.sources.testbed import (
    LOANS_SQL, RAW_APPLICATIONS_SQL, RAW_LOANS_SQL, loans, raw_applications, raw_loans,
)

PANEL_SQL = f"""{RAW_LOANS_SQL}, typed as (
 select *, trim("LoanStatus") status, try_cast("GrossApproval" as double) amount,
  try_cast("SBAGuaranteedApproval" as double) guaranteed, try_cast("ApprovalFY" as integer) fy
 from raw_loans), booked as (
 select * from typed where amount > 0 and try_cast("TermInMonths" as double) > 0 and trim("Program") not in ('PPP')),
 every_panel as (select
  case when status = 'CHGOFF' then 1 else 0 end is_chargeoff,
  try_cast("GrossChargeOffAmount" as double) chargeoff_amount, fy approval_fy,
  amount gross_approval, guaranteed sba_guaranteed,
  try_cast("InitialInterestRate" as double) initial_rate, try_cast("JobsSupported" as double) jobs_supported,
  guaranteed / nullif(amount, 0) guarantee_pct, ln(amount) log_gross_approval,
  substr(trim("NaicsCode"), 1, 2) naics_sector,
  case when coalesce(trim("FranchiseCode"), '') <> '' then 1 else 0 end has_franchise,
  trim("BusinessType") business_type, trim("BusinessAge") business_age, trim("RevolverStatus") revolver_status,
  trim("CollateralInd") collateral_ind, trim("FixedorVariableInterestInd") rate_type,
  trim("ProcessingMethod") processing_method, trim("BorrState") borrower_state, status, "LoanNumber" loan_id
 from booked where fy is not null),
 panel as (select * exclude (status) from every_panel where status in ('P I F', 'CHGOFF')),
 open_panel as (select * exclude (status) from every_panel where status not in ('CANCLD'))"""

DTI_SQL = """case debt_to_income_ratio when '<20%' then 15e0 when '20%-<30%' then 25e0 when '30%-<36%' then 33e0
 when '50%-60%' then 55e0 when '>60%' then 65e0 else try_cast(debt_to_income_ratio as double) end"""
AGE_SQL = """case applicant_age when '<25' then 22e0 when '25-34' then 30e0 when '35-44' then 40e0 when '45-54' then 50e0
 when '55-64' then 60e0 when '65-74' then 70e0 when '>74' then 80e0 end"""

APPLICATIONS_SQL = f"""{RAW_APPLICATIONS_SQL}, apps as (select
  try_cast(activity_year as integer) activity_year, case when action_taken = '3' then 1 else 0 end is_denied,
  derived_race race, derived_ethnicity ethnicity, derived_sex sex, applicant_age age_bucket, {AGE_SQL} age,
  try_cast(loan_amount as double) loan_amount, try_cast(income as double) * 1000e0 income, {DTI_SQL} dti,
  try_cast(loan_to_value_ratio as double) ltv, try_cast(property_value as double) property_value,
  try_cast(loan_amount as double) / nullif(try_cast(income as double) * 1000e0, 0) loan_to_income,
  ln(nullif(try_cast(loan_amount as double), 0)) log_loan_amount,
  try_cast(tract_to_msa_income_percentage as double) tract_to_msa_income_percentage,
  try_cast(tract_owner_occupied_units as double) tract_owner_occupied_units,
  try_cast(ffiec_msa_md_median_family_income as double) msa_median_income,
  state_code, loan_type, loan_purpose, lien_status, occupancy_type, construction_method, conforming_loan_limit,
  preapproval, "open-end_line_of_credit" open_end_line, business_or_commercial_purpose business_purpose,
  derived_dwelling_category dwelling_category, derived_loan_product_type loan_product_type, submission_of_application
 from raw_applications where try_cast(loan_amount as double) > 0 and try_cast(income as double) is not null)"""


def panel(spark, d):
    return L.loan_panel(raw_loans(spark, d), CFG)


def applications(spark, d):
    return A.application_panel(raw_applications(spark, d))


def _round_sql(dtypes: list[tuple[str, str]]) -> str:
    return ", ".join(f"round({c}, 6) {c}" if t == "double" else c for c, t in dtypes)


_PANEL_ROUND = _round_sql([
    (c, "double" if c in ("chargeoff_amount", "gross_approval", "sba_guaranteed", "initial_rate",
                          "jobs_supported", "guarantee_pct", "log_gross_approval") else "string")
    for c in L.PANEL_COLUMNS])
_APP_DOUBLES = (*APPLICATION_NUMERIC, "age")
_APP_ROUND = _round_sql([
    (c, "double" if c in _APP_DOUBLES else "string")
    for c in ("activity_year", "is_denied", *PROTECTED, *APPLICATION_NUMERIC, *APPLICATION_CATEGORICAL)])


@query("panel_loans", f"with {PANEL_SQL} select {_PANEL_ROUND} from panel")
def panel_loans(spark, d):
    return rounded(panel(spark, d))


@query("panel_applications", f"with {APPLICATIONS_SQL} select {_APP_ROUND} from apps")
def panel_applications(spark, d):
    return rounded(applications(spark, d))


@query("cast_tolerant", f"""with {RAW_LOANS_SQL} select count(*) n_rows,
 count(try_cast("GrossApproval" as double)) amounts, count(try_cast("ApprovalFY" as integer)) as years,
 count(try_cast("ApprovalDate" as date)) as dates, count(try_cast("InitialInterestRate" as double)) as rates,
 round(sum(try_cast("GrossApproval" as double)), 2) amount_sum, max(try_cast("ApprovalDate" as date)) last_date
 from raw_loans""")
def cast_tolerant(spark, d):
    raw = raw_loans(spark, d, "GrossApproval", "ApprovalFY", "ApprovalDate", "InitialInterestRate")
    return raw.agg(
        n().alias("n_rows"),
        F.count(S.to_double("GrossApproval")).alias("amounts"),
        F.count(S.to_int("ApprovalFY")).alias("years"),
        F.count(S.to_date("ApprovalDate")).alias("dates"),
        F.count(S.to_double("InitialInterestRate")).alias("rates"),
        r(F.sum(S.to_double("GrossApproval")), 2).alias("amount_sum"),
        F.max(S.to_date("ApprovalDate")).alias("last_date"),
    )


@query("filter_status_sets", f"""with {RAW_LOANS_SQL} select trim("LoanStatus") status,
 count(*) filter (trim("LoanStatus") in ('P I F', 'CHGOFF')) resolved, count(*) filter (trim("LoanStatus") not in ('CANCLD')) booked,
 count(*) filter (trim("Program") not in ('PPP')) in_program from raw_loans group by 1""")
def filter_status_sets(spark, d):
    raw = raw_loans(spark, d, "LoanStatus", "Program")
    status = F.trim("LoanStatus")
    return raw.groupBy(status.alias("status")).agg(
        F.count_if(status.isin(list(CFG.resolved_statuses))).alias("resolved"),
        F.count_if(~status.isin(list(CFG.not_booked_statuses))).alias("booked"),
        F.count_if(~F.trim("Program").isin(list(CFG.excluded_programs))).alias("in_program"),
    )


@query("filter_positive", f"""with {RAW_LOANS_SQL} select "LoanNumber" loan_id, try_cast("GrossApproval" as double) amount
 from raw_loans where try_cast("GrossApproval" as double) > 0 and try_cast("TermInMonths" as double) > 0""")
def filter_positive(spark, d):
    raw = raw_loans(spark, d, "LoanNumber", "GrossApproval", "TermInMonths")
    return raw.where((S.to_double("GrossApproval") > 0) & (S.to_double("TermInMonths") > 0)).select(
        F.col("LoanNumber").alias("loan_id"), S.to_double("GrossApproval").alias("amount"))


@query("target_flag", f"""with {RAW_LOANS_SQL}, {RAW_APPLICATIONS_SQL}
 select 'loans' source, count(*) n_rows, cast(sum(case when trim("LoanStatus") = 'CHGOFF' then 1 else 0 end) as bigint) positives from raw_loans
 union all select 'applications', count(*), cast(sum(case when action_taken = '3' then 1 else 0 end) as bigint) from raw_applications""")
def target_flag(spark, d):
    loan = raw_loans(spark, d, "LoanStatus").agg(
        n().alias("n_rows"), n(S.flag(F.trim("LoanStatus") == CFG.bad_status)).alias("positives"))
    app = raw_applications(spark, d, "action_taken").agg(
        n().alias("n_rows"), n(S.flag(F.col("action_taken") == "3")).alias("positives"))
    return loan.select(F.lit("loans").alias("source"), "*").unionByName(
        app.select(F.lit("applications").alias("source"), "*"))


@query("ratio_guarded", f"""with {APPLICATIONS_SQL}, {RAW_LOANS_SQL}
 select 'guarantee' ratio, count(*) n_rows, count(x) known, round(avg(x), 6) mean from (
  select try_cast("SBAGuaranteedApproval" as double) / nullif(try_cast("GrossApproval" as double), 0) x from raw_loans)
 union all select 'loan_to_income', count(*), count(loan_to_income), round(avg(loan_to_income), 6) from apps""")
def ratio_guarded(spark, d):
    def part(name, df, c):
        return df.select(c.alias("x")).agg(
            n().alias("n_rows"), F.count("x").alias("known"), r(F.avg("x")).alias("mean")
        ).select(F.lit(name).alias("ratio"), "*")

    raw = raw_loans(spark, d, "SBAGuaranteedApproval", "GrossApproval")
    guarantee = S.ratio(S.to_double("SBAGuaranteedApproval"), S.to_double("GrossApproval"))
    return part("guarantee", raw, guarantee).unionByName(
        part("loan_to_income", applications(spark, d), F.col("loan_to_income")))


@query("log_amount", f"""with {RAW_LOANS_SQL} select "LoanNumber" loan_id,
 round(ln(nullif(try_cast("GrossApproval" as double), 0)), 6) log_amount from raw_loans""")
def log_amount(spark, d):
    return raw_loans(spark, d, "LoanNumber", "GrossApproval").select(
        F.col("LoanNumber").alias("loan_id"), r(S.log_amount(S.to_double("GrossApproval"))).alias("log_amount"))


@query("code_prefix", f"""with {RAW_LOANS_SQL} select substr(trim("NaicsCode"), 1, 2) sector, count(*) loans from raw_loans group by 1""")
def code_prefix(spark, d):
    return raw_loans(spark, d, "NaicsCode").groupBy(S.code_prefix("NaicsCode").alias("sector")).agg(n().alias("loans"))


@query("presence_flag", f"""with {RAW_LOANS_SQL} select case when coalesce(trim("FranchiseCode"), '') <> '' then 1 else 0 end present,
 count(*) loans, count("FranchiseCode") non_null from raw_loans group by 1""")
def presence_flag(spark, d):
    return raw_loans(spark, d, "FranchiseCode").groupBy(
        S.presence_flag("FranchiseCode").alias("present")
    ).agg(n().alias("loans"), F.count("FranchiseCode").alias("non_null"))


@query("bucket_midpoint", f"""with {RAW_APPLICATIONS_SQL} select debt_to_income_ratio reported, {DTI_SQL} dti, count(*) applications
 from raw_applications group by 1, 2""")
def bucket_midpoint(spark, d):
    return raw_applications(spark, d, "debt_to_income_ratio").groupBy(
        F.col("debt_to_income_ratio").alias("reported"), A.dti().alias("dti")).agg(n().alias("applications"))


@query("sentinel_null", f"""with {RAW_APPLICATIONS_SQL} select applicant_age reported, {AGE_SQL} age, count(*) applications
 from raw_applications group by 1, 2""")
def sentinel_null(spark, d):
    return raw_applications(spark, d, "applicant_age").groupBy(
        F.col("applicant_age").alias("reported"), A.age().alias("age")).agg(n().alias("applications"))


@query("unit_scale", f"""with {RAW_APPLICATIONS_SQL} select derived_sex sex, count(try_cast(income as double) * 1000e0) known,
 round(avg(try_cast(income as double) * 1000e0), 4) mean_income, round(min(try_cast(income as double) * 1000e0), 4) lowest
 from raw_applications group by 1""")
def unit_scale(spark, d):
    raw = raw_applications(spark, d, "derived_sex", "income")
    return raw.select(F.col("derived_sex").alias("sex"), A.income_dollars().alias("x")).groupBy("sex").agg(
        F.count("x").alias("known"), r(F.avg("x"), 4).alias("mean_income"), r(F.min("x"), 4).alias("lowest"))


@query("amount_band", f"""with {APPLICATIONS_SQL} select case when loan_amount < 150000 then 'low' when loan_amount < 400000 then 'medium' else 'high' end band,
 count(*) applications, round(min(loan_amount), 4) lowest, round(max(loan_amount), 4) highest from apps group by 1""")
def amount_band(spark, d):
    return applications(spark, d).groupBy(features.amount_band(F.col("loan_amount")).alias("band")).agg(
        n().alias("applications"), r(F.min("loan_amount"), 4).alias("lowest"), r(F.max("loan_amount"), 4).alias("highest"))


@query("originations_unfiltered", f"""with {PANEL_SQL} select
 {_PANEL_ROUND.replace('is_chargeoff, round(chargeoff_amount, 6) chargeoff_amount, ', '')} from open_panel where approval_fy between 1998 and 2001""")
def originations_unfiltered(spark, d):
    return rounded(L.originations(raw_loans(spark, d), CFG, CFG.watch_from, 2001))


@query("split_out_of_time", f"""with {PANEL_SQL} select case when approval_fy between 1995 and 1997 then 'train'
 when approval_fy = 1998 then 'valid' when approval_fy between 1999 and 2000 then 'test' end split,
 count(*) loans, cast(sum(is_chargeoff) as bigint) bad, min(approval_fy) first_fy, max(approval_fy) last_fy from panel group by 1""")
def split_out_of_time(spark, d):
    return L.with_split(panel(spark, d), CFG).groupBy("split").agg(
        n().alias("loans"), n("is_chargeoff").alias("bad"),
        F.min("approval_fy").alias("first_fy"), F.max("approval_fy").alias("last_fy"))


def _draw_sql(key):
    return f"cast('0x' || substr(md5(concat_ws('|', {key}, '{CFG.seed}')), 1, 12) as bigint)"


@query("sample_bernoulli", f"""with {LOANS_SQL}, k as (select *, {_draw_sql('loan_id')} % 1000000 u from loans), s as (
 {" union all ".join(f"select '{s}' split, is_denied from k where approval_fy between {w[0]} and {w[1]} and u < {int(round(dict(CFG.sample_pct)[s] * 10_000))}"
                     for s, w in (("train", CFG.application_train), ("valid", CFG.application_valid), ("test", CFG.application_test)))})
 select split, count(*) sampled, round(avg(is_denied), 6) denial_rate from s group by split""")
def sample_bernoulli(spark, d):
    keyed = loans(spark, d, "loan_id", "approval_fy", "is_denied")
    windows = (("train", *CFG.application_train), ("valid", *CFG.application_valid), ("test", *CFG.application_test))
    picked = A.sample_split(keyed, windows, dict(CFG.sample_pct), ["loan_id"], CFG.seed, "approval_fy")
    return picked.groupBy("split").agg(n().alias("sampled"), r(F.avg("is_denied")).alias("denial_rate"))


@query("sample_n", f"""with {LOANS_SQL} select loan_id, score_a, score_b from loans
 order by {_draw_sql('loan_id')}, loan_id, score_a, score_b limit 20000""")
def sample_n(spark, d):
    return A.sample_n(loans(spark, d, "loan_id", "score_a", "score_b"), ["loan_id"], 20_000, CFG.seed)


@query("project_features_guarded", f"""with {APPLICATIONS_SQL} select
 {_round_sql([(c, 'double' if c in _APP_DOUBLES else 's') for c in (*APPLICATION_NUMERIC, *APPLICATION_CATEGORICAL)])} from apps""")
def project_features_guarded(spark, d):
    return rounded(features.project_guarded(
        applications(spark, d), (*APPLICATION_NUMERIC, *APPLICATION_CATEGORICAL),
        forbidden=("is_denied", "activity_year"), protected=PROTECTED))


@query("harmonize_vocab", f"""with {LOANS_SQL} select business_age raw_age, case business_age when 'NEW-OLDER' then 'NEW-OLDER'
 when 'OLD-5PLUS' then 'NEW-OLDER' when 'OLD-3TO5' then 'NEW-OLDER' when 'OLD-2TO3' then 'NEW-OLDER' else 'UNKNOWN' end harmonised,
 count(*) loans from loans group by 1, 2""")
def harmonize_vocab(spark, d):
    from loanlens.operators.vocabulary import harmonise

    return loans(spark, d, "business_age").groupBy(
        F.col("business_age").alias("raw_age"), harmonise("business_age", PARTIAL_MAP).alias("harmonised")
    ).agg(n().alias("loans"))


# Test-table stand-in for the vocabulary change; STARTUP has no entry on purpose.
PARTIAL_MAP = {k: "NEW-OLDER" for k in ("NEW-OLDER", "OLD-5PLUS", "OLD-3TO5", "OLD-2TO3")}


@query("floor_cells", f"""with {LOANS_SQL} select cast(floor(gross_approval / 10000) as bigint) cell, count(*) loans,
 round(sum(gross_approval), 2) amount from loans group by 1""")
def floor_cells(spark, d):
    return loans(spark, d, "gross_approval").groupBy(
        F.floor(F.col("gross_approval") / 10_000).alias("cell")
    ).agg(n().alias("loans"), r(F.sum("gross_approval"), 2).alias("amount"))


@query("clamp_default", f"""with {PANEL_SQL}, x as (select case when loan_id like '%1' then null
 when loan_id like '%2' then 1.4e0 else guarantee_pct end g, is_chargeoff, chargeoff_amount from panel)
 select is_chargeoff, count(*) loans, round(avg(least(greatest(coalesce(g, 0.75), 0e0), 1e0)), 6) mean_share,
 round(sum(coalesce(chargeoff_amount, 0e0) * is_chargeoff), 4) loss from x group by 1""")
def clamp_default(spark, d):
    from loanlens.operators.economics import loss_on_bad, share_or_default

    raw = raw_loans(spark, d)
    keep = L.population(CFG, resolved=True) & S.to_int("ApprovalFY").isNotNull()
    share = S.ratio(S.to_double("SBAGuaranteedApproval"), S.to_double("GrossApproval"))
    key = F.col("LoanNumber")
    x = raw.where(keep).select(
        F.when(key.endswith("1"), None).when(key.endswith("2"), 1.4).otherwise(share).alias("g"),
        S.flag(F.trim("LoanStatus") == CFG.bad_status).alias("is_chargeoff"),
        S.to_double("GrossChargeOffAmount").alias("amount"))
    return x.groupBy("is_chargeoff").agg(
        n().alias("loans"),
        r(F.avg(share_or_default(F.col("g"), CFG.default_guarantee))).alias("mean_share"),
        r(F.sum(loss_on_bad(F.col("is_chargeoff"), F.col("amount"))), 4).alias("loss"))
