"""Drift and the retraining decision (survey 2.8). Reference: booked loans of the training years."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.config import LOAN_CATEGORICAL, LOAN_NUMERIC, TESTBED as CFG
from loanlens.operators import cohorts, drift
from loanlens.plans.aggregates import MATCHED_SQL, REFERENCE_SQL, as_of, matched, resolutions
from loanlens.plans.registry import n, query, r, rounded
from loanlens.session import settle
from loanlens.sources.files import stage
from loanlens.sources.testbed import LOAN_COLUMNS, cte, loans

NUM, CAT = LOAN_NUMERIC, LOAN_CATEGORICAL
READ = ("gross_approval", "guaranteed", "initial_rate", "jobs_supported", "business_age", "processing_method", "collateral_ind",
        "NaicsCode", "BusinessType", "RevolverStatus", "FixedorVariableInterestInd", "BorrState", "FranchiseCode")
#: Features that a booked loan's other columns give, as expressions that both engines read. The share is rounded, as
#: values that differ in their last bit would make different edges.
DERIVED = {
    "sba_guaranteed": "guaranteed",
    "guarantee_pct": "round(guaranteed / nullif(gross_approval, 0), 6)",
    "log_gross_approval": "ln(gross_approval)",
    "naics_sector": "substr(trim(NaicsCode), 1, 2)",
    "business_type": "trim(BusinessType)",
    "revolver_status": "trim(RevolverStatus)",
    "rate_type": "trim(FixedorVariableInterestInd)",
    "borrower_state": "trim(BorrState)",
    "has_franchise": "cast(case when coalesce(trim(FranchiseCode), '') <> '' then 1 else 0 end as string)",
}
PROBS = ", ".join(str(i / 10) for i in range(11))


def population(spark, d):
    """Booked loans, written once: profiles, features and scores all read it."""
    booked = loans(spark, d, "approval_fy", "status", "score_a", *READ).where(~F.col("status").isin(list(CFG.not_booked_statuses)))
    wide = booked.withColumns({c: F.expr(e) for c, e in DERIVED.items()})
    return stage(wide.select("approval_fy", "status", "score_a", *NUM, *CAT), "booked")


def training(pop):
    return pop.where(F.col("approval_fy").between(*CFG.train))


def watched(pop):
    return pop.where(F.col("approval_fy") >= CFG.watch_from)


POP_SQL = f"""{cte("loans", *dict.fromkeys([*LOAN_COLUMNS, *READ]))}, pop as (select *, {", ".join(f"{e} {c}" for c, e in DERIVED.items())}
  from loans where status not in ('CANCLD')), tr as (select * from pop where approval_fy between 1995 and 1997),
 wa as (select * from pop where approval_fy >= 1998),
 numl as (select approval_fy, feature, v from (unpivot (select approval_fy, {", ".join(f"cast({c} as double) {c}" for c in NUM)} from pop)
  on {", ".join(NUM)} into name feature value v)),
 catl as (select approval_fy, feature, category from (unpivot (select approval_fy, {", ".join(f"coalesce({c}, 'NULO') {c}" for c in CAT)} from pop)
  on {", ".join(CAT)} into name feature value category)),
 scol as (select approval_fy, 'score' feature, least(greatest(score_a, 1e-6), 1 - 1e-6) v from pop),
 alln as (select * from numl union all select * from scol),
 edges as (select feature, list_sort(list_distinct(quantile_cont(v, [{PROBS}]))) edges from alln where approval_fy between 1995 and 1997 group by feature),
 grid as (select feature, edges, unnest(range(len(edges) - 1)) bin from edges),
 refbin as (select feature, len(list_filter(edges[2:len(edges) - 1], lambda x: x <= v)) bin, count(*) c from alln join edges using (feature)
  where approval_fy between 1995 and 1997 group by 1, 2),
 prof as (select feature, bin, coalesce(c, 0) * 1e0 / sum(coalesce(c, 0)) over (partition by feature) share from grid left join refbin using (feature, bin)),
 refcat as (select feature, category, count(*) * 1e0 / sum(count(*)) over (partition by feature) share from catl where approval_fy between 1995 and 1997 group by 1, 2)"""


def _psi_num(source: str, name: str) -> str:
    return f"""{name}_c as (select approval_fy, feature, len(list_filter(edges[2:len(edges) - 1], lambda x: x <= v)) bin, count(*) c
  from {source} join edges using (feature) group by 1, 2, 3),
 {name}_k as (select distinct approval_fy, feature from {name}_c),
 {name}_s as (select k.approval_fy, k.feature, p.bin, p.share e, coalesce(c.c, 0) * 1e0 / sum(coalesce(c.c, 0)) over (partition by k.approval_fy, k.feature) a
  from {name}_k k join prof p on p.feature = k.feature left join {name}_c c on c.approval_fy = k.approval_fy and c.feature = k.feature and c.bin = p.bin),
 {name} as (select approval_fy, feature, sum((greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6))) psi from {name}_s group by 1, 2)"""


PSI_NUM_SQL = f"{POP_SQL}, watchn as (select * from numl where approval_fy >= 1998), {_psi_num('watchn', 'pnum')}"
PSI_CAT_SQL = f"""obsc as (select approval_fy, feature, category, count(*) * 1e0 / sum(count(*)) over (partition by approval_fy, feature) obs
  from catl where approval_fy >= 1998 group by 1, 2, 3),
 refx as (select k.approval_fy, r.* from (select distinct approval_fy, feature from obsc) k join refcat r on r.feature = k.feature),
 bothc as (select coalesce(o.approval_fy, r.approval_fy) approval_fy, coalesce(o.feature, r.feature) feature, coalesce(o.category, r.category) category,
  coalesce(r.share, 0) ref, coalesce(obs, 0) obs, r.share is null unseen from obsc o full join refx r
  on o.approval_fy = r.approval_fy and o.feature = r.feature and o.category = r.category),
 newm as (select approval_fy, feature, sum(case when unseen then obs else 0 end) nm,
  sum(case when not unseen then (greatest(obs, 1e-6) - greatest(ref, 1e-6)) * ln(greatest(obs, 1e-6) / greatest(ref, 1e-6)) else 0 end) kn,
  sum(case when ref < 0.005 then obs else 0 end) unsupported from bothc group by 1, 2),
 pcat as (select approval_fy, feature, kn + case when nm > 0 then (nm - 1e-6) * ln(nm / 1e-6) else 0 end psi, unsupported from newm)"""
BAND_SQL = """case when unsupported >= 0.05 then 'VOCABULARY' when psi < 0.10 then 'stable' when psi < 0.25 then 'watch' else 'ACTION' end"""
FEATURES_SQL = f"""{PSI_NUM_SQL}, {PSI_CAT_SQL}, feats as (select *, {BAND_SQL} band from (
 select approval_fy, feature, 'numeric' kind, psi, 0e0 unsupported from pnum
 union all select approval_fy, feature, 'categorical', psi, unsupported from pcat))"""
_LG = "ln(v / (1 - v))"
SCORE_SQL = f"""refm as (select avg({_LG}) m from scol where approval_fy between 1995 and 1997),
 shift as (select approval_fy, avg({_LG}) - (select m from refm) logit_shift from scol where approval_fy >= 1998 group by 1),
 sraw as (select * from scol where approval_fy >= 1998),
 smov as (select approval_fy, feature, 1 / (1 + exp(-({_LG} - logit_shift))) v from sraw join shift using (approval_fy)),
 {_psi_num('sraw', 'pst')}, {_psi_num('smov', 'pss')},
 sd as (select approval_fy, pst.psi psi_total, pss.psi psi_shape, logit_shift, case when pst.psi < 0.10 then 'stable' when pss.psi < 0.10
  then 'level moved: recalibrate' else 'shape changed: consider retraining' end reading from pst join pss using (approval_fy) join shift using (approval_fy))"""


def numeric_profile(pop):
    return settle(drift.numeric_profile(drift.numeric_long(training(pop), NUM), CFG.n_bins))


def categorical_profile(pop):
    return settle(drift.categorical_profile(training(pop), CAT))


def score_profile(pop):
    return settle(drift.score_profile(training(pop), "score_a", CFG.n_bins))


def features(pop):
    return drift.feature_drift(watched(pop), numeric_profile(pop), categorical_profile(pop), NUM, CAT, CFG, ["approval_fy"])


def scores(pop):
    return drift.score_drift(watched(pop), "score_a", score_profile(pop), CFG.psi_warn, ["approval_fy"])


@query("build_reference", f"""with {POP_SQL} select feature, bin, lo, hi, share from (
 select feature, cast(bin as integer) bin, round(case when bin > 0 then edges[bin + 1] end, 6) lo,
 round(case when bin < len(edges) - 2 then edges[bin + 2] end, 6) hi, round(share, 6) share
 from prof join edges using (feature))""")
def build_reference(spark, d):
    pop = population(spark, d)
    both = numeric_profile(pop).unionByName(score_profile(pop))
    long = drift.profile_long(both)
    finite = lambda c: F.when(F.abs(c) != float("inf"), F.col(c))
    return rounded(long.select("feature", "bin", finite("lo").alias("lo"), finite("hi").alias("hi"), "share"))


@query("psi_numeric_profile", f"with {PSI_NUM_SQL} select approval_fy, feature, round(psi, 6) psi from pnum")
def psi_numeric_profile(spark, d):
    pop = population(spark, d)
    long = drift.numeric_long(watched(pop), NUM, ["approval_fy"])
    return rounded(drift.psi_numeric(long, numeric_profile(pop), ["approval_fy"]))


@query("psi_categorical", f"with {POP_SQL}, {PSI_CAT_SQL} select approval_fy, feature, round(psi, 6) psi, round(unsupported, 6) unsupported from pcat")
def psi_categorical(spark, d):
    pop = population(spark, d)
    seen = drift.category_shares(watched(pop), CAT, ["approval_fy"])
    return rounded(drift.psi_categorical(seen, categorical_profile(pop), CFG.min_support, ["approval_fy"]))


@query("score_drift", f"""with {POP_SQL}, {SCORE_SQL} select approval_fy, round(psi_total, 6) psi_total, round(psi_shape, 6) psi_shape,
 round(logit_shift, 6) logit_shift, reading from sd""")
def score_drift(spark, d):
    return rounded(scores(population(spark, d)))


@query("drift_bands", f"with {FEATURES_SQL} select approval_fy, feature, kind, round(psi, 6) psi, round(unsupported, 6) unsupported, band from feats")
def drift_bands(spark, d):
    return rounded(features(population(spark, d))).orderBy("approval_fy", F.col("unsupported").desc(), F.col("psi").desc())


@query("drift_by_cohort", f"""with {FEATURES_SQL}, {SCORE_SQL}, vol as (select approval_fy, count(*) n from wa group by 1),
 w as (select approval_fy, feature, psi from feats qualify row_number() over (partition by approval_fy order by unsupported desc, psi desc, feature desc) = 1),
 i as (select approval_fy, string_agg(feature, ',' order by feature) filter (psi >= 0.25) in_action,
  string_agg(feature, ',' order by feature) filter (unsupported >= 0.05) without_support from feats group by 1)
 select approval_fy, n, w.feature worst_feature, round(w.psi, 6) worst_psi, coalesce(in_action, '') in_action, coalesce(without_support, '') without_support,
 round(psi_total, 6) psi_total, round(psi_shape, 6) psi_shape, round(logit_shift, 6) logit_shift, reading
 from vol join w using (approval_fy) join i using (approval_fy) left join sd using (approval_fy)""")
def drift_by_cohort(spark, d):
    pop = population(spark, d)
    volumes = watched(pop).groupBy("approval_fy").agg(n().alias("n"))
    table = drift.drift_by_cohort(features(pop), scores(pop), volumes, "approval_fy", CFG)
    return rounded(table.withColumn("in_action", F.array_join("in_action", ",")).withColumn(
        "without_support", F.array_join(F.map_keys("unsupported"), ",")).drop("unsupported"))


@query("stale_profile_guard", f"""with {POP_SQL}, f as (select distinct feature from numl where approval_fy between 1995 and 1997 and v is not null)
 select feature, '{CFG.fingerprint()}' fingerprint, false refused from f union all select feature, repeat('0', 16), true from f""")
def stale_profile_guard(spark, d):
    """The profile as it is stored and a copy that other settings built; the second is refused, as data and when used."""
    stored = numeric_profile(population(spark, d)).select("feature", F.explode(F.array(
        F.lit(CFG.fingerprint()), F.lit("0" * 16))).alias("fingerprint"))
    return drift.with_refusal(stored, CFG)


TRIG_VOC_SQL = """tv as (select 'vocabulary' as trigger, count(*) > 0 fired, coalesce(string_agg(printf('%s %.3f', feature, mass), ', ' order by mass desc, feature),
 'no unsupported category') detail from (select feature, max(unsupported) mass from feats where unsupported >= 0.05 group by 1))"""
TRIG_SHAPE_SQL = """ts as (select 'score_shape' as trigger, max(psi_shape) >= 0.10 fired,
 printf('shape PSI %.4f in %d', max(psi_shape), arg_max(approval_fy, psi_shape)) detail from sd)"""
TRIG_MAT_SQL = f"""refr as ({REFERENCE_SQL}), yng as (select max(fy) fy, arg_max(rate, fy) rate, (select rate from refr where window_months = 24) ref
  from matched where window_months = 24 and observable and rate is not null),
 tm as (select 'matched_maturity' as trigger, coalesce(abs((rate - ref) / ref) > 0.32, false) fired,
 coalesce(printf('%d at %dm: %.2f vs %.2f', fy, 24, rate, ref), 'no cohort reaches the window') detail from yng)"""


def vocabulary_trigger(spark, d, pop=None):
    return drift.trigger_vocabulary(features(pop or population(spark, d)), CFG)


def shape_trigger(spark, d, pop=None):
    return drift.trigger_score_shape(scores(pop or population(spark, d)), "approval_fy", CFG)


def maturity_trigger(spark, d):
    ref = cohorts.reference_rates(resolutions(spark, d), CFG.maturity_windows, *CFG.train, CFG.bad_status)
    return drift.trigger_maturity(matched(spark, d), ref, CFG)


query("trigger_vocabulary", f"with {FEATURES_SQL}, {TRIG_VOC_SQL} select * from tv")(vocabulary_trigger)
query("trigger_score_shape", f"with {POP_SQL}, {SCORE_SQL}, {TRIG_SHAPE_SQL} select * from ts")(shape_trigger)
query("trigger_matched_maturity", f"with {MATCHED_SQL}, {TRIG_MAT_SQL} select * from tm")(maturity_trigger)


@query("retrain_decision", f"""with {FEATURES_SQL}, {SCORE_SQL}, {MATCHED_SQL}, {TRIG_VOC_SQL}, {TRIG_SHAPE_SQL}, {TRIG_MAT_SQL},
 al as (select * from tv union all select * from ts union all select * from tm) select *, (select bool_or(fired) from al) retrain from al""")
def retrain_decision(spark, d):
    pop = population(spark, d)
    triggers = settle(vocabulary_trigger(spark, d, pop).unionByName(shape_trigger(spark, d, pop)).unionByName(maturity_trigger(spark, d)))
    return drift.retrain_decision(triggers)


__all__ = ["as_of", "r"]
