"""Joins (survey 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.config import GATE_THRESHOLDS, TESTBED as CFG
from loanlens.operators import audits as AU
from loanlens.operators import drift, features, gates
from loanlens.operators import eventstudy as E
from loanlens.plans.aggregates import IDENT_SQL, identification_base
from loanlens.plans.cleaning import RAW_APPLICATIONS_SQL
from loanlens.plans.disparity import CELLS_SQL, COEF_SQL, cells, panel
from loanlens.plans.drift import CAT, POP_SQL, categorical_profile, population, watched
from loanlens.plans.quality import SCORED_SQL, auc_sql, calibration_sql, scored
from loanlens.plans.registry import n, query, r, rounded
from loanlens.operators import quality as Q
from loanlens.plans.scoring import STRESS_SQL, windows
from loanlens.session import settle
from loanlens.sources.testbed import loans, raw_applications, table


@query("join_equi_aggregate_back", f"""with {IDENT_SQL}, b as (select *, cast(floor(amount / 10000) as bigint) cell from base),
 c as (select method, cell, avg(share) mu, count(*) n from b group by 1, 2)
 select b.method, b.cell, round(sum(power(share - mu, 2)), 9) ss, count(*) n from b join c on b.method = c.method and b.cell = c.cell group by 1, 2""")
def join_equi_aggregate_back(spark, d):
    base = identification_base(spark, d).withColumn("cell", F.floor(F.col("amount") / 10_000))
    # Equal shares of a cell are one row before the join, so a cell that holds most loans is no hot key.
    shares = base.groupBy("method", "cell", "share").agg(n().alias("k"))
    means = shares.groupBy("method", "cell").agg((F.sum(F.col("share") * F.col("k")) / F.sum("k")).alias("mu"))
    off = F.col("share") - F.col("mu")
    return shares.join(means, ["method", "cell"]).groupBy("method", "cell").agg(
        r(F.sum(off * off * F.col("k")), 9).alias("ss"), F.sum("k").alias("n"))


@query("join_scalar", f"""with {IDENT_SQL} select method, round(avg(share) - (select avg(share) from base), 6) off_mean,
 round(sum(power(share - (select avg(share) from base), 2)), 6) ss from base group by 1""")
def join_scalar(spark, d):
    base = identification_base(spark, d)
    off = F.col("share") - base.agg(F.avg("share")).scalar()
    return base.withColumn("off", off).groupBy("method").agg(
        r(F.avg("off")).alias("off_mean"), r(F.sum(F.col("off") * F.col("off"))).alias("ss"))


@query("join_semi_cells", f"""with {CELLS_SQL} select e.year, race, count(*) n, cast(sum(denied) as bigint) denied from ev e
 semi join bc c on e.year = c.year and e.county_code = c.county_code and e.loan_purpose = c.loan_purpose and e.lien_status = c.lien_status group by 1, 2""")
def join_semi_cells(spark, d):
    keys = ["year", *CFG.cell_keys]
    return panel(spark, d).join(cells(spark, d).select(*keys), keys, "left_semi").groupBy("year", "race").agg(
        n().alias("n"), n("denied").alias("denied"))


FJ_SQL = f"""{RAW_APPLICATIONS_SQL}, cl as (select cast(activity_year as integer) as year, state_code state, derived_race race, action_taken from raw_applications
 where try_cast(loan_amount as double) > 0), fa as (select year, state, race, count(*) k from cl where year <= 1999 group by all),
 fb as (select year, state, race, count(*) k from cl where year >= 1998 and action_taken <> '4' group by all)"""


@query("join_full_outer_compare", f"""with {FJ_SQL} select coalesce(fa.year, fb.year) as year, count(*) filter (fb.year is null) only_a, count(*) filter (fa.year is null) only_b,
 count(*) filter (fa.k = fb.k) same, count(*) filter (fa.k <> fb.k) different from fa full join fb on fa.year = fb.year and fa.state = fb.state and fa.race = fb.race group by 1""")
def join_full_outer_compare(spark, d):
    a, b = both_runs(spark, d)
    j = a.withColumnRenamed("k", "ka").join(b.withColumnRenamed("k", "kb"), ["year", "state", "race"], "full_outer")
    return j.groupBy("year").agg(
        F.count_if(F.col("kb").isNull()).alias("only_a"), F.count_if(F.col("ka").isNull()).alias("only_b"),
        F.count_if(F.col("ka") == F.col("kb")).alias("same"), F.count_if(F.col("ka") != F.col("kb")).alias("different"))


def both_runs(spark, d):
    """Two result tables that overlap in part: counts by year, state and race."""
    raw = raw_applications(spark, d, "activity_year", "state_code", "derived_race", "loan_amount", "action_taken")
    clean = raw.where(F.col("loan_amount").try_cast("double") > 0).select(
        F.col("activity_year").try_cast("int").alias("year"), F.col("state_code").alias("state"),
        F.col("derived_race").alias("race"), "action_taken")
    keys = ["year", "state", "race"]
    a = clean.where(F.col("year") <= 1999).groupBy(*keys).agg(n().alias("k"))
    b = clean.where((F.col("year") >= 1998) & (F.col("action_taken") != "4")).groupBy(*keys).agg(n().alias("k"))
    return a, b


@query("join_profile_observed", f"""with {POP_SQL}, o as (select feature, category, count(*) * 1e0 / sum(count(*)) over (partition by feature) obs from catl where approval_fy >= 1998 group by 1, 2)
 select coalesce(o.feature, f.feature) feature, coalesce(o.category, f.category) category, round(coalesce(f.share, 0), 6) ref_share, round(coalesce(obs, 0), 6) obs_share,
 f.share is null unseen from o full join refcat f on o.feature = f.feature and o.category = f.category""")
def join_profile_observed(spark, d):
    pop = population(spark, d)
    return rounded(drift.observed_vs_profile(drift.category_shares(watched(pop), CAT), categorical_profile(pop)))


@query("join_base_year", f"""with {COEF_SQL} select a.year, a.county_code, round(coalesce(i.psi, 0) - coalesce(b.psi, 0), 9) influence_change from allc a
 left join inf i on i.year = a.year and i.county_code = a.county_code left join inf b on b.year = 1998 and b.county_code = a.county_code
 where a.year <> 1998 and (i.psi is not null or b.psi is not null)""")
def join_base_year(spark, d):
    return E.influence_changes(cells(spark, d), CFG).withColumn("influence_change", F.round("influence_change", 9))


@query("join_range_cohorts", f"""with {STRESS_SQL} select cohort, approval_fy, count(*) n, cast(sum(y) as bigint) bad from st group by 1, 2""")
def join_range_cohorts(spark, d):
    df = loans(spark, d, "approval_fy", "status", "is_bad").where(F.col("status").isin(list(CFG.resolved_statuses)))
    years = windows(spark).select("cohort", F.explode(F.sequence("first", "last")).alias("approval_fy"))
    return df.join(years, "approval_fy").groupBy("cohort", "approval_fy").agg(n().alias("n"), n("is_bad").alias("bad"))


LIMITS_SQL = "lim as (select * from (values " + ", ".join(f"('{g}', '{w}', {t}e0)" for g, w, t in GATE_THRESHOLDS) + ") v(gate, direction, threshold))"


def gate_metrics(spark, d):
    """Gate metrics of score_b (production) measured on the test window, AUC against the training window."""
    s = settle(Q.summary(scored(spark, d, "split"), "y", "p", ["model", "split"], CFG.n_bins))

    def at(model, split, c):
        return F.max(F.when((F.col("model") == model) & (F.col("split") == split), F.col(c)))

    wide = s.agg(
        at("score_b", "test", "auc").alias("a"), at("score_b", "train", "auc").alias("t"),
        at("score_b", "test", "brier").alias("b"), at("score_b", "test", "ece").alias("e"), at("score_a", "test", "auc").alias("o"))
    cells_ = F.array(*[F.struct(F.lit(g).alias("gate"), v.alias("value")) for g, v in (
        ("auc_test", F.col("a")), ("auc_drop", F.col("t") - F.col("a")), ("brier_test", F.col("b")), ("ece_test", F.col("e")),
        ("margin_over_baseline", F.col("a") - F.col("o")))])
    return wide.select(F.inline(cells_))


GATE_SQL = f"""{SCORED_SQL}, {auc_sql('scored', 'model, split')}, {calibration_sql('scored', 'model, split')}, {LIMITS_SQL},
 gw as (select max(auc) filter (model = 'score_b' and split = 'test') a, max(auc) filter (model = 'score_b' and split = 'train') t,
  max(brier) filter (model = 'score_b' and split = 'test') b, max(ece) filter (model = 'score_b' and split = 'test') e,
  max(auc) filter (model = 'score_a' and split = 'test') o from disc join cal using (model, split)),
 gm as (unpivot (select a auc_test, t - a auc_drop, b brier_test, e ece_test, a - o margin_over_baseline from gw)
  on auc_test, auc_drop, brier_test, ece_test, margin_over_baseline into name gate value value),
 gt as (select lim.gate, value, direction, threshold, coalesce(case direction when 'min' then value >= threshold else value <= threshold end, false) passed,
  case when value is null then 'metric absent' else '' end detail from lim left join gm on lim.gate = gm.gate)"""


@query("join_thresholds", f"with {GATE_SQL} select gate, direction, threshold, round(value, 6) as value from gt where value is not null")
def join_thresholds(spark, d):
    limits = gates.thresholds(spark)
    return limits.join(gate_metrics(spark, d), "gate").select("gate", "direction", "threshold", r("value").alias("value"))


@query("join_anti_missing", """select doc_id, lang from documents where doc_id not in (select doc_id from labels)""")
def join_anti_missing(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(
        table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


__all__ = ["AU", "features"]
