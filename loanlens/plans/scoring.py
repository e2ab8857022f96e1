"""Scorecard, challengers, calibration and scoring (survey 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.config import (
    APPLICATION_CATEGORICAL, APPLICATION_NUMERIC, LOAN_CATEGORICAL, LOAN_NUMERIC, NON_GROUPS, TESTBED as CFG,
)
from loanlens.operators import boosting as B
from loanlens.operators import calibrate as C
from loanlens.operators import fairness as FA
from loanlens.operators import models as M
from loanlens.operators import quality as Q
from loanlens.operators import scorecard as SC
from loanlens.operators.features import project_guarded
from loanlens.operators.vocabulary import harmonise
from loanlens.plans.cleaning import PANEL_SQL, PARTIAL_MAP, applications, panel
from loanlens.plans.quality import SCORED_SQL, auc_sql, calibration_sql, scored
from loanlens.plans.registry import n, query, r, rounded
from loanlens.session import settle
from loanlens.sources.files import stage
from loanlens.sources.loans import with_split
from loanlens.sources.testbed import LOANS_SQL, loans

NUM, CAT = list(LOAN_NUMERIC), list(LOAN_CATEGORICAL)
Y = "is_chargeoff"


def split_panel(spark, d):
    df = with_split(panel(spark, d), CFG).where(F.col("split").isNotNull())
    return stage(df.select(Y, "split", *NUM, *CAT), "panel")  # every fit reads it many times


def part(df, name):
    return df.where(F.col("split") == name)


def test_metrics(df, p, by=("split",)):
    # a summary reads its rows many times; they are scored once
    return Q.summary(settle(df.select(*by, Y, F.col(p).alias("p"))), Y, "p", list(by), CFG.n_bins)


_WOE_TAIL = """tt as (select *, sum(events) over (partition by feature) te, sum(n - events) over (partition by feature) tg from bins),
 ww as (select feature, bin, lo, label, n, events, events * 1e0 / te b, (n - events) * 1e0 / tg g from tt),
 woe as (select feature, bin, lo, label, n, events, events * 1e0 / n event_rate, case when b > 0 and g > 0 then ln(g / b) else 0 end woe,
  (g - b) * case when b > 0 and g > 0 then ln(g / b) else 0 end iv,
  (case when b > 0 then b * ln(b / ((b + g) / 2)) else 0 end + case when g > 0 then g * ln(g / ((b + g) / 2)) else 0 end) / 2 js from ww)"""
_CASTS = ", ".join(f"cast(coalesce({c}, -9e9) as double) {c}" for c in NUM)
_TEXTS = ", ".join(f"coalesce(cast({c} as varchar), 'NULO') {c}" for c in CAT)
_PROBS = ", ".join(str(i / CFG.n_bins) for i in range(CFG.n_bins + 1))
# Blocks by the max-min formula of isotonic regression, which shares nothing with the fold over bins.
WOE_SQL = f"""{PANEL_SQL}, tp as (select * from panel where approval_fy between 1995 and 1997),
 nl as (select feature, v, y from (unpivot (select is_chargeoff y, {_CASTS} from tp) on {', '.join(NUM)} into name feature value v)),
 ne as (select feature, list_sort(list_distinct(quantile_cont(v, [{_PROBS}]))) edges from nl where v > -9e9 group by 1),
 nb as (select feature, place, case when place > 0 then any_value(edges)[place + 1] end lo, cast(null as varchar) category, count(*) n, cast(sum(y) as bigint) events
  from (select feature, edges, y, case when v = -9e9 then -1 else len(list_filter(edges[2:len(edges) - 1], lambda x: x <= v)) end place from nl join ne using (feature)) group by 1, 2),
 c1 as (select feature, category, count(*) n, sum(y) e from (unpivot (select is_chargeoff y, {_TEXTS} from tp) on {', '.join(CAT)} into name feature value category) group by 1, 2),
 c2 as (select feature, case when category <> 'NULO' and n * 200 < sum(case when category <> 'NULO' then n end) over (partition by feature) then 'RARE' else category end category, n, e from c1),
 c3 as (select feature, category, cast(sum(n) as bigint) n, cast(sum(e) as bigint) events from c2 group by 1, 2),
 c4 as (select *, case when category = 'NULO' then -1 else cast(floor(coalesce(sum(n) over (partition by feature, category = 'NULO' order by events * 1e0 / n, category
  rows between unbounded preceding and 1 preceding), 0) * {CFG.n_bins}e0 / sum(n) over (partition by feature, category = 'NULO')) as bigint) end place from c3),
 ob as (select feature, place, min(lo) lo, cast(null as varchar[]) cats, sum(n) n, sum(events) events from nb group by 1, 2
  union all select feature, place, null, list(category), sum(n), sum(events) from c4 group by 1, 2),
 pre as (select *, sum(n) over w cn, sum(events) over w ce from ob where place >= 0 window w as (partition by feature order by place)),
 seg as (select x.feature, x.place a, y.place b, (y.ce - x.ce + x.events) * 1e0 / (y.cn - x.cn + x.n) m from pre x join pre y on x.feature = y.feature and x.place <= y.place),
 cut as (select p.feature, p.place, s.a, min(m) lowest, max(m) highest from pre p join seg s on s.feature = p.feature and s.a <= p.place and s.b >= p.place group by all),
 iso as (select feature, place, max(lowest) up, min(highest) down from cut group by 1, 2),
 us as (select feature, sum(e * e / k) t from (select feature, sum(events) * 1e0 e, sum(n) * 1e0 k from iso join pre using (feature, place) group by feature, up) group by 1),
 ds as (select feature, sum(e * e / k) t from (select feature, sum(events) * 1e0 e, sum(n) * 1e0 k from iso join pre using (feature, place) group by feature, down) group by 1),
 fitted as (select iso.feature, iso.place, case when us.t >= ds.t then up else down end v from iso join us using (feature) join ds using (feature)),
 numbered as (select feature, place, dense_rank() over (partition by feature order by first) - 1 bin from (select *, min(place) over (partition by feature, v) as first from fitted)),
 bins as (select feature, cast(coalesce(bin, -1) as integer) bin, case when min(ob.place) > 0 then min_by(lo, ob.place) end lo, array_to_string(list_sort(flatten(list(cats))), ' | ') label, cast(sum(n) as bigint) n, cast(sum(events) as bigint) events
  from ob left join numbered using (feature, place) group by 1, 2), {_WOE_TAIL}"""


def woe_table(spark, d):
    table, _ = SC.fitted_bins(part(split_panel(spark, d), "train"), Y, NUM, CAT, CFG.n_bins)
    return SC.with_woe(table)


@query("woe_binning", f"""with {WOE_SQL} select feature, bin, round(lo, 6) lo, nullif(label, '') label, n, events, round(event_rate, 6) event_rate, round(woe, 6) woe, round(iv, 6) iv, round(js, 6) js from woe""")
def woe_binning(spark, d):
    return rounded(woe_table(spark, d))


@query("iv_selection", f"""with {WOE_SQL} select feature, round(sum(iv), 6) iv, round(sum(js), 6) js from woe group by 1 having sum(iv) between 0.02 and 0.75""")
def iv_selection(spark, d):
    return rounded(SC.select_by_iv(SC.information_value(woe_table(spark, d)), 0.02, 0.75, 25))


@query("iv_ceiling", f"""with {WOE_SQL} select feature, round(sum(iv), 6) iv, round(sum(js), 6) js from woe group by 1 having sum(iv) > 0.1""")
def iv_ceiling(spark, d):
    # the generated labels depend on one feature only; a lower ceiling shows it as the suspect
    return rounded(SC.leak_suspects(SC.information_value(woe_table(spark, d)), 0.1))


@query("bin_labels", f"""with {WOE_SQL} select feature, bin, label, n, events from bins where label <> ''""")
def bin_labels(spark, d):
    return woe_table(spark, d).where("label IS NOT NULL").select("feature", "bin", "label", "n", "events")


def fit_card(df):
    return SC.fit_scorecard(part(df, "train"), Y, NUM, CAT, n_bins=CFG.n_bins)


@query("scorecard_fit_score")
def scorecard_fit_score(spark, d):
    df = split_panel(spark, d)
    card = fit_card(df)
    out = df.select("split", Y, card.probability().alias("p"), card.points().alias("points"))
    means = out.groupBy("split").agg(r(F.avg("points"), 4).alias("mean_points"), r(F.min("points"), 4).alias("lowest"), r(F.max("points"), 4).alias("highest"))
    return rounded(test_metrics(out, "p")).join(means, "split")


def fit_gbm(df, num=NUM, cat=CAT, y=Y):
    return B.fit(part(df, "train"), part(df, "valid"), y, num, cat, B.Params(seed=CFG.seed))


@query("gbm_challenger")
def gbm_challenger(spark, d):
    df = split_panel(spark, d)
    return rounded(test_metrics(B.score(fit_gbm(df), df, "p"), "p"))


@query("mlp_challenger")
def mlp_challenger(spark, d):
    df = split_panel(spark, d)
    out = M.score(M.fit_mlp(part(df, "train"), Y, NUM, CAT, seed=CFG.seed), df, Y, NUM, CAT, "p", fill=False)
    return rounded(test_metrics(out, "p"))


@query("feature_importance")
def feature_importance(spark, d):
    df = split_panel(spark, d)
    return rounded(M.importances(fit_gbm(df).importances(), df))


CAL_SQL = f"{SCORED_SQL}, va as (select * from scored where split = 'valid')"


def score_rows(spark, d):
    return scored(spark, d, "split").where(F.col("split").isin("valid", "test"))


@query("calibrate_intercept", f"""with {CAL_SQL} select model, count(*) n, round(avg(y), 6) observed_rate, round(avg(y), 6) mean_calibrated from va group by model""")
def calibrate_intercept(spark, d):
    """The shifted score's mean must equal the observed rate of the rows it was fitted on."""
    valid = part(score_rows(spark, d), "valid")
    out = None
    for model in ("score_a", "score_b"):
        rows = valid.where(F.col("model") == model)
        done = C.calibrate("intercept", rows, rows, "y", "p", "q")
        out = done if out is None else out.unionByName(done)
    return out.groupBy("model").agg(
        n().alias("n"), r(F.avg("y")).alias("observed_rate"), r(F.avg("q")).alias("mean_calibrated"))


def _calibrated(spark, d, name):
    rows = score_rows(spark, d).where(F.col("model") == "score_a")
    out = stage(C.calibrate(name, part(rows, "valid"), rows, "y", "p", "q").select("split", "y", "q"), "calibrated")
    return rounded(Q.summary(out, "y", "q", ["split"], CFG.n_bins))


@query("calibrate_platt")
def calibrate_platt(spark, d):
    return _calibrated(spark, d, "platt")


@query("calibrate_isotonic")
def calibrate_isotonic(spark, d):
    return _calibrated(spark, d, "isotonic")


@query("calibrator_compare")
def calibrator_compare(spark, d):
    rows = score_rows(spark, d)
    out = None
    for model in ("score_a", "score_b"):
        mine = rows.where(F.col("model") == model)
        for name in C.CALIBRATORS:
            done = C.calibrate(name, part(mine, "valid"), part(mine, "test"), "y", "p", "q").select(
                "model", F.lit(name).alias("calibrator"), "y", "q")
            out = done if out is None else out.unionByName(done)
    table = Q.summary(stage(out, "calibrated"), "y", "q", ["model", "calibrator"], CFG.n_bins)
    return rounded(table.select("model", "calibrator", "auc", "brier", "ece", "calibration_ratio",
                                (F.col("calibrator") == "intercept").alias("production")))


@query("model_comparison")
def model_comparison(spark, d):
    df = split_panel(spark, d)
    card = fit_card(df)
    df = df.withColumn("scorecard_woe", card.probability())
    df = B.score(fit_gbm(df), df, "gbm")
    df = M.score(M.fit_mlp(part(df, "train"), Y, NUM, CAT, seed=CFG.seed), df, Y, NUM, CAT, "mlp", fill=False)
    long = settle(Q.to_long(df, ["scorecard_woe", "gbm", "mlp"], ["split", Y]))
    m = settle(Q.summary(long, Y, "p", ["model", "split"], CFG.n_bins))

    def at(c, s):
        return F.max(F.when(F.col("split") == s, F.col(c)))

    wide = m.groupBy("model").agg(
        *[at("auc", s).alias(f"auc_{s}") for s in ("train", "valid", "test")],
        *[at(c, "test").alias(f"{c}_test") for c in ("gini", "ks", "brier", "ece", "calibration_ratio")],
        (at("auc", "train") - at("auc", "test")).alias("auc_drop"))
    return rounded(M.compare_models(wide, "scorecard_woe"))


@query("signal_gate")
def signal_gate(spark, d):
    df = split_panel(spark, d)
    project_guarded(df, [*NUM, *CAT], forbidden=CFG.forbidden)
    out = part(B.score(fit_gbm(df), df, "p"), "test")
    auc = Q.discrimination(out.select(Y, "p"), Y, "p")
    return auc.select(r("auc").alias("auc_test"), F.lit(CFG.min_signal_auc).alias("threshold"),
                      (F.col("auc") >= CFG.min_signal_auc).alias("passes"))


STRESS_SQL = f"""{LOANS_SQL}, win as (select * from (values ('early_1995_1996', 1995, 1996), ('mid_1996_1998', 1996, 1998), ('late_2001', 2001, 2001)) v(cohort, f, l)),
 st as (select cohort, approval_fy, is_bad y, score_a p from loans join win on approval_fy between f and l where status in ('P I F', 'CHGOFF'))"""


def windows(spark):
    return spark.createDataFrame([tuple(w) for w in CFG.stress], "cohort string, first int, last int")


@query("stress_cohorts", f"""with {STRESS_SQL}, {auc_sql('st', 'cohort')}, {calibration_sql('st', 'cohort')},
 sz as (select cohort, min(approval_fy) first_fy, max(approval_fy) last_fy from st group by 1)
 , ok as (select *, coalesce(n >= 500 and n_pos > 0 and n_neg > 0, false) enough from win left join sz using (cohort) left join disc using (cohort) left join cal using (cohort))
 select cohort, first_fy, last_fy, coalesce(n, 0) n, case when enough then round(observed_rate, 6) end observed_rate, case when enough then round(auc, 6) end auc,
 case when enough then round(ks, 6) end ks, case when enough then round(brier, 6) end brier, case when enough then round(predicted_rate, 6) end predicted_rate,
 case when enough then round(calibration_ratio, 6) end calibration_ratio, case when not enough then 'insufficient sample' end note from ok""")
def stress_cohorts(spark, d):
    df = loans(spark, d, "approval_fy", "status", "is_bad", "score_a").where(F.col("status").isin(list(CFG.resolved_statuses)))
    return rounded(M.stress_cohorts(df, windows(spark), year="approval_fy", y="is_bad", p="score_a"))


@query("harmonize_cost")
def harmonize_cost(spark, d):
    df = split_panel(spark, d)
    out = None
    for label, table in (
        ("raw", df), ("harmonised", df.withColumn("business_age", harmonise("business_age", PARTIAL_MAP)))):
        test = settle(part(B.score(fit_gbm(table), table, "p"), "test").select(Y, "p"))
        row = Q.discrimination(test.select(Y, "p"), Y, "p").select(F.lit(label).alias("vocabulary"), r("auc").alias("auc_test"))
        cats = part(table, "train").agg(F.count_distinct("business_age").alias("categories"))
        row = row.withColumn("categories", cats.scalar())
        out = row if out is None else out.unionByName(row)
    return out


@query("train_access_model")
def train_access_model(spark, d):
    num, cat = list(APPLICATION_NUMERIC), list(APPLICATION_CATEGORICAL)
    df = applications(spark, d)
    split = F.when(F.col("activity_year").between(*CFG.application_train), "train").when(
        F.col("activity_year").between(*CFG.application_valid), "valid").when(
        F.col("activity_year").between(*CFG.application_test), "test")
    df = stage(df.withColumn("split", split).where(F.col("split").isNotNull()), "applications")
    project_guarded(df, [*num, *cat], forbidden=("is_denied",), protected=("race", "ethnicity", "sex"))
    # several summaries read the scored rows; written, they take no memory of the executors
    out = settle(B.score(fit_gbm(df, num=num, cat=cat, y="is_denied"), df, "p0").select("split", "is_denied", "race", "ethnicity", "sex", "p0"))
    test = C.calibrate("intercept", part(out, "valid"), part(out, "test"), "is_denied", "p0", "p")
    threshold = settle(FA.approval_threshold(test, "p", CFG.approval_rate)).scalar()
    groups = FA.group_outcomes(test, y="is_denied", score="p", threshold=threshold, dimensions=("race", "ethnicity", "sex"))
    kept = settle(FA.split_groups(groups, NON_GROUPS, 100).where(F.col("excluded_because").isNull()))
    verdict = FA.promotion(FA.disparate_impact(kept, CFG.four_fifths), CFG.four_fifths)
    metrics = settle(Q.summary(test.select(F.lit("access").alias("model"), "is_denied", "p"), "is_denied", "p", ["model"], CFG.n_bins))
    found = settle(verdict)
    return rounded(metrics.select("*", *[
        found.select(c).scalar().alias(c) for c in ("impact_ratio", "worst_group", "promoted", "blocked_by")]))


_CODES = ",\n ".join(f"""v_{c} as (select cast({c} as varchar) c, row_number() over (order by cast({c} as varchar)) - 1 k
  from tp where {c} is not null group by 1)""" for c in CAT)
_CODED = ", ".join(f"cast(coalesce(v_{c}.k, -1) as integer) {c}" for c in CAT)
_CODE_JOINS = " ".join(f"left join v_{c} on cast(p.{c} as varchar) = v_{c}.c" for c in CAT)


@query("encode_contract", f"""with {PANEL_SQL}, tp as (select * from panel where approval_fy between 1995 and 1997),
 {_CODES}
 select p.approval_fy, {_CODED}, count(*) n, round(sum(try_cast(p.gross_approval as double)), 2) amount
 from panel p {_CODE_JOINS} group by all""")
def encode_contract(spark, d):
    df = stage(panel(spark, d).select("approval_fy", "gross_approval", *CAT), "encoded")
    vocab = settle(M.vocabulary(df.where(F.col("approval_fy").between(*CFG.train)), CAT))
    coded = M.encode(df, vocab, ["gross_approval"], CAT)
    return coded.groupBy("approval_fy", *CAT).agg(n().alias("n"), r(F.sum("gross_approval"), 2).alias("amount"))


@query("score_parity", f"""with {LOANS_SQL} select count(*) n, round(max(abs(score_a - cast(cast(score_a as real) as double))), 12) max_diff,
 max(abs(score_a - cast(cast(score_a as real) as double))) <= 1e-5 equal from loans""")
def score_parity(spark, d):
    both = loans(spark, d, "score_a").withColumn("stored", F.col("score_a").cast("float").cast("double"))
    return M.parity(both, "score_a", "stored").withColumn("max_diff", F.round("max_diff", 12))


@query("batch_score_loss", f"""with {LOANS_SQL}, el as (select loan_id, score_b p, score_b * 0.735e0 * gross_approval loss, guaranteed / nullif(gross_approval, 0) share from loans)
 select loan_id, p, case when p < 0.03 then 'A' when p < 0.06 then 'B' when p < 0.12 then 'C' when p < 0.20 then 'D' else 'E' end band,
 round(loss, 2) expected_loss, round(share, 4) guaranteed_share, round(loss * share, 2) expected_loss_guarantor, round(loss * (1 - share), 2) expected_loss_lender from el""")
def batch_score_loss(spark, d):
    df = loans(spark, d, "loan_id", "score_b", "gross_approval", "guaranteed").withColumnRenamed("score_b", "p")
    return M.score_loss(df, p="p", amount="gross_approval", guaranteed="guaranteed", severity=CFG.severity).drop(
        "gross_approval", "guaranteed")
