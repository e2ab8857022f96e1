"""Fairness and access disparity (survey 2.9): `score_a` decides over the applications of the test years."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.config import NON_GROUPS, TESTBED as CFG
from loanlens.operators import fairness as FA
from loanlens.plans.registry import query, rounded
from loanlens.session import settle
from loanlens.sources.files import stage
from loanlens.sources.testbed import cte, loans

DIMS = {"derived_race": "race", "derived_ethnicity": "ethnicity", "derived_sex": "sex"}
MIN_N = 500
FAIR_SQL = f"""{cte('f0', 'split', 'is_denied', 'score_a', *DIMS)},
 fair as (select is_denied y, score_a s, {', '.join(f'{k} {v}' for k, v in DIMS.items())} from f0 where split in ('valid', 'test')),
 thr as (select quantile_cont(s, 0.75) threshold from fair),
 fl as (unpivot (select y, s, race, ethnicity, sex from fair) on race, ethnicity, sex into name dimension value "group"),
 go as (select dimension, "group", count(*) n, avg(case when s < threshold then 1 else 0 end) selection_rate, avg(y) base_rate, avg(s) mean_score,
  avg(case when s >= threshold then 1 else 0 end) filter (y = 1) tpr, avg(case when s >= threshold then 1 else 0 end) filter (y = 0) fpr,
  avg(s) / nullif(avg(y), 0) calibration_ratio from fl, thr group by all),
 ok as (select * from go where n >= {MIN_N} and "group" not in ('Race Not Available', 'Joint', 'Free Form Text Only')),
 imp as (select dimension, count(*) groups, arg_max("group", selection_rate) reference_group, arg_min("group", selection_rate) worst_group,
  min(selection_rate) / nullif(max(selection_rate), 0) impact_ratio, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) odds_gap from ok group by 1)"""


def population(spark, d):
    df = loans(spark, d, "split", "is_denied", "score_a", *DIMS)
    return df.where(F.col("split").isin("valid", "test")).select(
        F.col("is_denied").alias("y"), F.col("score_a").alias("s"), *[F.col(k).alias(v) for k, v in DIMS.items()])


def outcomes(spark, d):
    df = stage(population(spark, d), "decided")
    threshold = settle(FA.approval_threshold(df, "s", CFG.approval_rate)).scalar()
    return FA.group_outcomes(df, y="y", score="s", threshold=threshold, dimensions=tuple(DIMS.values()))


def compared(spark, d):
    out = FA.split_groups(outcomes(spark, d), NON_GROUPS, MIN_N)
    return settle(out.where(F.col("excluded_because").isNull()).drop("excluded_because"))


@query("approval_threshold", f"with {FAIR_SQL} select round(threshold, 6) threshold from thr")
def approval_threshold(spark, d):
    return rounded(FA.approval_threshold(population(spark, d), "s", CFG.approval_rate))


@query("fairness_report", f"""with {FAIR_SQL} select dimension, "group", n, round(selection_rate, 6) selection_rate, round(base_rate, 6) base_rate,
 round(mean_score, 6) mean_score, round(tpr, 6) tpr, round(fpr, 6) fpr, round(calibration_ratio, 6) calibration_ratio,
 case when "group" in ('Race Not Available', 'Joint', 'Free Form Text Only') then 'not a coherent group' when n < {MIN_N} then 'below the minimum size' end excluded_because from go""")
def fairness_report(spark, d):
    return rounded(FA.split_groups(outcomes(spark, d), NON_GROUPS, MIN_N))


@query("disparate_impact", f"""with {FAIR_SQL} select dimension, groups, reference_group, worst_group, round(impact_ratio, 6) impact_ratio,
 round(odds_gap, 6) odds_gap, impact_ratio >= 0.8 passes from imp""")
def disparate_impact(spark, d):
    return rounded(FA.disparate_impact(compared(spark, d), CFG.four_fifths))


@query("disparity_delta", f"""with {FAIR_SQL}, dd as (select dimension, min(1 - base_rate) / max(1 - base_rate) o, min(selection_rate) / max(selection_rate) m from ok group by 1)
 select dimension, round(o, 6) observed_ratio, round(m, 6) model_ratio, round(m - o, 6) delta from dd""")
def disparity_delta(spark, d):
    return rounded(FA.disparity_delta(compared(spark, d)))


@query("promotion_flag", f"""with {FAIR_SQL}, p as (select min(impact_ratio) v, arg_min(worst_group, impact_ratio) w from imp)
 select round(v, 6) impact_ratio, w worst_group, v >= 0.8 promoted, case when v < 0.8 then printf('disparate_impact_ratio %.3f < 0.8', v) end blocked_by from p""")
def promotion_flag(spark, d):
    return rounded(FA.promotion(FA.disparate_impact(compared(spark, d), CFG.four_fifths), CFG.four_fifths))
