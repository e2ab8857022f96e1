"""Gates, publishing and report measures (survey 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.config import TESTBED as CFG
from loanlens.operators import fairness as FA
from loanlens.operators import gates as G
from loanlens.operators import models as M
from loanlens.operators import quality as Q
from loanlens.plans.economics import CURVE_SQL, curve
from loanlens.plans.fairness import FAIR_SQL, compared
from loanlens.plans.joins import GATE_SQL, LIMITS_SQL, gate_metrics
from loanlens.plans.quality import SCORED_SQL, auc_sql, calibration_sql, scored
from loanlens.plans.registry import n, query, r, rounded
from loanlens.plans.scoring import STRESS_SQL, windows
from loanlens.session import scratch_path, settle
from loanlens.sources import files
from loanlens.sources.testbed import LOANS_SQL, loans


def performance(spark, d):
    return G.evaluate(gate_metrics(spark, d), G.thresholds(spark))


@query("gates_performance", f"with {GATE_SQL} select gate, round(value, 6) as value, direction, threshold, passed, passed threshold_met, detail from gt")
def gates_performance(spark, d):
    return rounded(performance(spark, d))


@query("gate_margin_over_baseline", f"""with {GATE_SQL} select gate, round(value, 6) as value, direction, threshold, passed, passed threshold_met, detail
 from gt where gate = 'margin_over_baseline'""")
def gate_margin_over_baseline(spark, d):
    auc = Q.discrimination(scored(spark, d, "split").where(F.col("split") == "test"), "y", "p", ["model"]).select(
        "model", F.col("auc").alias("auc_test"))
    limits = G.thresholds(spark).where(F.col("gate") == "margin_over_baseline")
    return rounded(G.evaluate(G.margin(auc, "score_b", "score_a"), limits))


FGATE_SQL = f"""{FAIR_SQL}, fg as (select dimension model, impact_ratio, worst_group, case dimension when 'race' then false when 'sex' then true end promoted from imp),
 fv as (select model, 'disparate_impact' gate, impact_ratio as value, 0.9e0 threshold, case when promoted is null then false else impact_ratio >= 0.9 or not promoted end passed,
  impact_ratio >= 0.9 threshold_met, case when promoted is null then 'promotion flag absent' when impact_ratio < 0.9 and not promoted
  then 'worst group: ' || worst_group || ', not promoted' when impact_ratio < 0.9 then 'worst group: ' || worst_group else '' end detail from fg)"""


def fairness_gate(spark, d):
    """One decision per dimension; race is held back, sex promoted, ethnicity says nothing."""
    impact = FA.disparate_impact(compared(spark, d), CFG.four_fifths)
    k = F.col("dimension")
    table = impact.select(k.alias("model"), "impact_ratio", "worst_group", F.when(k == "race", False).when(k == "sex", True).alias("promoted"))
    return G.fairness_gate(table, 0.9)


@query("gate_fairness", f"with {FGATE_SQL} select model, gate, round(value, 6) as value, threshold, passed, threshold_met, detail from fv")
def gate_fairness(spark, d):
    return rounded(fairness_gate(spark, d))


@query("gate_verdict", f"""with {FGATE_SQL} select model, gate, case when not passed then 'FAIL' when not threshold_met then 'NOT MET (build ok, not promoted)' else 'PASS' end verdict from fv""")
def gate_verdict(spark, d):
    return G.verdict(fairness_gate(spark, d)).select("model", "gate", "verdict")


@query("config_fingerprint", f"with {LOANS_SQL} select split, count(*) n, '{CFG.fingerprint()}' fingerprint from loans group by split")
def config_fingerprint(spark, d):
    df = loans(spark, d, "split", "is_bad")
    return df.groupBy("split").agg(n().alias("n"), F.lit(CFG.fingerprint()).alias("fingerprint"))


@query("gate_report_fresh", "select * from (values ('current', true), ('stale', false)) v(report, fresh)")
def gate_report_fresh(spark, d):
    """Two written reports, one of them from other settings."""
    base = scratch_path(spark, "reports")
    body = performance(spark, d).select(F.concat_ws(" ", "gate", F.col("passed").cast("string")).alias("line"))
    for name, mark in (("current", CFG.fingerprint()), ("stale", "0" * 16)):
        lines = body.agg(F.concat_ws("\n", F.lit(f"settings {mark}"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("value"))
        lines.coalesce(1).write.text(f"{base}/{name}")
    out = None
    for name in ("current", "stale"):
        part = G.stale_reports(spark, f"{base}/{name}", CFG.fingerprint()).select(F.lit(name).alias("report"), "fresh")
        out = part if out is None else out.unionByName(part)
    return out


PUBLISH = ("model", "split", "auc", "ks", "brier", "ece")


@query("publish_projection", f"""with {SCORED_SQL}, {auc_sql('scored', 'model, split')}, {calibration_sql('scored', 'model, split')}
 select 'metrics' source, model, split, round(auc, 6) auc, round(ks, 6) ks, round(brier, 6) brier, round(ece, 6) ece from disc join cal using (model, split)""")
def publish_projection(spark, d):
    """The metric table published as JSON lines and read back."""
    path = scratch_path(spark, "publish")
    table = rounded(Q.summary(scored(spark, d, "split"), "y", "p", ["model", "split"], CFG.n_bins))
    files.export_json(G.project(table, (*PUBLISH, "not_there"), "metrics"), path, ["model", "split"])
    schema = "source string, model string, split string, auc double, ks double, brier double, ece double"
    return spark.read.schema(schema).json(path)


@query("publish_coherence", f"""with {SCORED_SQL}, g as (select distinct model, split from scored) select model, split, 'auc' "column" from g where model = 'score_b' and split = 'test'
 union all select model, split, 'ece' from g where model = 'score_a' union all select 'ghost', 'test', '(not in source)'""")
def publish_coherence(spark, d):
    """Published values are edited and a row of no source is added; the check must name exactly those."""
    source = settle(Q.summary(scored(spark, d, "split"), "y", "p", ["model", "split"], CFG.n_bins))
    published = source.withColumn(
        "auc", F.when((F.col("model") == "score_b") & (F.col("split") == "test"), F.col("auc") + 1e-6).otherwise(F.col("auc"))
    ).withColumn("ece", F.when(F.col("model") == "score_a", F.lit(None)).otherwise(F.col("ece")))
    ghost = published.limit(1).withColumns({"model": F.lit("ghost"), "split": F.lit("test")})
    published = published.unionByName(ghost)
    return G.incoherent(published, source, ["model", "split"], ["auc", "ks", "brier", "ece"])


BI_SQL = f"""{SCORED_SQL}, {auc_sql('scored', 'model, split')}, au as (select model, auc from disc where split = 'test'), {LIMITS_SQL},
 one as (select (select auc from au where model = 'score_b') a, (select auc from au where model = 'score_a') b,
  (select threshold from lim where gate = 'margin_over_baseline') m, (select threshold from lim where gate = 'disparate_impact') t)"""


@query("bi_measures", f"""with {BI_SQL}, d0 as (with {FAIR_SQL} select min(m) d from (select min(selection_rate) / max(selection_rate) m from ok group by dimension)),
 e0 as (with {CURVE_SQL} select loss_avoided s, good_volume_foregone g from curve where decline_rate = 0.1),
 c0 as (with {STRESS_SQL}, {auc_sql("(select * from st where cohort = 'early_1995_1996')", 'cohort')} select (select auc from disc) c,
  (select sum(p) / sum(y) from st where cohort = 'early_1995_1996') q)
 select v.measure, round(v.value, case v.measure when 'loss_avoided' then 4 when 'good_volume_foregone' then 2 else 6 end) as value, v.text from one, d0, e0, c0,
 lateral (values ('production_auc', a, null), ('baseline_auc', b, null), ('margin_over_baseline', a - b, null), ('margin_threshold', m, null),
 ('margin_verdict', null, case when a - b >= m then 'met' else 'NOT met' end), ('impact_threshold', t, null), ('model_disparate_impact', d, null),
 ('fairness_verdict', null, case when d >= t then 'MET' else 'NOT MET, promotion blocked' end), ('loss_avoided', s, null), ('good_volume_foregone', g, null),
 ('cost_per_dollar', g / nullif(s, 0), null), ('crisis_auc', c, null), ('crisis_underestimation', 1 / nullif(q, 0), null),
 ('provenance', null, 'config {CFG.fingerprint()}')) v(measure, value, text)""")
def bi_measures(spark, d):
    auc = settle(Q.discrimination(scored(spark, d, "split").where(F.col("split") == "test"), "y", "p", ["model"]).select(
        "model", F.col("auc").alias("auc_test")))
    impact = settle(FA.disparity_delta(compared(spark, d)))
    headline = curve(spark, d).where(F.round("decline_rate", 6) == 0.1)
    df = loans(spark, d, "approval_fy", "status", "is_bad", "score_a").where(F.col("status").isin(list(CFG.resolved_statuses)))
    stress = settle(M.stress_cohorts(df, windows(spark), year="approval_fy", y="is_bad", p="score_a"))
    out = G.measures(auc, G.thresholds(spark), impact, headline, stress, production="score_b", baseline="score_a",
                     crisis="early_1995_1996", provenance=f"config {CFG.fingerprint()}")
    digits = F.when(F.col("measure") == "loss_avoided", F.round("value", 4)).when(
        F.col("measure") == "good_volume_foregone", F.round("value", 2)).otherwise(F.round("value", 6))
    return out.withColumn("value", digits)


__all__ = ["r"]
