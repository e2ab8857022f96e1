"""Model-quality metrics (survey 2.7) on the two scores of the test loans."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.config import TESTBED as CFG
from loanlens.operators import quality as Q
from loanlens.plans.registry import n, query, r, rounded
from loanlens.session import settle
from loanlens.sources.files import stage
from loanlens.sources.testbed import LOANS_SQL, loans

MODELS = ("score_a", "score_b")
SCORED_SQL = f"""{LOANS_SQL}, resolved as (select * from loans where status in ('P I F', 'CHGOFF')),
 scored as (select loan_id, approval_fy, coalesce(split, 'none') split, is_bad y, 'score_a' model, score_a p from resolved
 union all select loan_id, approval_fy, coalesce(split, 'none'), is_bad, 'score_b', score_b from resolved)"""


def scored(spark, d, *keep, once=False):
    """(kept columns, y, model, p) of resolved loans. Metrics read it several times, so the joined view
    is written once; `once` skips that for a single pass."""
    df = loans(spark, d, "loan_id", "approval_fy", "status", "split", "is_bad", *MODELS).where(
        F.col("status").isin(list(CFG.resolved_statuses)))
    df = df.select("loan_id", "approval_fy", F.coalesce("split", F.lit("none")).alias("split"), F.col("is_bad").alias("y"), *MODELS)
    return Q.to_long(df if once else stage(df, "scored"), MODELS, [*keep, "y"])


def auc_sql(source: str, keys: str, extra: str = "") -> str:
    """Rank form of the AUC and the threshold form of KS, for a table with y and p."""
    part = f"partition by {keys} " if keys else ""
    return f"""t as (select {keys + ', ' if keys else ''}p, sum(y) pos, sum(1 - y) neg from {source} group by {keys + ', ' if keys else ''}p),
 c as (select *, sum(neg) over ({part}order by p) - neg nb, sum(pos) over ({part}order by p) - pos pb,
  sum(pos) over ({part.strip()}) tp, sum(neg) over ({part.strip()}) tn from t),
 disc as (select {keys + ', ' if keys else ''}cast(max(tp) as bigint) n_pos, cast(max(tn) as bigint) n_neg,
  sum(pos * (nb + neg / 2e0)) / nullif(max(tp) * 1e0 * max(tn), 0) auc,
  max(nb * 1e0 / nullif(tn, 0) - pb * 1e0 / nullif(tp, 0)) ks from c {'group by ' + keys if keys else ''}){extra}"""


def calibration_sql(source: str, keys: str) -> str:
    probs = ", ".join(str(i / 10) for i in range(11))
    return f"""e as (select {keys}, list_sort(list_distinct(quantile_cont(p, [{probs}]))) edges from {source} group by {keys}),
 b as (select s.*, len(list_filter(edges[2:len(edges) - 1], lambda x: x < p)) bin from {source} s join e using ({keys})),
 bins as (select {keys}, bin, count(*) n, sum(y) sy, sum(p) sp, sum((p - y) * (p - y)) se from b group by {keys}, bin),
 cal as (select {keys}, cast(sum(n) as bigint) n, sum(se) / sum(n) brier, sum(abs(sy - sp)) / sum(n) ece, sum(sy) * 1e0 / sum(n) observed_rate,
  sum(sp) / sum(n) predicted_rate, sum(sp) / nullif(sum(sy), 0) calibration_ratio from bins group by {keys})"""


def psi_sql(source: str, keys: str, value: str = "v", name: str = "psis") -> str:
    """`source` has the keys, a value and a boolean `ref`."""
    probs = ", ".join(str(i / 10) for i in range(11))
    return f"""{name}_e as (select {keys}, list_sort(list_distinct(quantile_cont({value}, [{probs}]))) edges from {source} where ref group by {keys}),
 {name}_b as (select {keys}, len(list_filter(edges[2:len(edges) - 1], lambda x: x <= {value})) bin, count(*) filter (ref) e, count(*) filter (not ref) a,
  max(len(edges)) k from {source} join {name}_e using ({keys}) group by {keys}, bin),
 {name}_s as (select *, sum(e) over (partition by {keys}) te, sum(a) over (partition by {keys}) ta from {name}_b),
 {name} as (select {keys}, case when max(k) >= 3 and max(te) > 0 and max(ta) > 0 then
  sum((greatest(a * 1e0 / ta, 1e-6) - greatest(e * 1e0 / te, 1e-6)) * ln(greatest(a * 1e0 / ta, 1e-6) / greatest(e * 1e0 / te, 1e-6))) else 0e0 end psi
  from {name}_s group by {keys})"""


@query("auc_gini_ks", f"""with {SCORED_SQL}, {auc_sql('scored', 'model, split')}
 select model, split, n_pos, n_neg, round(auc, 6) auc, round(2 * auc - 1, 6) gini, round(ks, 6) ks from disc""")
def auc_gini_ks(spark, d):
    return rounded(Q.discrimination(scored(spark, d, "split", once=True), "y", "p", ["model", "split"]))


@query("brier_ece", f"""with {SCORED_SQL}, {calibration_sql('scored', 'model, split')}
 select model, split, n, round(brier, 6) brier, round(ece, 6) ece, round(observed_rate, 6) observed_rate,
 round(predicted_rate, 6) predicted_rate, round(calibration_ratio, 6) calibration_ratio from cal""")
def brier_ece(spark, d):
    return rounded(Q.calibration(scored(spark, d, "split"), "y", "p", ["model", "split"], CFG.n_bins))


@query("reliability_table", f"""with {SCORED_SQL}, {calibration_sql('scored', 'model, split')}
 select model, split, cast(bin as integer) bin, n, round(sp / n, 12) predicted, round(sy * 1e0 / n, 12) observed, round((sp - sy) / n, 12) difference from bins""")
def reliability_table(spark, d):
    # Means of scores with six digits can end in a five at the seventh; twelve digits have no such ties.
    return rounded(Q.reliability_table(scored(spark, d, "split"), "y", "p", ["model", "split"], CFG.n_bins), 12)


PSI_SOURCE_SQL = f"""{SCORED_SQL}, sides as (select model, p v, split = 'train' ref from scored where split in ('train', 'test'))"""


def sides(spark, d):
    return scored(spark, d, "split").where(F.col("split").isin("train", "test"))


@query("psi", f"with {PSI_SOURCE_SQL}, {psi_sql('sides', 'model')} select model, round(psi, 6) psi from psis")
def psi(spark, d):
    return rounded(Q.psi(sides(spark, d), "p", F.col("split") == "train", ["model"], CFG.n_bins))


_LOGIT = "ln(least(greatest(v, 1e-6), 1 - 1e-6) / (1 - least(greatest(v, 1e-6), 1 - 1e-6)))"


@query("stability", f"""with {PSI_SOURCE_SQL}, m as (select model, avg({_LOGIT}) filter (ref) lr, avg({_LOGIT}) filter (not ref) lc,
  avg(v) filter (not ref) / avg(v) filter (ref) level_ratio from sides group by model),
 moved as (select model, case when ref then v else 1 / (1 + exp(-({_LOGIT} - lc + lr))) end v, ref from sides join m using (model)),
 {psi_sql('sides', 'model', name='tot')}, {psi_sql('moved', 'model', name='shp')},
 o as (select model, tot.psi psi_total, shp.psi psi_shape, level_ratio from tot join shp using (model) join m using (model))
 select model, round(psi_total, 6) psi_total, round(psi_shape, 6) psi_shape, round(level_ratio, 6) level_ratio,
 case when psi_total < 0.10 then 'stable' when psi_shape < 0.10 then 'level moved: recalibrate' else 'shape changed: consider retraining' end reading from o""")
def stability(spark, d):
    return rounded(Q.stability(sides(spark, d), "p", F.col("split") == "train", ["model"], CFG.n_bins))


@query("metric_summary", f"""with {SCORED_SQL}, {auc_sql('scored', 'model, split')}, {calibration_sql('scored', 'model, split')}
 select model, split, n_pos, n_neg, round(auc, 6) auc, round(2 * auc - 1, 6) gini, round(ks, 6) ks, n, round(brier, 6) brier, round(ece, 6) ece,
 round(observed_rate, 6) observed_rate, round(predicted_rate, 6) predicted_rate, round(calibration_ratio, 6) calibration_ratio
 from disc join cal using (model, split)""")
def metric_summary(spark, d):
    return rounded(Q.summary(scored(spark, d, "split"), "y", "p", ["model", "split"], CFG.n_bins))


@query("oot_drop", f"""with {SCORED_SQL}, {auc_sql('scored', 'model, split')}
 select model, round(max(auc) filter (split = 'train') - max(auc) filter (split = 'test'), 6) auc_drop from disc group by model""")
def oot_drop(spark, d):
    t = Q.discrimination(scored(spark, d, "split", once=True), "y", "p", ["model", "split"])
    at = lambda s: F.max(F.when(F.col("split") == s, F.col("auc")))
    return t.groupBy("model").agg(r(at("train") - at("test")).alias("auc_drop"))


def tested(spark, d):
    return loans(spark, d, "status", "split", "is_bad", *MODELS).where(
        F.col("status").isin(list(CFG.resolved_statuses)) & (F.col("split") == "test"))


@query("bootstrap_auc_diff")
def bootstrap_auc_diff(spark, d):
    return Q.bootstrap_auc_diff(tested(spark, d), y="is_bad", a="score_a", b="score_b", replicas=2000, seed=CFG.seed)


# The check has no draws: it takes the standard error of the difference from placement values of each class.
@query("bootstrap_auc_verdict", f"""with {LOANS_SQL}, k as (select score_a a, score_b b, is_bad y, count(*) n from loans
  where status in ('P I F', 'CHGOFF') and split = 'test' group by all),
 ra as (select a, sum(n * y) p, sum(n * (1 - y)) q from k group by a),
 rb as (select b, sum(n * y) p, sum(n * (1 - y)) q from k group by b),
 pa as (select a, sum(q) over (order by a) - q / 2e0 below, sum(p) over () - sum(p) over (order by a) + p / 2e0 above, sum(p) over () np, sum(q) over () nq from ra),
 pb as (select b, sum(q) over (order by b) - q / 2e0 below, sum(p) over () - sum(p) over (order by b) + p / 2e0 above from rb),
 v as (select y, n, np, nq, case when y = 1 then (pa.below - pb.below) / nq else (pa.above - pb.above) / np end x from k join pa using (a) join pb using (b)),
 m as (select y, any_value(np) np, any_value(nq) nq, sum(n) m, sum(n * x) / sum(n) mean, (sum(n * x * x) - sum(n * x) * sum(n * x) / sum(n)) / (sum(n) - 1) var from v group by y),
 t as (select cast(any_value(np) as bigint) n_pos, cast(any_value(nq) as bigint) n_neg, max(mean) filter (y = 1) diff, sqrt(sum(var / m)) se from m)
 select n_pos, n_neg, round(diff, 6) diff, abs(diff) > 1.96 * se significant from t""")
def bootstrap_auc_verdict(spark, d):
    """The difference over all rows, and whether the replicas call it significant."""
    cells = settle(Q.score_cells(tested(spark, d), "is_bad", "score_a", "score_b"))
    long = Q.to_long(cells, ("a", "b"), ["y", "n"])
    auc = settle(Q.discrimination(long, "y", "p", ["model"], weight=F.col("n")))
    at = lambda m: F.max(F.when(F.col("model") == m, F.col("auc")))
    point = auc.agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), (at("a") - at("b")).alias("diff"))
    drawn = bootstrap_auc_diff(spark, d).select("significant").scalar()
    return point.select("n_pos", "n_neg", r("diff").alias("diff"), drawn.alias("significant"))


__all__ = ["n"]
