"""Decision economics (survey 2.11) on the resolved loans of the test window."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.config import TESTBED as CFG
from loanlens.operators import economics as EC
from loanlens.plans.aggregates import PORTFOLIO_SQL, portfolio
from loanlens.plans.registry import n, query, r, rounded
from loanlens.session import settle
from loanlens.sources.files import stage

GRID = [i / 100 for i in range(1, 51)]
CURVE_SQL = f"""{PORTFOLIO_SQL}, rk as (select *, row_number() over (order by score_a desc, md5(loan_id), loan_id) rn, count(*) over () nn, sum(loss) over () tl from book),
 grid as (select i / 100e0 k from range(1, 51) t(i)), gm as (select k, cast(round_even(k * (select count(*) from book), 0) as bigint) m from grid),
 cum as (select rn, tl, sum(loss) over w l, sum(case when y = 0 then exposure else 0 end) over w g, sum(y) over w b from rk
  window w as (order by rn rows between unbounded preceding and current row)),
 curve as (select k decline_rate, m n_declined, l loss_avoided, g good_volume_foregone, cast(b as bigint) bad_declined, cast(m - b as bigint) good_declined,
  b * 1e0 / m as "precision", l / nullif(tl, 0) loss_capture from gm join cum on rn = m),
 tot as (select round(sum(loss), 4) tl, round(sum(case when y = 0 then exposure else 0 end), 2) tg from book),
 lifted as (select curve.*, decline_rate * tl loss_avoided_random, decline_rate * tg good_volume_random, loss_avoided / nullif(decline_rate * tl, 0) lift from curve, tot)"""
# losses have four decimals and amounts two: fewer digits would round exact ties
_DIGITS = {"loss_avoided": 4, "net_benefit": 4, "good_volume_foregone": 2, "loss_avoided_random": 6, "good_volume_random": 4}


def money(df):
    return df.select(*[
        F.round(c, _DIGITS.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def curve(spark, d):
    return settle(EC.decision_curve(
        stage(portfolio(spark, d), "portfolio"), key="loan_id", y="y", score="score_a", loss="loss", exposure="exposure", grid=GRID))


def lifted(spark, d):
    totals = settle(portfolio(spark, d).agg(
        r(F.sum("loss"), 4).alias("tl"), r(F.sum(F.when(F.col("y") == 0, F.col("exposure"))), 2).alias("tg")))
    return EC.random_baseline(curve(spark, d), totals.select("tl").scalar(), totals.select("tg").scalar())


_CURVE = """decline_rate, n_declined, round(loss_avoided, 4) loss_avoided, round(good_volume_foregone, 2) good_volume_foregone, bad_declined, good_declined,
 round("precision", 6) as "precision", round(loss_capture, 6) loss_capture"""
_LIFT = _CURVE + ", round(loss_avoided_random, 6) loss_avoided_random, round(good_volume_random, 4) good_volume_random, round(lift, 6) lift"


@query("decision_curve", f"with {CURVE_SQL} select {_CURVE} from curve")
def decision_curve(spark, d):
    return money(curve(spark, d))


@query("random_baseline_lift", f"with {CURVE_SQL} select {_LIFT} from lifted")
def random_baseline_lift(spark, d):
    return money(lifted(spark, d))


@query("breakeven_margin", f"""with {PORTFOLIO_SQL} select round(sum(loss) / nullif(sum(exposure), 0), 6) gross,
 round(sum(loss * (1 - share)) / nullif(sum(exposure), 0), 6) lender from book""")
def breakeven_margin(spark, d):
    t = EC.portfolio_totals(portfolio(spark, d), "y", "exposure", "loss", "share")
    return t.select(r("breakeven_gross").alias("gross"), r("breakeven_lender").alias("lender"))


@query("optimal_cutoff", f"""with {CURVE_SQL}, nt as (select mg margin, decline_rate, loss_avoided - mg * good_volume_foregone net from curve, unnest([0.02e0, 0.03e0, 0.05e0, 0.08e0]) t(mg))
 select margin, decline_rate, round(net, 4) net_benefit, decline_rate in ((select min(decline_rate) from curve), (select max(decline_rate) from curve)) at_boundary
 from nt qualify row_number() over (partition by margin order by net desc, decline_rate) = 1""")
def optimal_cutoff(spark, d):
    return money(EC.optimal_cutoffs(curve(spark, d), CFG.margins))


@query("headline_at_rate", f"with {CURVE_SQL} select {_LIFT} from lifted order by round(abs(decline_rate - 0.10), 9), decline_rate limit 1")
def headline_at_rate(spark, d):
    return money(EC.nearest(lifted(spark, d), 0.10))


@query("loss_by_bearer", f"""with {PORTFOLIO_SQL} select loan_id, round(loss * share, 6) guarantor, round(loss * (1 - share), 6) lender from book where y = 1""")
def loss_by_bearer(spark, d):
    guarantor, lender = EC.split_by_bearer(F.col("loss"), F.col("share"))
    return portfolio(spark, d).where(F.col("y") == 1).select(
        "loan_id", r(guarantor).alias("guarantor"), r(lender).alias("lender"))


__all__ = ["n", "rounded"]
