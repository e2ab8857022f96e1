"""Ordering, ranking, set operations (survey 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.config import TESTBED as CFG
from loanlens.operators import economics as EC
from loanlens.operators import fairness as FA
from loanlens.operators.identification import density_at_threshold
from loanlens.operators.ranking import running_totals
from loanlens.plans.aggregates import IDENT_SQL, MATCHED_SQL, PORTFOLIO_SQL, identification_base, matched, portfolio
from loanlens.plans.cleaning import PANEL_SQL, panel
from loanlens.plans.disparity import CELLS_SQL, panel as event_rows
from loanlens.plans.drift import FEATURES_SQL, SCORE_SQL, features, population, scores
from loanlens.plans.economics import CURVE_SQL, curve, money
from loanlens.plans.fairness import FAIR_SQL, compared
from loanlens.plans.joins import FJ_SQL, both_runs
from loanlens.plans.registry import n, query, r, rounded
from loanlens.session import settle
from loanlens.sources.testbed import LOANS_SQL, loans


@query("cumulative_by_score", f"""with {PORTFOLIO_SQL}, s as (select score_b score, count(*) c, sum(y) y, sum(loss) loss, sum(exposure) exposure from book group by 1)
 select score, c loans, cast(sum(c) over w as bigint) cum_loans, cast(sum(y) over w as bigint) cum_bad, round(sum(loss) over w, 4) cum_loss,
 round(sum(exposure) over w, 2) cum_exposure from s window w as (order by score desc)""")
def cumulative_by_score(spark, d):
    t = running_totals(portfolio(spark, d).withColumnRenamed("score_b", "score"), "score", {
        "c": F.lit(1), "bad": F.col("y"), "l": F.col("loss"), "e": F.col("exposure")}, descending=True)
    through = lambda x: F.col(f"{x}_before") + F.col(x)
    return t.select(
        "score", F.col("c").alias("loans"), through("c").alias("cum_loans"), through("bad").alias("cum_bad"),
        r(through("l"), 4).alias("cum_loss"), r(through("e"), 2).alias("cum_exposure"))


@query("argmax_argmin_group", f"""with {FAIR_SQL} select dimension, arg_max("group", selection_rate) best, arg_min("group", selection_rate) worst,
 arg_max("group", base_rate) most_denied from ok group by 1""")
def argmax_argmin_group(spark, d):
    t = compared(spark, d)
    return t.groupBy("dimension").agg(
        F.max_by("group", "selection_rate").alias("best"), F.min_by("group", "selection_rate").alias("worst"),
        F.max_by("group", "base_rate").alias("most_denied"))


@query("nearest_row", f"""with {CURVE_SQL}, t as (select unnest([0.05e0, 0.1e0, 0.15e0, 0.2e0, 0.3e0]) rate)
 select rate, decline_rate, n_declined, round(loss_avoided, 4) loss_avoided, round(good_volume_foregone, 2) good_volume_foregone, bad_declined, good_declined,
 round("precision", 6) as "precision", round(loss_capture, 6) loss_capture from t, curve
 qualify row_number() over (partition by rate order by round(abs(decline_rate - rate), 9), decline_rate) = 1""")
def nearest_row(spark, d):
    table = curve(spark, d)
    out = None
    for rate in (0.05, 0.10, 0.15, 0.20, 0.30):
        row = EC.nearest(table, rate).select(F.lit(rate).alias("rate"), "*")
        out = row if out is None else out.unionByName(row)
    return money(out)


@query("last_n_years", f"""with {LOANS_SQL} select approval_fy, count(*) n from loans where approval_fy > (select max(approval_fy) - 3 from loans) group by 1""")
def last_n_years(spark, d):
    df = loans(spark, d, "approval_fy")
    return df.where(F.col("approval_fy") > df.agg(F.max("approval_fy") - 3).scalar()).groupBy("approval_fy").agg(n().alias("n"))


@query("worst_cohort", f"""with {FEATURES_SQL}, {SCORE_SQL} select (select arg_max(approval_fy, psi_shape) from sd) worst_year, (select round(max(psi_shape), 6) from sd) worst_shape,
 feature, round(max(unsupported), 6) max_unsupported from feats where kind = 'categorical' group by feature""")
def worst_cohort(spark, d):
    pop = population(spark, d)
    shape = settle(scores(pop).agg(F.max_by("approval_fy", "psi_shape").alias("y"), F.max("psi_shape").alias("s")))
    mass = features(pop).where(F.col("kind") == "categorical").groupBy("feature").agg(r(F.max("unsupported")).alias("max_unsupported"))
    return mass.withColumn("worst_year", shape.select("y").scalar()).withColumn("worst_shape", F.round(shape.select("s").scalar(), 6))


@query("sorted_outputs", f"with {MATCHED_SQL} select *, cast(row_number() over (order by fy, window_months) as integer) position from matched")
def sorted_outputs(spark, d):
    from pyspark.sql import Window

    # years times windows: a handful of rows
    place = F.row_number().over(Window.orderBy("fy", "window_months"))
    return rounded(matched(spark, d)).withColumn("position", place).orderBy("fy", "window_months")


@query("union_all_windows", f"""with {IDENT_SQL}, s as (select round(amount / 500) * 500 m from base) """ + " union all ".join(
    f"select {w}e0 as \"window\", count(*) n, count(*) filter (m = 50000) n_at_threshold, round(100e0 * count(*) filter (m = 50000) / nullif(count(*), 0), 2) pct_at_threshold "
    f"from s where m between {50000 - w} and {50000 + w}" for w in (1500, 3000)))
def union_all_windows(spark, d):
    snapped = identification_base(spark, d).withColumn("amount", F.round(F.col("amount") / 500) * 500)
    return density_at_threshold(snapped, 50_000, (1500, 3000))


@query("set_difference_keys", f"""with {FJ_SQL}, ka as (select year, state, race from fa), kb as (select year, state, race from fb)
 select 'only_a' side, * from (select * from ka except select * from kb) union all select 'only_b', * from (select * from kb except select * from ka)
 union all select 'both', * from (select * from ka intersect select * from kb)""")
def set_difference_keys(spark, d):
    a, b = (x.drop("k") for x in both_runs(spark, d))
    side = lambda name, df: df.select(F.lit(name).alias("side"), "year", "state", "race")
    return side("only_a", a.subtract(b)).unionByName(side("only_b", b.subtract(a))).unionByName(side("both", a.intersect(b)))


@query("distinct_rows", f"""with {CELLS_SQL} select distinct year, county_code, loan_purpose, lien_status, occupancy_type from ev""")
def distinct_rows(spark, d):
    return event_rows(spark, d).select("year", "county_code", "loan_purpose", "lien_status", "occupancy_type").distinct()


__all__ = ["CFG", "FA", "PANEL_SQL", "panel"]
