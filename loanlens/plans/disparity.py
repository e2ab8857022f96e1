"""Decomposition and event study (survey 2.12) on the application analog."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.config import TESTBED as CFG
from loanlens.operators import eventstudy as E
from loanlens.plans.registry import query, rounded
from loanlens.session import settle
from loanlens.sources.applications import event_panel as build_panel
from loanlens.sources.files import stage
from loanlens.sources.testbed import RAW_APPLICATIONS_SQL, raw_applications

FIELDS = ("activity_year", "action_taken", "derived_race", "derived_ethnicity", "county_code", "loan_purpose",
          "lien_status", "occupancy_type", "loan_amount", "income")
YEARS = ", ".join(str(y) for y in CFG.event_years)
FINALS = tuple(y for y in CFG.event_years if y > CFG.shock_year)
EVENT_SQL = f"""{RAW_APPLICATIONS_SQL}, ev as (select try_cast(activity_year as integer) as year, case when action_taken = '3' then 1 else 0 end denied,
 derived_race race, derived_ethnicity ethnicity, county_code, loan_purpose, lien_status, occupancy_type, try_cast(loan_amount as double) loan_amount,
 try_cast(income as double) * 1000 income from raw_applications
 where county_code is not null and county_code not in ('', 'NA') and try_cast(activity_year as integer) in ({YEARS})),
 ev2 as (select *, case when race = 'White' then 'ref' else 'focal' end side from ev where race in ('White', 'Black or African American'))"""
GAP_SQL = f"""{EVENT_SQL}, gy as (select year, count(*) filter (side = 'focal') n_focal, count(*) filter (side = 'ref') n_ref,
 avg(denied) filter (side = 'focal') rate_focal, avg(denied) filter (side = 'ref') rate_ref from ev2 group by year),
 gap as (select *, (rate_focal - rate_ref) * 100 gap_pp, (1 - rate_focal) / (1 - rate_ref) approval_ratio from gy)"""


def panel(spark, d):
    return build_panel(raw_applications(spark, d, *FIELDS), CFG)


@query("event_panel", f"with {EVENT_SQL} select * replace (round(loan_amount, 6) as loan_amount, round(income, 6) as income) from ev")
def event_panel(spark, d):
    return rounded(panel(spark, d))


@query("regime_gap", f"""with {GAP_SQL}, m as (select avg(gap_pp) filter (year between 1995 and 1996) b, avg(gap_pp) filter (year between 1997 and 1998) o,
 avg(gap_pp) filter (year between 2000 and 2001) a from gap)
 select round(b, 6) gap_before, round(o, 6) gap_boom, round(a, 6) gap_after, round(o - b, 6) boom_change_pp, round(a - o, 6) after_vs_boom_pp,
 round(a - b, 6) after_vs_before_pp, abs(a - b) < abs(a - o) is_reversal from m""")
def regime_gap(spark, d):
    return rounded(E.regime_summary(E.gap_by_year(panel(spark, d), CFG), CFG))


@query("four_fifths_pairwise", f"""with {GAP_SQL} select year, n_focal, n_ref, round(rate_focal, 6) rate_focal, round(rate_ref, 6) rate_ref,
 round(gap_pp, 6) gap_pp, round(approval_ratio, 6) approval_ratio from gap""")
def four_fifths_pairwise(spark, d):
    return rounded(E.gap_by_year(panel(spark, d), CFG))


KITA_SQL = f"""{EVENT_SQL}, sc as (select year, side, loan_purpose || '|' || lien_status || '|' || occupancy_type segment, count(*) n, avg(denied) d
  from ev2 where year in (1998, {', '.join(map(str, FINALS))}) group by all),
 sw as (select *, n * 1e0 / sum(n) over (partition by year, side) w from sc),
 fin as (select unnest([{', '.join(map(str, FINALS))}]) final_year),
 kk as (select distinct final_year, side, segment from sw, fin where sw.year in (1998, final_year)),
 kt as (select kk.*, coalesce(b.w, 0) w0, coalesce(l.w, 0) w1, b.d d0, l.d d1 from kk
  left join sw b on b.year = 1998 and b.side = kk.side and b.segment = kk.segment
  left join sw l on l.year = kk.final_year and l.side = kk.side and l.segment = kk.segment),
 terms as (select *, w1 - w0 dw, (w1 - w0) * (case when d0 is null then d1 when d1 is null then d0 else (d0 + d1) / 2 end) * 100 composition_pp,
  (w0 + w1) / 2 * coalesce(d1 - d0, 0) * 100 rate_pp, (w1 * coalesce(d1, 0) - w0 * coalesce(d0, 0)) * 100 observed_pp from kt)"""


@query("kitagawa", f"""with {KITA_SQL}, s as (select final_year, count(distinct segment) segments,
  sum(case side when 'focal' then observed_pp else -observed_pp end) change_pp,
  sum(case side when 'focal' then composition_pp else -composition_pp end) composition_pp,
  sum(case side when 'focal' then rate_pp else -rate_pp end) rate_pp from terms group by 1)
 select final_year, segments, round(change_pp, 6) change_pp, round(composition_pp, 6) composition_pp, round(rate_pp, 6) rate_pp,
 abs(composition_pp + rate_pp - change_pp) < 1e-8 adds_up, round(composition_pp / change_pp, 6) composition_share from s""")
def kitagawa(spark, d):
    return rounded(E.kitagawa(E.kitagawa_terms(panel(spark, d), CFG, FINALS)))


_TOP = ", ".join(
    f"round(coalesce(sum(case when side = '{s}' then {c} end), 0), 6) {a}_{s}"
    for s in ("focal", "ref") for c, a in (("dw", "dw"), ("composition_pp", "composition"), ("rate_pp", "rate")))


@query("top_segments", f"""with {KITA_SQL} select segment, {_TOP} from terms where final_year = 2000 group by 1
 order by round(abs(sum(case side when 'focal' then composition_pp else -composition_pp end)), 9) desc, segment limit 12""")
def top_segments(spark, d):
    return rounded(E.top_segments(E.kitagawa_terms(panel(spark, d), CFG, (2000,)), 2000))


CELLS_SQL = f"""{EVENT_SQL}, cy as (select year, county_code, loan_purpose, lien_status, count(*) filter (side = 'focal') n_focal,
  cast(coalesce(sum(denied) filter (side = 'focal'), 0) as bigint) k_focal, count(*) filter (side = 'ref') n_ref,
  cast(coalesce(sum(denied) filter (side = 'ref'), 0) as bigint) k_ref from ev2 group by all
  having count(*) filter (side = 'focal') >= 3 and count(*) filter (side = 'ref') >= 3),
 full_years as (select county_code, loan_purpose, lien_status from cy group by all having count(distinct year) = {len(CFG.event_years)}),
 bc as (select cy.* from cy join full_years using (county_code, loan_purpose, lien_status))"""


def cells(spark, d):
    return settle(E.cell_years(panel(spark, d), CFG))


@query("balanced_cells", f"with {CELLS_SQL} select * from bc")
def balanced_cells(spark, d):
    return E.cell_years(panel(spark, d), CFG)


COEF_SQL = f"""{CELLS_SQL}, hc as (select *, n_focal * n_ref * 1e0 / (n_focal + n_ref) h, k_focal * 1e0 / n_focal - k_ref * 1e0 / n_ref g from bc),
 lv as (select year, sum(h) hh, sum(h * g) / sum(h) theta, count(*) cells, cast(sum(n_focal + n_ref) as bigint) n from hc group by year),
 inf as (select hc.year, county_code, sum(h * (g - theta)) / max(hh) psi from hc join lv on hc.year = lv.year group by 1, 2),
 allc as (select distinct y.year, c.county_code from lv y, (select distinct county_code from inf) c),
 se as (select a.year, sqrt(sum(power(coalesce(i.psi, 0) - coalesce(b.psi, 0), 2))) se from allc a
  left join inf i on i.year = a.year and i.county_code = a.county_code
  left join inf b on b.year = 1998 and b.county_code = a.county_code group by 1),
 coef as (select lv.year, theta * 100 theta_pp, (theta - (select theta from lv where year = 1998)) * 100 gamma_pp,
  case when lv.year = 1998 then 0 else se * 100 end se_pp, cells, n from lv join se on lv.year = se.year)"""


def coefficients(spark, d):
    return E.within_cell(cells(spark, d), CFG)


@query("within_cell_estimator", f"""with {COEF_SQL} select year, round(theta_pp, 6) theta_pp, round(gamma_pp, 6) gamma_pp, round(se_pp, 6) se_pp, cells, n,
 round(gamma_pp - 1.96e0 * se_pp, 6) ci_low, round(gamma_pp + 1.96e0 * se_pp, 6) ci_high from coef""")
def within_cell_estimator(spark, d):
    return rounded(coefficients(spark, d))


@query("parallel_trends_verdict", f"""with {COEF_SQL}, v as (select count(*) filter (year < 1998) n_before,
  coalesce(max(abs(gamma_pp)) filter (year < 1998) < 1.0, true) parallel, max(abs(gamma_pp)) filter (year < 1998) lb,
  arg_max(gamma_pp, abs(gamma_pp)) filter (year > 1999) eff from coef)
 select n_before, parallel, round(lb, 6) largest_before_pp, round(eff, 6) effect_pp, case when n_before = 0 then 'not falsifiable' when not parallel then 'not identified'
 when abs(eff) < 1.0 then 'identified null' else 'effect' end verdict from v""")
def parallel_trends_verdict(spark, d):
    return rounded(E.trends_verdict(coefficients(spark, d), CFG))


@query("trend_adjusted", f"""with {COEF_SQL}, ln as (select regr_slope(theta_pp, year) s, regr_intercept(theta_pp, year) i, regr_r2(theta_pp, year) r2 from coef where year < 1999)
 select year, round(theta_pp, 6) observed_pp, round(s * year + i, 6) expected_pp, round(s, 6) slope, round(theta_pp - (s * year + i), 6) deviation_pp,
 round(r2, 6) r2 from coef, ln where year >= 1999""")
def trend_adjusted(spark, d):
    return rounded(E.trend_adjusted(coefficients(spark, d), CFG))


@query("differential_selection", f"""with {CELLS_SQL}, k as (select e.year, side, loan_amount / nullif(income, 0) lti from ev2 e
  semi join bc c on e.year = c.year and e.county_code = c.county_code and e.loan_purpose = c.loan_purpose and e.lien_status = c.lien_status
  where income > 0),
 w as (select year, count(*) filter (side = 'focal') n_focal, count(*) filter (side = 'ref') n_ref, median(lti) filter (side = 'focal') lf,
  median(lti) filter (side = 'ref') lr from k group by year), b as (select * from w where year = 1998),
 t as (select w.*, (w.n_focal * 1e0 / b.n_focal - 1) * 100 rf, (w.n_ref * 1e0 / b.n_ref - 1) * 100 rr, (w.lf - w.lr) - (b.lf - b.lr) ld from w, b)
 select year, n_focal, n_ref, round(lf, 6) lti_focal, round(lr, 6) lti_ref, round(rf, 6) retention_focal_pct, round(rr, 6) retention_ref_pct,
 round(ld, 6) lti_difference, round(rf - rr, 6) retention_difference_pp,
 (select max(abs(rf - rr)) from t where year > 1999) >= 10 contaminates from t""")
def differential_selection(spark, d):
    rows = stage(panel(spark, d), "event")
    return rounded(E.differential_selection(rows, settle(E.cell_years(rows, CFG)), CFG))


__all__ = ["F"]
