"""Gap between two groups over time: regimes, decomposition, within-cell event study, selection.

Input is the event panel: year, denied, race, the cell keys, loan_amount, income.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.config import Settings
from loanlens.functions.scalar import flag, ratio
from loanlens.operators.ranking import exact_quantiles

SEGMENT = ("loan_purpose", "lien_status", "occupancy_type")


def _two_groups(panel: DataFrame, cfg: Settings) -> DataFrame:
    return panel.where(F.col("race").isin(cfg.focal_group, cfg.reference_group)).withColumn(
        "side", F.when(F.col("race") == cfg.focal_group, "focal").otherwise("ref"))


def _side_sums() -> list[Column]:
    focal = F.col("side") == "focal"
    return [
        F.sum(flag(focal)).cast("bigint").alias("n_focal"),
        F.sum(F.when(focal, F.col("denied")).otherwise(0)).cast("bigint").alias("k_focal"),
        F.sum(flag(~focal)).cast("bigint").alias("n_ref"),
        F.sum(F.when(focal, 0).otherwise(F.col("denied"))).cast("bigint").alias("k_ref"),
    ]


def gap_by_year(panel: DataFrame, cfg: Settings) -> DataFrame:
    """Per year: volumes, denial rates, gap in points, approval ratio of the two groups."""
    t = _two_groups(panel, cfg).groupBy("year").agg(*_side_sums())
    f, r = ratio(F.col("k_focal"), F.col("n_focal")), ratio(F.col("k_ref"), F.col("n_ref"))
    return t.select(
        "year", "n_focal", "n_ref", f.alias("rate_focal"), r.alias("rate_ref"),
        ((f - r) * 100.0).alias("gap_pp"), ratio(F.lit(1.0) - f, F.lit(1.0) - r).alias("approval_ratio"))


def regime_summary(by_year: DataFrame, cfg: Settings) -> DataFrame:
    """One row: mean gap of each regime, the changes, and whether the last one returns to the first."""
    means = [
        F.avg(F.when(F.col("year").between(a, b), F.col("gap_pp"))).alias(f"gap_{name}")
        for name, a, b in cfg.regimes
    ]
    (first, _, _), (boom, _, _), (last, _, _) = cfg.regimes
    vs_boom = F.col(f"gap_{last}") - F.col(f"gap_{boom}")
    vs_first = F.col(f"gap_{last}") - F.col(f"gap_{first}")
    return by_year.agg(*means).select(
        "*", (F.col(f"gap_{boom}") - F.col(f"gap_{first}")).alias("boom_change_pp"),
        vs_boom.alias("after_vs_boom_pp"), vs_first.alias("after_vs_before_pp"),
        (F.abs(vs_first) < F.abs(vs_boom)).alias("is_reversal"))


def kitagawa_terms(panel: DataFrame, cfg: Settings, finals: Sequence[int]) -> DataFrame:
    """(final_year, side, segment): composition and rate term of the change since the base year.

    A segment absent in one year has weight 0 there, and the other year's rate stands for both.
    Only segment totals are joined, never applications.
    """
    keys = ["side", "segment"]
    cells = (
        _two_groups(panel, cfg).where(F.col("year").isin([cfg.base_year, *finals]))
        .groupBy("year", "side", F.concat_ws("|", *[F.coalesce(c, F.lit("none")) for c in SEGMENT]).alias("segment"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("denied").alias("d"))
        .withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("year", "side")))
    )
    base = cells.where(F.col("year") == cfg.base_year).select(
        F.explode(F.array(*[F.lit(int(y)) for y in finals])).alias("final_year"), *keys,
        F.col("w").alias("w0"), F.col("d").alias("d0"))
    last = cells.where(F.col("year") != cfg.base_year).select(
        F.col("year").alias("final_year"), *keys, F.col("w").alias("w1"), F.col("d").alias("d1"))
    both = base.join(last, ["final_year", *keys], "full_outer")
    w0, w1 = F.coalesce("w0", F.lit(0.0)), F.coalesce("w1", F.lit(0.0))
    mid = (F.coalesce("d0", "d1") + F.coalesce("d1", "d0")) / 2.0
    step = F.coalesce(F.col("d1") - F.col("d0"), F.lit(0.0))
    return both.select(
        "final_year", *keys, (w1 - w0).alias("dw"),
        ((w1 - w0) * mid * 100.0).alias("composition_pp"),
        ((w0 + w1) / 2.0 * step * 100.0).alias("rate_pp"),
        ((w1 * F.coalesce("d1", F.lit(0.0)) - w0 * F.coalesce("d0", F.lit(0.0))) * 100.0).alias("observed_pp"))


def _focal_minus_ref(c: str) -> Column:
    return F.sum(F.when(F.col("side") == "focal", F.col(c)).otherwise(-F.col(c)))


def kitagawa(terms: DataFrame) -> DataFrame:
    """Per final year: change of the gap, its two parts, and whether they add up."""
    t = terms.groupBy("final_year").agg(
        F.count_distinct("segment").alias("segments"), _focal_minus_ref("observed_pp").alias("change_pp"),
        _focal_minus_ref("composition_pp").alias("composition_pp"), _focal_minus_ref("rate_pp").alias("rate_pp"))
    return t.withColumn(
        "adds_up", F.abs(F.col("composition_pp") + F.col("rate_pp") - F.col("change_pp")) < 1e-8
    ).withColumn("composition_share", F.when(F.abs("change_pp") > 1e-12, F.col("composition_pp") / F.col("change_pp")))


def top_segments(terms: DataFrame, final_year: int, limit: int = 12) -> DataFrame:
    """Segments with the largest composition difference between the groups."""
    def of(side: str, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0.0))

    t = terms.where(F.col("final_year") == final_year).groupBy("segment").agg(*[
        of(s, c).alias(f"{name}_{s}") for s in ("focal", "ref")
        for c, name in (("dw", "dw"), ("composition_pp", "composition"), ("rate_pp", "rate"))])
    away = F.abs(F.col("composition_focal") - F.col("composition_ref"))
    return t.orderBy(F.round(away, 9).desc(), "segment").limit(limit)


def cell_years(panel: DataFrame, cfg: Settings, *, balanced: bool = True) -> DataFrame:
    """Cell-years with enough applications of both groups; balanced keeps cells seen in every year."""
    keys = list(cfg.cell_keys)
    least = F.lit(cfg.min_per_cell_group)
    t = _two_groups(panel, cfg).groupBy("year", *keys).agg(*_side_sums()).where(
        (F.col("n_focal") >= least) & (F.col("n_ref") >= least))
    if not balanced:
        return t
    # one row per cell and year, so the window holds at most the number of years
    seen = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return t.withColumn("_years", seen).where(F.col("_years") == len(cfg.event_years)).drop("_years")


def _by_county(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted gap sums per (year, county), and the year's level built from them."""
    h = F.col("n_focal") * F.col("n_ref") / (F.col("n_focal") + F.col("n_ref"))
    gap = F.col("k_focal") / F.col("n_focal") - F.col("k_ref") / F.col("n_ref")
    county = cells.groupBy("year", "county_code").agg(
        F.sum(h).alias("h"), F.sum(h * gap).alias("hg"),
        F.count(F.lit(1)).alias("cells"), F.sum(F.col("n_focal") + F.col("n_ref")).alias("n"))
    levels = county.groupBy("year").agg(
        F.sum("h").alias("hh"), (F.sum("hg") / F.sum("h")).alias("theta"),
        F.sum("cells").cast("bigint").alias("cells"), F.sum("n").cast("bigint").alias("n"))
    return county, levels


def influence_changes(cells: DataFrame, cfg: Settings) -> DataFrame:
    """(year, county_code, influence_change): each county's influence on the level against the base
    year. A county missing in one of the two years has influence 0 there."""
    county, levels = _by_county(cells)
    infl = county.select("year", "county_code", "h", "hg").join(levels.select("year", "hh", "theta"), "year").select(
        "year", "county_code", ((F.col("hg") - F.col("theta") * F.col("h")) / F.col("hh")).alias("psi"))
    others = [F.lit(int(y)) for y in cfg.event_years if y != cfg.base_year]
    base = infl.where(F.col("year") == cfg.base_year).select(
        F.explode(F.array(*others)).alias("year"), "county_code", F.col("psi").alias("psi0"))
    return infl.where(F.col("year") != cfg.base_year).join(base, ["year", "county_code"], "full_outer").select(
        "year", "county_code",
        (F.coalesce("psi", F.lit(0.0)) - F.coalesce("psi0", F.lit(0.0))).alias("influence_change"))


def within_cell(cells: DataFrame, cfg: Settings) -> DataFrame:
    """Per year: within-cell gap weighted by n_f n_r / (n_f + n_r), change since the base year, and
    its standard error clustered by county."""
    _, levels = _by_county(cells)
    away = F.col("influence_change")
    errors = influence_changes(cells, cfg).groupBy("year").agg(F.sqrt(F.sum(away * away)).alias("se"))
    theta0 = levels.where(F.col("year") == cfg.base_year).select(F.max("theta")).scalar()
    se = F.when(F.col("year") == cfg.base_year, 0.0).otherwise(F.col("se")) * 100.0
    gamma = (F.col("theta") - theta0) * 100.0
    return levels.join(errors, "year", "left").select(
        "year", (F.col("theta") * 100.0).alias("theta_pp"), gamma.alias("gamma_pp"), se.alias("se_pp"), "cells", "n",
    ).select("*", (F.col("gamma_pp") - 1.96 * F.col("se_pp")).alias("ci_low"),
             (F.col("gamma_pp") + 1.96 * F.col("se_pp")).alias("ci_high"))


def trends_verdict(coefs: DataFrame, cfg: Settings) -> DataFrame:
    """Parallel trends by one economic threshold for both periods, and the verdict."""
    before, after = F.col("year") < cfg.base_year, F.col("year") > cfg.base_year + 1
    size = F.abs(F.col("gamma_pp"))

    def biggest(when: Column) -> Column:
        return F.max_by(F.col("gamma_pp"), F.when(when, F.struct(size, -F.col("year"))))

    t = coefs.agg(
        F.count_if(before).alias("n_before"),
        F.coalesce(F.max(F.when(before, size)) < cfg.meaningful_pp, F.lit(True)).alias("parallel"),
        F.max(F.when(before, size)).alias("largest_before_pp"),
        biggest(after).alias("effect_pp"))
    return t.withColumn(
        "verdict",
        F.when(F.col("n_before") == 0, "not falsifiable").when(~F.col("parallel"), "not identified")
        .when(F.abs("effect_pp") < cfg.meaningful_pp, "identified null").otherwise("effect"))


def trend_adjusted(coefs: DataFrame, cfg: Settings) -> DataFrame:
    """Deviations from the straight line through the pre-shock levels, with the line's slope and R2."""
    pre = F.col("year") < cfg.shock_year
    y, x = F.when(pre, F.col("theta_pp")), F.when(pre, F.col("year").cast("double"))
    line = coefs.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    expected = F.col("_slope") * F.col("year") + line.select("intercept").scalar()
    return (
        coefs.where(~pre).withColumn("_slope", line.select("slope").scalar())
        .select("year", F.col("theta_pp").alias("observed_pp"), expected.alias("expected_pp"), F.col("_slope").alias("slope"))
        .withColumn("deviation_pp", F.col("observed_pp") - F.col("expected_pp"))
        .withColumn("r2", line.select("r2").scalar())
    )


def differential_selection(panel: DataFrame, cells: DataFrame, cfg: Settings) -> DataFrame:
    """Within balanced cells: how each group's volume and median loan-to-income moved since the base year.

    `contaminates` is set when the two groups' retention differs by 10 points or more after the shock.
    """
    keys = ["year", *cfg.cell_keys]
    kept = _two_groups(panel, cfg).where(F.col("income") > 0).join(cells.select(*keys), keys, "left_semi").select(
        "year", "side", ratio(F.col("loan_amount"), F.col("income")).alias("lti"))
    volume = kept.groupBy("year", "side").agg(F.count(F.lit(1)).alias("n"))
    median = exact_quantiles(kept, "lti", [0.5], ["year", "side"]).select("year", "side", F.col("value").alias("lti"))
    focal = F.col("side") == "focal"
    wide = volume.join(median, ["year", "side"]).groupBy("year").agg(
        F.max(F.when(focal, F.col("n"))).alias("n_focal"), F.max(F.when(~focal, F.col("n"))).alias("n_ref"),
        F.max(F.when(focal, F.col("lti"))).alias("lti_focal"), F.max(F.when(~focal, F.col("lti"))).alias("lti_ref"))
    at_base = Window.partitionBy()  # one row per year

    def base(c: str) -> Column:
        return F.max(F.when(F.col("year") == cfg.base_year, F.col(c))).over(at_base)

    kept_f = (F.col("n_focal") / base("n_focal") - 1.0) * 100.0
    kept_r = (F.col("n_ref") / base("n_ref") - 1.0) * 100.0
    burden = (F.col("lti_focal") - F.col("lti_ref")) - (base("lti_focal") - base("lti_ref"))
    t = wide.select("*", kept_f.alias("retention_focal_pct"), kept_r.alias("retention_ref_pct"), burden.alias("lti_difference"))
    t = t.withColumn("retention_difference_pp", F.col("retention_focal_pct") - F.col("retention_ref_pct"))
    worst = F.max(F.when(F.col("year") > cfg.shock_year, F.abs("retention_difference_pp"))).over(at_base)
    return t.withColumn("contaminates", F.coalesce(worst >= 10.0, F.lit(False)))
