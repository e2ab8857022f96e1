"""Population and score drift against a stored reference profile, and the retraining triggers.

A profile is two small tables: numeric (feature, edges, shares, mean) and categorical
(feature, category, share). Scores use the numeric form under a feature name of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.config import Settings
from loanlens.functions.scalar import (
    EPS, bin_left_closed, clip01, flag, logit, psi_term, sigmoid,
)
from loanlens.operators.quality import open_inner, reading
from loanlens.operators.ranking import attach_lookup, quantile_edges

NULL_CATEGORY = "NULO"  # fixed value: nulls are a category of their own


def numeric_long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, feature, v) without nulls and NaN; one scan for all features."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = df.select(*keep, F.explode(cells).alias("_x")).select(*keep, "_x.*")
    return long.where(F.col("v").isNotNull() & ~F.isnan("v"))


def category_counts(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, feature, category, n): nulls counted as a category; one scan."""
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("string"), F.lit(NULL_CATEGORY)).alias("category"))
        for f in features])
    long = df.select(*keep, F.explode(cells).alias("_x")).select(*keep, "_x.*")
    return long.groupBy(*keep, "feature", "category").agg(F.count(F.lit(1)).alias("n"))


def category_shares(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Adds the share within each feature. The window runs over counts, not over rows."""
    whole = Window.partitionBy(*keep, "feature")
    return category_counts(df, features, keep).withColumn("share", F.col("n") / F.sum("n").over(whole))


def numeric_profile(long: DataFrame, n_bins: int) -> DataFrame:
    """(feature, edges, shares, mean): equal-frequency edges of the reference rows and bin shares.

    A near-constant feature gets two bins split at its minimum.
    """
    edges = quantile_edges(long, "v", n_bins, ["feature"]).withColumn(
        "edges",
        F.when(F.size("edges") >= 3, F.col("edges")).otherwise(
            F.array(F.element_at("edges", 1), F.element_at("edges", 1), F.element_at("edges", -1))))
    bins = attach_lookup(long, edges, ["feature"], "edges").groupBy(
        "feature", "edges", bin_left_closed(F.col("v"), open_inner(F.col("edges"))).alias("bin")
    ).agg(F.count(F.lit(1)).alias("c"), F.sum("v").alias("s"))
    share_of = F.map_from_entries(F.collect_list(F.struct("bin", "c")))
    grouped = bins.groupBy("feature", "edges").agg(
        share_of.alias("_m"), F.sum("c").alias("_n"), (F.sum("s") / F.sum("c")).alias("mean"))
    shares = F.transform(
        F.sequence(F.lit(0), F.size("edges") - 2),
        lambda i: F.coalesce(F.element_at("_m", i), F.lit(0)) / F.col("_n"))
    return grouped.select("feature", "edges", shares.alias("shares"), "mean")


def categorical_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return category_shares(df, features).select("feature", "category", "share")


def score_profile(df: DataFrame, score: str, n_bins: int, name: str = "score") -> DataFrame:
    """Numeric profile of the clipped score; `mean` is the mean logit."""
    p = df.select(clip01(F.col(score)).alias("v"), F.lit(name).alias("feature"))
    base = numeric_profile(p, n_bins)
    return base.drop("mean").withColumn("mean", p.agg(F.avg(logit(F.col("v")))).scalar())


def profile_long(profile: DataFrame) -> DataFrame:
    """(feature, bin, lo, hi, share) with infinite ends, the stored form of a numeric profile."""
    k = F.size("edges") - 2
    rows = F.explode(F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(
        i.alias("bin"),
        F.when(i == 0, F.lit(float("-inf"))).otherwise(F.get("edges", i)).alias("lo"),
        F.when(i == k, F.lit(float("inf"))).otherwise(F.get("edges", i + 1)).alias("hi"),
        F.get("shares", i).alias("share"))))
    return profile.select("feature", rows.alias("_r")).select("feature", "_r.*")


def psi_numeric(long: DataFrame, profile: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, feature, psi): one aggregate by (keep, feature, bin) for all features and cohorts."""
    k = list(keep)
    marked = attach_lookup(long, profile, ["feature"], "edges")
    counts = marked.groupBy(
        *k, "feature", bin_left_closed(F.col("v"), open_inner(F.col("edges"))).alias("bin")
    ).agg(F.count(F.lit(1)).alias("c"))
    found = counts.groupBy(*k, "feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("_m"), F.sum("c").alias("_n"))
    terms = F.transform("shares", lambda e, i: psi_term(
        e, F.coalesce(F.element_at("_m", i), F.lit(0)) / F.col("_n")))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return found.join(profile.select("feature", "shares"), "feature").select(*k, "feature", total.alias("psi"))


def observed_vs_profile(observed: DataFrame, profile: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Categories of either side with both shares; a category missing on one side has share 0.

    `keep` are cohort columns: every cohort is compared with the whole profile.
    """
    ref = profile.select("feature", "category", F.col("share").alias("ref_share"))
    if keep:
        seen = observed.select(*keep, "feature").distinct()
        ref = seen.join(ref, "feature")
    keys = [*keep, "feature", "category"]
    return observed.select(*keys, F.col("share").alias("obs_share")).join(ref, keys, "full_outer").select(
        *keys, F.coalesce("ref_share", F.lit(0.0)).alias("ref_share"),
        F.coalesce("obs_share", F.lit(0.0)).alias("obs_share"), F.col("ref_share").isNull().alias("unseen"))


def psi_categorical(observed: DataFrame, profile: DataFrame, min_support: float, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, feature, psi, unsupported): unseen categories pooled in one bucket, and the mass in
    categories the reference hardly holds."""
    both = observed_vs_profile(observed, profile, keep)
    new = F.sum(F.when(F.col("unseen"), F.col("obs_share")).otherwise(0.0))
    known = F.sum(F.when(~F.col("unseen"), psi_term(F.col("ref_share"), F.col("obs_share"))).otherwise(0.0))
    return both.groupBy(*keep, "feature").agg(
        (known + F.when(new > 0, (new - EPS) * F.log(new / EPS)).otherwise(0.0)).alias("psi"),
        F.sum(F.when(F.col("ref_share") < min_support, F.col("obs_share")).otherwise(0.0)).alias("unsupported"))


def score_drift(df: DataFrame, score: str, profile: DataFrame, warn: float, keep: Sequence[str] = ()) -> DataFrame:
    """PSI of the score, PSI after removing the shift of the mean logit, the shift, and a reading."""
    k = list(keep)
    base = df.select(*k, clip01(F.col(score)).alias("v"), F.lit("score").alias("feature")).withColumn(
        "_l", logit(F.col("v")))
    means = base.groupBy(*k, "feature").agg(F.avg("_l").alias("_m")).join(
        profile.select("feature", F.col("mean").alias("_ref")), "feature").select(
        *k, "feature", (F.col("_m") - F.col("_ref")).alias("logit_shift"))
    moved = attach_lookup(base, means, [*k, "feature"], "logit_shift").select(
        *k, "feature", sigmoid(F.col("_l") - F.col("logit_shift")).alias("v"))
    total = psi_numeric(base.select(*k, "feature", "v"), profile, k).withColumnRenamed("psi", "psi_total")
    shape = psi_numeric(moved, profile, k).withColumnRenamed("psi", "psi_shape")
    keys = [*k, "feature"]
    return total.join(shape, keys).join(means, keys).drop("feature").withColumn(
        "reading", reading(F.col("psi_total"), F.col("psi_shape"), warn))


def band_of(cfg: Settings) -> Column:
    return (
        F.when(F.col("unsupported") >= cfg.unsupported_alarm, "VOCABULARY")
        .when(F.col("psi") < cfg.psi_warn, "stable").when(F.col("psi") < cfg.psi_action, "watch").otherwise("ACTION")
    )


def feature_drift(
    df: DataFrame, numeric: DataFrame, categorical: DataFrame, num: Sequence[str], cat: Sequence[str],
    cfg: Settings, keep: Sequence[str] = (),
) -> DataFrame:
    """(keep, feature, kind, psi, unsupported, band) for every feature."""
    a = psi_numeric(numeric_long(df, num, keep), numeric, keep).select(
        *keep, "feature", F.lit("numeric").alias("kind"), "psi", F.lit(0.0).alias("unsupported"))
    b = psi_categorical(category_shares(df, cat, keep), categorical, cfg.min_support, keep).select(
        *keep, "feature", F.lit("categorical").alias("kind"), "psi", "unsupported")
    return a.unionByName(b).withColumn("band", band_of(cfg))


def drift_by_cohort(features: DataFrame, scores: DataFrame, volumes: DataFrame, year: str, cfg: Settings) -> DataFrame:
    """One row per cohort: volume, worst feature, features in action, unsupported masses, score readings."""
    worst = F.struct(F.col("unsupported"), F.col("psi"), F.col("feature"))
    per = features.groupBy(year).agg(
        F.max_by("feature", worst).alias("worst_feature"), F.max_by("psi", worst).alias("worst_psi"),
        F.array_sort(F.collect_list(F.when(F.col("psi") >= cfg.psi_action, F.col("feature")))).alias("in_action"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(
            F.col("unsupported") >= cfg.unsupported_alarm, F.struct("feature", "unsupported"))))).alias("unsupported"))
    return volumes.join(per, year).join(scores, year, "left")


def trigger_vocabulary(features: DataFrame, cfg: Settings) -> DataFrame:
    """Fires when any cohort holds unsupported mass: the variable is lost, retraining alone does not help."""
    hit = features.where(F.col("unsupported") >= cfg.unsupported_alarm).groupBy("feature").agg(
        F.max("unsupported").alias("mass"))
    text = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("mass")).alias("o"), "feature", "mass"))),
        lambda x: F.format_string("%s %.3f", x["feature"], x["mass"])), ", ")
    return hit.agg(F.count(F.lit(1)).alias("_n"), text.alias("_d")).select(
        F.lit("vocabulary").alias("trigger"), (F.col("_n") > 0).alias("fired"),
        F.when(F.col("_n") > 0, F.col("_d")).otherwise("no unsupported category").alias("detail"))


def trigger_score_shape(scores: DataFrame, year: str, cfg: Settings) -> DataFrame:
    """Fires when the largest shape PSI over the cohorts reaches the warning level."""
    top = F.struct(F.col("psi_shape"), -F.col(year))
    return scores.agg(F.max("psi_shape").alias("v"), F.max_by(year, top).alias("y")).select(
        F.lit("score_shape").alias("trigger"),
        F.coalesce(F.col("v") >= cfg.psi_warn, F.lit(False)).alias("fired"),
        F.coalesce(F.format_string("shape PSI %.4f in %d", F.col("v"), F.col("y")), F.lit("no score")).alias("detail"))


def trigger_maturity(matched: DataFrame, reference: DataFrame, cfg: Settings) -> DataFrame:
    """Fires when the youngest cohort that reached the window is off the reference rate by the tolerance."""
    ok = matched.where((F.col("window_months") == cfg.maturity_window) & F.col("observable") & F.col("rate").isNotNull())
    ref = reference.where(F.col("window_months") == cfg.maturity_window).select(F.max("rate"))
    young = ok.agg(F.max("fy").alias("fy"), F.max_by("rate", "fy").alias("rate")).withColumn("ref", ref.scalar())
    off = (F.col("rate") - F.col("ref")) / F.nullif(F.col("ref"), F.lit(0.0))
    return young.select(
        F.lit("matched_maturity").alias("trigger"),
        F.coalesce(F.abs(off) > cfg.maturity_tolerance, F.lit(False)).alias("fired"),
        F.coalesce(F.format_string("%d at %dm: %.2f vs %.2f", "fy", F.lit(cfg.maturity_window), "rate", "ref"),
                   F.lit("no cohort reaches the window")).alias("detail"))


def retrain_decision(triggers: DataFrame) -> DataFrame:
    """All triggers with the overall decision."""
    return triggers.withColumn("retrain", triggers.agg(F.bool_or("fired")).scalar())


def require_fresh(profile_fingerprint: str, cfg: Settings) -> None:
    """A profile built under other settings must not be used."""
    if profile_fingerprint != cfg.fingerprint():
        raise ValueError(f"profile {profile_fingerprint} was built for other settings than {cfg.fingerprint()}: rebuild it")


def with_refusal(profile: DataFrame, cfg: Settings) -> DataFrame:
    """Adds whether a stored profile's rows were built under other settings, so a report can name them."""
    return profile.withColumn("refused", F.col("fingerprint") != cfg.fingerprint())


__all__ = ["flag"]
