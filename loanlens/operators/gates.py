"""Promotion gates, integrity of published numbers, publishing and report measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.config import GATE_THRESHOLDS
from loanlens.operators import quality

MAX_PAYLOAD_BYTES = 200_000


def thresholds(spark: SparkSession) -> DataFrame:
    """(gate, direction, threshold): the only place a threshold comes from."""
    return spark.createDataFrame([tuple(t) for t in GATE_THRESHOLDS], "gate string, direction string, threshold double")


def evaluate(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per gate. A metric that is absent or null fails."""
    met = F.when(F.col("direction") == "min", F.col("value") >= F.col("threshold")).otherwise(
        F.col("value") <= F.col("threshold"))
    return limits.join(metrics.select("gate", F.col("value").cast("double").alias("value")), "gate", "left").select(
        "gate", "value", "direction", "threshold",
        F.coalesce(met, F.lit(False)).alias("passed"),
        F.coalesce(met, F.lit(False)).alias("threshold_met"),
        F.when(F.col("value").isNull(), "metric absent").otherwise("").alias("detail"))


def margin(models: DataFrame, production: str, baseline: str) -> DataFrame:
    """Production AUC minus baseline AUC as a gate metric."""
    def auc(name: str) -> Column:
        return F.max(F.when(F.col("model") == name, F.col("auc_test")))

    return models.agg((auc(production) - auc(baseline)).alias("value")).select(
        F.lit("margin_over_baseline").alias("gate"), "value")


def fairness_gate(df: DataFrame, limit: float) -> DataFrame:
    """Blocks promotion, not the build: fails only if a model that misses the limit is promoted, or
    if nothing says whether it is. Columns: model, impact_ratio, worst_group, promoted (nullable)."""
    met = F.coalesce(F.col("impact_ratio") >= limit, F.lit(False))
    return df.select(
        "model", F.lit("disparate_impact").alias("gate"), F.col("impact_ratio").alias("value"),
        F.lit(limit).alias("threshold"),
        F.when(F.col("promoted").isNull(), False).otherwise(met | ~F.col("promoted")).alias("passed"),
        met.alias("threshold_met"),
        F.when(F.col("promoted").isNull(), "promotion flag absent")
        .when(~met & ~F.col("promoted"), F.concat(F.lit("worst group: "), F.col("worst_group"), F.lit(", not promoted")))
        .when(~met, F.concat(F.lit("worst group: "), F.col("worst_group"))).otherwise("").alias("detail"))


def verdict(df: DataFrame) -> DataFrame:
    """Text for a report: build failure, threshold missed, or pass."""
    return df.withColumn("verdict", F.when(~F.col("passed"), "FAIL").when(
        ~F.col("threshold_met"), "NOT MET (build ok, not promoted)").otherwise("PASS"))


def stale_reports(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """(file, fresh): does each report mention the current fingerprint?"""
    text = spark.read.text(path, wholetext=True)
    return text.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"),
        F.contains(F.col("value"), F.lit(fingerprint)).alias("fresh"))


def recomputed(df: DataFrame, models: Sequence[str], y: str) -> DataFrame:
    """(model, metric, value) from stored predictions."""
    long = quality.to_long(df, models, [y])
    s = quality.summary(long, y, "p", ["model"])
    cells = F.array(*[F.struct(F.lit(f"{m}_test").alias("metric"), F.col(m).alias("value"))
                      for m in ("auc", "gini", "ks", "brier")])
    return s.select("model", F.inline(cells))


def tampering(published: DataFrame, actual: DataFrame, tol: float = 1e-4) -> DataFrame:
    """Published values that differ from the recomputed ones, and models without predictions."""
    stored = actual.select("model").distinct()
    absent = published.select("model").distinct().join(stored, "model", "left_anti").select(
        "model", F.lit(None).cast("string").alias("metric"), F.lit("no predictions").alias("issue"))
    changed = (
        published.join(actual.withColumnRenamed("value", "_actual"), ["model", "metric"])
        .where(F.abs(F.col("value") - F.col("_actual")) > tol)
        .select("model", "metric", F.lit("altered").alias("issue"))
    )
    return changed.unionByName(absent)


def project(df: DataFrame, columns: Sequence[str], source: str) -> DataFrame:
    """Copy-only projection for publishing: declared columns that exist, and where they come from."""
    return df.select(F.lit(source).alias("source"), *[c for c in columns if c in df.columns])


def incoherent(published: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Published values that are not exactly the source's, nulls compared as values.

    A row that only one side has is reported once, with the column `(not in source)` or `(not published)`.
    """
    a = published.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in columns], F.lit(True).alias("_published"))
    b = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in columns], F.lit(True).alias("_found"))
    j = a.join(b, list(keys), "full_outer")
    cells = F.array_compact(F.array(*[
        F.when(~F.col(f"_p_{c}").eqNullSafe(F.col(f"_s_{c}")), F.lit(c)) for c in columns]))
    found = F.when(F.col("_found").isNull(), F.array(F.lit("(not in source)"))).when(
        F.col("_published").isNull(), F.array(F.lit("(not published)"))).otherwise(cells)
    return j.select(*keys, F.explode(found).alias("column"))


def payload_bytes(df: DataFrame) -> DataFrame:
    """Total JSON size of a payload's rows and whether it is over the limit."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("bigint"))
    return df.agg(F.coalesce(size, F.lit(0)).alias("bytes")).withColumn("too_large", F.col("bytes") > MAX_PAYLOAD_BYTES)


def measures(
    models: DataFrame, limits: DataFrame, impact: DataFrame, headline: DataFrame, stress: DataFrame, *,
    production: str, baseline: str, crisis: str, provenance: str,
) -> DataFrame:
    """(measure, value, text): the dashboard's measures over published result tables.

    Every source is a handful of rows; thresholds are looked up, never written here.
    """
    def auc(name: str) -> Column:
        return models.where(F.col("model") == name).select(F.max("auc_test")).scalar()

    def limit(gate: str) -> Column:
        return limits.where(F.col("gate") == gate).select(F.max("threshold")).scalar()

    saved = headline.select(F.sum("loss_avoided")).scalar()
    given = headline.select(F.sum("good_volume_foregone")).scalar()
    worst = impact.select(F.min("model_ratio")).scalar()
    crash = stress.where(F.col("cohort") == crisis)
    one = models.agg(F.count(F.lit(1)).alias("_n")).select(
        auc(production).alias("a"), auc(baseline).alias("b"), limit("margin_over_baseline").alias("m"),
        worst.alias("d"), limit("disparate_impact").alias("t"), saved.alias("s"), given.alias("g"),
        crash.select(F.max("auc")).scalar().alias("c"),
        crash.select(F.max("calibration_ratio")).scalar().alias("q"))

    def row(name: str, value: Column | None, text: Column | None = None) -> Column:
        v = F.lit(None).cast("double") if value is None else value.cast("double")
        return F.struct(F.lit(name).alias("measure"), v.alias("value"),
                        (F.lit(None).cast("string") if text is None else text).alias("text"))

    a, b, m, d, t, s, g, c, q = (F.col(x) for x in "abmdtsgcq")
    return one.select(F.inline(F.array(
        row("production_auc", a), row("baseline_auc", b), row("margin_over_baseline", a - b),
        row("margin_threshold", m), row("margin_verdict", None, F.when(a - b >= m, "met").otherwise("NOT met")),
        row("impact_threshold", t), row("model_disparate_impact", d),
        row("fairness_verdict", None, F.when(d >= t, "MET").otherwise("NOT MET, promotion blocked")),
        row("loss_avoided", s), row("good_volume_foregone", g),
        row("cost_per_dollar", g / F.nullif(s, F.lit(0.0))),
        row("crisis_auc", c), row("crisis_underestimation", F.lit(1.0) / F.nullif(q, F.lit(0.0))),
        row("provenance", None, F.lit(provenance)),
    )))
