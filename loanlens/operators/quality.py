"""Discrimination, calibration and stability of a score, per group, on any row count."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.scalar import (
    bin_left_closed, bin_right_closed, flag, logit, psi_term, ratio, sigmoid,
)
from loanlens.operators.ranking import attach, exact_quantiles, quantile_edges, running_totals
from loanlens.session import settle


def to_long(df: DataFrame, models: Sequence[str], keep: Sequence[str], name: str = "model") -> DataFrame:
    """One row per (row, model): kept columns, model name, score `p`. One scan."""
    cells = F.array(*[F.struct(F.lit(m).alias(name), F.col(m).cast("double").alias("p")) for m in models])
    return df.select(*keep, F.explode(cells).alias("_m")).select(*keep, f"_m.{name}", "_m.p")


def discrimination(df: DataFrame, y: str, p: str, groups: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """AUC with ties counted half, Gini and KS. Null where one class is absent."""
    w = F.lit(1) if weight is None else weight
    sums = {"pos": w * F.col(y), "neg": w * (1 - F.col(y))}
    t = running_totals(df, p, sums, groups)
    pairs = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    pos, neg = F.max("pos_total"), F.max("neg_total")
    # share of negatives below the threshold minus share of positives below it
    gap = ratio(F.col("neg_before"), F.col("neg_total")) - ratio(F.col("pos_before"), F.col("pos_total"))
    out = t.groupBy(*groups).agg(
        pos.alias("_p"), neg.alias("_n"),
        (pairs / F.nullif(pos.cast("double") * neg, F.lit(0.0))).alias("auc"),
        F.max(gap).alias("ks"))
    return out.select(*groups, F.col("_p").alias("n_pos"), F.col("_n").alias("n_neg"), "auc",
                      (F.lit(2.0) * F.col("auc") - 1.0).alias("gini"), "ks")


def _binned(df: DataFrame, y: str, p: str, groups: Sequence[str], n_bins: int) -> DataFrame:
    """Per equal-frequency right-closed bin: rows, sums of y, p and squared error."""
    edges = settle(quantile_edges(df, p, n_bins, groups))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    rows = attach(df.select(*groups, y, p), edges, groups, "edges")
    return rows.groupBy(*groups, bin_right_closed(F.col(p), inner).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("sy"),
        F.sum(p).alias("sp"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("se"))


def calibration(df: DataFrame, y: str, p: str, groups: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Brier score, ECE on equal-frequency bins, observed and predicted rate and their ratio."""
    b = _binned(df, y, p, groups, n_bins)
    n = F.sum("n")
    miss = F.sum(F.abs(F.col("sy") - F.col("sp")))
    return b.groupBy(*groups).agg(
        n.alias("n"), (F.sum("se") / n).alias("brier"), (miss / n).alias("ece"),
        (F.sum("sy") / n).alias("observed_rate"), (F.sum("sp") / n).alias("predicted_rate"),
        ratio(F.sum("sp"), F.sum("sy")).alias("calibration_ratio"))


def reliability_table(df: DataFrame, y: str, p: str, groups: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Per score bin: rows, mean prediction, observed rate, difference."""
    return _binned(df, y, p, groups, n_bins).select(
        *groups, "bin", "n",
        (F.col("sp") / F.col("n")).alias("predicted"), (F.col("sy") / F.col("n")).alias("observed"),
        ((F.col("sp") - F.col("sy")) / F.col("n")).alias("difference"))


def open_inner(edges: Column) -> Column:
    """Inner edges of a profile whose two ends are open."""
    return F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))


def psi(df: DataFrame, value: str, reference: Column, groups: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Population stability index of the rows outside `reference` against those inside it.

    Edges come from the reference only; bins are left-closed with open ends; 0 when either side is
    empty or the reference has fewer than three edges.
    """
    base = df.where(F.col(value).isNotNull()).select(*groups, value, reference.alias("_ref"))
    edges = settle(quantile_edges(base.where("_ref"), value, n_bins, groups))
    return _psi_on(base, value, edges, groups)


def _psi_on(base: DataFrame, value: str, edges: DataFrame, groups: Sequence[str]) -> DataFrame:
    rows = attach(base, edges, groups, "edges")
    g = list(groups)
    bins = rows.groupBy(*g, bin_left_closed(F.col(value), open_inner(F.col("edges"))).alias("bin")).agg(
        F.sum(flag(F.col("_ref"))).alias("e"), F.sum(flag(~F.col("_ref"))).alias("a"),
        F.max(F.size("edges")).alias("k"))
    totals = bins.groupBy(*g).agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    joined = attach(bins, totals, groups, "te", "ta")
    term = psi_term(F.col("e") / F.nullif(F.col("te"), F.lit(0)), F.col("a") / F.nullif(F.col("ta"), F.lit(0)))
    usable = (F.max("k") >= 3) & (F.max("te") > 0) & (F.max("ta") > 0)
    return joined.groupBy(*g).agg(F.when(usable, F.sum(term)).otherwise(0.0).alias("psi"))


LEVEL_READING = "level moved: recalibrate"
SHAPE_READING = "shape changed: consider retraining"


def reading(total: Column, shape: Column, warn: float = 0.10) -> Column:
    return F.when(total < warn, "stable").when(shape < warn, LEVEL_READING).otherwise(SHAPE_READING)


def stability(df: DataFrame, p: str, reference: Column, groups: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """PSI of a score split into level and shape.

    Shape is the PSI left after the current scores are moved on the logit scale to the reference's
    mean logit. `level_ratio` is the ratio of mean scores.
    """
    g = list(groups)
    base = df.select(*g, F.col(p).alias("p"), reference.alias("_ref"))
    ref, cur = F.col("_ref"), ~F.col("_ref")
    means = settle(base.groupBy(*g).agg(
        F.avg(F.when(ref, logit(F.col("p")))).alias("_lr"), F.avg(F.when(cur, logit(F.col("p")))).alias("_lc"),
        ratio(F.avg(F.when(cur, F.col("p"))), F.avg(F.when(ref, F.col("p")))).alias("level_ratio")))
    edges = settle(quantile_edges(base.where("_ref"), "p", n_bins, g))
    moved = attach(base, means, g, "_lr", "_lc").withColumn(
        "p", F.when(F.col("_ref"), F.col("p")).otherwise(
            sigmoid(logit(F.col("p")) - F.col("_lc") + F.col("_lr"))))
    total = _psi_on(base, "p", edges, g).withColumnRenamed("psi", "psi_total")
    shape = _psi_on(moved.select(*g, "p", "_ref"), "p", edges, g).withColumnRenamed("psi", "psi_shape")
    if g:
        out = total.join(shape, g).join(means.select(*g, "level_ratio"), g)
    else:
        out = total.select("psi_total", shape.scalar().alias("psi_shape"),
                           means.select("level_ratio").scalar().alias("level_ratio"))
    return out.withColumn("reading", reading(F.col("psi_total"), F.col("psi_shape")))


def summary(df: DataFrame, y: str, p: str, groups: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Discrimination and calibration side by side, one row per group."""
    d = discrimination(df, y, p, groups)
    return d.join(calibration(df, y, p, groups, n_bins), list(groups))


def score_cells(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """a, b, y, n: rows with the same two scores and class, which no ranking can part. Rows with a null count nowhere."""
    cells = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(y).cast("int").alias("y"))
    return cells.dropna().groupBy("a", "b", "y").agg(F.count(F.lit(1)).alias("n"))


def replica_weights(n: int, draw: int, replicas: int) -> np.ndarray:
    """How often each replica takes the `n` rows of a cell: sums of n Poisson(1) draws, the same at every retry."""
    return np.random.Generator(np.random.Philox(key=draw % 2**64)).poisson(n, replicas)


def _replica_pieces(dealt: DataFrame, replicas: int) -> DataFrame:
    """lo, tied, pos, neg, pairs: sums by replica of a sorted task's first value, of its last, and of all between them.

    Equal values may lie in two tasks, so only values between the first and the last are compared here; `tied` pieces
    hold one value.
    """
    zero = np.zeros(replicas)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, inner, middle = [], None, [zero, zero, zero]
        value, pos, neg = None, zero, zero

        def close(last: bool) -> None:
            nonlocal inner, middle
            if last or not out:
                out.append((value, True, pos, neg, zero))
            else:
                inner = value if inner is None else inner
                middle = [middle[0] + pos, middle[1] + neg, middle[2] + pos * (middle[1] + neg / 2)]

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for v, y, n, draw in rows:
                if v != value:
                    if value is not None:
                        close(False)
                    value, pos, neg = v, zero, zero
                w = replica_weights(n, draw, replicas)
                pos, neg = (pos + w, neg) if y else (pos, neg + w)
        if value is not None:
            close(True)
        if inner is not None:
            out.append((inner, False, *middle))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.float64()), pa.array(columns[1]),
                 *(pa.array([x.tolist() for x in c], pa.list_(pa.float64())) for c in columns[2:])],
                ["lo", "tied", "pos", "neg", "pairs"])

    return dealt.mapInArrow(run, "lo double, tied boolean, pos array<double>, neg array<double>, pairs array<double>")


def replica_aucs(cells: DataFrame, score: str, replicas: int) -> DataFrame:
    """replica, auc: of `score` in every replica of the cells (a, b, y, n, draw); null where a class is absent.

    Cells are sorted in ranges; a task gives out at most three pieces, however many rows a value has.
    """
    dealt = cells.repartitionByRange(F.col(score), F.col("draw")).sortWithinPartitions(score)
    pieces = _replica_pieces(dealt.select(score, "y", "n", "draw"), replicas)
    each = pieces.select("lo", "tied", F.posexplode(F.arrays_zip("pos", "neg", "pairs")).alias("replica", "_s"))
    flat = each.groupBy("replica", "lo").agg(
        F.max("tied").alias("tied"), *[F.sum(f"_s.{c}").alias(c) for c in ("pos", "neg", "pairs")])
    before = Window.partitionBy("replica").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # three rows per task
    own = F.when(F.col("tied"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("pairs"))
    pairs = flat.withColumn("pairs", own + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    return pairs.groupBy("replica").agg(
        (F.sum("pairs") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def bootstrap_auc_diff(df: DataFrame, *, y: str, a: str, b: str, replicas: int = 2000, seed: int = 0) -> DataFrame:
    """Paired Poisson bootstrap of AUC(a) - AUC(b): replicas used, mean, 95% interval, two-sided p.

    Rows are combined to cells of equal scores and class before anything is drawn. A cell of n rows draws Poisson(n), the
    law of the sum of its rows' draws, from a generator seeded by the cell itself, so both scores see the same weights
    and a retried task draws them again. Replicas without one of the classes are left out; without any, the row is null.
    """
    cells = settle(score_cells(df, y, a, b).withColumn("draw", F.xxhash64("a", "b", "y", F.lit(seed))))
    left, right = (replica_aucs(cells, s, replicas).withColumnRenamed("auc", f"auc_{s}") for s in ("a", "b"))
    diff = left.join(right, "replica").select((F.col("auc_a") - F.col("auc_b")).alias("diff")).dropna()
    ci = F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975)))
    low = F.avg(flag(F.col("diff") <= 0).cast("double"))
    high = F.avg(flag(F.col("diff") >= 0).cast("double"))
    return diff.agg(
        F.count(F.lit(1)).alias("replicas"), F.avg("diff").alias("diff"), ci.alias("_ci"),
        F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p_value"),
    ).select(
        "replicas", "diff", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"), "p_value",
    ).withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


__all__ = [
    "bootstrap_auc_diff", "calibration", "discrimination", "exact_quantiles", "psi", "reading",
    "reliability_table", "replica_aucs", "replica_weights", "score_cells", "stability", "summary", "to_long",
]
