"""Money side of a decision: losses, decision curve, cut-offs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.scalar import flag, ratio
from loanlens.operators.ranking import running_totals
from loanlens.session import settle


def share_or_default(share: Column, default: float) -> Column:
    """Guaranteed share clipped to [0, 1]; unknown takes the default."""
    known = F.when(~F.isnan(share), share)
    return F.least(F.greatest(F.coalesce(known, F.lit(default)), F.lit(0.0)), F.lit(1.0))


def loss_on_bad(y: Column, amount: Column) -> Column:
    """Charged-off amount of bad loans, zero elsewhere and where it is not reported."""
    return F.coalesce(amount, F.lit(0.0)) * y


def portfolio_totals(df: DataFrame, y: str, exposure: str, loss: str, share: str) -> DataFrame:
    """Lent, lost, who bears it, and the margins at which the book breaks even. One pass."""
    lost, borne = F.sum(loss), F.sum(F.col(loss) * F.col(share))
    own = F.sum(F.col(loss) * (F.lit(1.0) - F.col(share)))
    lent = F.sum(exposure)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).cast("bigint").alias("n_bad"),
        lent.alias("lent"), lost.alias("loss"),
        F.avg(share).alias("mean_share"),
        borne.alias("loss_guarantor"), own.alias("loss_lender"),
        ratio(lost, lent).alias("breakeven_gross"),
        ratio(own, lent).alias("breakeven_lender"),
    )


def decision_curve(
    df: DataFrame, *, key: str, y: str, score: str, loss: str, exposure: str,
    grid: Sequence[float],
) -> DataFrame:
    """Effect of declining the riskiest share k, for each k of the grid.

    Equal scores are ordered by the MD5 of the key, then the key. Scores are summed up first; only
    the rows that tie at a cut are read again, split by MD5 prefix so that one huge tie is still
    many tasks.
    """
    facts = df.select(
        F.col(key).alias("_key"), F.col(score).alias("_s"), F.col(y).alias("_y"),
        F.col(loss).alias("_loss"),
        F.when(F.col(y) == 0, F.col(exposure)).otherwise(0.0).alias("_good"),
    )
    sums = {"c": F.lit(1), "bad": F.col("_y"), "loss": F.col("_loss"), "good": F.col("_good")}
    names = list(sums)
    by_score = running_totals(facts, "_s", sums, descending=True)
    cuts = F.array(*[
        F.struct(F.lit(float(k)).alias("k"),
                 F.bround(F.lit(float(k)) * F.col("c_total")).cast("bigint").alias("m"))
        for k in grid
    ])
    hit = F.filter(cuts, lambda t: (
        (t["m"] > 0) & (t["m"] > F.col("c_before"))
        & (t["m"] <= F.col("c_before") + F.col("c"))))
    # one row per k: bounded by the grid
    edges = settle(
        by_score.withColumn("_t", F.explode(hit)).select(
            F.col("_t.k").alias("k"), F.col("_t.m").alias("m"), "_s",
            (F.col("_t.m") - F.col("c_before")).alias("_need"),
            *[F.col(f"{x}_before") for x in names], F.col("loss_total"), F.col("c_total"),
        ))
    tied = (
        facts.join(F.broadcast(edges.select("_s").distinct()), "_s")
        .withColumn("_md5", F.md5("_key"))
        .withColumn("_piece", F.substring("_md5", 1, 3))
    )
    pieces = tied.groupBy("_s", "_piece").agg(*[F.sum(c).alias(x) for x, c in sums.items()])
    earlier = Window.partitionBy("_s").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    piece_off = pieces.select(
        "_s", "_piece", F.col("c").alias("_pc"),
        *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"_p_{x}") for x in names])
    # for each k, the piece where the cut falls
    at_piece = settle(
        edges.join(piece_off, "_s")
        .where((F.col("_need") > F.col("_p_c")) & (F.col("_need") <= F.col("_p_c") + F.col("_pc")))
        .withColumn("_rest", F.col("_need") - F.col("_p_c")))
    rank = Window.partitionBy("_s", "_piece").orderBy("_md5", "_key")
    last = (
        tied.join(F.broadcast(at_piece.select("_s", "_piece").distinct()), ["_s", "_piece"])
        .withColumn("_at", F.row_number().over(rank))
        .join(F.broadcast(at_piece.select("k", "_s", "_piece", "_rest")), ["_s", "_piece"])
        .where(F.col("_at") <= F.col("_rest"))
        .groupBy("k").agg(*[F.sum(c).alias(f"_l_{x}") for x, c in sums.items()])
    )
    whole = at_piece.join(last, "k").select(
        F.col("k").alias("decline_rate"), F.col("m").alias("n_declined"),
        *[(F.col(f"{x}_before") + F.col(f"_p_{x}") + F.col(f"_l_{x}")).alias(x) for x in names],
        "loss_total",
    )
    return whole.select(
        "decline_rate", "n_declined",
        F.col("loss").alias("loss_avoided"),
        F.col("good").alias("good_volume_foregone"),
        F.col("bad").cast("bigint").alias("bad_declined"),
        (F.col("n_declined") - F.col("bad")).cast("bigint").alias("good_declined"),
        (F.col("bad") / F.col("n_declined")).alias("precision"),
        F.coalesce(ratio(F.col("loss"), F.col("loss_total")), F.lit(0.0)).alias("loss_capture"),
    )


def random_baseline(curve: DataFrame, total_loss: Column, total_good: Column) -> DataFrame:
    """Declining at random avoids k of the loss; lift compares the curve with that."""
    k = F.col("decline_rate")
    return curve.select(
        "*",
        (k * total_loss).alias("loss_avoided_random"),
        (k * total_good).alias("good_volume_random"),
        ratio(F.col("loss_avoided"), k * total_loss).alias("lift"),
    )


def optimal_cutoffs(curve: DataFrame, margins: Sequence[float]) -> DataFrame:
    """Per assumed margin: best decline rate, net benefit, and whether it sits on the grid's edge."""
    m = F.explode(F.array(*[F.lit(float(x)) for x in margins])).alias("margin")
    nets = curve.select("*", m).withColumn(
        "net", F.col("loss_avoided") - F.col("margin") * F.col("good_volume_foregone"))
    best = F.max_by("decline_rate", F.struct("net", -F.col("decline_rate")))
    return nets.groupBy("margin").agg(
        best.alias("decline_rate"), F.max("net").alias("net_benefit"),
        ((best == F.min("decline_rate")) | (best == F.max("decline_rate"))).alias("at_boundary"),
    )


def nearest(curve: DataFrame, rate: float) -> DataFrame:
    """The curve row closest to a decline rate, the lower one on a tie."""
    away = F.struct(F.round(F.abs(F.col("decline_rate") - F.lit(rate)), 9), F.col("decline_rate"))
    row = F.min_by(F.struct(*curve.columns), away).alias("_r")
    return curve.agg(row).select("_r.*")


def split_by_bearer(loss: Column, share: Column) -> tuple[Column, Column]:
    """(guarantor's part, lender's part) of a loss."""
    return loss * share, loss * (F.lit(1.0) - share)


__all__ = [
    "decision_curve", "flag", "loss_on_bad", "nearest", "optimal_cutoffs", "portfolio_totals",
    "random_baseline", "share_or_default", "split_by_bearer",
]
