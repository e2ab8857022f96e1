"""Global order without a one-partition sort: prefix sums and exact quantiles.

Equal values are summed up first. Distinct values then get an order-preserving key whose upper part is a bucket (1/1024
of a factor of two) and whose lower part is one of `SLICES` slices of it. Totals by bucket and by slice are small
whatever the row count; values are only ordered inside a slice, so a bucket that holds most values is still many tasks.
The key is an expression of the value alone, hence the same after a retry.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 1024
SLICES = 4096
SHIFT = 1200 * STEPS * SLICES  # above 1075 * STEPS * SLICES, the smallest double's exponent


def order_key(v: Column) -> Column:
    """Whole number that never decreases when v grows."""
    size = F.floor(F.least(F.log2(F.abs(v)) * STEPS * SLICES, F.lit(1100.0 * STEPS * SLICES))) + F.lit(SHIFT)
    return F.when(v > 0, size).when(v < 0, -size).when(v == 0, F.lit(0).cast("bigint"))


def order_bucket(v: Column) -> Column:
    """The key's upper part."""
    return F.floor(order_key(v) / SLICES)


def _keyed(df: DataFrame, value: str) -> DataFrame:
    """Adds the bucket and the slice of a value."""
    v = F.col(value)
    return df.withColumns({"_bucket": order_bucket(v), "_slice": F.pmod(order_key(v), F.lit(SLICES))})


def _offsets(
    flat: DataFrame, groups: Sequence[str], names: Sequence[str], *, descending: bool = False,
    wanted: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(groups, _bucket, _slice): what comes before the slice, `_off_<name>`, and the group's `<name>_total`.

    `wanted` filters the buckets (a few thousand rows) before the slices, which can be as many as the values, are read."""
    side = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    slices = flat.groupBy(*groups, "_bucket", "_slice").agg(*[F.sum(n).alias(n) for n in names])
    buckets = slices.groupBy(*groups, "_bucket").agg(*[F.sum(n).alias(n) for n in names])
    everything = Window.partitionBy(*groups)  # a row per bucket
    before = everything.orderBy(side("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        *groups, "_bucket",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_top_{n}") for n in names],
        *[F.sum(n).over(everything).alias(f"{n}_total") for n in names],
        *[F.col(n).alias(f"_all_{n}") for n in names])
    if wanted:
        buckets = wanted(buckets)
        slices = slices.join(buckets.select(*groups, "_bucket"), [*groups, "_bucket"], "left_semi")
    inside = Window.partitionBy(*groups, "_bucket").orderBy(side("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        *groups, "_bucket", "_slice", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_in_{n}") for n in names],
        *[F.col(n).alias(f"_of_{n}") for n in names])
    return slices.join(buckets, [*groups, "_bucket"]).select(
        *groups, "_bucket", "_slice", *[(F.col(f"_top_{n}") + F.col(f"_in_{n}")).alias(f"_off_{n}") for n in names],
        *[f"_of_{n}" for n in names], *[f"{n}_total" for n in names])


def running_totals(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column],
    groups: Sequence[str] = (),
    *,
    descending: bool = False,
) -> DataFrame:
    """One row per (groups, value): each sum, its total before this value and its group total.

    Adds `<name>`, `<name>_before` and `<name>_total`. Equal values share a row, so ties are whole.
    Groups must not be null.
    """
    g = list(groups)
    names = list(sums)
    flat = _keyed(df.groupBy(*g, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), value)
    place = [*g, "_bucket", "_slice"]
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*place).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return flat.join(_offsets(flat, g, names, descending=descending), place).select(
        *g, value, *names,
        *[(F.col(f"_off_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before") for n in names],
        *[f"{n}_total" for n in names],
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """(groups, prob, value): linear-interpolated exact quantiles, nulls and NaN ignored.

    Rows are combined to counts of distinct values; counts of buckets, then those of their slices, say which slices hold
    the wanted ranks, and only the values of those (at most two per prob and group) are ordered.
    """
    g = list(groups)
    place = [*g, "_bucket", "_slice"]
    counts = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .select(*g, F.col(value).cast("double").alias("_v"))
        .groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_k"))
    )
    base = _keyed(counts, "_v")
    every = F.array(*[F.lit(float(p)) for p in probs])

    def touching(first: Column, count: Column, n: Column) -> Column:
        last = first + count - 1
        found = F.filter(every, lambda p: (
            F.floor(p * (n - 1)).between(first, last) | F.ceil(p * (n - 1)).between(first, last)))
        return F.transform(found, lambda p: F.struct(p.alias("prob"), (p * (n - 1)).alias("pos")))

    def holding(buckets: DataFrame) -> DataFrame:
        return buckets.where(F.size(touching(F.col("_top__k"), F.col("_all__k"), F.col("_k_total"))) > 0)

    placed = _offsets(base, g, ["_k"], wanted=holding).select(
        *place, F.col("_off__k").alias("_first"), F.col("_of__k").alias("_c"), F.col("_k_total").alias("_n"))
    targets = placed.where(F.size(touching(F.col("_first"), F.col("_c"), F.col("_n"))) > 0).drop("_c")
    inside = Window.partitionBy(*place).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = base.join(targets, place).withColumn(
        "_at", F.col("_first") + F.coalesce(F.sum("_k").over(inside), F.lit(0)))
    hit = ranked.select(
        *g, "_v", "_at", "_k",
        F.explode(touching(F.col("_at"), F.col("_k"), F.col("_n"))).alias("_s"),
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("_at"), F.col("_at") + F.col("_k") - 1), F.col("_v")))

    pos = F.col("_s.pos")
    picked = hit.groupBy(*g, F.col("_s.prob").alias("prob")).agg(
        at(F.floor(pos)).alias("_lo"), at(F.ceil(pos)).alias("_hi"),
        F.max(pos - F.floor(pos)).alias("_f"),
    )
    return picked.select(
        *g, "prob",
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"),
    )


def quantile_edges(
    df: DataFrame, value: str, n_bins: int, groups: Sequence[str] = ()
) -> DataFrame:
    """(groups, edges): sorted distinct equal-frequency bin edges, both ends included."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = exact_quantiles(df, value, probs, groups)
    return q.groupBy(*groups).agg(F.array_sort(F.collect_set("value")).alias("edges"))


def attach(df: DataFrame, small: DataFrame, groups: Sequence[str], *names: str) -> DataFrame:
    """Add summary columns: by key, or as scalar subqueries when there is no key."""
    if groups:
        return df.join(small.select(*groups, *names), list(groups))
    return df.select("*", *[small.select(n).scalar().alias(n) for n in names])


def attach_lookup(df: DataFrame, small: DataFrame, keys: Sequence[str], *names: str) -> DataFrame:
    """Inner join with a table of few keys (features, cohorts) as one map in every row, so rows are not shuffled by
    a handful of key values. Rows without their key go, as in an inner join."""
    key = F.struct(*keys)
    table = small.agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.struct(*names).alias("v"))))).scalar()
    found = df.withColumn("_found", F.element_at(table, key)).where(F.col("_found").isNotNull())
    return found.select(*df.columns, *[F.col(f"_found.{n}").alias(n) for n in names])
