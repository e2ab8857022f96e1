"""Prefix sums and quantiles where many values share a bucket, and lookups by few keys."""

import random

import numpy as np
import pytest
from loanlens.operators import gates, identification, models, ranking
from pyspark.sql import functions as F


@pytest.fixture()
def close(spark):
    """Values within one bucket, ties, zeros, negatives and far ones."""
    random.seed(4)
    values = [1.7e9 + random.randrange(60_000) for _ in range(800)] + [-(1.7e9 + random.randrange(900)) for _ in range(300)]
    values += [0.0] * 200 + [random.gauss(0, 1) for _ in range(300)] + [float("inf"), 1e-320, -1e300]
    return values, spark.createDataFrame([(v, float(i % 3)) for i, v in enumerate(values)], "v double, w double").repartition(3)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(close, descending):
    values, df = close
    weights = {}
    for i, v in enumerate(values):
        weights[v] = weights.get(v, 0.0) + i % 3
    before, want = 0.0, {}
    for v in sorted(weights, reverse=descending):
        want[v] = before
        before += weights[v]
    got = {r.v: (r.w_before, r.w_total) for r in ranking.running_totals(df, "v", {"w": F.col("w")}, descending=descending).collect()}
    assert got == {v: (b, before) for v, b in want.items()}


def test_quantiles(close):
    values, df = close
    finite = [v for v in values if v != float("inf")]
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.prob: r.value for r in ranking.exact_quantiles(df.where("v < double('infinity')"), "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(finite, p), rel=1e-12, abs=1e-12)


def test_slices_part_a_bucket(close):
    _, df = close
    keyed = ranking._keyed(df.where("v between 1.7e9 and 1.8e9"), "v").agg(
        F.count_distinct("_bucket").alias("b"), F.count_distinct("_slice").alias("s")).first()
    assert keyed.b == 1 and keyed.s > 100


def test_lookup_is_an_inner_join(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4)], "k string, v int")
    small = spark.createDataFrame([("a", 10, "x"), ("b", None, "y")], "k string, n int, t string")
    got = sorted(tuple(r) for r in ranking.attach_lookup(df, small, ["k"], "n", "t").collect())
    assert got == sorted(tuple(r) for r in df.join(small, "k").select("k", "v", "n", "t").collect())


def test_incoherent_names_rows_of_one_side(spark):
    source = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("d", None)], "m string, x double")
    published = spark.createDataFrame([("a", 1.5), ("c", 2.0), ("d", None)], "m string, x double")
    got = {tuple(r) for r in gates.incoherent(published, source, ["m"], ["x"]).collect()}
    assert got == {("a", "x"), ("b", "(not published)"), ("c", "(not in source)")}


def test_parity_needs_no_key(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.1, 0.1000001)], "id int, a double, b double")
    row = models.parity(df, "a", "b").first()
    assert row.n == 2 and row.equal and row.max_diff == pytest.approx(1e-7)


def test_close_means_keep_their_digits(spark):
    rows = [(1e3 * (i % 2), "m", 1e6 + (i % 2) * 1e-3 + (i % 7) * 1e-5) for i in range(2000)]
    df = spark.createDataFrame(rows, "amount double, method string, share double")
    share = np.array([r[2] for r in rows]) - 1e6
    cell = np.array([r[0] for r in rows])
    within = sum(((share[cell == c] - share[cell == c].mean()) ** 2).sum() for c in (0.0, 1e3))
    want = 1 - within / ((share - share.mean()) ** 2).sum()
    assert identification.treatment_r2(df, 500.0, 1e9).first().r2 == pytest.approx(want, abs=1e-3)


def test_quantiles_read_slices_of_wanted_buckets_only(spark):
    """Two buckets hold the ranks of two probs: the slices of all others are left out before they are searched."""
    rows = [(g, float(v) * 1.37) for g in "ab" for v in range(1, 4000)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = ranking.exact_quantiles(df, "v", [0.25, 0.9], ["g"])
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    want = {p: float(np.quantile([v for g, v in rows if g == "a"], p)) for p in (0.25, 0.9)}
    got = out.collect()
    assert len(got) == 4 and all(abs(r.value - want[r.prob]) < 1e-9 for r in got)
