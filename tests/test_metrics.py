"""Metrics against brute force on small tables with heavy ties and one hot group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.operators import calibrate as C
from loanlens.operators import economics as EC
from loanlens.operators import models as M
from loanlens.operators import quality as Q
from loanlens.operators.ranking import exact_quantiles, order_bucket, running_totals


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 3000
    score = np.round(rng.beta(2, 8, n), 2)
    score[: n // 3] = 0.17  # a third of the rows share one score
    y = (rng.random(n) < score).astype(int)
    group = np.where(np.arange(n) % 3 == 0, "small", "hot")
    amount = np.round(rng.lognormal(10, 1, n), 2)
    data = [(f"id{i}", group[i], float(score[i]), int(y[i]), float(amount[i])) for i in range(n)]
    df = spark.createDataFrame(data, "id string, g string, p double, y int, amount double").cache()
    return df, data


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_bucket_keeps_order(spark):
    rng = np.random.default_rng(1)
    values = sorted([0.0, -1.0, 1e-300, 5e-324, 1e300, -1e-5, *rng.normal(0, 1, 500), *rng.lognormal(0, 9, 500)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", order_bucket(F.col("v")).alias("b"))
    got = [r["b"] for r in df.orderBy("v").collect()]
    assert got == sorted(got)


def test_running_totals(rows):
    df, data = rows
    out = running_totals(df, "p", {"c": F.lit(1)}, ["g"], descending=True).collect()
    for r in out:
        mine = [d[2] for d in data if d[1] == r["g"]]
        assert r["c_before"] == sum(v > r["p"] for v in mine)
        assert r["c"] == mine.count(r["p"])
        assert r["c_total"] == len(mine)


def test_exact_quantiles(rows):
    df, data = rows
    probs = [0.0, 0.1, 0.333, 0.5, 0.97, 1.0]
    for value, at in (("p", 2), ("amount", 4)):
        for r in exact_quantiles(df, value, probs, ["g"]).collect():
            want = np.quantile([d[at] for d in data if d[1] == r["g"]], r["prob"])
            assert r["value"] == pytest.approx(want, rel=1e-12)


def test_auc_ks_gini(rows):
    df, data = rows
    y, p = np.array([d[3] for d in data]), np.array([d[2] for d in data])
    r = Q.discrimination(df, "y", "p").first()
    assert r["auc"] == pytest.approx(brute_auc(y, p), abs=1e-12)
    ks = max((p[y == 1] >= t).mean() - (p[y == 0] >= t).mean() for t in np.unique(p))
    assert r["ks"] == pytest.approx(ks, abs=1e-12)
    assert r["gini"] == pytest.approx(2 * r["auc"] - 1)


def test_ece_brier(rows):
    df, data = rows
    y, p = np.array([d[3] for d in data], float), np.array([d[2] for d in data])
    edges = np.unique(np.quantile(p, np.linspace(0, 1, 11)))
    which = np.digitize(p, edges[1:-1], right=True)
    ece = sum((which == b).mean() * abs(y[which == b].mean() - p[which == b].mean()) for b in np.unique(which))
    r = Q.calibration(df, "y", "p").first()
    assert r["ece"] == pytest.approx(ece, abs=1e-12)
    assert r["brier"] == pytest.approx(((p - y) ** 2).mean(), abs=1e-12)


def test_psi_and_level_against_shape(spark):
    rng = np.random.default_rng(3)
    ref = 1 / (1 + np.exp(-rng.normal(-2, 1, 4000)))
    moved = 1 / (1 + np.exp(-(np.log(ref / (1 - ref)) + 0.8)))
    df = spark.createDataFrame(
        [(float(v), True) for v in ref] + [(float(v), False) for v in moved], "p double, ref boolean")
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    e, a = (np.clip(np.histogram(v, edges)[0] / len(v), 1e-6, None) for v in (ref, moved))
    r = Q.stability(df, "p", F.col("ref")).first()
    assert r["psi_total"] == pytest.approx(((a - e) * np.log(a / e)).sum(), abs=1e-10)
    assert r["psi_shape"] < 0.01 < 0.10 < r["psi_total"]
    assert r["reading"] == Q.LEVEL_READING


def test_decision_curve_with_a_huge_tie(rows):
    import hashlib

    df, data = rows
    df = df.withColumn("loss", F.col("amount") * F.col("y"))
    order = sorted(data, key=lambda d: (-d[2], hashlib.md5(d[0].encode()).hexdigest(), d[0]))
    got = {round(r["decline_rate"], 2): r for r in EC.decision_curve(
        df, key="id", y="y", score="p", loss="loss", exposure="amount", grid=[0.01, 0.2, 0.35, 0.5]).collect()}
    for k, r in got.items():
        head = order[: round(k * len(data))]
        assert r["n_declined"] == len(head)
        assert r["bad_declined"] == sum(d[3] for d in head)
        assert r["loss_avoided"] == pytest.approx(sum(d[4] * d[3] for d in head))
        assert r["good_volume_foregone"] == pytest.approx(sum(d[4] for d in head if not d[3]))
    assert len(got) == 4


def test_shift_matches_bisection(rows):
    df, data = rows
    y, p = np.array([d[3] for d in data]), np.clip([d[2] for d in data], 1e-6, 1 - 1e-6)
    low, high = -10.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        if (1 / (1 + np.exp(-(np.log(p / (1 - p)) + mid)))).mean() < y.mean():
            low = mid
        else:
            high = mid
    assert C.fit_shift(df, "y", "p") == pytest.approx(low, abs=1e-7)


def test_calibrators_keep_order_and_range(rows):
    df, _ = rows
    for name in C.CALIBRATORS:
        out = C.calibrate(name, df, df, "y", "p", "q").select("p", "q").distinct().orderBy("p").collect()
        q = [r["q"] for r in out]
        assert all(a <= b + 1e-12 for a, b in zip(q, q[1:])) and 0 <= min(q) and max(q) <= 1


def test_bootstrap_sees_no_difference_between_equal_scores(rows):
    df, _ = rows
    r = Q.bootstrap_auc_diff(df.withColumn("q", F.col("p")), y="y", a="p", b="q", replicas=20, seed=1).first()
    assert r["replicas"] == 20 and r["diff"] == 0 and not r["significant"]


def test_bootstrap_finds_a_better_score(rows):
    df, data = rows
    y, p = np.array([d[3] for d in data]), np.array([d[2] for d in data])
    worse = df.withColumn("q", F.lit(1.0) - F.col("p"))
    r = Q.bootstrap_auc_diff(worse, y="y", a="p", b="q", replicas=40, seed=1).first()
    assert r["significant"] and r["diff"] == pytest.approx(2 * brute_auc(y, p) - 1, abs=0.05)


def test_replica_aucs_are_those_of_repeated_rows(rows):
    df, _ = rows
    scores = df.withColumn("q", F.round(1 - F.col("p") * F.col("p"), 1))
    cells = Q.score_cells(scores, "y", "p", "q").withColumn("draw", F.xxhash64("a", "b", "y")).cache()
    kept = cells.collect()
    weights = [Q.replica_weights(c.n, c.draw, 30) for c in kept]
    for score in ("a", "b"):
        got = {r.replica: r.auc for r in Q.replica_aucs(cells, score, 30).collect()}
        assert len(got) == 30
        for k, auc in got.items():
            many = [w[k] for w in weights]
            y, p = np.repeat([c.y for c in kept], many), np.repeat([c[score] for c in kept], many)
            assert auc == pytest.approx(brute_auc(y, p), abs=1e-12)


def test_bootstrap_width_is_that_of_placement_values(rows):
    df, data = rows
    y, p = np.array([d[3] for d in data]), np.array([d[2] for d in data])
    q = np.round(1 - p * p, 1)
    pos, neg = y == 1, y == 0

    def placed(s):
        wins = (s[pos][:, None] > s[neg][None, :]) + 0.5 * (s[pos][:, None] == s[neg][None, :])
        return wins.mean(1), wins.mean(0)

    (up, uq), (vp, vq) = placed(p), placed(q)
    error = np.sqrt(np.var(up - vp, ddof=1) / pos.sum() + np.var(uq - vq, ddof=1) / neg.sum())
    scores = df.withColumn("q", F.round(1 - F.col("p") * F.col("p"), 1))
    r = Q.bootstrap_auc_diff(scores, y="y", a="p", b="q", replicas=2000, seed=3).first()
    assert r["diff"] == pytest.approx(up.mean() - vp.mean(), abs=0.2 * error)
    assert r["ci_high"] - r["ci_low"] == pytest.approx(3.92 * error, rel=0.15)


def test_bootstrap_without_a_class_or_rows(rows):
    df, _ = rows
    for few in (df.where("y = 1"), df.limit(0), df.withColumn("p", F.lit(None).cast("double"))):
        r = Q.bootstrap_auc_diff(few.withColumn("q", F.col("p")), y="y", a="p", b="q", replicas=5, seed=1).first()
        assert r["replicas"] == 0 and r["diff"] is None


def test_codes_are_dense_and_sorted_over_many_ranges(spark):
    names = [f"k{i:03d}" for i in range(500)] + ["Z", "é", ""]
    train = spark.createDataFrame([(v, "x" if i % 3 else None) for i, v in enumerate(names)], "a string, b string")
    vocab = M.vocabulary(train, ["a", "b"]).cache()
    got = {(r.feature, r.category): r.code for r in vocab.collect()}
    assert got == {**{("a", v): i for i, v in enumerate(sorted(names))}, ("b", "x"): 0}
    coded = M.encode(spark.createDataFrame([("k001", None, "7"), ("new", "x", "n/a")], "a string, b string, v string"), vocab, ["v"], ["a", "b"])
    assert sorted(tuple(r) for r in coded.collect()) == sorted([(got["a", "k001"], -1, 7.0), (-1, 0, None)], key=str)
    assert M.vocabulary(train.limit(0), ["a", "b"]).count() == 0
