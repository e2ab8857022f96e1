"""Known answers and semantic traps of the domain operators."""

import datetime as dt
import hashlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.config import TESTBED, Settings
from loanlens.functions import text as T
from loanlens.functions.scalar import calendar_months
from loanlens.operators import audits, cohorts, drift, eventstudy, fairness, features, gates, notices, vocabulary
from loanlens.operators.scorecard import category_places, monotone_bins
from loanlens.session import settle
from loanlens.sources import files
from loanlens.sources.loans import PANEL_COLUMNS


def test_calendar_months_count_boundaries(spark):
    df = spark.createDataFrame([(dt.date(2001, 1, 31), dt.date(2001, 2, 1))], "a date, b date")
    assert df.select(calendar_months("a", "b")).first()[0] == 1


def test_unobservable_cells_are_null(spark):
    rows = [(2000, dt.date(2000, 1, 1), "CHGOFF", dt.date(2000, 9, 1)), (2000, dt.date(2000, 12, 1), "P I F", dt.date(2001, 3, 1))]
    res = spark.createDataFrame(rows, "fy int, approved_on date, status string, resolved_on date")
    out = {r["window_months"]: r for r in cohorts.matched_maturity(
        res, F.lit("2001-12-15").cast("date"), (12, 24), 1990, "CHGOFF").collect()}
    assert out[12]["observable"] and out[12]["n_chargeoffs"] == 1 and out[12]["rate"] == 50.0
    assert not out[24]["observable"] and out[24]["rate"] is None and out[24]["n_resolved"] is None


def test_support_is_not_presence(spark):
    train = spark.createDataFrame([("old", )] * 9999 + [("rare",)], "c string")
    profile = drift.categorical_profile(train, ["c"])
    now = drift.category_shares(spark.createDataFrame([("rare",)] * 52 + [("old",)] * 48, "c string"), ["c"])
    r = drift.psi_categorical(now, profile, 0.005).first()
    assert r["unsupported"] == pytest.approx(0.52)


def test_profile_survives_json(spark):
    long = drift.numeric_long(spark.range(1000).withColumn("x", F.col("id") * 1.5), ["x"])
    stored = drift.profile_long(drift.numeric_profile(long, 10))
    from loanlens.session import scratch_path

    path = scratch_path(spark, "profile-test")
    files.save_profile(stored, path)
    back = files.load_profile(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, stored.select(back.columns).collect()))
    ends = back.agg(F.min("lo"), F.max("hi")).first()
    assert ends[0] == float("-inf") and ends[1] == float("inf")


def test_stale_profile_is_refused():
    drift.require_fresh(TESTBED.fingerprint(), TESTBED)
    with pytest.raises(ValueError):
        drift.require_fresh(TESTBED.fingerprint(), Settings(seed=7))


def test_feature_guards(spark):
    df = spark.createDataFrame([(1, 2, "x")], "a int, b int, race string")
    assert features.project_guarded(df, ["a"]).columns == ["a"]
    for bad in ({"wanted": ["zz"]}, {"wanted": ["a"], "forbidden": ["a"]}, {"wanted": ["race"], "protected": ["race"]}):
        with pytest.raises(ValueError):
            features.project_guarded(df, **bad)
    with pytest.raises(ValueError):
        audits.strict_columns(df, PANEL_COLUMNS)


def test_csv_layouts_match_by_name_and_drop_malformed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1,2,3\n4,5\n")
    (tmp_path / "b.csv").write_text("y,x\n20,10\n")
    df = files.read_csv_union(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(map(tuple, df.select("x", "y", "z").collect())) == [("1", "2", "3"), ("10", "20", None)]


def test_declared_years_must_exist(spark, tmp_path):
    path = str(tmp_path / "apps")
    spark.range(6).withColumn("activity_year", (F.col("id") % 2 + 2000).cast("int")).write.partitionBy("activity_year").parquet(path)
    assert files.read_years(spark, path, [2001]).count() == 3
    with pytest.raises(FileNotFoundError):
        files.read_years(spark, path, [2001, 2007])


def test_settle(spark):
    df = spark.range(50)
    assert settle(df).count() == 50
    assert settle(df).agg(F.sum("id")).first()[0] == 1225


def test_harmonised_support_is_summed(spark):
    train = spark.createDataFrame([("a",)] * 3 + [("b",)] * 3 + [("c",)] * 94, "c string")
    pop = spark.createDataFrame([(2020, "new"), (2020, "a"), (2020, "zz"), (2020, "c")], "fy int, c string")
    out = vocabulary.coverage(pop, train, year="fy", category="c", mapping={"a": "new", "b": "new", "new": "new"},
                              orphans=("zz",), min_support=0.05).first()
    assert (out["supported_raw"], out["supported_harmonised"], out["orphan_share"]) == (0.25, 0.5, 0.25)


def test_fairness_gate_separates_threshold_from_build(spark):
    rows = [("held", 0.7, "B", False), ("pushed", 0.7, "B", True), ("silent", 0.9, "B", None), ("good", 0.9, "B", True)]
    df = spark.createDataFrame(rows, "model string, impact_ratio double, worst_group string, promoted boolean")
    out = {r["model"]: r for r in gates.verdict(gates.fairness_gate(df, 0.8)).collect()}
    assert out["held"]["passed"] and not out["held"]["threshold_met"] and out["held"]["verdict"].startswith("NOT MET")
    assert not out["pushed"]["passed"] and not out["silent"]["passed"] and out["good"]["verdict"] == "PASS"


def test_absent_metric_fails_its_gate(spark):
    metrics = spark.createDataFrame([("auc_test", 0.8)], "gate string, value double")
    out = {r["gate"]: r for r in gates.evaluate(metrics, gates.thresholds(spark)).collect()}
    assert out["auc_test"]["passed"] and not out["ece_test"]["passed"] and out["ece_test"]["detail"] == "metric absent"


def test_bias_is_found(spark):
    rng = np.random.default_rng(5)
    group = np.where(rng.random(4000) < 0.5, "A", "B")
    score = rng.random(4000) * 0.5 + 0.3 * (group == "B")
    df = spark.createDataFrame([(str(g), float(s), int(rng.random() < s)) for g, s in zip(group, score)], "g string, s double, y int")
    out = fairness.group_outcomes(df, y="y", score="s", threshold=F.lit(0.5), dimensions=["g"])
    r = fairness.disparate_impact(out, 0.8).first()
    assert r["worst_group"] == "B" and r["reference_group"] == "A" and not r["passes"]


def event_rows(spark):
    rng = np.random.default_rng(11)
    rows = []
    for year in TESTBED.event_years:
        for county in ("c1", "c2", "c3"):
            for side, rate in (("Black or African American", 0.3 + 0.02 * (year > 1999)), ("White", 0.2)):
                for i in range(60):
                    rows.append((year, int(rng.random() < rate), side, "x", county, "p" + str(i % 2), "l", "o", 100.0 + i, 50.0 + i))
    return spark.createDataFrame(rows, "year int, denied int, race string, ethnicity string, county_code string, loan_purpose string, "
                                       "lien_status string, occupancy_type string, loan_amount double, income double")


def test_within_cell_equals_brute_force(spark):
    cells = eventstudy.cell_years(event_rows(spark), TESTBED).cache()
    got = {r["year"]: r for r in eventstudy.within_cell(cells, TESTBED).collect()}
    rows = cells.collect()
    level, infl = {}, {}
    for year in TESTBED.event_years:
        mine = [r for r in rows if r["year"] == year]
        h = np.array([r["n_focal"] * r["n_ref"] / (r["n_focal"] + r["n_ref"]) for r in mine])
        gap = np.array([r["k_focal"] / r["n_focal"] - r["k_ref"] / r["n_ref"] for r in mine])
        level[year] = (h * gap).sum() / h.sum()
        infl[year] = {}
        for r, a, b in zip(mine, h, gap):
            infl[year][r["county_code"]] = infl[year].get(r["county_code"], 0) + a * (b - level[year]) / h.sum()
    base = TESTBED.base_year
    for year, r in got.items():
        assert r["gamma_pp"] == pytest.approx((level[year] - level[base]) * 100, abs=1e-9)
        se = np.sqrt(sum((infl[year].get(c, 0) - infl[base].get(c, 0)) ** 2 for c in infl[base])) * 100
        assert r["se_pp"] == pytest.approx(0 if year == base else se, abs=1e-9)


def test_kitagawa_adds_up(spark):
    out = eventstudy.kitagawa(eventstudy.kitagawa_terms(event_rows(spark), TESTBED, (2000, 2001))).collect()
    assert len(out) == 2 and all(r["adds_up"] for r in out)


def pooled(bins, sign):
    """Blocks of equal fitted rate by the max-min formula, in exact fractions."""
    def mean(a, b):
        return Fraction(sum(e for _, e in bins[a:b + 1]), sum(n for n, _ in bins[a:b + 1]))

    k = range(len(bins))
    pick, turn = (max, min) if sign > 0 else (min, max)
    fit = [pick(turn(mean(a, b) for b in k if b >= i) for a in k if a <= i) for i in k]
    groups = [sorted(set(fit), reverse=sign < 0).index(v) for v in fit]
    spread = sum(Fraction(sum(e for (_, e), g in zip(bins, groups) if g == j) ** 2, sum(n for (n, _), g in zip(bins, groups) if g == j))
                 for j in set(groups))
    return spread, groups


def test_bins_become_monotone(spark):
    """Rising, falling, tied, single and random bins of many features in one fold."""
    draw = np.random.default_rng(3)
    tables = {"a": [(100, 10), (100, 12), (100, 8), (100, 20), (100, 30)], "b": [(100, 30), (50, 10), (100, 19), (10, 0)],
              "c": [(7, 3)], "d": [(10, 2), (20, 4), (30, 6)], "e": [(10, 0), (10, 10)]}
    for i in range(40):
        tables[f"r{i}"] = [(int(n), int(draw.integers(0, n + 1))) for n in draw.integers(1, 40, draw.integers(1, 12))]
    rows = [(f, i, n, e) for f, bins in tables.items() for i, (n, e) in enumerate(bins)]
    out = monotone_bins(spark.createDataFrame(rows, "feature string, place int, n bigint, events bigint")).collect()
    for f, bins in tables.items():
        up, down = pooled(bins, 1), pooled(bins, -1)
        got = [r.bin for r in sorted((r for r in out if r.feature == f), key=lambda r: r.place)]
        assert got in ([up[1]] if up[0] > down[0] else [down[1]] if down[0] > up[0] else [up[1], down[1]]), (f, bins)


def test_rare_categories_count_together(spark):
    rows = [("f", f"k{i}", 1, i % 2) for i in range(30)] + [("f", "big", 3000, 300), ("f", "other", 4000, 100), ("f", "NULO", 50, 9)]
    out = {r.category: r for r in category_places(spark.createDataFrame(rows, "feature string, category string, n bigint, events bigint"), 10).collect()}
    assert set(out) == {"RARE", "big", "other", "NULO"} and (out["RARE"].n, out["RARE"].events) == (30, 15)
    assert out["NULO"].place == -1 and out["other"].place == 0 < out["big"].place < out["RARE"].place


def test_business_age_is_not_applicant_age(spark):
    df = spark.createDataFrame([("La ANTIGÜEDAD del negocio",), ("Por su edad.",), ("the applicant's age",)], "t string")
    out = [r["prohibited_found"] for r in notices.with_prohibited(notices.with_folded(df, "t")).collect()]
    assert out == [[], ["su edad"], ["applicant's age"]]


def test_words_and_readability(spark):
    r = spark.createDataFrame([("un año más. sí",)], "t string").select(
        T.word_count(F.col("t")), T.readability(F.col("t"), F.lit("es")), T.fold(F.col("t"))).first()
    assert r[0] == 4 and r[2] == "un ano mas. si"
    assert r[1] == pytest.approx(206.84 - 60 * 5 / 4 - 1.02 * 4)


def test_faithfulness_and_rewrite_gate(spark):
    cited = ["el monto solicitado", "la tasa de interés inicial"]
    texts = ["Por el monto y la tasa.", "Por el monto, la tasa y la condición de franquicia.", "Por el monto.", " "]
    df = spark.createDataFrame([(i, t, cited, "es", "plantilla") for i, t in enumerate(texts)], "i int, t string, c array<string>, l string, f string")
    out = {r["i"]: r for r in notices.gate_rewrite(df, rewrite="t", fallback="f", cited="c", language="l").collect()}
    assert out[0]["used_rewrite"] and out[0]["final_text"] == texts[0]
    assert out[1]["rejection_reason"] == "invented factors: la condición de franquicia"
    assert out[2]["rejection_reason"] == "omitted reasons: la tasa de interés inicial"
    assert out[3]["rejection_reason"] == "empty output" and out[3]["final_text"] == "plantilla"


def test_secrets_are_masked(spark):
    df = spark.createDataFrame([("GET /v1?key=abcdEFGH1234 failed; Bearer abcdefghij",)], "t string")
    assert df.select(T.redact(F.col("t"))).first()[0] == "GET /v1?key=[REDACTED] failed; Bearer [REDACTED]"


def test_manifest_verdicts(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(name)
    digests = files.file_digests(spark, str(tmp_path / "*.txt"))
    good = {r["name"]: r["sha256"] for r in digests.collect()}
    manifest = spark.createDataFrame([("a.txt", good["a.txt"]), ("b.txt", "x"), ("c.txt", "y")], "name string, sha256 string")
    out = {r["name"]: r["verdict"] for r in files.verify_manifest(manifest, digests).collect()}
    assert out == {"a.txt": "OK", "b.txt": "MISMATCH", "c.txt": "MISSING"}


def test_digests_have_no_size_limit(spark, tmp_path, monkeypatch):
    texts = {"small.bin": b"abc", "none.bin": b"", "large one.bin": bytes(range(256)) * 5000}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    for attribute in ("BLOB", "MAX_BLOB"):
        monkeypatch.setattr(files, attribute, 3, raising=False)
    found = {r["name"]: (r["bytes"], r["sha256"]) for r in files.file_digests(spark, str(tmp_path / "*.bin")).collect()}
    assert found == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in texts.items()}


def test_denial_rates_rank_only_groups_that_are_large_enough(spark):
    rows = [("a", "3", "10", "1"), ("a", "1", "30", None), ("a", "1", "NA", "5"), ("b", "3", "7", "7"), (None, "3", "1", "1"),
            ("skip", "1", "1", "1"), ("skip", "1", "1", "1"), ("c", "1", None, "2"), ("c", "3", None, "4")]
    raw = spark.createDataFrame(rows, "g string, action_taken string, income string, loan_amount string")
    got = {r.group: tuple(r)[1:] for r in fairness.denial_rates_by(raw, "g", ["skip"], 2).collect()}
    assert got == {"a": (3, 1 / 3, 20000.0, 3.0), "c": (2, 0.5, None, 3.0)}
    assert fairness.denial_rates_by(raw.limit(0), "g", ["skip"], 2).count() == 0


def test_folding_counting_and_terms_agree_with_plain_rules(spark):
    texts = ["", None, "plain ASCII, two words", "Résumé É", "éa b", "İstanbul ͅx", "ΆΛΦΑ й", "naïve gender; su edad!", "x́ race"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    folded = notices.with_folded(df, "t").select(
        "i", "_fold", T.word_count(F.col("t")).alias("n"), T.word_count_folded(F.col("t"), F.col("_fold"), F.col("_tok")).alias("m"))
    for r in folded.collect():
        assert r.n == r.m and r["_fold"] == (None if texts[r.i] is None else T.fold_text(texts[r.i]))
    found = {r.i: r[1] for r in notices.with_prohibited(notices.with_folded(df, "t")).select("i", "prohibited_found").collect()}
    assert found[7] == ["gender", "su edad"] and found[8] == ["race"] and found[2] == [] and found[1] is None


def test_labels_that_are_not_fixed_are_looked_for_by_their_words(spark):
    rows = [(0, "We saw Tardy things", ["tardy payments", "the loan guarantee percentage"]), (1, "Loan", ["tardy payments", None]), (2, "", [])]
    df = spark.createDataFrame([(*r, "en") for r in rows], "i int, t string, c array<string>, l string")
    out = {r.i: (r.recall, r.missing) for r in notices.with_faithfulness(df, "t", "c", "l").collect()}
    assert out[0] == (0.5, ["the loan guarantee percentage"]) and out[1][0] == 0 and out[2] == (1.0, [])


def test_notice_rows_are_dealt_before_their_texts_are_made(spark):
    from loanlens.plans.notices import gated

    plan = gated(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(loan_id" in plan  # lineitem is one file of one row group
