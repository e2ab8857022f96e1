"""Learned operators: held-out accuracy, plain versions, normalisation and odd inputs."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from loanlens.llm import hpylm, quality_fm, toxicity

from .conftest import ODD

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def auc(pairs):
    pairs = sorted(pairs)
    ones = sum(y for _, y in pairs)
    ranks = sum(i for i, (_, y) in enumerate(pairs, 1) if y)
    return (ranks - ones * (ones + 1) / 2) / (ones * (len(pairs) - ones))


def test_toxicity(spark, tables, odd, none):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(scores) == docs.count()
    held = [(scores[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert auc(held) > 0.8
    out = {(r.doc_id, i): r for i, r in enumerate(toxicity.score_toxicity(odd, model).collect())}
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out.values())
    assert toxicity.score_toxicity(none, model).count() == 0
    row = toxicity.score_toxicity(spark.createDataFrame([(1, "The of and. You stupid idiot scum.\nOf the.")], "doc_id bigint, text string"), model).first()
    assert row.score > 0.3 and [(s.start, s.length) for s in row.offending] in ([(11, 22)], [])
    assert toxicity.fit_toxicity(docs, labels.where("toxic = 0")).prior == 0.0
    assert toxicity.clean_documents(docs, model).columns == docs.columns


def test_noisy_or_is_the_product():
    model = toxicity.ToxicModel(np.zeros(toxicity.DIMENSIONS, np.float32), -1.0)
    score, _ = toxicity.score_text("A b. C d! E\nF", model, toxicity._Weigher(model.weights))
    assert score == pytest.approx(1 - (1 - 1 / (1 + math.exp(1.0)))**4)


def test_quality(tables, odd, none):
    docs, labels = tables
    model = quality_fm.fit_quality(docs, labels)
    scores = {r.doc_id: r.score for r in quality_fm.score_quality(docs, model).collect()}
    held = [(scores[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert auc(held) > 0.9
    found = quality_fm.score_quality(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert quality_fm.score_quality(none, model).count() == 0
    assert quality_fm.fit_quality(docs, labels.where("quality = 1")).prior == 1.0


def test_squares_identity():
    random = np.random.default_rng(1)
    size = quality_fm.DIMENSIONS + len(quality_fm.STATISTICS)
    blank = np.zeros(len(quality_fm.STATISTICS))
    model = quality_fm.QualityModel(0.1, random.normal(size=size), random.normal(size=(size, quality_fm.FACTORS)) / 4, blank, blank + 1)
    at, x = np.array([3, 70, 900]), np.array([0.5, 0.2, 0.8])
    plain = 0.1 + model.linear[at] @ x + sum(
        model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert model.score((at, x, blank)) == pytest.approx(1 / (1 + math.exp(-plain)))


# --- Pitman-Yor


def tokens(text):
    said = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return [*said, None]


def test_language_model_counts_and_gain(tables):
    docs, _ = tables
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    count = Counter(t for i, text in rows.items() if not held[i] for t in tokens(text))
    size, kinds = sum(count.values()), len(count)
    gain = Counter()
    for r in hpylm.score_corpus(docs, 7, 2).collect():
        said = tokens(rows[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(said), sum(count[t] > 0 for t in said), size)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (size + kinds + 1)) for t in said), rel=1e-9)
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
        gain[r.held_out] += r.score - r.base_score
    assert gain[True] > 0 and gain[False] > 0


def test_probabilities_sum_to_one():
    random = np.random.default_rng(2)
    n, kinds = 4000, 90
    keys, count = np.unique(np.minimum(random.zipf(1.5, n), kinds - 1) * hpylm.CONTEXTS + random.integers(0, 6, n), return_counts=True)
    words = np.unique(keys // hpylm.CONTEXTS)
    pairs = hpylm.Pairs(words.astype(np.uint64), np.searchsorted(words, keys // hpylm.CONTEXTS), (keys % hpylm.CONTEXTS).astype(np.uint16), count)
    customers = np.bincount(pairs.context, pairs.count, hpylm.CONTEXTS)
    model = hpylm.Model(customers, len(words), int(count.sum()), 0.6, 0.4)
    dishes = np.bincount(pairs.context, minlength=hpylm.CONTEXTS).astype(float)
    model.history.append(hpylm.Totals(dishes, dishes.sum(), float(len(words))))
    for _ in range(hpylm.SWEEPS):
        tables, parent, parent_tables = list(hpylm.sweeps(pairs, model, 0))[-1]
        assert (tables >= 1).all() and (tables <= pairs.count).all() and (parent_tables <= parent).all()
        model.history.append(hpylm.Totals(np.bincount(pairs.context, tables, hpylm.CONTEXTS), float(parent.sum()), float(parent_tables.sum())))
    predictor = hpylm.Predictor.of(pairs, model, 0)
    for context in (0, 3, 77):
        known = predictor.probabilities(np.arange(len(words)), np.full(len(words), context), model).sum()
        unknown = np.mean([model.backoff(t)[context] * model.parent(np.zeros(1), np.zeros(1), t)[0] for t in model.history[hpylm.BURN_IN + 1:]])
        assert known + unknown == pytest.approx(1.0, abs=1e-9)


def test_tables_follow_their_conditional():
    """Exact draws against the exact conditional, and the normal beyond EXACT against a chain of single customers."""
    random = np.random.default_rng(3)
    d, stirling = 0.5, hpylm.log_stirling(0.5)
    for c, a in ((2, 0.3), (6, 2.0), (40, 5.0)):
        weight = np.exp(stirling[c, 1:c + 1] + np.arange(1, c + 1) * np.log(a))
        mean = (weight * np.arange(1, c + 1)).sum() / weight.sum()
        drawn = hpylm.draw_tables(np.full(20_000, c), np.full(20_000, a), d, stirling, random)
        assert drawn.mean() == pytest.approx(mean, rel=0.02)
    longer = hpylm.log_stirling(d, 300)
    for a in (0.5, 20.0, 400.0):
        t = np.arange(1, 301)
        log = longer[300, 1:] + t * np.log(a)
        weight = np.exp(log - log.max())
        mean = (weight * t).sum() / weight.sum()
        drawn = hpylm.draw_tables(np.full(20_000, 300), np.full(20_000, a), d, stirling, random)
        assert drawn.mean() == pytest.approx(mean, rel=0.03, abs=0.6)


def test_language_model_odd(odd, none, make):
    out = hpylm.score_corpus(odd, 7, 2).collect()
    assert len(out) == len(ODD) and sorted(r.n_tokens for r in out)[:3] == [1, 1, 1]
    assert hpylm.score_corpus(none, 7, 2).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    for r in hpylm.score_corpus(make([(i, "a b") for i in held]), 7, 2).collect():
        assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and math.isfinite(r.score)
