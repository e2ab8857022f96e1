"""Toxicity by multiple-instance learning.

A document is a bag of sentences (longer ones in windows of `WINDOW` words). A sentence's chance of being toxic is
logistic in its hashed words and word beginnings, whose weights are evidence and never negative; the document's is
their noisy-or, 1 - prod(1 - p). Only documents carry labels; the sentence weights are fitted so that the noisy-or
meets them. The same weights then point out the sentences that make a document toxic. A toxic document mostly has
several toxic words, so a plain fit may explain it by one of them or by rare words of its own: each weight has a price
(`SPARSE`), and up to step `ALL_FROM` each step hides a random half of the features, so every word has to do alone.

Fitting uses a sample of labelled rows, at most `POSITIVES` and `NEGATIVES` by a hash of the id, weighted to the
true shares; executors turn the texts into feature numbers. Scoring reads all rows and shuffles nothing.

Cases: a null or blank text has no sentence and scores as an empty noisy-or, 0; without both labels the score is the
labels' share; unlabelled rows are scored like others; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import WORD_CHARS, fold

DIMENSIONS = 1 << 18
BEGINNINGS = (3, 4, 5, 6, 7)
WINDOW = 40
POSITIVES, NEGATIVES = 2000, 4000
MIN_DOCUMENTS = 3
STEPS, RATE, DECAY = 120, 0.15, 2e-5
#: Price of a unit of weight, in documents; share of the features a step hides, and the step from which it hides none.
SPARSE, HIDDEN, ALL_FROM = 0.2, 0.5, 91
SEED = 1
OFFENDING = 0.5
SENTENCE = re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[int]:
    keys = [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % DIMENSIONS for k in keys]


def sentences(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and lower-case words of each sentence or window that has a word."""
    for found in SENTENCE.finditer(text or ""):
        said = WORD_CHARS.findall(found[0].lower())
        if len(said) > WINDOW:
            marks = list(WORD_CHARS.finditer(found[0]))
            for at in range(0, len(marks), WINDOW):
                part = marks[at:at + WINDOW]
                yield found.start() + part[0].start(), found.start() + part[-1].end(), [m[0].lower() for m in part]
        elif said:
            yield found.start(), found.end(), said


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray
    bias: float
    prior: float | None = None  # the score where there was nothing to learn


class _Weigher(dict):
    """Weight of a word, remembered; cleared when full."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights.astype(np.float64)

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = float(self.weights[word_features(word)].sum())
        return value


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features, lengths = [], []
        for text in batch.column(0).to_pylist():
            bag = [[f for w in set(said) for f in word_features(w)] for _, _, said in sentences(text)]
            features.append(np.array([f for s in bag for f in s], "<i4").tobytes())
            lengths.append(np.array([len(s) for s in bag], "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(features, pa.binary()), pa.array(lengths, pa.binary())],
                                         ["label", "weight", "features", "lengths"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, positives: int, negatives: int) -> DataFrame:
    """text, label, weight of the sampled rows; rows whose id's fold is `held` are left out."""
    rows = labels.where(F.col(label).isNotNull() & (fold("doc_id", parts) != held)).select(
        F.col("doc_id").alias("labelled_id"), F.col(label).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    chosen = [rows.where(F.col("label") == value).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(most)
              .withColumn("weight", F.lit(counts.get(value, 0) / max(1, min(most, counts.get(value, 0)))))
              for value, most in ((1, positives), (0, negatives))]
    sample = chosen[0].unionByName(chosen[1])
    return docs.join(sample, docs.doc_id == sample.labelled_id).select("text", "label", "weight", "labelled_id")


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held: int = 2) -> ToxicModel:
    sample = labelled_sample(docs.select("doc_id", "text"), labels, label, parts, held, POSITIVES, NEGATIVES)
    return _fit(sample.select("text", "label", "weight", "labelled_id").mapInArrow(
        lambda batches: _bags(batches), "label int, weight double, features binary, lengths binary").toArrow())


def _fit(rows: pa.Table) -> ToxicModel:
    table = sorted(zip(*(rows.column(c).to_pylist() for c in ("features", "lengths", "label", "weight"))))
    del rows
    y = np.array([r[2] for r in table], float)
    weight = np.array([r[3] for r in table], float)
    if not len(y) or y.min() == y.max():
        return ToxicModel(np.zeros(DIMENSIONS, np.float32), 0.0, float(y.mean()) if len(y) else 0.0)
    seen = np.zeros(DIMENSIONS, np.int32)
    for features, *_ in table:
        seen[np.unique(np.frombuffer(features, "<i4"))] += 1
    known = seen >= MIN_DOCUMENTS
    number = (np.cumsum(known) - 1).astype(np.int32)
    doc = np.repeat(np.arange(len(table), dtype=np.int32), [len(r[1]) // 4 for r in table])
    blocks = []  # first sentence, sentences, features and their sentences, for some hundred documents each
    first = 0
    for at in range(0, len(table), 400):
        feature = np.frombuffer(b"".join(r[0] for r in table[at:at + 400]), "<i4")
        sizes = np.frombuffer(b"".join(r[1] for r in table[at:at + 400]), "<i4")
        keep = known[feature]
        every = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[keep]
        blocks.append((first, len(sizes), number[feature[keep]], every))
        first += len(sizes)
    count = len(table)
    del table
    w, b = np.zeros(int(known.sum())), -5.0
    moments = [np.zeros(len(w) + 1), np.zeros(len(w) + 1)]
    total, z = weight.sum(), np.zeros(first)
    random = np.random.default_rng(SEED)
    for step in range(1, STEPS + 1):
        shown = random.random(len(w)) >= (HIDDEN if step < ALL_FROM else 0)
        visible = w * shown
        for at, size, feature, every in blocks:
            z[at:at + size] = np.bincount(every, visible[feature], size) + b
        odds = np.bincount(doc, np.logaddexp(0, z), count)  # -log(1 - noisy-or)
        pull = np.where(y > 0, -np.exp(-odds) / np.maximum(-np.expm1(-odds), 1e-6), 1.0) * weight / total
        slope = pull[doc] / (1 + np.exp(-z))
        grad = np.append(np.zeros(len(w)), slope.sum())
        for at, size, feature, every in blocks:
            grad[:-1] += np.bincount(feature, slope[at:at + size][every], len(w))
        grad[:-1] = grad[:-1] * shown + DECAY * w + SPARSE / count
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad * grad
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-7)
        w = np.maximum(w - move[:-1], 0)
        b -= move[-1]
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[known] = w
    return ToxicModel(weights, float(b))


def score_text(text: str | None, model: ToxicModel, weigh: dict[str, float]) -> tuple[float, list[dict]]:
    """Noisy-or of the sentences, and those that are likely to be toxic themselves."""
    if model.prior is not None:
        return model.prior, []
    starts, ends, sums = [], [], []
    for start, end, said in sentences(text):
        starts.append(start)
        ends.append(end)
        sums.append(sum(map(weigh.__getitem__, set(said))))
    z = np.array(sums) + model.bias
    score = float(-np.expm1(-np.logaddexp(0, z).sum())) if sums else 0.0
    chance = 1 / (1 + np.exp(-z))
    return score, [{"start": starts[i], "length": ends[i] - starts[i], "score": float(chance[i])} for i in np.flatnonzero(chance >= OFFENDING)]


SPANS = "array<struct<start:bigint,length:bigint,score:double>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))


def score_toxicity(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, offending (spans in code points) for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = _Weigher(model.weights)
        for batch in batches:
            made = [score_text(t, model, weigh) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.float64()),
                                              pa.array([m[1] for m in made], SPAN_TYPE)], ["doc_id", "score", "offending"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double, offending {SPANS}")


def clean_documents(docs: DataFrame, model: ToxicModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of `docs` that score below the threshold, with all their columns."""
    place = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = _Weigher(model.weights)
        for batch in batches:
            yield batch.filter(pa.array([score_text(t, model, weigh)[0] < threshold for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
