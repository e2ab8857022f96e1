"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The margin is w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j. The pairs cost linear time, by
1/2 sum over factors of ((sum v_i x_i)^2 - sum (v_i x_i)^2). Words weigh 1 + log(count), scaled to length one;
statistics are standardised on the sample and cut at +-4.

Fitting uses a sample of labelled rows, at most `POSITIVES` and `NEGATIVES`, weighted to the true shares. Scoring reads
all rows and shuffles nothing.

Cases: a null or blank text has zero statistics and no words and is scored like any other; missing metadata is filled
from the text; without both labels the score is the labels' share; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.toxicity import labelled_sample

DIMENSIONS = 1 << 15
FACTORS = 4
POSITIVES, NEGATIVES = 4000, 3000
STEPS, RATE, DECAY = 150, 0.05, 1e-4
STATISTICS = ("log_chars", "log_words", "mean_word", "distinct", "adjacent_repeats", "top_share", "upper", "digits",
              "marks", "wide", "lines_repeated", "words_per_line", "log_meta_chars")

#: Class of each byte: 0 lower case, 1 upper case, 2 digit, 3 white space, 4 mark, 5 byte of a wider character.
_CLASS = np.array([5 if b > 127 else 0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit()
                   else 3 if b == 32 or 9 <= b <= 13 else 4 for b in range(256)], np.uint8)


class _Numbers(dict):
    """Word to its hashed number, remembered; cleared when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = zlib.crc32(word) % DIMENSIONS
        return value


def document_features(text: str | None, meta_chars: int | None, numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words (distinct, ascending), their values, and the statistics."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    said = raw.lower().split()
    hashed = np.fromiter(map(numbers.__getitem__, said), np.int32, len(said))
    stats = np.zeros(len(STATISTICS))
    chars = len(text or "")
    stats[12] = np.log1p(max(0, chars if meta_chars is None else meta_chars))
    if not said:
        stats[0] = np.log1p(chars)
        return hashed, np.zeros(0), stats
    distinct, counts = np.unique(hashed, return_counts=True)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6) / len(raw)
    lines = raw.split(b"\n")
    stats[:12] = (np.log1p(chars), np.log1p(len(said)), len(raw) / len(said), len(distinct) / len(said),
                  float((hashed[1:] == hashed[:-1]).mean()) if len(said) > 1 else 0.0, counts.max() / len(said),
                  kinds[1], kinds[2], kinds[4], kinds[5], 1 - len(set(lines)) / len(lines), np.log1p(len(said) / len(lines)))
    values = 1 + np.log(counts)
    return distinct, values / np.sqrt((values * values).sum()), stats


@dataclass(frozen=True)
class QualityModel:
    bias: float
    linear: np.ndarray  # one for each hashed word, then each statistic
    factors: np.ndarray  # as many rows, FACTORS columns
    mean: np.ndarray
    spread: np.ndarray
    prior: float | None = None

    def score(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
        if self.prior is not None:
            return self.prior
        distinct, values, stats = features
        at = np.concatenate([distinct, np.arange(DIMENSIONS, DIMENSIONS + len(STATISTICS))])
        x = np.concatenate([values, np.clip((stats - self.mean) / self.spread, -4, 4)])
        vx = self.factors[at] * x[:, None]
        summed = vx.sum(0)
        margin = self.bias + self.linear[at] @ x + 0.5 * (summed @ summed - (vx * vx).sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = _Numbers()
    for batch in batches:
        made = [document_features(t, m, numbers) for t, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([
            batch.column(2), batch.column(3), pa.array([m[0].astype("<i4").tobytes() for m in made], pa.binary()),
            pa.array([m[1].astype("<f8").tobytes() for m in made], pa.binary()),
            pa.array([m[2].astype("<f8").tobytes() for m in made], pa.binary())], ["label", "weight", "words", "values", "stats"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held: int = 0) -> QualityModel:
    meta = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    slim = docs.select("doc_id", F.struct(F.col("text").alias("said"), meta.alias("meta")).alias("text"))
    sample = labelled_sample(slim, labels, label, parts, held, POSITIVES, NEGATIVES)
    rows = sample.select("text.said", "text.meta", "label", "weight").mapInArrow(
        lambda batches: _rows(batches), "label int, weight double, words binary, values binary, stats binary").toArrow()
    return _fit(rows)


def _fit(rows: pa.Table) -> QualityModel:
    table = sorted(zip(*(rows.column(c).to_pylist() for c in ("words", "stats", "values", "label", "weight"))))
    y, weight = np.array([r[3] for r in table], float), np.array([r[4] for r in table], float)
    size = DIMENSIONS + len(STATISTICS)
    blank = (np.zeros(size), np.zeros((size, FACTORS)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    if not len(y) or y.min() == y.max():
        return QualityModel(0.0, *blank, prior=float(y.mean()) if len(y) else 0.0)
    stats = np.array([np.frombuffer(r[1], "<f8") for r in table])
    mean, spread = stats.mean(0), stats.std(0) + 1e-6
    scaled = np.clip((stats - mean) / spread, -4, 4)
    words = [np.frombuffer(r[0], "<i4") for r in table]
    doc = np.concatenate([np.repeat(np.arange(len(y)), [len(w) for w in words]), np.repeat(np.arange(len(y)), len(STATISTICS))])
    at = np.concatenate([*words, np.tile(np.arange(DIMENSIONS, size), len(y))]).astype(np.int64)
    x = np.concatenate([*(np.frombuffer(r[2], "<f8") for r in table), scaled.ravel()])
    random = np.random.Generator(np.random.PCG64(7))
    theta = np.concatenate([np.zeros((size, 1)), random.normal(0, 0.05, (size, FACTORS))], axis=1)
    bias, share = 0.0, weight / weight.sum()
    first, second = np.zeros((size + 1, FACTORS + 1)), np.zeros((size + 1, FACTORS + 1))
    for step in range(1, STEPS + 1):
        part = theta[at] * x[:, None]
        summed = np.stack([np.bincount(doc, part[:, f], len(y)) for f in range(FACTORS + 1)], axis=1)
        squares = sum(np.bincount(doc, part[:, f] ** 2, len(y)) for f in range(1, FACTORS + 1))
        margin = bias + summed[:, 0] + 0.5 * ((summed[:, 1:] ** 2).sum(1) - squares)
        off = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) * share
        grad = np.zeros_like(first)
        pull = off[doc] * x
        grad[:size, 0] = np.bincount(at, pull, size)
        for f in range(1, FACTORS + 1):
            grad[:size, f] = np.bincount(at, pull * (summed[doc, f] - part[:, f]), size)
        grad[:size] += DECAY / 10 * theta
        grad[size, 0] = off.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-7)
        theta -= move[:size]
        bias -= move[size, 0]
    return QualityModel(float(bias), theta[:, 0].copy(), theta[:, 1:].copy(), mean, spread)


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text", meta_chars: str | None = "n_chars") -> DataFrame:
    """doc_id, score for every row."""
    meta = F.col(meta_chars).cast("bigint") if meta_chars in docs.columns else F.lit(None).cast("bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for batch in batches:
            scores = [model.score(document_features(t, m, numbers)) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text), meta.alias("meta")).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")
