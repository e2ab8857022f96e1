"""Spelling variants: words that differ by one code point, found by PartEnum signatures, and the form each goes back to.

A word's letters are a binary vector: one dimension for the k-th occurrence of a letter. One inserted or deleted code
point changes one dimension, one replaced code point two, so near words have vectors within Hamming distance 2. The
dimensions are dealt into `PARTS` parts of about equal entropy, measured over all words. Two vectors within distance 2
differ in at most two parts, so they agree on all parts but some two: a word's signatures are its hashes without each
pair of parts, `PARTS * (PARTS - 1) / 2` of them, and an equi-join on signatures meets every near pair. A pair is taken
at one signature only (told by which of the two left-out parts differ), passes a 64-bit sketch of its dimensions, and is
verified by its edit distance, in the join's own condition, so what meets but is not near is never a row.

Hashes that collide only add candidates; verification decides. Occurrences are counted by task before the shuffle, so a
frequent word is no load, and hot signatures are split by Spark's skewed joins.

Cases: a null text has no words, a null id counts as empty text in the hash; rows that repeat an id count once each; texts
are read in pieces that end with a run, so very long ones need no list of all their runs; runs of any length are words; of
near words that are equally frequent the smallest in code-point order is the form; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import LOWER_AZ, staged

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
PIECE = re.compile(r".{1,1000000}[A-Za-zÀ-ÿ]*", re.S)
#: Every so many hashes one code point is deleted; length and occurrences of a word; how much more frequent a form is.
ALTERED, LENGTH, OCCURRENCES, TIMES = 199, 6, 5, 5
PARTS = 8
#: Occurrences of a letter whose frequency is measured; later ones are dealt by hash.
MEASURED = 8
HELD = 200_000  # words that a task counts before it gives them out


def altered(run: str, prefix: int) -> str:
    """The run, without one of its code points where the hash says so. `prefix`: crc32 of what stands before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % ALTERED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def runs(text: str) -> Counter[str]:
    """The text's runs, A-Z lower-cased, with their counts."""
    low = text.encode("utf-8", "surrogatepass").translate(LOWER_AZ).decode("utf-8", "surrogatepass")
    if len(low) < 1_000_000:
        return Counter(RUN.findall(low))
    found: Counter[str] = Counter()
    for piece in PIECE.finditer(low):
        found.update(RUN.findall(piece[0]))
    return found


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: words of at least `LENGTH` code points with their occurrences over all documents, if `OCCURRENCES` or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for number, said in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{number}:".encode())
                for found, n in runs(said.as_py()).items():
                    word = altered(found, prefix)
                    if len(word) >= LENGTH:
                        counts[word] += n
                if len(counts) >= HELD:
                    yield given()
        if counts:
            yield given()

    slim = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text).cast("string"))
    return slim.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _dimensions(word: str) -> list[tuple[str, int]]:
    """(letter, its occurrence) for each letter."""
    seen: Counter[str] = Counter()
    made = []
    for letter in word:
        made.append((letter, seen[letter]))
        seen[letter] += 1
    return made


def dealt_parts(words: DataFrame) -> dict[tuple[str, int], int]:
    """The part of each measured dimension: the most uncertain first, each to the part that holds least so far.

    Only sums for at most `MEASURED` occurrences of 90 letters reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()
        rows = 0
        for batch in batches:
            for word in batch.column(0).to_pylist():
                counts.update(d for d in _dimensions(word) if d[1] < MEASURED)
                rows += 1
        yield pa.RecordBatch.from_arrays([
            pa.array([*(d[0] for d in counts), ""], pa.string()), pa.array([*(d[1] for d in counts), 0], pa.int64()),
            pa.array([*counts.values(), rows], pa.int64())], ["letter", "nth", "n"])

    sums = {(r.letter, r.nth): r.n for r in words.select("word").mapInArrow(run, "letter string, nth bigint, n bigint").groupBy(
        "letter", "nth").agg(F.sum("n").alias("n")).collect()}
    rows = max(sums.pop(("", 0), 0), 1)

    def uncertainty(n: int) -> float:
        p = n / rows
        return -(p * math.log(p) + (1 - p) * math.log(1 - p)) if 0 < p < 1 else 0.0

    load, parts = [0.0] * PARTS, {}
    for dimension in sorted(sums, key=lambda d: (-uncertainty(sums[d]), d)):
        part = load.index(min(load))
        parts[dimension] = part
        load[part] += uncertainty(sums[dimension])
    return parts


def _mixed(dimension: tuple[str, int]) -> int:
    """64 bits that stand for a dimension."""
    spelled = f"{dimension[0]}{dimension[1]}".encode()
    h = (zlib.crc32(spelled) << 32 | zlib.crc32(spelled, 0xFFFFFFFF)) + 0x9E3779B97F4A7C15
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> shift) * factor & (1 << 64) - 1
    return h ^ h >> 31


def _hashed(words: DataFrame, parts: dict[tuple[str, int], int]) -> DataFrame:
    """word, n, parts (a hash of each part), sketch (64 bits, one turned by each dimension)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], tuple[int, int, int]] = {}
        for batch in batches:
            made = np.zeros((len(batch), PARTS + 1), np.uint64)
            for row, word in zip(made, batch.column(0).to_pylist()):
                held = [0] * (PARTS + 1)
                for dimension in _dimensions(word):
                    if dimension not in known:
                        mixed = _mixed(dimension)
                        known[dimension] = parts.get(dimension, mixed % PARTS), mixed, 1 << (mixed >> 58)
                    part, mixed, bit = known[dimension]
                    held[part] ^= mixed
                    held[PARTS] ^= bit
                row[:] = held
            if len(known) > HELD:
                known.clear()
            values = made.view(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values[:, :PARTS].ravel()), PARTS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(values[:, PARTS].copy())],
                                              ["word", "n", "parts", "sketch"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, parts array<bigint>, sketch bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b (a < b): all pairs of `words` (word, n; distinct) one code point apart, each once."""
    hashed = _hashed(words, dealt_parts(words))
    total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda x, y: x.bitwiseXOR(y))
    signatures = []
    for i, j in combinations(range(PARTS), 2):
        one, two = F.col("parts")[i], F.col("parts")[j]
        signatures.append(F.struct(F.lit(i * PARTS + j).cast("tinyint").alias("pair"), F.col("total").bitwiseXOR(one).bitwiseXOR(two).alias("key"),
                                   one.alias("one"), two.alias("two")))
    sent = hashed.withColumn("total", total).select("word", "n", "sketch", F.explode(F.array(*signatures)).alias("s")).select(
        "word", "n", "sketch", "s.*")
    # The written words are small, what they are spread to is not; by the files' size Spark would send it through the driver.
    a, b = sent.alias("a"), sent.hint("merge").alias("b")
    one, two = F.expr("a.one <> b.one"), F.expr("a.two <> b.two")
    first = F.expr(f"a.pair < {PARTS}")  # the pairs of part 0
    here = (one & two) | (two & ~one & first) | (one & ~two & (F.expr("a.pair") == 1))
    met = a.join(b, (F.col("a.pair") == F.col("b.pair")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & here
                 & (F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch"))) <= 2)
                 & (F.abs(F.char_length("a.word") - F.char_length("b.word")) <= 1)
                 & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where following `forms` (word, form) ends. Ways double in length each round, and a form is `TIMES` as
    frequent as its word, so rounds grow with the logarithm of the logarithm of the largest count."""
    ways = staged(forms.select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("further")).hint("merge")
        if ways.join(onward, "root", "left_semi").isEmpty():
            return ways
        ways = staged(ways.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-ways")


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of `words` (word, n; distinct)."""
    words = staged(words, "spelling-words")
    pairs = near_pairs(words)
    each = staged(pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p")).select("p.*").groupBy("word").agg(
            F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")), "spelling-near")
    chosen = words.join(each.hint("merge"), "word", "left").withColumn("fits", F.coalesce(-F.col("best.less") >= TIMES * F.col("n"), F.lit(False)))
    chosen = staged(chosen.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                  F.when(F.col("fits"), F.col("best.near")).alias("form"),
                                  F.when(F.col("fits"), -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = _roots(chosen.where("form IS NOT NULL"))
    return chosen.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`variants` of the words of a table of documents."""
    return variants(word_counts(docs, doc_id, text))
