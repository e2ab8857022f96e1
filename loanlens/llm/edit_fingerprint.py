"""Fingerprints by a randomised edit embedding.

A pointer walks over the text; at step j it writes the character under it and moves on if a random bit of (j,
character), shared by all texts, is one. Texts within edit distance k are then within Hamming distance O(k^2) of each
other, whatever their length, since the pointers meet again after an edit. A fingerprint samples the written symbols at
fixed steps: `SAMPLES` in each octave of steps, so that short and long texts are covered alike. Weighted by the
octaves' widths, the share of equal samples estimates the Hamming similarity.

Bands are keys of a few more sampled steps each; two texts are linked if a band meets and the likeness verifies it.
`with_followers` says so for each text and its edit or follower; `edit_pairs` finds all linked pairs of a table.

The random bits have a period of `PERIOD` steps; how many steps the pointer stays is then a table lookup, and the
walks of many texts advance together, a character at a time.

Cases: null texts are empty and have an empty fingerprint; two empty fingerprints are alike (1.0); rows that repeat an id
are ordered by a hash of their text; rows with a null id come last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import staged

PERIOD = 4096
SAMPLES = 32
OCTAVES = 40
WIDTH = 512  # texts that walk together
NARROW = 24  # fewer walk one by one
TOGETHER = 6_000_000  # characters held at a time
BANDS, ROWS = 24, 5
ALIKE = 0.8
SEED = 20


@lru_cache(maxsize=1)
def _stays() -> np.ndarray:
    """Steps that the pointer stays on a character, by character class and step; 0 for the padding class 0."""
    bits = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (256, PERIOD))
    bits[:, 0] = 1  # no class stays forever
    stays = np.zeros((256, PERIOD), np.int32)
    following = np.zeros(256, np.int64)
    for step in range(2 * PERIOD - 1, -1, -1):
        following = np.where(bits[:, step % PERIOD] == 1, step, following)
        if step < PERIOD:
            stays[:, step] = following - step + 1
    stays[0] = 0
    return stays


@lru_cache(maxsize=1)
def _stays_bytes() -> list[list[int]]:
    return [row.tolist() for row in _stays()]


@lru_cache(maxsize=1)
def _samples() -> list[np.ndarray]:
    random = np.random.Generator(np.random.PCG64(SEED + 1))
    return [np.sort(random.choice(1 << o, min(SAMPLES, 1 << o), replace=False) if o < 16 else random.integers(0, 1 << o, SAMPLES)) + (1 << o) - 1
            for o in range(OCTAVES)]


def classes(text: str | None) -> np.ndarray:
    """Class of each code point, 1 to 255; ASCII characters have classes of their own."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = 128 + (points * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(128)
    return np.where(points < 128, np.where(points == 0, 127, points), wide).astype(np.uint8)


def walk_all(texts: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    """For each text of classes, the steps at which its characters are reached, and the step after the last."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    stays, flat, mask = _stays_bytes(), _stays().ravel(), PERIOD - 1
    at = 0
    while at < len(order):
        width = WIDTH
        longest = len(texts[order[min(at + width, len(order)) - 1]])
        while width > NARROW and longest * width > TOGETHER:
            width //= 2
            longest = len(texts[order[min(at + width, len(order)) - 1]])
        group = order[at:at + width]
        at += width
        if len(group) < NARROW:
            for i in group:
                step, steps = int(starts[i]), []
                for c in texts[i].tolist():
                    steps.append(step)
                    step += stays[c][step & mask]
                out[i] = np.array([*steps, step], np.int64)
            continue
        grid = np.zeros((longest, len(group)), np.int32)
        for column, i in enumerate(group):
            grid[:len(texts[i]), column] = texts[i]
        grid *= PERIOD
        steps = np.empty((longest + 1, len(group)), np.int32)
        steps[0] = starts[group]
        place = np.empty(len(group), np.int32)
        for row in range(longest):
            np.bitwise_and(steps[row], mask, out=place)
            np.add(place, grid[row], out=place)
            np.add(steps[row], flat.take(place), out=steps[row + 1])
        for column, i in enumerate(group):
            out[i] = steps[:len(texts[i]) + 1, column].astype(np.int64)
    return out


def symbols_at(steps: np.ndarray, text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """What the walk writes at the wanted steps; 0 after its end."""
    index = np.searchsorted(steps, wanted, "right") - 1
    return np.where(index < len(text), text[np.minimum(index, max(len(text) - 1, 0))], 0).astype(np.uint8) if len(text) else np.zeros(len(wanted), np.uint8)


def sampled(steps: np.ndarray, text: np.ndarray) -> bytes:
    """Symbols at the sampled steps of the octaves that the walk enters."""
    octaves = int(steps[-1]).bit_length()  # octave o has steps 2^o - 1 to 2^(o+1) - 2
    return symbols_at(steps, text, np.concatenate(_samples()[:octaves])).tobytes() if octaves else b""


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    return np.concatenate([np.full(len(s), (1 << o) / len(s)) for o, s in enumerate(_samples())])


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of equal symbols of two embeddings, up to the end of the longer."""
    size = max(len(a), len(b))
    x, y = (np.frombuffer(v.ljust(size, b"\0"), np.uint8) for v in (a, b))
    weight = _weights()[:size] * ((x | y) > 0)
    total = weight.sum()
    return float((weight * (x == y)).sum() / total) if total else 1.0


def fingerprint(text: str | None) -> str:
    coded = classes(text)
    return sampled(walk_all([coded], np.zeros(1, np.int64))[0], coded).hex()


@lru_cache(maxsize=OCTAVES)
def _band_steps(octave: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED + 100 + octave)).integers(0, 1 << octave, BANDS * ROWS)


def band_keys(steps: np.ndarray, text: np.ndarray) -> list[str]:
    """Keys of the bands up to the walk's last whole octave and up to the one below it."""
    top = int(steps[-1]).bit_length() - 1
    keys = []
    for octave in sorted({max(top, 0), max(top - 1, 0)}):
        symbols = symbols_at(steps, text, _band_steps(octave)).reshape(BANDS, ROWS)
        keys += [f"{octave}:{i}:{row.tobytes().hex()}" for i, row in enumerate(symbols)]
    return keys


FIELDS = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
          " near_edited double, near_next double, edited_linked boolean, next_linked boolean")


def _edited_rows(rows: list[tuple[int | None, str]], following: str) -> Iterator[tuple]:
    """Rows of FIELDS for texts in order, the last of which is followed by `following`."""
    texts = [t for _, t in rows] + [following]
    coded = [classes(t) for t in texts]
    steps = walk_all(coded, np.zeros(len(texts), np.int64))
    marks = [sampled(s, c) for s, c in zip(steps, coded)]
    bands = [set(band_keys(s, c)) for s, c in zip(steps, coded)]
    keep = [len(t) - len(t) // 2 for t in texts[:-1]]
    tails = [coded[i + 1][:len(texts[i]) // 2] for i in range(len(rows))]
    tail_steps = walk_all(tails, np.array([steps[i][k] for i, k in enumerate(keep)], np.int64))
    for i, (doc_id, text) in enumerate(rows):
        edited = text[:keep[i]] + texts[i + 1][:len(text) // 2]
        walk = np.concatenate([steps[i][:keep[i]], tail_steps[i]]), np.concatenate([coded[i][:keep[i]], tails[i]])
        mark = sampled(*walk)
        near_edited, near_next = likeness(marks[i], mark), likeness(marks[i], marks[i + 1])
        yield (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), marks[i].hex(), mark.hex(),
               near_edited, near_next, near_edited >= ALIKE and not bands[i].isdisjoint(band_keys(*walk)),
               near_next >= ALIKE and not bands[i].isdisjoint(bands[i + 1]))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the id, by a tree of comparisons; -1 for null."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(doc_id < bounds[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(tree(0, len(bounds)))


def with_followers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text edited with its follower's beginning.

    The follower is the next row by descending id. Ids are cut into ranges; the first row of a range is also sent to the
    range before it, so each range is a stream of its own and texts move once. Memory holds `TOGETHER` characters.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = slim.select("doc_id")
    bounds = sorted({int(b) for b in ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)})
    bucket = _bucket(F.col("doc_id"), bounds)
    heads = sorted((r.bucket, r.head) for r in ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head")).collect())
    # The head of a range goes to the range above; the first head of all follows the last row.
    goal = {heads[i][1]: heads[(i + 1) % len(heads)][0] for i in range(len(heads))}
    named = [h for h in goal if h is not None]
    guest = F.lit(None).cast("int")
    if named:
        guest = F.when(F.col("doc_id").isin(named), F.get(
            F.array(*[F.lit(goal[h]) for h in named]), F.array_position(F.array(*map(F.lit, named)), F.col("doc_id")).cast("int") - 1))
    if None in goal:
        guest = F.when(F.col("doc_id").isNull(), F.lit(goal[None])).otherwise(guest)
    sent = slim.withColumn("to", F.explode(F.array(
        F.struct(bucket.alias("bucket"), F.lit(False).alias("guest")), F.struct(guest.alias("bucket"), F.lit(True).alias("guest")))))
    sent = sent.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "to.*").where(F.col("bucket").isNotNull())
    placed = sent.repartition(ranges, "bucket").sortWithinPartitions(
        "bucket", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int | None, str]] = []
        held, place, done = 0, None, False

        def batch(following: str) -> pa.RecordBatch:
            columns = list(zip(*_edited_rows(rows, following)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in FIELDS.split(", ")])

        for incoming in batches:
            for key, said, at, is_guest in zip(*(incoming.column(i).to_pylist() for i in range(4))):
                if at != place:
                    place, done = at, False
                if is_guest:
                    if not done and rows:
                        yield batch(said)
                        rows, held = [], 0
                    done = True
                    continue
                if held + len(said) > TOGETHER and rows:
                    yield batch(said)
                    rows, held = [], 0
                rows.append((key, said))
                held += len(said)

    return placed.mapInArrow(run, FIELDS)


def edit_pairs(docs: DataFrame, least: float = ALIKE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b, likeness: pairs of different texts (by their smallest id) whose bands meet and whose likeness is verified.

    Equal texts are one row before the join, so copies make no pairs. Only ids meet; each pair is verified once. A band
    that many different texts share is a skewed side that Spark may split.
    """
    distinct = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy(
        F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [classes(t) for t in batch.column(1).to_pylist()]
            steps = walk_all(coded, np.zeros(len(coded), np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([sampled(s, c) for s, c in zip(steps, coded)], pa.binary()),
                pa.array([band_keys(s, c) for s, c in zip(steps, coded)], pa.list_(pa.string()))], ["id", "mark", "bands"])

    marked = staged(distinct.select("id", "text").mapInArrow(run, "id bigint, mark binary, bands array<string>"), "edit-marks")
    keys = marked.select("id", F.explode(F.transform("bands", lambda b: F.xxhash64(b))).alias("band"))
    left, right = (keys.withColumnRenamed("id", n) for n in ("a", "b"))
    met = left.join(right, "band").where("a < b").select("a", "b").distinct()
    for n in ("a", "b"):
        met = met.join(marked.select(F.col("id").alias(n), F.col("mark").alias(f"mark_{n}")), n)

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                [likeness(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.float64())], ["a", "b", "likeness"])

    return met.select("a", "b", "mark_a", "mark_b").mapInArrow(verify, "a bigint, b bigint, likeness double").where(F.col("likeness") >= least)
