"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 bits over the XXH64 hashes of word shingles. Pairs within 3 differing bits are found on distinct
fingerprints: the bits are grouped into parts, correlated bits together, and part i gets a threshold t_i >= -1 with
sum(t_i + 1) = 4. Two fingerprints within 3 bits then agree in at least one part to within its threshold. The number
of parts and the thresholds come from a dynamic program over the estimated cost of each part at each threshold:
probes sent plus candidates to verify. The estimate uses the bits' counts over all fingerprints. Each fingerprint
probes all values within t_i bits of its own; a candidate is verified on all 64 bits and kept by the first part that
finds it.

Cases: a null or blank text has fingerprint zero, linked like any other; fewer words than a shingle are one shingle;
rows that repeat an id count once each, and a null id never names a component unless no other id is in it; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import free_name, staged, words
from loanlens.llm.components import components

BITS = 64
DISTANCE = 3
SEED = 42
#: Cost of a verified candidate against a sent probe.
CANDIDATE_COST = 6.0
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    said = words(text)
    if not said:
        return np.zeros(0, np.uint64)
    line = b" ".join(said)
    if len(said) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in said]) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[:1 - width].tolist(), ends[width - 1:].tolist())], np.uint64)


def simhash(text: str | None, width: int) -> int:
    """A bit is set if it is set in over half of the hashes."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    each = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(each[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, print (64 bits as a signed number). Equal texts of a batch are worked out once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str | None, int] = {}
            made = []
            for text in batch.column(2).to_pylist():
                if text not in known:
                    known[text] = simhash(text, width)
                made.append(known[text])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(made, np.uint64).view(np.int64))],
                                              ["doc_id", "text_hash", "print"])

    return docs.select(F.col(doc_id).cast("bigint"), F.xxhash64(text).alias("text_hash"), F.col(text)).mapInArrow(
        run, "doc_id bigint, text_hash bigint, print bigint")


def bit_products(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set: 64 x 64 sums over all of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(values), 65536):
                bits = np.unpackbits(values[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                count += len(bits)
        at = np.arange(-1, BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(count, total.ravel().astype(np.int64)))], ["at", "n"])

    sums = prints.select("print").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1)
    for row in sums:
        out[row["at"] + 1] = row.n
    return int(out[0]), out[1:].reshape(BITS, BITS)


def grouped_bits(count: int, products: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into parts of equal size; each part grows by the bit most correlated with those it has."""
    mean = np.diag(products) / max(count, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    close = np.abs((products / max(count, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(close, 0)
    free, groups = set(range(BITS)), []
    for nth in range(parts):
        size = BITS // parts + (nth < BITS % parts)
        group = [max(free, key=lambda b: (close[b, sorted(free)].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (close[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def estimated_cost(count: int, differ: np.ndarray, threshold: int) -> float:
    """Probes and weighted candidates of a part whose bits differ with these chances, for all fingerprints."""
    if threshold < 0:
        return 0.0
    chance = np.zeros(threshold + 2)
    chance[0] = 1.0
    for p in differ:
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    probes = sum(math.comb(len(differ), e) for e in range(threshold + 1))
    return count * probes + CANDIDATE_COST * count * count / 2 * chance[:threshold + 1].sum()


def allocate(costs: list[list[float]], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """Least total cost and the thresholds with sum(t + 1) = distance + 1; costs[i][t + 1] for t from -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for take in range(distance + 2 - used):
                option = (total + cost[take], [*chosen, take - 1])
                if used + take not in following or option[0] < following[used + take][0]:
                    following[used + take] = option
        best = following
    return best[distance + 1]


def plan_parts(count: int, products: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, the cheapest over two to distance + 1 parts; parts without probes are left out."""
    mean = np.diag(products) / max(count, 1)
    differ = 2 * mean * (1 - mean)
    plans = []
    for parts in range(2, distance + 2):
        groups = grouped_bits(count, products, parts)
        costs = [[estimated_cost(count, differ[g], t) for t in range(-1, distance + 1)] for g in groups]
        total, chosen = allocate(costs, distance)
        plans.append((total, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits: Iterable[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: all pairs of distinct fingerprints within `distance` bits, each once. `prints`: distinct, column print."""
    count, products = bit_products(prints)
    plan = plan_parts(count, products, distance)
    masks = [_mask(bits) for bits, _ in plan]

    def probes(nth: int) -> Column:
        bits, threshold = plan[nth]
        flips = [_mask(c) for e in range(threshold + 1) for c in combinations(bits, e)]
        own = F.col("print").bitwiseAND(F.lit(masks[nth]))
        return F.transform(F.array(*map(F.lit, flips)), lambda m: F.struct(F.lit(nth).alias("part"), own.bitwiseXOR(m).alias("key")))

    sent = prints.select(F.col("print").alias("a"), F.explode(F.concat(*map(probes, range(len(plan))))).alias("p")).select("a", "p.*")
    own = F.array(*[F.struct(F.lit(i).alias("part"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    held = prints.select(F.col("print").alias("b"), F.explode(own).alias("p")).select("b", "p.*")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    seen_before = F.lit(False)
    for i, (mask, (_, threshold)) in enumerate(zip(masks, plan)):
        seen_before |= (F.col("part") > i) & (F.bit_count(apart.bitwiseAND(F.lit(mask))) <= threshold)
    return sent.join(held, ["part", "key"]).where("a < b").where(
        (F.bit_count(apart) <= distance) & ~seen_before).select("a", "b")


def near_groups(docs: DataFrame, width: int, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, print, component_id (the smallest id that links reach), stays (the row that represents it).

    Of rows with the smallest id of a group, the one with the smallest text hash represents it.
    """
    marked = staged(fingerprints(docs, width, doc_id, text), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "text_hash")
    distinct = staged(marked.groupBy("print").agg(F.min(order).alias("least")), "simhash-distinct")
    grouped = components(links(distinct.select("print"), distance))
    named = distinct.join(grouped, distinct.print == grouped.node, "left").select(
        "print", "least", F.coalesce("component", "print").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    names = named.select("print", "component").join(least, "component").select("print", "first")
    return marked.join(names, "print").select(
        "doc_id", "text_hash", "print", F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays"))


def representatives(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, whole. Rows that repeat id and text count once."""
    keep, seen, own, nth = (free_name(docs, n) for n in ("kept_id", "kept_hash", "hash_of_row", "nth_of_row"))
    kept = groups.where("stays").select(F.col("doc_id").alias(keep), F.col("text_hash").alias(seen))
    rows = docs.withColumn(own, F.xxhash64(text))
    rows = rows.join(kept, rows[doc_id].cast("bigint").eqNullSafe(F.col(keep)) & (F.col(own) == F.col(seen)), "left_semi")
    order = F.row_number().over(Window.partitionBy(doc_id, own).orderBy(F.lit(1)))
    return rows.withColumn(nth, order).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(docs: DataFrame, width: int, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, whole: one of each group. Rows that repeat id and text count once."""
    return representatives(docs, near_groups(docs, width, distance, doc_id, text), doc_id, text)
