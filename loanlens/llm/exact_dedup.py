"""Exact deduplication by Grace hashing.

Each task first folds the equal texts of its own split, so that a text with a billion copies crosses the network
once per task. The distinct texts are then dealt out by a hash of the text. A task that receives more than its
memory budget deals its records on to spill files by further bits of the hash, again and again, until a bucket
fits an open-addressing table. The table compares whole contents, never digests alone.

Cases: a null text is an empty text; a null id is smaller than any id; of rows that repeat both id and text one
stays; an empty table gives an empty result. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import free_name, lower_az

BUDGET = 24 << 20  # bytes of text that a table may hold
FAN_OUT = 16
BITS = 4

#: A record: hash of the text, the text, largest id (or None), number of rows.
Record = tuple[int, bytes, int | None, int]


class TextTable:
    """Open addressing with linear probing; keys are whole texts, values the largest id and a count."""

    def __init__(self, capacity: int = 1024) -> None:
        self.slots: list[list | None] = [None] * capacity
        self.filled = 0
        self.held = 0

    def add(self, record: Record) -> None:
        key, text, doc_id, count = record
        slots, mask = self.slots, len(self.slots) - 1
        at = (key ^ key >> 29) & mask
        while (entry := slots[at]) is not None:
            if entry[0] == key and entry[1] == text:
                if entry[2] is None or doc_id is not None and doc_id > entry[2]:
                    entry[2] = doc_id
                entry[3] += count
                return
            at = (at + 1) & mask
        slots[at] = [key, text, doc_id, count]
        self.filled += 1
        self.held += len(text) + 200
        if 3 * self.filled > 2 * len(slots):
            self._grow()

    def _grow(self) -> None:
        old, self.slots = self.slots, [None] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry in filter(None, old):
            at = (entry[0] ^ entry[0] >> 29) & mask
            while self.slots[at] is not None:
                at = (at + 1) & mask
            self.slots[at] = entry

    def __iter__(self) -> Iterator[Record]:
        return (tuple(entry) for entry in self.slots if entry is not None)


def _read(file: BinaryIO) -> Iterator[Record]:
    file.seek(0)
    while True:
        try:
            yield from pickle.load(file)
        except EOFError:
            return


def _spill_folder() -> str | None:
    """Where Spark lets this executor's tasks spill; the files have no name and go with the task."""
    return next(iter(filter(os.path.isdir, os.environ.get("SPARK_LOCAL_DIRS", "").split(","))), None)


def grace(records: Iterable[Record], budget: int = BUDGET, depth: int = 0) -> Iterator[Record]:
    """Fold equal texts. Beyond the budget, what the table holds and what follows goes to FAN_OUT spill files,
    by bits of the hash that no level above has used; each file is then handled in the same way."""
    table, records = TextTable(), iter(records)
    for record in records:
        table.add(record)
        if table.held > budget and table.filled > 1 and depth * BITS < 60:
            break
    else:
        yield from table
        return
    files = [tempfile.TemporaryFile(dir=_spill_folder()) for _ in range(FAN_OUT)]
    waiting: list[list[Record]] = [[] for _ in files]
    sizes = [0] * FAN_OUT

    def deal(record: Record) -> None:
        part = record[0] >> depth * BITS & FAN_OUT - 1
        waiting[part].append(record)
        sizes[part] += len(record[1]) + 64
        if sizes[part] > 1 << 20:
            pickle.dump(waiting[part], files[part], pickle.HIGHEST_PROTOCOL)
            waiting[part], sizes[part] = [], 0

    for record in table:
        deal(record)
    del table
    for record in records:
        deal(record)
    for part, file in enumerate(files):
        pickle.dump(waiting[part], file, pickle.HIGHEST_PROTOCOL)
        waiting[part] = []
        with file:
            yield from grace(_read(file), budget, depth + 1)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[Record]:
    for batch in batches:
        for key, text, doc_id, count in zip(*(batch.column(i) for i in range(4))):
            yield key.as_py() & (1 << 64) - 1, text.as_py().encode("utf-8", "surrogatepass"), doc_id.as_py(), count.as_py()


def _batches(records: Iterable[Record]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[Record]) -> pa.RecordBatch:
        key, text, doc_id, count = zip(*rows)
        return pa.RecordBatch.from_arrays([
            pa.array([k - (1 << 64) if k >> 63 else k for k in key], pa.int64()),
            pa.array([t.decode("utf-8", "surrogatepass") for t in text], pa.string()),
            pa.array(doc_id, pa.int64()), pa.array(count, pa.int64())], ["key", "body", "top", "n"])

    rows, held = [], 0
    for record in records:
        rows.append(record)
        held += len(record[1])
        if held > 4 << 20 or len(rows) >= 5000:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def _fold_split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold equal texts of a split; a full table is passed on and begun anew."""
    table = TextTable()
    for record in _records(batches):
        table.add(record)
        if table.held > BUDGET:
            yield from _batches(table)
            table = TextTable()
    yield from _batches(table)


def _fold_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(grace(_records(batches)))


SHAPE = "key bigint, body string, top bigint, n bigint"


def text_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct text: text_sha256, keep_id (largest id), group_size."""
    body = lower_az(F.coalesce(F.col(text), F.lit("")))
    slim = docs.select(body.alias("body"), F.col(doc_id).cast("bigint").alias("top"))
    slim = slim.select(F.xxhash64("body").alias("key"), "body", "top", F.lit(1).cast("bigint").alias("n"))
    local = slim.mapInArrow(_fold_split, SHAPE)
    merged = local.repartition("key").mapInArrow(_fold_bucket, SHAPE)
    return merged.select(F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"),
                         F.col("top").alias("keep_id"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Members carry digests, not texts, to the join; a hot digest is a skewed side that Spark may split.
    """
    body = lower_az(F.coalesce(F.col(text), F.lit("")))
    members = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                          F.sha2(body.cast("binary"), 256).alias("text_sha256"))
    return _judged(members, text_groups(docs, doc_id, text)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _judged(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members with their group; of rows that repeat id and text, the first of an arbitrary order stays."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(1)))
    first = members.withColumn("nth", nth)
    return first.join(groups, "text_sha256").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, whole and with all their columns."""
    sha, keep, nth = (free_name(docs, n) for n in ("text_sha256_of_row", "keep_id_of_text", "nth_of_row"))
    body = lower_az(F.coalesce(F.col(text), F.lit("")))
    groups = text_groups(docs, doc_id, text).select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep))
    rows = docs.withColumn(sha, F.sha2(body.cast("binary"), 256))
    kept = rows.join(groups, (rows[sha] == groups[sha]) & rows[doc_id].cast("bigint").eqNullSafe(groups[keep]),
                     "left_semi")
    order = F.row_number().over(Window.partitionBy(sha).orderBy(F.lit(1)))
    return kept.withColumn(nth, order).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
