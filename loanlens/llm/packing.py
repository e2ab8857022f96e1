"""Harmonic packing of tokenized documents into sequences.

With capacity C, class k takes pieces of length up to C/k, and its bins hold exactly k pieces. A document gives
whole sequences first; what remains goes whole into its class if k such pieces leave at most `SLACK` tokens of a bin
empty, otherwise a head of exactly C/(k+1) tokens goes to class k+1 and the rest is treated alike. Every task packs
its own documents, without a shuffle. Pieces of bins that a task cannot fill are cut into powers of two, for which
sequences of a power of two are filled exactly.

Words are tokenized once each and remembered, up to a fixed number; the tokenizer never joins what white space
parts, so the ids are those of the whole text.

Cases: a null text is empty and has the end id alone; null and repeated ids are packed like others; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import string
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import LOWER_AZ

CAPACITY = 4096
SLACK = 64
END_ID = 2
REMEMBERED = 400_000  # words that a Python worker keeps
MARKS = string.punctuation.encode()

#: A piece: document id, start in the document, ids, tokens of the document.
Piece = tuple[int | None, int, np.ndarray, int]


class _Places(dict):
    """Number of each word; a new word gets the next one and waits to be learned."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.waiting.append(word)
        return place


class WordEncoder:
    """Ids of texts; each word is given to the tokenizer once.

    Words are cut further where the tokenizer cuts too: ASCII marks after an ASCII letter. Words of letters are given to
    it many at a time, and their ids told apart by the ids that end a word; where the count of those differs, one by one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, words: list[bytes]) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
        """The words in the order in which their ids come, ids, lengths."""
        letters, others = [], []
        for word in words:
            (letters if word.decode("utf-8").isalpha() else others).append(word)
        order, parts, lengths = [], [], []
        for at in range(0, len(letters), 512):
            group = letters[at:at + 512]
            ids = np.array(self._ids_of([b" ".join(group).decode("utf-8")])[0], np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                order += group
                parts.append(ids)
                lengths.append(np.diff(ends, prepend=0))
            else:
                others += group
        for word, found in zip(others, self._ids_of([w.decode("utf-8") for w in others]) if others else ()):
            order.append(word)
            parts.append(np.array(found, np.uint32))
            lengths.append(np.array([len(found)]))
        return order, parts, lengths

    def _keep(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        self.starts[at] = len(self.ids) + np.cumsum(lengths) - lengths
        self.lengths[at] = lengths
        self.ids = np.concatenate([self.ids, ids])

    def _gather(self, at: np.ndarray, spare: int = 0) -> np.ndarray:
        """Ids of the remembered words at these places, one after the other, with room for `spare` more."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        out = np.empty(total + spare, np.uint32)
        out[:total] = self.ids[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(total)]
        return out

    def _learn(self) -> None:
        places, waiting = self.places, self.places.waiting
        whole, joined, parts = [], [], []
        for word in waiting:  # grows by the parts of its words
            stem = word.rstrip(MARKS)
            if stem and len(stem) < len(word) and 97 <= stem[-1] <= 122 and b"<|" not in word:
                joined.append(word)
                parts += places[stem], places[word[len(stem):]]
            else:
                whole.append(word)
        places.waiting = []
        more = np.zeros(len(places) - len(self.starts), np.int64)
        self.starts, self.lengths = np.concatenate([self.starts, more]), np.concatenate([self.lengths, more])
        order, ids, lengths = self._ask(whole)
        if order:
            self._keep(order, np.concatenate(ids), np.concatenate(lengths))
        if joined:
            at = np.array(parts, np.int64)
            self._keep(joined, self._gather(at), self.lengths[at].reshape(-1, 2).sum(1))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if len(self.places) > REMEMBERED:
            self._forget()
        rows = []
        for text in texts:
            raw = (text or "").encode("utf-8")
            words = (raw if b"<|" in raw else raw.translate(LOWER_AZ)).split()  # strings of special tokens keep their case
            rows.append(np.fromiter(map(self.places.__getitem__, words), np.int64, len(words)))
        if self.places.waiting:
            self._learn()
        for at in rows:
            ids = self._gather(at, 1)
            ids[-1] = END_ID
            yield ids


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class HarmonicPacker:
    """Gives lists of pieces, a sequence each."""

    def __init__(self, capacity: int = CAPACITY, slack: int = SLACK) -> None:
        self.capacity, self.slack = capacity, slack
        self.open: defaultdict[int, list[Piece]] = defaultdict(list)

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        size, at, total = self.capacity, 0, len(ids)
        while total - at >= size:
            yield [(doc_id, at, ids[at:at + size], total)]
            at += size
        while at < total:
            rest = total - at
            k = size // rest
            if k * rest < size - self.slack:
                k += 1
                rest = size // k
            yield from self._put(k, k, (doc_id, at, ids[at:at + rest], total))
            at += rest

    def _put(self, key: int, count: int, piece: Piece) -> Iterator[list[Piece]]:
        bin_ = self.open[key]
        bin_.append(piece)
        if len(bin_) == count:
            yield self.open.pop(key)

    def finish(self) -> Iterator[list[Piece]]:
        """What is left, cut into powers of two; the last sequences have a power of two of tokens."""
        left = [piece for bin_ in self.open.values() for piece in bin_]
        self.open.clear()
        for doc_id, start, ids, total in left:
            at = 0
            while at < len(ids):
                length = 1 << (len(ids) - at).bit_length() - 1
                yield from self._put(length, max(1, self.capacity // length), (doc_id, start + at, ids[at:at + length], total))
                at += length
        for bin_ in self.open.values():
            while bin_:
                count = 1 << len(bin_).bit_length() - 1
                yield bin_[:count]
                del bin_[:count]
        self.open.clear()


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces in sequences of `capacity` (a power of two); ids are little-endian unsigned 32-bit numbers.

    Sequence ids hold the task's number in their upper bits, so tasks need not agree on them.
    """
    if capacity & capacity - 1:
        raise ValueError("the capacity has to be a power of two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encoder = HarmonicPacker(capacity), _encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PIECES.split(", ")])

        def sequences() -> Iterator[list[Piece]]:
            for incoming in batches:
                for at in range(0, incoming.num_rows, 1024):
                    part = incoming.slice(at, 1024)
                    for key, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                        yield from packer.add(key, ids)
            yield from packer.finish()

        for pieces in sequences():
            offset = 0
            for key, start, ids, total in pieces:
                rows.append((key, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))
                offset += len(ids)
            sequence += 1
            held += offset
            if held > 1 << 20:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(run, PIECES)
