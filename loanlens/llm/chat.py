"""Chat formatting with typed content parts.

A message is a list of parts (text, image, audio, document). A visitor walks the parts in order and gives the
flat text of the message, in which every other part is a placeholder, and the attachments: the part's place, kind,
reference and the tokens that the placeholder grows to. A turn becomes `<|im_start|>role\\n...<|im_end|>\\n`; control
strings inside texts get one more backslash after `<`, which `unescape` takes away again.

Turns are formatted row by row, so a conversation of any length needs no single task to hold it. Reading back walks
the sorted turns of a conversation as a stream with running digests.

Cases: null text and null role are empty; a null turn comes first; rows that repeat a turn are ordered by role, then
text; an unknown kind of part raises; null conversation ids form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Pixels along a tile of an image, tokens of a tile; audio tokens of a second; tokens of a page.
TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 256, 25, 512


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@dataclass
class Flat:
    """A message after the visit: its text, the spans under the loss, and what the placeholders stand for."""

    text: str = ""
    attachments: list[dict[str, Any]] = field(default_factory=list)
    extra_tokens: int = 0


class PartVisitor:
    """Visits parts in order, one method for each kind."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[dict[str, Any]] = []

    def visit(self, part: dict[str, Any]) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part: {kind}")
        method(part)

    def visit_text(self, part: dict[str, Any]) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict[str, Any]) -> None:
        tiles = [max(1, -(-int(part.get(side) or TILE) // TILE)) for side in ("width", "height")]
        self._placeholder("image", part, tiles[0] * tiles[1] * TILE_TOKENS)

    def visit_audio(self, part: dict[str, Any]) -> None:
        self._placeholder("audio", part, max(1, round(float(part.get("seconds") or 0) * SECOND_TOKENS)))

    def visit_document(self, part: dict[str, Any]) -> None:
        self._placeholder("document", part, max(1, int(part.get("pages") or 1)) * PAGE_TOKENS)

    def _placeholder(self, kind: str, part: dict[str, Any], tokens: int) -> None:
        self.attachments.append({"place": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.pieces.append(f"<|{kind}|>")

    def result(self) -> Flat:
        return Flat("".join(self.pieces), self.attachments, sum(a["tokens"] for a in self.attachments))


def flatten(parts: Iterable[dict[str, Any]] | None) -> Flat:
    visitor = PartVisitor()
    for part in parts or ():
        visitor.visit(part)
    return visitor.result()


def format_turn(role: str | None, parts: Iterable[dict[str, Any]] | None) -> tuple[str, int, int, Flat]:
    """The turn's segment, the span of it under the loss (start and end, equal where there is none), the visit."""
    flat = flatten(parts)
    head = f"{START}{escape_role(role or '')}\n"
    end = len(head) + (len(flat.text) if role == TRAINED_ROLE else 0)
    return f"{head}{flat.text}{END}\n", len(head), end, flat


def parse_turn(segment: str) -> tuple[str, str]:
    """Role and text, unescaped, of a segment."""
    if not (segment.startswith(START) and segment.endswith(f"{END}\n")):
        raise ValueError("not a formatted turn")
    role, _, text = segment[len(START):-len(END) - 1].partition("\n")
    return unescape_role(role), unescape(text)


SEGMENTS = ("conv_id bigint, turn bigint, segment string, loss_start bigint, loss_end bigint, extra_tokens bigint,"
            " attachments array<struct<place:bigint,kind:string,ref:string,tokens:bigint>>")
ATTACHMENTS = pa.list_(pa.struct([("place", pa.int64()), ("kind", pa.string()), ("ref", pa.string()),
                                  ("tokens", pa.int64())]))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One segment per message; the formatted conversation is its segments in order of turn.

    `messages`: conv_id, turn, role, and either content (JSON list of parts) or text. Other columns are ignored.
    """
    content = F.col("content") if "content" in messages.columns else F.lit(None).cast("string")
    text = F.col("text") if "text" in messages.columns else F.lit(None).cast("string")
    slim = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"),
                           text.alias("text"), content.alias("content"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            made = [format_turn(role, [{"type": "text", "text": said}] if parts is None else json.loads(parts))
                    for role, said, parts in zip(columns["role"], columns["text"], columns["content"])]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()),
                pa.array([m[3].extra_tokens for m in made], pa.int64()),
                pa.array([m[3].attachments for m in made], ATTACHMENTS),
            ], ["conv_id", "turn", "segment", "loss_start", "loss_end", "extra_tokens", "attachments"])

    return slim.mapInArrow(run, SEGMENTS)


DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
           " formatted_chars bigint, extra_tokens bigint")


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation from its segments alone; memory holds one batch, not a conversation."""

    def close(conv: int | None, state: list[Any]) -> tuple:
        n, turns, chars, loss, formatted, extra = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, extra

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)],
                                              [c.split()[0] for c in DIGESTS.split(", ")])

        for incoming in batches:
            columns = [incoming.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end", "extra_tokens")]
            for conv, segment, start, end, extra in zip(*columns):
                if state is None or conv != current:
                    if state is not None:
                        done.append(close(current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = parse_turn(segment)
                under_loss = unescape(segment[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(under_loss)
                state[3].update(under_loss.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
                state[5] += extra
            if done:
                yield batch()
                done = []
        if state is not None:
            done.append(close(current, state))
            yield batch()

    placed = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return placed.mapInArrow(run, DIGESTS)
