"""Conversation structure repair: the cheapest edits that make a conversation's roles read `(s?(ua)+)?`.

A conversation's rows are walked in order of turn (nulls first, then role, then text). The walk keeps, for each last
role so far (none, system, user, assistant), the cheapest edits that lead there: Keep, Rerole, Delete a row, Insert an
empty turn. Edits of equal cost are ordered by their initials, so an audit is a string and the least one wins.

Audits are persistent: an edit is a node that points to the edit before it, so audits share their beginnings. A node
holds its ancestors at distances 1, 2, 4 ... and a rolling hash of the string that ends in it. Two audits of equal cost
are compared by their longest common prefix, found by descending the ancestors while the hashes differ; the prefix is
then read back and compared, so a collision of hashes costs time and never a wrong order. Of two audits of equal cost
that have read the same rows neither begins with the other (what is left would be inserts, which cost), so the order
stays right whatever follows.

Beginnings that all living audits share are final: they are given out and their rows forgotten, every `SETTLE` rows. A
conversation is one sorted stream in one task, since the digest of its repaired text is sequential; memory holds the
rows on which the living audits still differ.

Cases: null role and text count as one space; a null turn comes first, a null conversation id is a conversation; rows
that repeat are duplicates of the first; a role with an empty name has no initial and cannot be kept; any role with the
initial s, u or a counts as system, user or assistant; a conversation without rows has no edits; texts of any length
are read row by row; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SETTLE = 1024
#: A batch of results is given out beyond this many rows or code points.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 22
#: What may follow what; "" is the beginning. An audit may end where nothing or an assistant came last.
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
ENDS = ("", "a")
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Edit:
    """The last edit of an audit. `up[k]` is the edit 2^k places before."""

    __slots__ = ("up", "depth", "mark", "digest")

    def __init__(self, before: Edit | None, mark: str) -> None:
        self.mark = mark
        if before is None:
            self.up, self.depth, self.digest = (), 0, 0
            return
        up = [before]
        while len(up[-1].up) >= len(up):
            up.append(up[-1].up[len(up) - 1])
        self.up, self.depth = tuple(up), before.depth + 1
        self.digest = (before.digest * BASE + ord(mark)) % MODULUS


def ancestor(edit: Edit, depth: int) -> Edit:
    while edit.depth > depth:
        edit = edit.up[(edit.depth - depth).bit_length() - 1]
    return edit


def _same(x: Edit, y: Edit) -> bool:
    """Whether two audits of one length are equal, read back to the edit that they share."""
    while x is not y:
        if x.mark != y.mark:
            return False
        x, y = x.up[0], y.up[0]
    return True


def _marks(edit: Edit, beyond: Edit | None = None) -> str:
    """The audit's marks, or those after `beyond`."""
    marks = []
    while edit is not beyond and edit.up:
        marks.append(edit.mark)
        edit = edit.up[0]
    return "".join(reversed(marks))


def precedes(a: Edit, b: Edit) -> bool:
    """Whether audit `a` is ASCII-less than `b`."""
    depth = min(a.depth, b.depth)
    x, y = ancestor(a, depth), ancestor(b, depth)
    if x is y:
        return a.depth < b.depth
    if x.digest == y.digest:
        return a.depth < b.depth if _same(x, y) else _marks(a) < _marks(b)
    for k in range(len(x.up) - 1, -1, -1):
        if k < len(x.up) and x.up[k].digest != y.up[k].digest:
            x, y = x.up[k], y.up[k]
    return x.mark < y.mark if _same(x.up[0], y.up[0]) else _marks(a) < _marks(b)


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str | None
    illegal: bool


class Audit:
    """The walk over one conversation. `add` takes rows in order; `done` gives the edits that are final."""

    def __init__(self) -> None:
        self.best: dict[str, tuple[int, Edit]] = {"": (0, Edit(None, ""))}
        self.rows: deque[Row] = deque()
        self.last = ""  # the last role given out
        self.unsettled = 0
        self._insert(self.best)

    @staticmethod
    def _offer(table: dict[str, tuple[int, Edit]], to: str, cost: int, before: Edit, mark: str) -> bool:
        held = table.get(to)
        if held and held[0] < cost:
            return False
        edit = Edit(before, mark)
        if held and held[0] == cost and not precedes(edit, held[1]):
            return False
        table[to] = cost, edit
        return True

    def _insert(self, table: dict[str, tuple[int, Edit]]) -> None:
        found = True
        while found:
            found = False
            for at, (cost, edit) in list(table.items()):
                to = "a" if at == "u" else "u"
                if table[at][1] is edit:
                    found |= self._offer(table, to, cost + INSERT, edit, "I")

    def add(self, row: Row) -> None:
        table: dict[str, tuple[int, Edit]] = {}
        initial, extra = row.role[:1], TRUNCATED if row.fault == "truncated" else 0
        for at, (cost, edit) in self.best.items():
            self._offer(table, at, cost + DELETE, edit, "D")
            if row.fault in ("blank", "duplicate"):
                continue
            if initial and initial in FOLLOWS[at]:
                self._offer(table, initial, cost + extra, edit, "K")
            self._offer(table, "a" if at == "u" else "u", cost + REROLE + extra, edit, "R")
        self._insert(table)
        # What an assistant may be followed by costs no more than what may follow a system row, and at most a deletion
        # more than what may follow nothing, so dearer audits of those can't win.
        if "a" in table:
            for at, more in (("", DELETE), ("s", 0)):
                if at in table and table[at][0] > table["a"][0] + more:
                    del table[at]
        self.best = table
        self.rows.append(row)
        self.unsettled += 1

    def settle(self) -> Iterator[tuple[str, Row | None, str]]:
        """Gives out what all living audits begin with."""
        shared = min((e for _, e in self.best.values()), key=lambda e: e.depth)
        for _, edit in self.best.values():
            x, y = ancestor(shared, min(shared.depth, edit.depth)), ancestor(edit, min(shared.depth, edit.depth))
            for k in range(len(x.up) - 1, -1, -1):
                if k < len(x.up) and x.up[k] is not y.up[k]:
                    x, y = x.up[k], y.up[k]
            shared = x if x is y else x.up[0]
        yield from self._replay(_marks(shared))
        root = Edit(None, "")
        made: dict[tuple[int, str], Edit] = {}
        for at, (cost, edit) in self.best.items():
            node = root
            for mark in _marks(edit, shared):
                step = id(node), mark
                if step not in made:
                    made[step] = Edit(node, mark)
                node = made[step]
            self.best[at] = cost, node
        self.unsettled = 0

    def finish(self) -> Iterator[tuple[str, Row | None, str]]:
        """Gives out the rest of the least audit."""
        least: tuple[int, Edit] | None = None
        for at in ENDS:
            held = self.best.get(at)
            if held and (least is None or held[0] < least[0] or held[0] == least[0] and precedes(held[1], least[1])):
                least = held
        yield from self._replay(_marks(least[1]))

    def _replay(self, marks: str) -> Iterator[tuple[str, Row | None, str]]:
        """(edit, its row, the role that the repaired turn has) for each mark."""
        for mark in marks:
            row = None if mark == "I" else self.rows.popleft()
            if mark == "D":
                yield mark, row, row.role
                continue
            self.last = row.role[:1] if mark == "K" else "a" if self.last == "u" else "u"
            yield mark, row, row.role if mark == "K" else ROLES[self.last]


EDITS = ("conv_id bigint, at bigint, edit string, turn bigint, role string, text string, fault string, illegal boolean, cost bigint")
_EDIT_FIELDS = [("conv_id", pa.int64()), ("at", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()),
                ("text", pa.string()), ("fault", pa.string()), ("illegal", pa.bool_()), ("cost", pa.int64())]

SPACE, MARK = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table, null role and text as one space, and dropped = false."""
    return conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(False).alias("dropped"))


def damaged(rows: DataFrame) -> DataFrame:
    """`messages` with faults dealt by crc32 of `conv_id:turn` modulo 20 (null: one space): 0 drops the row (it stays with
    dropped = true, so its conversation is known), 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes it the
    user's."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    dealt = rows.withColumn("fold", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("fold") == 1, "").when(F.col("fold") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fold") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return dealt.select("conv_id", "turn", F.when(F.col("fold") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                        (F.col("dropped") | (F.col("fold") == 0)).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")


def _with_first(rows: DataFrame) -> DataFrame:
    """Adds whether a row's role and text stand in an earlier turn of its conversation."""
    body = F.sha2("text", 256)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    kept = rows.withColumn("body", body)
    first = kept.where(~F.col("dropped")).groupBy("conv_id", "role", "body").agg(F.min(turn).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("body").alias("b"), "first")
    same = kept["conv_id"].eqNullSafe(first["c"]) & (kept["role"] == first["r"]) & (kept["body"] == first["b"])
    return kept.join(first, same, "left").withColumn("seen", F.coalesce(F.col("first") < turn, F.lit(False))).drop("c", "r", "b", "first", "body")


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation, one row each, a conversation's rows together and in order; a conversation
    without rows has one row without an edit. `rows`: as `messages` gives them."""
    blank = ~F.col("text").rlike(SPACE)
    fault = F.when(blank, "blank").when(F.col("seen"), "duplicate").when(~F.col("text").rlike(MARK), "truncated")
    placed = _with_first(rows).select("conv_id", "turn", "role", "text", "dropped", fault.alias("fault")).repartition(
        "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "dropped")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = at = 0
        conv: int | None = None
        audit: Audit | None = None
        before: tuple | None = None

        def give(made: Iterable[tuple[str, Row | None, str]]) -> None:
            nonlocal at, held
            for mark, row, role in made:
                text = row.text if row else ""
                cost = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[mark]
                if row and mark != "D" and row.fault == "truncated":
                    cost += TRUNCATED
                out.append((conv, at, mark, row and row.turn, role, text, row and row.fault, bool(row and row.illegal), cost))
                at, held = at + 1, held + len(text)

        def close() -> None:
            if before is None:
                out.append((conv, 0, None, None, None, None, None, False, 0))
            else:
                give(audit.finish())

        def batch() -> pa.RecordBatch:
            nonlocal out, held
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), _EDIT_FIELDS)], [n for n, _ in _EDIT_FIELDS])
            out, held = [], 0
            return made

        for incoming in batches:
            for values in zip(*(incoming.column(i) for i in range(6))):
                c, turn, role, text, dropped, fault = (v.as_py() for v in values)
                if audit is None or c != conv:
                    if audit is not None:
                        close()
                    conv, audit, before, at = c, Audit(), None, 0
                if dropped:
                    continue
                # Equal rows of one turn follow each other; the first of them may be new, the others are not.
                if fault != "blank" and before and before[:3] == (turn, role, text):
                    fault = "duplicate"
                illegal = before is not None and before[1][:1] + role[:1] not in LEGAL
                audit.add(Row(turn, role, text, fault, illegal))
                before = turn, role, text
                if audit.unsettled >= SETTLE:
                    give(audit.settle())
                if len(out) >= BATCH_ROWS or held >= BATCH_CHARS:
                    yield batch()
            if out:
                yield batch()
        if audit is not None:
            close()
            yield batch()

    return placed.mapInArrow(run, EDITS)


def repaired(made: DataFrame) -> DataFrame:
    """conv_id, at, role, text of the repaired conversations."""
    return made.where("edit IN ('K', 'R', 'I')").select("conv_id", "at", "role", "text")


SUMMARY = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,"
           " audit string, repaired_sha256 string")
_SUMMARY_KINDS = [pa.int64()] * 7 + [pa.string()] * 2


def summaries(made: DataFrame) -> DataFrame:
    """Counts, audit and digest of the repaired text of each conversation, read from `edits` as a stream, in its order.

    gaps: turns missing between the first and the last."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: int | None = None
        state: dict | None = None
        done: list[tuple] = []

        def close() -> None:
            turns = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
            done.append((conv, turns, *(state[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")),
                         "".join(state["audit"]), state["digest"].hexdigest()))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), _SUMMARY_KINDS)],
                                              [c.split()[0] for c in SUMMARY.split(", ")])

        for incoming in batches:
            for values in zip(*(incoming.column(i) for i in range(9))):
                c, _, edit, turn, role, text, fault, illegal, cost = (v.as_py() for v in values)
                if state is None or c != conv:
                    if state is not None:
                        close()
                    conv = c
                    state = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "turns": 0, "low": None,
                             "high": None, "digest": hashlib.sha256(), "begun": False}
                if edit is None:
                    continue
                state["audit"].append(edit)
                state["cost"] += cost
                state["illegal"] += illegal
                if fault:
                    state[fault] += 1
                if turn is not None and turn != state["high"]:
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"] = turn
                    state["turns"] += 1
                if edit != "D":
                    state["digest"].update(f"{chr(10) if state['begun'] else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    state["begun"] = True
            if done:
                yield batch()
                done = []
        if state is not None:
            close()
            yield batch()

    return made.mapInArrow(run, SUMMARY)
