"""Conversation repair next to exhaustive search and to a plain walk over whole strings."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from loanlens.llm import queries, turn_repair
from loanlens.llm.turn_repair import Audit, Row, edits, messages, repaired, summaries

SPACES = " \t\n\x0b\x0c\r"
SMALL = "/root/testdata/sf0.001"


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or bool(rest) and len(rest) % 2 == 0 and all(c == "ua"[i % 2] for i, c in enumerate(rest))


def faults(rows):
    """(turn, role, text) in order -> a fault or None for each."""
    seen, found = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACES)
        found.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def exhaustive(rows, inserts=2):
    """(cost, audit, roles and texts) of the best edits, all of them tried."""
    said, best = faults(rows), None
    options = []
    for (_, role, text), fault in zip(rows, said):
        own = [("D", 4, [])]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            own += [("K", more, [(role, text)])] if role else []
            own += [("R", 3 + more, [(r, text)]) for r in ("user", "assistant")]
        options.append(own)
    gap = [tuple(("I", 3, [(r, "")]) for r in chosen) for n in range(inserts + 1) for chosen in product(("user", "assistant"), repeat=n)]
    for chosen in product(*options):
        for gaps in product(gap, repeat=len(rows) + 1):
            path = [e for g, c in zip(gaps, [*((c,) for c in chosen), ()]) for e in (*g, *c)]
            turns = [t for e in path for t in e[2]]
            if legal("".join(r[:1] for r, _ in turns)):
                found = sum(e[1] for e in path), "".join(e[0] for e in path), turns
                best = min(best, found) if best else found
    return best


def plain(rows):
    """The same by a walk that keeps whole strings."""
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}

    def insert(table):
        for _ in range(4):
            for at, (cost, audit, turns) in list(table.items()):
                to = "a" if at == "u" else "u"
                made = cost + 3, audit + "I", [*turns, ({"u": "user", "a": "assistant"}[to], "")]
                table[to] = min(table.get(to, made), made)
        return table

    table = insert({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows)):
        after = {}
        for at, (cost, audit, turns) in table.items():
            offers = [(at, (cost + 4, audit + "D", turns))]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role and role[0] in nexts[at]:
                    offers.append((role[0], (cost + more, audit + "K", [*turns, (role, text)])))
                to = "a" if at == "u" else "u"
                offers.append((to, (cost + more + 3, audit + "R", [*turns, ({"u": "user", "a": "assistant"}[to], text)])))
            for to, made in offers:
                after[to] = min(after.get(to, made), made)
        table = insert(after)
    return min(table[s] for s in ("", "a") if s in table)


def walked(rows, settle=lambda: False):
    """(cost, audit, roles and texts) by the operator's walk."""
    audit, made = Audit(), []
    for row, fault in zip(rows, faults(rows)):
        audit.add(Row(*row, fault, False))
        if settle():
            made += audit.settle()
    made += audit.finish()
    cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[m] + 3 * (m != "D" and bool(r) and r.fault == "truncated") for m, r, _ in made)
    return cost, "".join(m for m, _, _ in made), [(role, r.text if r else "") for m, r, role in made if m != "D"]


def drawn(draw, n):
    texts = ["a.", "b", " ", "c!", "d?", "a. \n"]
    return [(i, draw.choice(["user", "assistant", "system", "tool", "user", "assistant", " ", ""]), draw.choice(texts) + draw.choice(["", str(i) + "."]))
            for i in range(n)]


def test_walk_is_the_best_of_all_edits():
    draw = random.Random(1)
    for n in (0, 1, 2, 2, 2, 2, 2, 2, 2, 2):
        rows = drawn(draw, n)
        assert walked(rows) == exhaustive(rows), rows
    for _ in range(6):
        rows = drawn(draw, 3)
        assert walked(rows) == exhaustive(rows, 1 if len(rows) > 2 else 2), rows


@pytest.mark.parametrize("base", [turn_repair.BASE, 0])
def test_walk_is_the_plain_walk(monkeypatch, base):
    """Also when all digests of audits collide, and when beginnings are settled at any time."""
    monkeypatch.setattr(turn_repair, "BASE", base)
    monkeypatch.setattr(turn_repair, "MODULUS", turn_repair.MODULUS if base else 1)
    draw = random.Random(2)
    for n in [*range(12)] * 20 + [60, 200]:
        rows = drawn(draw, n)
        assert walked(rows) == plain(rows), rows
        assert walked(rows, lambda: draw.random() < 0.3) == plain(rows), rows


def test_memory_follows_what_is_open():
    audit, out = Audit(), 0
    for i in range(20_000):
        audit.add(Row(i, "user" if i % 2 == 0 else "assistant", f"t{i}.", None, False))
        if audit.unsettled >= 100:
            out += sum(1 for _ in audit.settle())
            assert len(audit.rows) < 10
    assert out > 19_000 and len("".join(m for m, _, _ in audit.finish())) + out == 20_000


def brute(rows):
    """The contract's columns from (conv_id, turn, role, text), by plain Python."""
    after = {}
    for conv, turn, role, text in rows:
        kept = after.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fold = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fold == 0:
            continue
        text = "" if fold == 1 else "".join(c for c in text if c not in ".!?") if fold == 2 else text
        kept += [(turn, "user" if fold == 4 else role, text)] * (2 if fold == 3 else 1)
    out = {}
    for conv, kept in after.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        said, turns = faults(kept), {r[0] for r in kept} - {None}
        cost, audit, body = plain(kept)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(said.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in body).encode()).hexdigest())
    return out


def digest(df):
    rows = [tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    made = queries.op11_turn_repair(spark, f"/root/testdata/{size}")
    assert dict(made.dtypes) == {**dict.fromkeys(("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"),
                                 "audit": "string", "repaired_sha256": "string"}
    rows = spark.read.parquet(f"/root/testdata/{size}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert digest(made) == brute([tuple(r) for r in rows])


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_odd_rows(spark):
    draw = random.Random(3)
    rows = [(draw.choice([None, 1, 2, 3, 4, 5]), draw.choice([None, 0, 1, 2, 7, 9]), draw.choice([None, "", "user", "assistant", "system", "tool"]),
             draw.choice([None, "", " ", "x.", "y", "z ", "é!", "long " * 20_000])) for _ in range(150)]
    rows += [(9, 1, "user", "same."), (9, 1, "user", "same."), (9, 1, "user", "same."), (9, 2, "assistant", "same.")]
    rows += [(conv, 0, "user", "gone.") for conv in range(100, 160)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = brute(rows)
    assert any(v[6] == "" and v[0:6] == (0,) * 6 for v in expected.values())  # a conversation whose rows are all dropped
    assert digest(summaries(edits(turn_repair.damaged(messages(df))))) == expected
    clash = df.selectExpr("*", "1 AS FAULT", "2 AS seen", "3 AS dropped", "4 AS copy", "5 AS body", "6 AS c", "7 AS at")
    assert digest(summaries(edits(turn_repair.damaged(messages(clash))))) == expected
    assert summaries(edits(turn_repair.damaged(messages(df.where("false"))))).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "hi."), (1, 1, "user", "more."), (1, 2, "assistant", "so"), (2, 5, "assistant", "a."), (2, 6, "assistant", "a.")]
    made = edits(messages(spark.createDataFrame(rows, SCHEMA)))
    got = {}
    for r in repaired(made).orderBy("conv_id", "at").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: plain([r[1:] for r in rows if r[0] == c])[2] for c in (1, 2)}
    faulty = {(r.conv_id, r.turn): r.fault for r in made.where("fault IS NOT NULL").collect()}
    assert faulty == {(1, 2): "truncated", (2, 6): "duplicate"}


def test_a_long_conversation_is_settled_on_the_way(spark):
    draw = random.Random(4)
    rows = [(1, i, draw.choice(["user", "assistant"]), f"t{i % 900}" + draw.choice([".", ""])) for i in range(5000)]
    assert digest(summaries(edits(messages(spark.createDataFrame(rows, SCHEMA)))))[1][5:] == (
        lambda best: (best[0], best[1], hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()))(plain([r[1:] for r in rows]))
