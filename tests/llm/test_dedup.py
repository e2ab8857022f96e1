"""Exact and near deduplication against brute force."""

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import pytest
import xxhash
from loanlens.llm import components, exact_dedup, simhash

from .conftest import ODD


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups(odd):
    groups = defaultdict(list)
    for doc_id, text in ODD:
        groups[low(text)].append(doc_id)
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.text_sha256, r.kept) for r in exact_dedup.exact_groups(odd).collect())
    seen, want = set(), []
    for doc_id, text in ODD:
        same = groups[low(text)]
        top = max((i for i in same if i is not None), default=None)
        kept = doc_id == top and (doc_id, low(text)) not in seen
        seen.add((doc_id, low(text)))
        want.append((doc_id or 0, top, len(same), hashlib.sha256(low(text).encode()).hexdigest(), kept))
    assert got == sorted(want)
    kept = exact_dedup.dedup(odd).collect()
    assert len(kept) == len(groups) and {low(r.text) for r in kept} == set(groups)


def test_empty(none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.dedup(none).count() == 0
    assert simhash.near_groups(none, 3).count() == 0


def test_clashing_columns(make):
    docs = make([(1, "a"), (2, "A"), (3, "b")]).withColumnRenamed("lang", "keep_id").withColumnRenamed("source", "text_sha256_of_row")
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]
    near = simhash.near_dedup(docs, 3)
    assert near.columns == docs.columns


def test_grace_spills_and_compares_contents():
    random.seed(5)
    bodies = [f"{random.random()} {'x' * random.randrange(200)}".encode() for _ in range(400)]
    rows = [(xxhash.xxh64_intdigest(b), b, i, 1) for i, b in enumerate(bodies * 3)]
    rows += [(7, b"same hash %d" % i, i, 1) for i in range(20)]  # equal hashes, unequal contents
    random.shuffle(rows)
    want = {}
    for _, body, i, n in rows:
        top, count = want.get(body, (-1, 0))
        want[body] = (max(top, i), count + n)
    for budget in (500, 20_000, 1 << 30):
        found = list(exact_dedup.grace(rows, budget))
        assert {b: (top, n) for _, b, top, n in found} == want and len(found) == len(want)


def brute_print(text, width):
    said = low(text).encode().split()
    if not said:
        return 0
    shingles = [b" ".join(said[i:i + width]) for i in range(max(1, len(said) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_groups(make, spark):
    random.seed(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = random.choices(words, k=random.choice([2, 5, 60, 400]))
        texts.append(" ".join(base))
        for _ in range(random.randrange(4)):
            other = base[:]
            other[random.randrange(len(other))] = random.choice(words)
            texts.append(" ".join(other).upper() if random.random() < 0.5 else " ".join(other))
    rows = [(i, t) for i, t in enumerate(texts + [None, "", texts[0]])]
    prints = {i: brute_print(t, 3) for i, t in rows}
    linked = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = brute_components(prints, linked)
    got = {r.doc_id: r for r in simhash.near_groups(make(rows), 3).collect()}
    assert {i: got[i].print % (1 << 64) for i in got} == prints
    assert {i: got[i].component_id for i in got} == want
    assert sorted(r.doc_id for r in simhash.near_dedup(make(rows), 3).collect()) == sorted(set(want.values()))


def test_links_lose_nothing(spark):
    random.seed(9)
    values = {random.getrandbits(64) & 0x00FF00FFFFFF0FFF for _ in range(150)}
    for v in list(values):
        for _ in range(2):
            for b in random.sample(range(64), random.randrange(1, 5)):
                v ^= 1 << b
            values.add(v)
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "print bigint")).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("costs,best", [([[0, 5, 50, 500, 5000]] * 4, [0, 0, 0, 0]), ([[0, 100, 200, 300, 400], [0, 1, 2, 3, 400]], [0, 2])])
def test_allocation(costs, best):
    assert simhash.allocate(costs)[1] == best


def test_components(spark):
    random.seed(1)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == brute_components(nodes, links)
