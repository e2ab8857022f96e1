"""Spelling variants next to plain counting and neighbours by wildcards."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from loanlens.llm import queries, spelling


def letter(c):
    return "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ"


def brute_counts(rows):
    """Occurrences of words from (doc_id, text)."""
    counts = Counter()
    for number, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in "".join(c if letter(c) else " " for c in low).split(" "):
            if run:
                h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
                if h % 199 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_near(words):
    """Words one code point apart: they agree with one code point masked, or one without a code point is the other."""
    masked, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masked[w[:i], w[i + 1:]].add(w)
            less = w[:i] + w[i + 1:]
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for same in masked.values():
        for w in same:
            near[w] |= same - {w}
    return near


def brute(words):
    near, form = brute_near(words), {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return out


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    made = queries.op12_spelling(spark, f"/root/testdata/{size}")
    assert dict(made.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    rows = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text").collect()
    expected = brute(brute_counts([tuple(r) for r in rows]))
    assert len(expected) > 50 and got(made) == expected


def test_chains_ties_and_anagrams(spark):
    draw = random.Random(3)
    words = {"alphabet": 10 ** 6, "alphabe": 10 ** 5, "alphab": 20_000, "alphabt": 10 ** 5, "école÷s": 50, "école÷": 10, "ecole÷": 5,
             "listen": 400, "silent": 400, "tinsel": 400, "aaaaaa": 9, "aaaaaaa": 9, "a" * 5000: 5, "a" * 4999 + "b": 30, "tiedaa": 7,
             "tiedab": 35, "tiedac": 35}
    for _ in range(1500):
        words["".join(draw.choice("abc") for _ in range(draw.randrange(6, 9)))] = draw.choice([5, 5, 6, 30, 200, 10 ** 5])
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    expected = brute(words)
    assert expected["tiedaa"][0] == "tiedab" and expected["alphab"][1] == "alphabet"
    assert got(spelling.variants(df)) == expected


def test_every_near_pair_shares_signatures_once(spark):
    """One letter, so all words are one group of near multisets; each pair comes once."""
    words = ["x" * n for n in range(6, 40)] + ["x" * n + "y" for n in range(6, 40)]
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")).collect()
    found = [(p.a, p.b) for p in pairs]
    near = brute_near(dict.fromkeys(words, 5))
    assert sorted(found) == sorted((a, b) for a in words for b in near[a] if a < b)


def test_altered_runs():
    """About one of 199 runs loses the code point that its hash names."""
    changed = 0
    for i in range(2000):
        run, h = f"w{'abcdefgh'[i % 8]}rds{'xyz' * (i % 5)}", zlib.crc32(f"{i}:".encode())
        whole = zlib.crc32(run.encode(), h)
        word = spelling.altered(run, h)
        assert word == (run if whole % 199 else run[:whole % len(run)] + run[whole % len(run) + 1:])
        changed += word != run
    assert 2 <= changed <= 25


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = ("Abc×def, Éa " * 40 + "q" * 900 + "1") * 60
    whole = Counter(spelling.RUN.findall("".join(c.lower() if c.isascii() else c for c in text)))
    big = text * (1 + 1_100_000 // len(text))
    times = 1 + 1_100_000 // len(text)
    assert spelling.runs(big) == Counter({w: n * times for w, n in whole.items()})


def test_odd(make, odd, none):
    rows = [(1, None), (2, ""), (None, "Strange words " * 6), (3, "strange " * 3), (3, "strange " * 3), (4, "strangé " * 5 + "wörds12words×")]
    assert got(spelling.spelling_groups(make(rows))) == brute(brute_counts(rows))
    clash = make(rows).withColumnRenamed("lang", "WORD").withColumnRenamed("source", "n").withColumnRenamed("n_chars", "parts")
    assert got(spelling.spelling_groups(clash)) == brute(brute_counts(rows))
    assert spelling.spelling_groups(odd).count() == 0
    assert spelling.spelling_groups(none).count() == 0


def test_no_join_sends_words_through_the_driver(spark, tmp_path):
    """A table read from small files must not be broadcast once it is spread to 28 rows a word."""
    spark.createDataFrame([(f"word{i:05d}", i + 5) for i in range(300)], "word string, n bigint").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    for made in (spelling.near_pairs(words), spelling.variants(words)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
