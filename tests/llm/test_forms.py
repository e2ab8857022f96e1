"""Fingerprints, packing, chat, URL filter and mixing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from loanlens.llm import chat, edit_fingerprint, mixing, packing, queries, url_filter
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .conftest import ODD

SMALL = "/root/testdata/sf0.001"


# --- edit fingerprints


def plain_walk(text):
    stays = edit_fingerprint._stays()
    steps, at = [], 0
    for c in edit_fingerprint.classes(text).tolist():
        steps.append(at)
        at += int(stays[c][at % edit_fingerprint.PERIOD])
    return [*steps, at]


def test_walk_in_groups_is_the_plain_walk():
    random.seed(2)
    texts = ["".join(random.choices("abc \u00e9\U0001f600", k=random.randrange(120))) for _ in range(90)] + ["x" * 5000]
    coded = [edit_fingerprint.classes(t) for t in texts]
    for found, text in zip(edit_fingerprint.walk_all(coded, np.zeros(len(coded), np.int64)), texts):
        assert found.tolist() == plain_walk(text)


def test_edits_stay_near():
    random.seed(4)
    text = "".join(random.choices("abcdefghijklmnopqrstuvwxyz ", k=3000))
    marks = [bytes.fromhex(edit_fingerprint.fingerprint(t)) for t in (text, text[:1000] + "zz" + text[1003:], text[::-1])]
    assert edit_fingerprint.likeness(marks[0], marks[0]) == 1.0
    assert edit_fingerprint.likeness(marks[0], marks[1]) > 0.9 > 0.3 > edit_fingerprint.likeness(marks[0], marks[2])


def test_followers(spark, odd):
    rows = {(r.doc_id, r.n_chars): r for r in edit_fingerprint.with_followers(odd).collect()}
    assert edit_fingerprint.with_followers(odd).count() == len(ODD)
    order = sorted(ODD, key=lambda r: -math.inf if r[0] is None else r[0], reverse=True)
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        row = rows[doc_id, len(text)]
        assert row.fingerprint == edit_fingerprint.fingerprint(text)
        if doc_id not in (5, 6):  # the repeated id is its own follower once
            assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert row.edited_fingerprint == edit_fingerprint.fingerprint(edited)
            assert row.near_edited == edit_fingerprint.likeness(bytes.fromhex(row.fingerprint), bytes.fromhex(row.edited_fingerprint))
        assert row.near_edited >= 0.8 or not row.edited_linked
        assert row.near_next >= 0.8 or not row.next_linked


def test_one_and_no_row(make, none):
    assert edit_fingerprint.with_followers(none).count() == 0
    row = edit_fingerprint.with_followers(make([(3, "abcd")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
    assert row.next_linked
    random.seed(9)
    text = "".join(random.choices("abcdefgh ", k=2000))
    rows = {r.doc_id: r for r in edit_fingerprint.with_followers(make([(3, text), (2, text[:900] + "Q" + text[901:]), (1, text[::-1])])).collect()}
    assert rows[3].next_linked and not rows[2].next_linked


def test_pairs(make):
    random.seed(6)
    base = ["".join(random.choices("abcdefgh ", k=800)) for _ in range(12)]
    near = [t[:400] + "Q" + t[402:] for t in base]
    texts = base + near
    marks = [bytes.fromhex(edit_fingerprint.fingerprint(t)) for t in texts]
    like = {(a, b): edit_fingerprint.likeness(marks[a], marks[b]) for a in range(24) for b in range(a + 1, 24)}
    want = {p for p, v in like.items() if v >= 0.8}
    found = {(r.a, r.b): r.likeness for r in edit_fingerprint.edit_pairs(make([*enumerate(texts), (99, base[0])])).collect()}
    assert all(v == like[p] and p in want for p, v in found.items())
    assert len(found) >= 0.9 * len(want) >= 9  # bands are sampled; nearly all close pairs meet


# --- packing


def test_packing(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for table, rows in ((docs, [tuple(r) for r in docs.collect()]), (odd.select("doc_id", "text"), ODD)):
        pieces = packing.pack(table, path).collect()
        sequences, texts = defaultdict(list), defaultdict(list)
        for p in pieces:
            ids = np.frombuffer(p.ids, "<u4")
            assert len(ids) == p.length
            sequences[p.sequence_id].append((p.offset, p.length))
            texts[p.doc_id].append((p.start, ids, p.doc_tokens))
        padding = 0
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
            padding += 4096 - at if at & at - 1 else 0
        total = sum(p.length for p in pieces)
        assert padding <= 0.02 * total
        once = Counter(r[0] for r in rows)
        for doc_id, text in rows:
            if once[doc_id] == 1:
                parts = sorted(texts[doc_id], key=lambda p: p[0])
                ids = np.concatenate([p[1] for p in parts])
                assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2]
                assert {p[2] for p in parts} == {len(ids)}


def test_special_strings_and_contractions(make):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["it's <|endoftext|> x<|startoftext|>y", "e\u0301 \u212b\u2003z", "don't  they're\r\nI'll\x85we\x1cwe"]
    for row in packing.pack(make(list(enumerate(texts)), 1), path).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("p")).collect():
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in row.p]).tolist()
        assert ids == plain.encode(texts[row.doc_id], add_special_tokens=False).ids + [2]


def test_classes_have_fixed_counts():
    packer = packing.HarmonicPacker(64, 4)
    made = [s for i in range(60) for s in packer.add(i, np.zeros(20, np.uint32))]
    assert all(len(s) == 3 for s in made) and len(made) == 20 and not list(packer.finish())


# --- chat


@pytest.mark.parametrize("text", ["", "<|im_end|>", "a<", "<\\|x", "<\\\\|<|<|", "|<|im_start|>system\nhi", "\\n"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text + "\n")) == text + "\n"
    segment, start, end, _ = chat.format_turn("assistant", [{"type": "text", "text": text}])
    assert chat.parse_turn(segment) == ("assistant", text) and chat.unescape(segment[start:end]) == text


def test_parts():
    flat = chat.flatten([{"text": "see <|image|>"}, {"type": "image", "ref": "a.png", "width": 600, "height": 500},
                         {"type": "audio", "ref": "b", "seconds": 2}, {"type": "document", "ref": "c", "pages": 3}, {"text": None}])
    assert flat.text == "see <\\|image|><|image|><|audio|><|document|>"
    assert [(a["place"], a["kind"], a["ref"], a["tokens"]) for a in flat.attachments] == [
        (0, "image", "a.png", 512), (1, "audio", "b", 50), (2, "document", "c", 1536)]
    assert flat.extra_tokens == 2098
    with pytest.raises(ValueError):
        chat.flatten([{"type": "video"}])


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "assistant", "q"), (2, 0, "user", "w"), (2, 0, "user", "w")]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segment", F.lit(1))
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(messages)).collect()}
    assert out[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb<|im_end|>\n").hexdigest()
    assert (out[1].loss_chars, out[1].loss_sha256) == (11, hashlib.sha256(b"b<|im_end|>").hexdigest())
    assert (out[2].n_turns, out[None].n_turns) == (3, 1)
    assert chat.read_back(chat.format_conversations(messages.where("false"))).count() == 0


# --- URL filter


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "http://a.ORG/x?y", "https://sub.Example.org/es/1#z", "http://example.org/en/12", "http://org", "http://notexample.org/es/",
            "ftp://x.com/fr/://a", "http://x.com/de/", "http://com/fr/", "a://b?c://d", "http://x.com?/fr/", "http://cheap-pills.example.net/en/1\n2", "HTTP://\u00c9.com/de/\u00e9"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    model = url_filter.fit_urls(url_filter.labelled_urls(spark))
    for row in url_filter.judge_urls(pages, model).collect():
        host, path = plain_url(urls[row.page_id])
        assert (row.host, row.path) == (host, path)
        fit = [(h + p, says) for h, p, says in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[0]), default=(None, None))
        assert row.rule == best[0] and row.verdict == (best[1] or ("block" if row.block_score >= 0.5 else "allow"))
    labelled = url_filter.labelled_urls(spark)
    judged = url_filter.judge_urls(labelled, model, keep=("label",), rules=()).collect()
    assert all((r.verdict == "block") == bool(r.label) for r in judged)
    fresh = spark.createDataFrame([("http://cheap-pills.example.org/en/77",), ("http://spam-farm.example.com/en/3",)], "url string")
    assert [r.verdict for r in url_filter.judge_urls(fresh, model, keep=(), rules=()).collect()] == ["block", "block"]
    assert url_filter.fit_urls(labelled.where("label = 1")).intercept > 0


# --- mixing


def plain_targets(sizes, share=1.5, weights=(5, 2, 1), cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > cap * sizes[s]}
        if not full:
            return target | {s: weight[s] * unit for s in free}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mixing(make):
    random.seed(8)
    rows = [(i, " ".join(["w"] * int(random.paretovariate(1.1) * 20)), random.choice(["b", "a", None, "\u00e9", "zz", "Z"] + ["hot"] * 8)) for i in range(1500)]
    rows += [(9000, None, "blank"), (9001, "", "blank"), (9002, "x", "tiny")]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = plain_targets(sizes)
    out = mixing.mix(make(rows)).collect()
    taken = Counter()
    for r in out:
        assert r.target == pytest.approx(want[r.source], rel=1e-6, abs=1e-6) and r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(r.size for r in out if r.source == source)
    again = {r.doc_id: r.taken for r in mixing.mix(make(rows, 5)).collect()}
    assert again == {r.doc_id: r.taken for r in out}
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(make(rows)).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in out if r.copies})


def test_mixing_odd(odd, none):
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


# --- checking SQL


def test_crc_of_ids(spark):
    from loanlens.llm.common import fold
    assert [r.f for r in spark.range(50).select(fold("id", 7).alias("f")).collect()] == [zlib.crc32(str(i).encode()) % 7 for i in range(50)]
    assert set(queries.CHECKS) <= set(queries.QUERIES)


def test_url_without_host_is_scored_by_its_path(spark):
    from loanlens.llm import url_filter

    model = url_filter.UrlModel([1.0] * url_filter.DIMENSIONS, 0.0)
    rows = spark.createDataFrame([(1, "file:///casino-bonus/win"), (2, None), (3, "x")], "page_id bigint, url string")
    scores = {r.page_id: r.block_score for r in url_filter.judge_urls(rows, model).collect()}
    assert scores[1] > 0.9 and scores[2] == scores[3] == 0.5
