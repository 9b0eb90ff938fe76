"""Suffix-array deduplication against a brute-force count of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from turnloom.llm import suffix_dedup
from turnloom.llm.suffix_dedup import blind_trie_order, common_prefix, deep_shallow_order, repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long_passage = prose(12), prose(30)
    texts = [None, "", "x", "ab" * 200, "ab" * 90 + prose(10), "zz" * 300]
    for _ in range(25):
        texts.append(prose(rng.randint(5, 40)) + rng.choice(["", shared, long_passage, long_passage[7:]]) + prose(rng.randint(0, 30)))
    base = prose(60)
    texts += [base, base, base + "tail", base[:100] + "!" + base[100:]]
    texts += [base[:90] + w + base[90:] for w in ("q", "qq", "r")]
    return texts


@pytest.mark.parametrize("group", [10_000, 2])
def test_equals_brute_force(spark, group):
    texts = corpus(5)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(docs, 40, 12, group).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    """The query's own length and gram: what decides is bytes, not words, and texts without a repeat lose nothing."""
    rng = random.Random(8)
    word = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    prose = lambda n, letters="abcdefgh", low=2, high=9: " ".join(word(letters, low, high) for _ in range(n))
    planted = [" ".join(word("abcdefgh", w, w) for _ in range(n)) for n, w in ((51, 5), (57, 6), (58, 6), (66, 5), (67, 5), (120, 4))]
    planted += [prose(51, "éß語", 3, 3), " ".join(["é"] * 60), prose(60, "x", 6, 6)[:399], prose(60, "y", 6, 6)[:400]]
    texts = [prose(40) + before + p + after + prose(30) for p in planted for before, after in ("14", "25", "36")]
    clean = [prose(n) for n in (1, 51, 60, 200, 900)]
    docs = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(docs, keep_bytes=False).collect()}
    assert [got[i] for i in range(len(got))] == brute(texts + clean, 400)
    size = [len(p.encode()) for p in planted for _ in range(3)]
    assert all(len(p.split()) > 50 for p in planted) and {399, 400} <= set(size)
    assert [got[i][1] > 0 for i in range(len(texts))] == [s >= 400 for s in size]
    assert all(got[i][1] == 0 for i in range(len(texts), len(got)))


def test_kept_bytes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a" * 50), (2, "b" * 3)], "doc_id long, text string")
    rows = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.deduplicate(docs, 20, 8).collect()}
    assert rows == {1: b"", 2: b"bbb"}
    assert suffix_dedup.deduplicate(docs.where("doc_id > 5"), 20, 8).collect() == []


def test_orders_equal_sorting():
    rng = random.Random(3)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 40))]
        strings += strings[:3]
        for order in (deep_shallow_order(strings, 0, 8), blind_trie_order(strings, list(range(len(strings))))):
            assert [strings[i] for i in order] == sorted(strings)
            assert sorted(order) == list(range(len(strings)))


def test_repeats_equals_all_pairs():
    rng = random.Random(4)
    for _ in range(60):
        rights = ["g" * 4 + "".join(rng.choice("ab") for _ in range(rng.randint(3, 16))) for _ in range(rng.randint(2, 9))]
        lefts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 10))) for _ in rights]
        both = list({(a.encode(), b.encode()) for a, b in zip(lefts, rights, strict=True)})
        if len(both) < 2:
            continue
        lefts, rights = [a for a, _ in both], [b for _, b in both]
        want = []
        for i in range(len(both)):
            met = [(common_prefix(lefts[i], lefts[j]), common_prefix(rights[i], rights[j])) for j in range(len(both)) if j != i]
            met = [m for m in met if sum(m) >= 14]
            want.append((max(m[0] for m in met), max(m[1] for m in met)) if met else (-1, -1))
        assert repeats(lefts, rights, 14, 4) == want
