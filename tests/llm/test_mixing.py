from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from cases import AWKWARD, awkward, prose

from turnloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, free, rest = {}, set(names), share * sum(sizes.values())
    while over := [s for s in free if rest * w[s] / sum(w[x] for x in free) > cap * sizes[s]]:
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
            free.discard(s)
    total = sum(w[x] for x in free)
    return out | {s: rest * w[s] / total for s in free}


def rows_of(n):
    texts = prose(3, n, 1, 200)
    return [(i, t, [None, "b", "a", "é", "z", "B"][i % 6] if i % 3 else "b") for i, t in enumerate(texts)]


def test_targets_and_copies(spark):
    rows = rows_of(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.allot(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert r["mix_source_size"] == sizes[r["source"]] and r["mix_target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["mix_copies"] <= 2
        taken[r["source"]] += r["mix_copies"] * r["mix_size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.005 * t)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.allot(docs.repartition(3)).collect()), key=str)


def test_longer_documents_are_tilted_alike(spark):
    """Within a source the rate is monotone in size: the exponential tilt."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 50), "a" if i % 2 else "b") for i in range(4000)], "doc_id long, text string, source string")
    mean = defaultdict(list)
    for r in mixing.allot(docs, weights=(1, 3)).collect():
        mean[r["source"], r["mix_size"]].append(r["mix_copies"])
    for s in "ab":
        rates = [sum(v) / len(v) for (t, _), v in sorted(mean.items()) if t == s]
        up = sum(b >= a - 0.05 for a, b in zip(rates, rates[1:], strict=False))
        down = sum(b <= a + 0.05 for a, b in zip(rates, rates[1:], strict=False))
        assert max(up, down) == len(rates) - 1


def test_mix_repeats_rows_as_allotted(spark):
    docs = spark.createDataFrame([(*r, "x") for r in rows_of(300)], "doc_id long, text string, source string, mixed string")
    want = {r["doc_id"]: r["mix_copies"] for r in mixing.allot(docs).collect() if r["mix_copies"]}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == want


def test_mix_takes_of_equal_rows_what_allot_takes(spark):
    rows = [(None, "one two three four five six seven eight", "a", k) for k in range(300)] + [(None, "one two three four five six seven eight", "b", 0)] * 100 + [(k, "w " * (1 + k % 9), "b", 1) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, least int").repartition(5)
    want = Counter()
    for r in mixing.allot(docs).collect():
        want[r["source"], r["doc_id"]] += r["mix_copies"]
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r["source"], r["doc_id"]) for r in got) == +want
    assert 0 < want["a", None] < 600 and max(Counter(r["least"] for r in got if r["source"] == "a").values()) <= 2


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.allot(docs).collect()
    assert len(got) == len(AWKWARD)
    assert all(r["mix_copies"] == 0 for r in got if r["mix_size"] == 0)
    assert mixing.allot(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []
    hot = spark.createDataFrame([(1, "same text here", "a")] * 500 + [(2, "other", "b")] * 100, "doc_id long, text string, source string")
    taken = sum(r["mix_copies"] * r["mix_size"] for r in mixing.allot(hot).collect() if r["source"] == "a")
    assert abs(taken - 2200) <= 3  # b stops at twice its 100 words
    clash = docs.selectExpr("*", "'x' as mix_size", "'y' as mix_copy", "'z' as least", "'w' as d_key")
    assert [r["mix_size"] for r in mixing.allot(clash).orderBy("text", "doc_id").collect()] == [r["mix_size"] for r in mixing.allot(docs).orderBy("text", "doc_id").collect()]
    assert mixing.mix(clash).columns == clash.columns and {r["mix_copy"] for r in mixing.mix(clash).collect()} == {"y"}
    with pytest.raises(ValueError):
        mixing.allot(docs, share=3)


def test_small_sources_come_as_near_as_copies_can(spark):
    rng = random.Random(17)
    sizes = {f"s{k:02}": [rng.randint(1, 3000) for _ in range(1 + k % 12)] for k in range(24)}
    sizes["s99"] = [2065, 453, 372, 261, 243, 189, 150, 142, 141, 46]
    docs = spark.createDataFrame([(1000 * k + j, "w " * n, s) for k, (s, own) in enumerate(sizes.items()) for j, n in enumerate(own)], "doc_id long, text string, source string")
    want, taken = targets({s: sum(own) for s, own in sizes.items()}), Counter()
    for r in mixing.allot(docs).collect():
        assert 0 <= r["mix_copies"] <= 2
        taken[r["source"]] += r["mix_copies"] * r["mix_size"]
    for s, own in sizes.items():
        sums = {0}
        for n in own:
            sums = {x + c * n for x in sums for c in range(3)}
        best = min(abs(x - want[s]) for x in sums)
        assert abs(taken[s] - want[s]) <= best + min(own), (s, taken[s], want[s], best)
