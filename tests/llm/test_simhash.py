from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from cases import AWKWARD, awkward, prose

from turnloom.llm import components, simhash
from turnloom.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def classes(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_equals_brute_force(spark):
    texts = prose(2, 30) + [a[1] for a in AWKWARD]
    rng = random.Random(1)
    for t in texts[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["fp"] for i, r in got.items()} == {i: signed(f) for i, f in fps.items()}
    edges = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 4]
    assert {i: r["component_id"] for i, r in got.items()} == classes(edges, fps)


def test_links_of_hot_keys_join_what_brute_force_joins(spark, monkeypatch):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 300:  # one cluster whose keys are hot, and strangers
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    fps |= {rng.getrandbits(64) for _ in range(200)}
    rows = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for t, hot_key, block, bucket in ((4, 32, 512, 8), (4, 3, 16, 8), (6, 100_000, 512, 8), (3, 32, 512, 1e-9), (6, 3, 16, 8)):
        monkeypatch.setattr(simhash, "_chain_length", lambda n, s, b=bucket: 3 if b < 1 else 2)
        links = simhash.fingerprint_links(rows, t, hot_key, block).collect()
        u = np.array(sorted(fps), dtype=np.uint64)
        near = np.bitwise_count(u[:, None] ^ u[None, :]) <= t
        want = [(signed(int(u[i])), signed(int(u[j]))) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
        nodes = [signed(f) for f in fps]
        assert classes([(r["a"], r["b"]) for r in links], nodes) == classes(want, nodes)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    assert {r["node"]: r["label"] for r in rows} == {n: c for n, c in classes(edges, nodes).items()}
    assert len(rows) == len(nodes)
    salted = connected_components(spark.createDataFrame(edges, "a long, b long"), broadcast_edges=0).collect()
    assert sorted(map(tuple, salted)) == sorted(map(tuple, rows))
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 6]  # 1, 2 and 4 have no words
    assert simhash.drop_near_duplicates(docs.limit(0)).collect() == []


def test_keys_are_spread(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(signed(rng.getrandbits(64)),) for _ in range(300)], "fp long")
    segments = simhash._segments(4)
    keys = simhash._keyed(rows, "y", segments, 2, 4, False)
    assert keys.count() == 1500 and keys.select("key").distinct().count() > 1490
    assert simhash._keyed(rows, "x", segments, 2, 4, True).count() == 300 * (4 * 14 + 13)


def test_chains_grow_with_the_input():
    segments = simhash._segments(4)
    assert [simhash._chain_length(n, segments) for n in (0, 10**6, 10**10, 10**13)] == [2, 2, 3, 4]
    assert sorted(simhash._changes([2, 2], 4, 5)) == [0, 1, 2] and simhash._changes([3], 4, 5) == [0]


def test_wider_links_are_verified(spark, monkeypatch):
    import corpus_pipeline

    rng, texts = random.Random(31), prose(32, 60, 90, 110)
    for t in texts[:60]:
        for changes in (2, 2, 4, 6):  # 2 leave a Jaccard similarity of about 0.8
            w = t.split()
            for k in rng.sample(range(5, len(w) - 5), changes):
                w[k] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    fps = [fingerprint(t, 5) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.translate(LOWER).split() for t in texts)]
    near = [(i, j, (fps[i] ^ fps[j]).bit_count(), len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(len(texts)) for j in range(i)]
    edges = [(i, j) for i, j, d, s in near if d <= 6 or (d <= 12 and s >= 0.8)]
    assert sum(6 < d <= 12 and s >= 0.8 for _, _, d, s in near) > 30 and sum(6 < d <= 12 and s < 0.8 for _, _, d, s in near) > 30
    want = {k for k, c in classes(edges, range(len(texts))).items() if k == c}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot_key, block in ((32, 512), (1, 8)):
        monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (4, hot_key, block))
        assert {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()} == want


def test_a_pair_beside_a_failed_edge_is_verified(spark, monkeypatch):
    """0 is seven bits from a and eight from b, which link surely: where (0, a) fails, (0, b) is still asked."""
    import pyarrow as pa

    a, b = 0b1111111, 0b11111111
    probe, index = [0, a], [0, a, b]
    n = len(probe) + len(index)
    batch = pa.table({"fp": probe + index, "proof_1": [0] * n, "proof_2": [0] * n, "start": [0] * n, "probe": [True] * len(probe) + [False] * len(index)})
    rows = simhash._block_links(simhash._segments(12), 12, ["proof_1", "proof_2"])(batch).to_pylist()
    asked = {(frozenset((r["a"], r["b"])), r["later"]) for r in rows if r["a_proof"] is not None}
    assert asked == {(frozenset((0, a)), False), (frozenset((0, b)), True)}

    texts = [f"t{k}" for k in range(3)]  # of these fingerprints only the second pair is similar
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    per_doc = spark.createDataFrame([(k, fp, 0, 0) for k, fp in enumerate((0, a, b))], "doc_id long, fp long, proof_1 long, proof_2 long")
    per_doc = per_doc.join(docs.selectExpr("doc_id", "xxhash64(text) as text_hash"), "doc_id").select("doc_id", "text_hash", "fp", "proof_1", "proof_2")
    shingles = {"t0": [1, 2, 3, 4, 5], "t1": [9], "t2": [1, 2, 3, 4, 5]}
    sets = spark.createDataFrame(list(shingles.items()), "text string, hashes array<long>").selectExpr("xxhash64(text) as text_hash", "hashes")
    monkeypatch.setattr(simhash, "fingerprints", lambda *args: per_doc)
    monkeypatch.setattr(simhash, "with_shingles", lambda texts, words: texts.selectExpr("doc_id", "xxhash64(text) as text_hash").join(sets, "text_hash"))
    monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (4, 1, 512))
    assert {r["component_id"] for r in simhash.near_duplicates(docs, 5, 12).collect()} == {0}


def test_pairs_beside_failed_edges_are_no_rows(spark):
    """A bucket of one family in which nothing links surely: rows grow with its fingerprints, not with its pairs."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({signed(base ^ sum(1 << b for b in rng.sample(range(64), 6))) for _ in range(200)})
    n = len(fps)
    import pyarrow as pa

    batch = pa.table({"fp": fps + fps, "proof_1": [0] * 2 * n, "proof_2": [0] * 2 * n, "start": [0] * 2 * n, "probe": [True] * n + [False] * n})
    rows = simhash._block_links(simhash._segments(12), 12, ["proof_1", "proof_2"])(batch).to_pylist()
    assert any(r["later"] for r in rows) and len(rows) < 2 * n
    near = [(x, y) for x in fps for y in fps if x < y and bin((x ^ y) & (2**64 - 1)).count("1") <= 12]
    assert len(near) > 10 * n and classes([(r["a"], r["b"]) for r in rows], fps) == classes(near, fps)


def test_pairs_that_count_at_one_start_still_join_all(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = sorted({signed(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(2, 6)))) for _ in range(60)})
    rows = spark.createDataFrame([(f, 0, 0) for f in fps], "fp long, proof_1 long, proof_2 long")
    near = [(x, y) for x in fps for y in fps if x < y and bin((x ^ y) & (2**64 - 1)).count("1") <= 12]
    for hot_key in (1, 8):
        links = simhash.fingerprint_links(rows, 12, hot_key, 16)
        assert classes([(r["a"], r["b"]) for r in links.collect()], fps) == classes(near, fps)


def test_families_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base, texts = rng.getrandbits(64), [f"t{k}" for k in range(60)]
    fps = [signed(base ^ sum(1 << b for b in rng.sample(range(64), 6))) for _ in texts]
    shingles = {t: [k % 8 * 100 + x for x in rng.sample(range(12), rng.randint(9, 11))] for k, t in enumerate(texts)}
    shingles["t3"] = []
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    per_doc = spark.createDataFrame([(k, fp, 0, 0) for k, fp in enumerate(fps)], "doc_id long, fp long, proof_1 long, proof_2 long")
    per_doc = per_doc.join(docs.selectExpr("doc_id", "xxhash64(text) as text_hash"), "doc_id").select("doc_id", "text_hash", "fp", "proof_1", "proof_2")
    sets = spark.createDataFrame(list(shingles.items()), "text string, hashes array<long>").selectExpr("xxhash64(text) as text_hash", "hashes")
    monkeypatch.setattr(simhash, "fingerprints", lambda *args: per_doc)
    monkeypatch.setattr(simhash, "with_shingles", lambda texts, words: texts.selectExpr("doc_id", "xxhash64(text) as text_hash").join(sets, "text_hash"))
    monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (4, 1, 16))
    monkeypatch.setattr(simhash, "FAMILY_BLOCK", 400)
    assert len(set(fps)) == 60
    edges = []
    for i in range(60):
        for j in range(i):
            d, x, y = ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count(), set(shingles[texts[i]]), set(shingles[texts[j]])
            if d <= 6 or (d <= 12 and len(x & y) >= 0.8 * len(x | y) and x | y):
                edges.append((i, j))
    want = classes(edges, range(60))
    assert 3 < len(set(want.values())) < 57
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 5, 12).collect()} == want


def test_later_links_walk_no_component_again(spark, monkeypatch):
    """A chain of eight that links surely, and texts beside it that link or don't: the star steps see the chain once."""
    chain = [(1 << 6 * k) - 1 for k in range(8)]
    fps = chain + [signed(chain[0] ^ 0xFF << 50), signed(chain[0] ^ 0x1FF << 50)]
    texts = [f"t{k}" for k in range(len(fps))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    per_doc = spark.createDataFrame([(k, fp, 0, 0) for k, fp in enumerate(fps)], "doc_id long, fp long, proof_1 long, proof_2 long")
    per_doc = per_doc.join(docs.selectExpr("doc_id", "xxhash64(text) as text_hash"), "doc_id").select("doc_id", "text_hash", "fp", "proof_1", "proof_2")
    sets = spark.createDataFrame([(t, [1, 2, 3, 4, 5] if k in (0, 9) else [10 * k]) for k, t in enumerate(texts)], "text string, hashes array<long>").selectExpr("xxhash64(text) as text_hash", "hashes")
    monkeypatch.setattr(simhash, "fingerprints", lambda *args: per_doc)
    monkeypatch.setattr(simhash, "with_shingles", lambda texts, words: texts.selectExpr("doc_id", "xxhash64(text) as text_hash").join(sets, "text_hash"))
    links = [(a, b, None, None, False) for a, b in zip(chain, chain[1:], strict=False)]
    links += [(fps[0], fps[8], 0, 0, False), (fps[0], fps[9], 0, 0, True), (fps[1], fps[8], 0, 0, True), (fps[8], fps[9], None, None, False)]
    links = spark.createDataFrame(links, "a long, b long, a_proof long, b_proof long, later boolean")
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *args: links)
    walked = []
    for module in (simhash, components):
        monkeypatch.setattr(module, "connected_components", lambda edges, walk=connected_components: walked.append(edges.count()) or walk(edges))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 5, 12).collect()}
    assert got == dict.fromkeys(range(10), 0)
    assert walked == [8, 1, 1]


def test_components_extend_by_edges_between_them(spark):
    rng = random.Random(12)
    first = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    more = [(rng.randrange(80), rng.randrange(80)) for _ in range(25)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    labels = connected_components(frame(first))
    got = {r["node"]: r["label"] for r in components.extended(labels, frame(more)).collect()}
    want = classes(first + more, range(80))
    assert len(set(want.values())) < 60 and {n: got.get(n, n) for n in range(80)} == want
    apart = [components.contracted(frame(more), labels, few).collect() for few in (0, 1000)]
    assert {*apart[0]} == {*apart[1]} and all(r["a"] != r["b"] for r in apart[0])
