from __future__ import annotations

import random
import re

import duckdb
import numpy as np
from cases import AWKWARD, awkward, prose

from turnloom.llm import minhash, queries
from turnloom.llm.oracle import MINHASH

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} or ({" ".join(w)} if w else set())


def brute(docs, words=4):
    sets = [shingles(t, words) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, _) in enumerate(docs):
        ids = [x for x in (least.get(find(k)), i) if x is not None]
        least[find(k)] = min(ids) if ids else None
    return sorted(((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(docs)), key=str)


def found(df, words=4):
    got = minhash.near_duplicates(df, words)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=str)


def varied(text, changes, rng):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = prose(2, 30, 40, 120)
    for t in texts[:20]:
        texts += [varied(t, k, rng) for k in range(0, 8)]
    chain = texts[25]
    for _ in range(12):  # each links with the next only
        chain = varied(chain, 2, rng)
        texts.append(chain)
    docs = [(1000 - k, t) for k, t in enumerate(texts)] + [(a[0], a[1]) for a in AWKWARD]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, node int, key string").repartition(6)
    want = brute(docs)
    assert found(df) == want
    assert len({r[2] for r in want}) < len(want) - 50
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)  # all links by families
    assert found(df) == want
    for name, value in (("CHUNK", 3), ("HOT_KEY", 2), ("BLOCK_SHINGLES", 300)):
        monkeypatch.setattr(minhash, name, value)
    assert found(df) == want
    assert found(df, 2) == brute(docs, 2)


def test_bins_fill_and_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 300, 20_000):
        own = rng.integers(0, 2**63, size=n, dtype=np.uint64)
        bins = minhash.sketch(own)
        assert len(bins) == minhash.COORDINATES and bins.max() < np.iinfo(np.uint64).max
        assert (minhash.sketch(own[::-1].copy()) == bins).all() and minhash.set_hash(own) == minhash.set_hash(own[::-1].copy())
    for n in (3, 40, 2000):
        shares = []
        for _ in range(60):
            both = rng.integers(0, 2**63, size=n, dtype=np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, size=max(1, n // 8), dtype=np.uint64)]) for _ in range(2))
            shares.append((minhash.sketch(a) == minhash.sketch(b)).mean() - n / (n + 2 * max(1, n // 8)))
        assert abs(np.mean(shares)) < 0.02 and np.std(shares) < 1.3 * (0.25 / minhash.COORDINATES) ** 0.5


def test_sets_have_hashes_of_their_own():
    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 2**63, size=n, dtype=np.uint64) for n in (1, 1, 1, 2, 2, 3, 3)]
    assert len({minhash.set_hash(s) for s in sets}) == len(sets)


def test_keys_and_bits_leave_pairs_at_the_limit():
    rng = np.random.default_rng(8)
    for n in (1, 10, 400):
        for _ in range(100):
            both = rng.integers(0, 2**63, size=8 * n, dtype=np.uint64)
            a, b = (minhash.sketch(np.concatenate([both, rng.integers(0, 2**63, size=n, dtype=np.uint64)])) for _ in range(2))
            assert (minhash.keys_of(a) == minhash.keys_of(b)).any()
            assert ((a & np.uint64(1)) != (b & np.uint64(1))).sum() <= minhash.FAR


def test_a_failed_star_does_not_part_true_links(spark):
    """The smallest node of a key may be unlike two sets that are alike."""
    rng = random.Random(9)
    base = " ".join(f"w{k}" for k in range(200))
    family = [varied(base, k, rng) for k in (0, 9, 9, 9, 9, 9, 9)]
    docs = [(k, varied(f, j, rng)) for k, (f, j) in enumerate((f, j) for f in family for j in (0, 1, 2, 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df) == brute(docs)


def test_awkward_rows(spark):
    df = awkward(spark)
    assert found(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert found(df.limit(0)) == []
    assert found(df.where("text is null")) == [(1, 0, 1, True)]


def test_query_equals_its_statement(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = sorted(con.execute(f"select doc_id, n_shingles, component_id, kept from ({MINHASH})").fetchall(), key=str)
    assert found_query(spark, sf_dir) == got and any(not r[3] for r in got)


def found_query(spark, sf_dir):
    return sorted(map(tuple, queries.op11_minhash(spark, sf_dir).collect()), key=str)
