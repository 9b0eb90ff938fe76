from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from cases import awkward, prose

from turnloom.llm import lexical_search, queries
from turnloom.llm.oracle import LEXICAL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in held:
            m = 75 + 25 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, item long, rank string").repartition(5)
    got = lexical_search.search(d, spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    texts = prose(3, 300, 1, 80)
    docs = [(k % 250, t) for k, t in enumerate(texts)] + [(900 + k, texts[7]) for k in range(30)] + [(None, texts[8]), (None, texts[8])]
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice(texts).split()[: rng.randint(1, 20)] + ["unknownword"] * (k % 3))) for k in range(25)] + [(50, texts[7]), (51, None), (52, ""), (53, "nothing_there..."), (50, texts[7]), (50, texts[9])]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    for name, value in (("BLOCK_DOCUMENTS", 3), ("SORTED_DOCUMENTS", 10), ("BATCH_ITEMS", 4), ("FIRST_BLOCKS", 1), ("BLOCK_ROWS", 2), ("GATHERED", 10), ("PIECE", 7)):
        monkeypatch.setattr(lexical_search, name, value)
    assert found(spark, docs, items) == want
    monkeypatch.setattr(lexical_search, "EXACT", 1)  # sums as integers
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_bounds_hold_and_prune(monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCUMENTS", 16)
    rng = np.random.default_rng(4)
    words = [f"t{k}" for k in range(400)]
    held = []
    for k in range(640):
        topic = k % 10
        c = Counter(rng.choice(words[topic * 40 : topic * 40 + 40], size=30).tolist())
        held.append((c.most_common(1)[0][0], c.total(), k, c))
    blocks = lexical_search._cut(held, 0)
    n, total = 640, sum(h[1] for h in held)
    with_tops = next(lexical_search._with_maxima(n, total)(iter([blocks])))
    entries = pa.table({"item": [1, 1, 2], "term": ["t1", "t2", "t390"], "weight": [500, 700, 300]})
    asked = lexical_search.Batch(lexical_search.batch_state(entries))
    known = asked.known(with_tops)
    bounds = asked.bounds(with_tops, known)
    for b, postings in enumerate(lexical_search._impacts_of(with_tops, n, total)):
        scores = asked.scores(known[b], postings, len(with_tops["doc_ids"][b]), np.arange(2))
        assert (scores.max(axis=0) <= bounds[b]).all()
    assert (bounds == 0).sum() > bounds.size / 2  # documents of one topic lie side by side


def test_awkward_rows(spark):
    df = awkward(spark)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    items = [(1, "hello world"), (2, "WORD ÜNÏ 42 é"), (3, "id here")]
    assert found(spark, docs, items) == brute(docs, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(df.limit(0), bench).collect() == [] and lexical_search.search(df, bench.limit(0)).collect() == []


def test_query_equals_its_statement(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = sorted(con.execute(f"select item_id, rank, doc_id, score from ({LEXICAL})").fetchall())
    assert sorted(map(tuple, queries.op12_lexical(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect())) == got and got


def test_no_reader_holds_all_blocks_of_a_file(spark, monkeypatch):
    """A block can have 32,768 postings, so tasks read a few blocks at a time, however many a file has."""
    seen, write = {}, lexical_search.materialise
    key = "spark.sql.parquet.columnarReaderBatchSize"

    def noted(df, tag, *rest):
        seen[tag] = (int(spark.conf.get(key)), rest)
        return write(df, tag, *rest)

    monkeypatch.setattr(lexical_search, "materialise", noted)
    before = spark.conf.get(key)
    docs = spark.createDataFrame(list(enumerate(prose(5, 300))), "doc_id long, text string")
    assert lexical_search.search(docs, spark.createDataFrame([("i", "the an ti")], "item_id string, text string")).count()
    for tag in ("search-index", "search-entries", "search-first", "search-found"):
        assert seen[tag][0] <= lexical_search.BLOCK_ROWS
    assert seen["search-index"][1] == seen["search-forward"][1] == (lexical_search.GROUP_BYTES,)
    assert spark.conf.get(key) == before
