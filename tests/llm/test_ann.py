from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from turnloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def exact(ids, x, q, k):
    d = np.sqrt(np.square(x - x[ids == q][0]).sum(axis=1))
    d[ids == q] = np.inf
    return [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d))[:k] if np.isfinite(d[i])]


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[1000:1400] = x[1000]  # a group of copies
    ids = np.arange(3000)
    rows = [(int(i), v.tolist(), "s") for i, v in zip(ids, x, strict=True)]
    got = {}
    for block in (2048, 7):
        found = ann.search(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") % 100 == 0, 10, query_block=block, list_rows=300, rows=block).collect()
        got[block] = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)
    assert got[2048] == got[7]
    hits = 0
    for q in range(0, 3000, 100):
        want = exact(ids, x.astype(float), q, 10)
        mine = [(r[2], r[3]) for r in got[7] if r[0] == q]
        assert [r[1] for r in got[7] if r[0] == q] == list(range(1, 11))
        hits += len({v for v, _ in want} & {v for v, _ in mine})
        assert all(abs(s - np.sqrt(np.square(x[v].astype(float) - x[q].astype(float)).sum())) < 1e-12 for v, s in mine)
    assert hits == 300
    assert [r[2] for r in got[7] if r[0] == 1000] == list(range(1001, 1011))  # ties to the smaller id


def test_parallel_error_costs_more():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 16))
    books = ann.learn(x)
    codes = ann.encode(x, books, 2)
    plain = ann.encode(x, books, 0)

    def errors(c):
        r = x - np.concatenate([books[k][c[:, k]] for k in range(8)], axis=1)
        along = (r * x).sum(axis=1) / np.linalg.norm(x, axis=1)
        return np.square(along).mean(), np.square(r).sum(axis=1).mean()

    assert errors(codes)[0] < errors(plain)[0] and errors(codes)[1] >= errors(plain)[1]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.9, 0.1]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 0.1]), (7, [1.0, 0.1]), (None, [1.0, 1.0]), (200, [0.0, 0.0])]
    docs = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA + ", list int")
    got = ann.search(docs, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 7), (0, 2, 100), (100, 1, 7), (100, 2, 0)]
    assert ann.search(docs.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_near_copies_and_repeated_ids_leave_no_neighbour_out(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x[:1000] = x[0] + 0.02 * rng.normal(size=(1000, 64))  # a third are near copies
    x[1000:1300] = x[2900] + 0.01 * rng.normal(size=(300, 64))
    ids = np.arange(3000)
    ids[1000:1300] = 1000  # one id on many rows that are nearest to 2900
    x = x.astype(np.float32)
    rows = [(int(i), v.tolist(), "s") for i, v in zip(ids, x, strict=True)]
    found = ann.search(spark.createDataFrame(rows, SCHEMA).coalesce(1), F.col("vec_id").isin(0, 100, 500, 900, 2900, 2000)).collect()
    for q in (0, 100, 500, 900, 2900, 2000):
        want = []
        for v, _ in exact(ids, x.astype(float), q, 3000):
            if v not in want:
                want.append(v)
        assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == want[:10]


def test_lists_without_a_possible_neighbour_are_left_out(spark):
    rng = np.random.default_rng(6)
    centre = 20 * rng.normal(size=(12, 16))
    x = (centre[np.arange(2400) % 12] + rng.normal(size=(2400, 16))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), "s") for i, v in enumerate(x)], SCHEMA)
    index, model = ann.build_index(table, list_rows=200)
    spread = {r["list"]: (r["n"], r["low"], r["high"]) for r in index.groupBy("list").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()}
    queries = index.where("vec_id % 100 = 0").select("vec_id", "embedding", F.lit(8.0).cast("double").alias("limit"))
    routed = queries.mapInArrow(ann._route(model, spread, 1, True), "vec_id long, embedding array<float>, limit double, list int")
    assert len(spread) > 6 and routed.count() < 24 * (len(spread) - 1) / 3
    found = ann.search(table, F.col("vec_id") % 100 == 0, list_rows=200).collect()
    few = ann.search(table, F.col("vec_id") % 100 == 0, list_rows=200, probes=1).collect()
    met = 0
    for q in range(0, 2400, 100):
        want = [v for v, _ in exact(np.arange(2400), x.astype(float), q, 10)]
        assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == want
        met += len(set(want) & {r["vec_id"] for r in few if r["query_id"] == q})
    assert met >= 0.9 * 240  # what one list of each query has


def test_components_of_any_size(spark):
    rng = np.random.default_rng(7)
    plain = rng.normal(size=(300, 16))
    for scale in (1e25, 1e-25, 1e160, 1e-200):
        x = plain * scale
        x[:150] *= 1e-3  # and rows of very unlike sizes
        found = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, list_rows=100).collect()
        for q in (0, 100, 200):
            d = scale * np.sqrt(np.square((x - x[q]) / scale).sum(axis=1))
            d[q] = np.inf
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
            assert [v for _, v, _ in mine] == np.argsort(d, kind="stable")[:10].tolist()
            assert np.allclose([s for _, _, s in mine], np.sort(d)[:10], rtol=1e-12)
    huge = [(i, [1.7e308 * s, float(i), 1.0]) for i, s in enumerate([1.0] * 6 + [-1.0] * 6)]
    found = ann.search(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == list(range(1, 11)) and found[-1]["score"] == float("inf")
