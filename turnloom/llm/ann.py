"""Nearest neighbours by score-aware anisotropic quantisation.

Nearness is Euclidean: |x - q|^2 = |x|^2 - 2 q.x + |q|^2. The squared norm is kept exactly, so the search is one for
maximum inner product, and vectors are quantised for that: the residual's part parallel to the vector costs more than
the rest, as it moves the inner products that matter. Rows belong to the inverted list of the nearest of some centres;
what is left of a vector is cut into sub-vectors of ``SUB`` dimensions, each coded with 4 bits. Codes are chosen by
coordinate descent on the weighted loss and codebooks by its normal equations.

Search, in two passes. The first looks in each query's nearest list only and so bounds the distance of its k-th
neighbour. The second looks in every other list that may hold a row within that bound: by the triangle inequality a
list whose rows lie ``low`` to ``high`` from its centre has nothing nearer than d - high or low - d. In a list a query's
inner products with the 16 centroids of every sub-vector are a table, and a scan adds up table entries by code. The
part of a row's residual along its quantised vector is known and the rest adds at most the product of both orthogonal
parts' lengths (Cauchy-Schwarz), so every row that the bound leaves possible, and no other, is ranked on the original
vectors. So the result is that of brute force. How many lists the second pass drops depends on the data;
``probes`` looks into that many nearest lists instead, which bounds the work and may miss neighbours.

Scale. Queries and rows are tables, met by list: a list with many rows or queries is cut into blocks of both, and each
pair of blocks is a group of bounded size. The driver holds the centres and a row of sums for each list.

Cases. Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
Finite components may be of any size: the search works on vectors scaled by a power of two, and a distance beyond the
range of doubles is infinite and comes last. Ties go to the smaller vec_id. A vec_id that occurs several times is never
its own neighbour and is listed once, at its nearest. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

SUB = 2
CENTROIDS = 16

#: Inner products above this share of the norm's product count; it sets the weight of parallel error.
THRESHOLD = 0.2

#: Vectors that centres are learned from, at most, and those of them that codebooks are; every row is encoded.
SAMPLE = 20_000
BOOK_ROWS = 4000

#: Rows of a list on average, as long as there are no more than so many lists.
LIST_ROWS = 2048
LISTS = 1024

#: Rows and queries of one group: with 64 dimensions each about 4 MB.
ROWS = 8192
QUERY_BLOCK = 8192

#: Rows per query that are ranked exactly in the first pass to set the limit for the others.
CANDIDATES = 100

#: Pairs of a row and a query that one task of a pass looks at, on average.
TASK_PAIRS = 200_000_000


class Model(NamedTuple):
    """What the search learns: vectors are scaled by 2 to the power of -``exponent``."""

    exponent: int
    centres: np.ndarray
    books: np.ndarray


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the distinct rows that take part."""
    kind = dict(vectors.dtypes)["embedding"]
    rows = vectors.select("vec_id", F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (length["n"] if length else 0)).dropDuplicates(["vec_id", "embedding"])


def _parallel_weight(dims: int) -> float:
    return max(2.0, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def _split(x: np.ndarray) -> np.ndarray:
    """(rows, sub-vectors, SUB), padded with zeros."""
    pad = -x.shape[1] % SUB
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUB)


def _unit(x: np.ndarray) -> np.ndarray:
    """Directions; zeros where a vector is too short to have one."""
    length = np.linalg.norm(x, axis=1)[:, None]
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def encode(x: np.ndarray, books: np.ndarray, rounds: int = 2, base: np.ndarray | None = None) -> np.ndarray:
    """Codes (rows, sub-vectors) of x - base that are locally best for the anisotropic loss of x."""
    parts, weight = _split(x if base is None else x - base), _parallel_weight(x.shape[1]) - 1
    unit = _split(_unit(x))
    m = parts.shape[1]
    residual = [parts[:, k, None, :] - books[k][None, :, :] for k in range(m)]
    square = [np.square(r).sum(axis=2) for r in residual]
    along = [np.einsum("ncd,nd->nc", residual[k], unit[:, k]) for k in range(m)]
    codes = np.stack([s.argmin(axis=1) for s in square], axis=1)
    rows = np.arange(len(x))
    total = sum(along[k][rows, codes[:, k]] for k in range(m))
    for _ in range(rounds):
        for k in range(m):
            rest = total - along[k][rows, codes[:, k]]
            codes[:, k] = (square[k] + weight * np.square(rest[:, None] + along[k])).argmin(axis=1)
            total = rest + along[k][rows, codes[:, k]]
    return codes


def learn(x: np.ndarray, seed: int = 11, rounds: int = 8, base: np.ndarray | None = None) -> np.ndarray:
    """Codebooks (sub-vectors, CENTROIDS, SUB) for a sample of vectors, of what they have beyond ``base``."""
    rng = np.random.default_rng(seed)
    parts, weight = _split(x if base is None else x - base), _parallel_weight(x.shape[1]) - 1
    unit = _split(_unit(x))
    m = parts.shape[1]
    books = np.stack([parts[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS), k] for k in range(m)])
    for _ in range(rounds):
        codes = encode(x, books, 1, base)
        along = np.stack([np.einsum("nd,nd->n", parts[:, k] - books[k][codes[:, k]], unit[:, k]) for k in range(m)], axis=1)
        total = along.sum(axis=1)
        for k in range(m):
            rest = total - along[:, k] + np.einsum("nd,nd->n", parts[:, k], unit[:, k])
            for c in range(CENTROIDS):
                own = codes[:, k] == c
                if own.any():
                    u = unit[own, k]
                    left = own.sum() * np.eye(SUB) + weight * u.T @ u
                    right = parts[own, k].sum(axis=0) + weight * (u * rest[own, None]).sum(axis=0)
                    books[k, c] = np.linalg.solve(left + 1e-9 * np.eye(SUB), right)
            new = np.einsum("nd,nd->n", parts[:, k] - books[k][codes[:, k]], unit[:, k])
            total += new - along[:, k]
            along[:, k] = new
    return books


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(np.square(centres).sum(axis=1) - 2 * x[a : a + 4096] @ centres.T).argmin(axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def cluster(x: np.ndarray, lists: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """Centres of a sample by Lloyd's steps; one that nobody is nearest to stays where it is."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest_centre(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, column, len(centres)) for column in x.T], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _learn_task(exponent: int, lists: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b["embedding"]) for b in batches if b.num_rows]
        if parts:
            x = np.ldexp(np.concatenate(parts), -exponent)
            centres = cluster(x, lists)
            part = x[:: -(-len(x) // BOOK_ROWS)]
            books = learn(part, base=centres[nearest_centre(part, centres)])
            flat = pa.list_(pa.float64())
            yield pa.RecordBatch.from_pydict({"centres": pa.array([centres.ravel()], flat), "books": pa.array([books.ravel()], flat), "dims": pa.array([x.shape[1]], pa.int32())})

    return task


INDEX = "list int, away double, codes binary"


def build_index(vectors: DataFrame, sample: int = SAMPLE, list_rows: int = LIST_ROWS, most_lists: int = LISTS) -> tuple[DataFrame, Model | None]:
    """(vec_id, embedding, list, distance from its centre, codes: two to a byte) of every usable row, and the model."""
    rows = usable(vectors)
    schema = f"vec_id long, embedding {dict(rows.dtypes)['embedding']}, {INDEX}"
    seen = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))).alias("most")).first()
    if not seen["n"]:
        return rows.sparkSession.createDataFrame([], schema), None
    exponent = int(np.frexp(seen["most"])[1])
    lists = max(1, min(most_lists, seen["n"] // list_rows))
    order = F.xxhash64("vec_id", "embedding")
    # the smallest hashes: most rows go before the sort, so that no task is sent a sample's worth of each partition
    upto = (1 << 64) * 2 * sample // seen["n"] - (1 << 63)
    drawn = rows.where(order < F.lit(upto)) if upto < (1 << 63) - 1 else rows
    chosen = drawn.orderBy(order, "vec_id").limit(sample).select("embedding")
    got = chosen.coalesce(1).mapInArrow(_learn_task(exponent, lists), "centres array<double>, books array<double>, dims int").first()
    centres = np.array(got["centres"]).reshape(-1, got["dims"])
    model = Model(exponent, centres, np.array(got["books"]).reshape(-1, CENTROIDS, SUB))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                x = np.ldexp(_matrix(batch["embedding"]), -exponent)
                at = nearest_centre(x, centres)
                codes = encode(x, model.books, 2, centres[at]).astype(np.uint8)
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = codes[:, ::2] | (codes[:, 1::2] << 4)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch["vec_id"], "embedding": batch["embedding"], "list": pa.array(at, pa.int32()),
                    "away": np.linalg.norm(x - centres[at], axis=1), "codes": pa.array([r.tobytes() for r in packed], pa.binary()),
                })

    return materialise(rows.mapInArrow(put, schema), "ann-index"), model


def _best(approx: np.ndarray, most: int) -> np.ndarray:
    """Column numbers (rows, most) of the smallest values, ties to the left."""
    if approx.shape[1] <= most:
        return np.broadcast_to(np.arange(approx.shape[1]), approx.shape)
    return np.sort(np.argpartition(approx, most - 1, axis=1)[:, :most], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, row by row; only where squares leave the range of doubles are differences scaled first."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = x - y
        most = np.abs(apart).max(axis=1, initial=0)
        plain = np.sqrt(np.square(apart).sum(axis=1))
        far = ((most > 1e150) | (most < 1e-150)) & (most > 0)
        if far.any():
            safe = np.where(np.isinf(most[far]), 1.0, most[far])
            plain[far] = np.where(np.isinf(most[far]), np.inf, safe * np.sqrt(np.square(apart[far] / safe[:, None]).sum(axis=1)))
    return plain


def _top(query: np.ndarray, ids: np.ndarray, away: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k nearest distinct ids, in order of query, distance and id."""
    order = np.lexsort((ids, away, query))
    _, first = np.unique(np.stack([query[order], ids[order]]), axis=1, return_index=True)
    order = order[np.sort(first)]
    q = query[order]
    start = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    return order[rank < k]


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _scan(model: Model, k: int, candidates: int):
    """For one block of a list's rows and one of queries: the queries' k nearest rows there, if within their limits."""
    exponent, centres, books = model
    m = len(books)

    def scan(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return FOUND.empty_table()
        ids, query_ids = rows["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        whole, queries = _matrix(rows["embedding"]), _matrix(asked["embedding"])
        x, y = np.ldexp(whole, -exponent), np.ldexp(queries, -exponent)
        known = np.ldexp(asked["limit"].to_numpy(zero_copy_only=False).astype(float), -exponent)
        packed = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(ids), -1)[:, :m]
        centre = centres[rows["list"][0].as_py()]
        near = np.concatenate([books[j][codes[:, j]] for j in range(m)], axis=1)[:, : x.shape[1]] + centre
        residual = x - near
        norm2, length2 = np.square(x).sum(axis=1), np.maximum(np.square(near).sum(axis=1), 1e-300)
        along = (residual * near).sum(axis=1) / length2
        across = np.sqrt(np.maximum(np.square(residual).sum(axis=1) - np.square(along) * length2, 0))
        tables = np.einsum("qmd,mcd->qmc", _split(y), books)
        found = []
        for a in range(0, len(y), 128):
            part = slice(a, a + 128)
            product = np.repeat((y[part] @ centre)[:, None], len(ids), axis=1)
            for j in range(m):
                product += tables[part, j][:, codes[:, j]]
            size2 = np.square(y[part]).sum(axis=1)[:, None]
            own = query_ids[part, None] == ids[None, :]
            limit = known[part].copy()
            open_ = np.flatnonzero(np.isinf(limit))
            if len(open_):
                at = _best(np.where(own[open_], np.inf, norm2 - 2 * product[open_]), candidates)
                i, j = np.repeat(open_, at.shape[1]), at.ravel()
                i, j = i[~own[i, j]], j[~own[i, j]]
                away = distances(whole[j], queries[part][i])
                top = _top(i, ids[j], away, k)
                last = np.flatnonzero(np.diff(np.append(i[top], -1)))  # the last of each query's
                full = np.bincount(i[top], minlength=len(limit))[i[top][last]] == k
                limit[i[top][last][full]] = np.ldexp(away[top][last][full], -exponent)
            rest = np.sqrt(np.maximum(size2 - np.square(product) / length2, 0)) * across
            least = norm2 + size2 - 2 * (product * (1 + along) + rest)
            # the slack covers rounding, the last term numbers too small for their squares
            slack, most = 1e-9 * (norm2 + size2) + 1e-300, np.square(limit)[:, None]
            could = (least - slack <= most) & ~own
            some = np.flatnonzero(could.any(axis=0))
            # what the codes leave is ranked on the vectors: by products first, then those within the limit exactly
            i, j = np.nonzero(could[:, some] & (norm2[some] + size2 - 2 * y[part] @ x[some].T - slack[:, some] <= most))
            j = some[j]
            for b in range(0, len(i), 65_536):
                cut = slice(b, b + 65_536)
                away = distances(whole[j[cut]], queries[part][i[cut]])
                top = _top(i[cut], ids[j[cut]], away, k)
                found.append((i[cut][top] + a, ids[j[cut]][top], away[top]))
        if not found:
            return FOUND.empty_table()
        i, v, d = (np.concatenate(c) for c in zip(*found, strict=True))
        top = _top(i, v, d, k)
        return pa.table({"query_id": query_ids[i[top]], "vec_id": v[top], "score": d[top]}, schema=FOUND)

    return scan


def _route(model: Model, spread: dict[int, tuple[int, float, float]], first: int, then: bool):
    """The lists that a query looks into: its ``first`` nearest ones, or ``then`` all others that its limit leaves."""
    lists = np.array(sorted(spread))
    low, high = np.array([spread[x][1] for x in lists]), np.array([spread[x][2] for x in lists])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                y = np.ldexp(_matrix(batch["embedding"]), -model.exponent)
                away = np.sqrt(np.maximum(np.square(y).sum(axis=1)[:, None] - 2 * y @ model.centres[lists].T + np.square(model.centres[lists]).sum(axis=1), 0))
                take = np.zeros(away.shape, bool)
                np.put_along_axis(take, np.argsort(away, axis=1, kind="stable")[:, :first], True, axis=1)
                if then:
                    limit = np.ldexp(batch["limit"].to_numpy(zero_copy_only=False).astype(float), -model.exponent)
                    take = ~take & (np.maximum(away - high, low - away) <= limit[:, None] + 1e-6)
                i, at = np.nonzero(take)
                if len(i):
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(i)) for c in ("vec_id", "embedding", "limit")), pa.array(lists[at], pa.int32())], names=["vec_id", "embedding", "limit", "list"])

    return route


def _pass(index: DataFrame, model: Model, asked: DataFrame, spread: dict[int, tuple[int, float, float]], k: int, candidates: int, rows: int, query_block: int) -> DataFrame:
    """query_id, vec_id, score: of each query that is ``asked`` of a list, the k nearest rows of every block of it."""
    spark = index.sparkSession
    per_list = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row per list
    if not per_list:
        return spark.createDataFrame([], "query_id long, vec_id long, score double")
    blocks = [(x, -(-spread[x][0] // rows), -(-n // query_block)) for x, n in per_list.items()]
    plan = F.broadcast(spark.createDataFrame(blocks, "p_list int, r_blocks int, q_blocks int"))
    own = F.xxhash64("vec_id", "embedding")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = index.join(plan, index["list"] == plan["p_list"]).select("vec_id", "embedding", "codes", "list", F.pmod(own, "r_blocks").cast("int").alias("r_block"), F.explode(upto("q_blocks")).alias("q_block"))
    right = asked.join(plan, asked["list"] == plan["p_list"]).select("vec_id", "embedding", "limit", "list", F.explode(upto("r_blocks")).alias("r_block"), F.pmod(own, "q_blocks").cast("int").alias("q_block"))
    pairs = sum(spread[x][0] * n for x, n in per_list.items())
    groups = sum(r * q for _, r, q in blocks)
    # a number of its own: few bytes, but much work, so partitions must not be put together by size
    tasks = max(1, min(groups, max(2 * spark.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS))))
    key = ("list", "r_block", "q_block")
    return left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *key).groupBy(*key)).applyInArrow(_scan(model, k, candidates), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, candidates: int = CANDIDATES, sample: int = SAMPLE, probes: int | None = None,
    list_rows: int = LIST_ROWS, rows: int = ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows for every usable row that ``is_query`` selects.

    Exact; with ``probes`` only that many lists are looked into for each query.
    """
    index, model = build_index(vectors, sample, list_rows)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sums = index.groupBy("list").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()  # a row per list
    spread = {r["list"]: (r["n"], r["low"], r["high"]) for r in sums}
    queries = index.where(is_query).select("vec_id", "embedding")
    routed = f"vec_id long, embedding {dict(index.dtypes)['embedding']}, limit double, list int"
    first = probes or 1
    asked = queries.withColumn("limit", F.lit(float("inf"))).mapInArrow(_route(model, spread, first, False), routed)
    found = _pass(index, model, materialise(asked, "ann-asked"), spread, k, candidates, rows, query_block)
    if probes:
        return _ranked(found, k)
    found = materialise(_ranked(found, k), "ann-first")
    limits = found.groupBy(F.col("query_id").alias("l_id")).agg(F.when(F.count("*") >= k, F.max("score")).alias("known"))
    limited = queries.join(limits, queries["vec_id"] == limits["l_id"], "left").select("vec_id", "embedding", F.coalesce("known", F.lit(float("inf"))).alias("limit"))
    asked = materialise(limited.mapInArrow(_route(model, spread, first, True), routed), "ann-asked")
    then = _pass(index, model, asked, spread, k, candidates, rows, query_block)
    return _ranked(found.drop("rank").unionByName(then), k)
