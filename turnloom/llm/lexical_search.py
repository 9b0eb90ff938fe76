"""Ranked lexical search over forward-index blocks with block-max pruning.

Terms are runs of ASCII letters, digits and non-ASCII characters, A to Z lower-cased. A document's score for an item sums,
over the item's terms with repeats, ``w * ((SCALE * tf) div (1000 * tf + 12 * m))``; w falls with the documents that hold
the term, m grows with the document's length. All of it is in 64-bit integers; the products of a block run as matrices of
doubles where every sum stays below 2^53, and as integers elsewhere.

The index is a table of blocks: up to ``BLOCK_DOCUMENTS`` documents with their terms and counts, and per term the block's
largest impact. A task puts documents of one most frequent term and like length side by side, so bounds are tight. A search
takes items in batches; each batch meets the blocks in three passes:

1. every item's ``FIRST_BLOCKS`` blocks of the highest bound (the sum of its weights times the block's maxima);
2. the documents of these blocks are scored: an item's k-th best score is a threshold;
3. each task scores its blocks in the order of their bounds, per item until the bound is below the threshold, which rises
   as the task's own k-th best does. What a task found best is ranked over all tasks.

A block with a bound equal to the threshold is scored, so ties are whole.

Cases. Null and empty texts have no terms, count nowhere and are never found; items without a known term get no rows. Each
row is a document of its own, so repeated rows rank one after the other; equal scores rank by doc_id, nulls last. Items
that repeat id and text rank once; unlike texts under one id each get their ranks. Texts are read whole; a long document
fills a block alone. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, discard, materialise, written

NOT_TERMS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = re.compile("[A-Z]+")

SCALE = 1_000_000_000
TOP = 20

#: Documents and postings of a block, and of the documents that a task sorts before it cuts blocks.
BLOCK_DOCUMENTS, BLOCK_POSTINGS = 64, 32_768
SORTED_DOCUMENTS, SORTED_POSTINGS = 2_048, 262_144

#: Blocks in an Arrow batch, and texts in one.
BLOCK_ROWS, TEXT_ROWS = 16, 128

#: Bytes of a row group of blocks.
GROUP_BYTES = 8_000_000

#: Characters of a text whose terms are listed at once.
PIECE = 4_000_000

#: Items, and (item, term) entries, of a batch on average. The driver and each task hold one batch at a time.
BATCH_ITEMS, BATCH_ENTRIES = 128, 65_536

#: Blocks that an item looks into for its threshold.
FIRST_BLOCKS = 4

#: Candidates that a task gathers before it keeps the best of each item.
GATHERED = 200_000

#: Sums under this bound are exact in doubles.
EXACT = 2**53

BLOCKS = "block long, docs long, words long, doc_ids array<long>, lengths array<long>, ends array<int>, terms array<string>, spread array<int>, places array<int>, counts array<long>"
_BLOCKS = pa.schema([
    ("block", pa.int64()), ("docs", pa.int64()), ("words", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())),
    ("terms", pa.list_(pa.string())), ("spread", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
])


@contextmanager
def _arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows for what runs within, those of the Parquet reader too: by its own measure of 4,096 rows
    a reader would hold all blocks of a large file at once, each with up to ``BLOCK_POSTINGS`` postings."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(key) for key in keys]
    for key in keys:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        for key, value in zip(keys, before, strict=True):
            spark.conf.set(key, value)


def _counted(text: str) -> Counter:
    """The terms of a text with their occurrences; a long text is listed piece by piece."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        stop = at + PIECE
        if stop < len(text) and (cut := re.compile(NOT_TERMS).search(text, stop)):  # no term is cut
            stop = cut.start()
        elif stop < len(text):
            stop = len(text)
        piece = text[at:stop]
        found.update(TERMS.findall(piece.lower() if piece.isascii() else CAPITALS.sub(lambda m: m[0].lower(), piece)))
        at = stop
    return found


def _cut(held: list[tuple[str, int, int | None, Counter]], first: int) -> pa.RecordBatch:
    """Blocks of the held documents, numbered from ``first``."""
    held.sort(key=lambda h: h[:2])
    parts: list[list] = [[]]
    postings = 0
    for h in held:
        if parts[-1] and (len(parts[-1]) == BLOCK_DOCUMENTS or postings + len(h[3]) > BLOCK_POSTINGS):
            parts.append([])
            postings = 0
        parts[-1].append(h)
        postings += len(h[3])
    rows = []
    for k, part in enumerate(parts):
        coded = pa.array([t for h in part for t in h[3]], pa.string()).dictionary_encode()
        places = coded.indices.to_numpy().astype(np.int32)
        rows.append({
            "block": first + k, "docs": len(part), "words": sum(h[1] for h in part), "doc_ids": [h[2] for h in part], "lengths": [h[1] for h in part],
            "ends": np.cumsum([len(h[3]) for h in part]).astype(np.int32), "terms": coded.dictionary, "spread": np.bincount(places, minlength=len(coded.dictionary)).astype(np.int32),
            "places": places, "counts": np.fromiter((n for h in part for n in h[3].values()), np.int64, len(places)),
        })
    lists = lambda name, kind: pa.ListArray.from_arrays(np.cumsum([0, *(len(r[name]) for r in rows)]).astype(np.int32), pa.concat_arrays([x if isinstance(x := r[name], pa.Array) else pa.array(x, kind) for r in rows]))
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) if not pa.types.is_list(f.type) else lists(f.name, f.type.value_type) for f in _BLOCKS], schema=_BLOCKS)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, held, postings = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            if not (found := _counted(text.as_py() or "")):
                continue
            held.append((found.most_common(1)[0][0], found.total(), doc_id, found))
            postings += len(found)
            if len(held) == SORTED_DOCUMENTS or postings >= SORTED_POSTINGS:
                yield (out := _cut(held, number))
                number, held, postings = number + len(out), [], 0
    if held:
        yield _cut(held, number)


def impacts(counts: np.ndarray, lengths: np.ndarray, n: int, words: int) -> np.ndarray:
    """What a term's occurrences in documents of these lengths are worth, in integers."""
    m = 75 + (25 * lengths * n) // words
    return (SCALE * counts) // (1000 * counts + 12 * m)


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch[name]
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(at, at[1:], strict=False)]


def _impacts_of(batch: pa.RecordBatch, n: int, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block the rows of its documents, the places of the terms and the impacts, one for each posting."""
    for lengths, ends, places, counts in zip(*(_lists(batch, c) for c in ("lengths", "ends", "places", "counts")), strict=True):
        row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        yield row, places, impacts(counts, lengths[row], n, words)


def _with_maxima(n: int, words: int):
    """Adds ``tops`` to blocks: the largest impact of each term."""

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for (_, places, worth), spread in zip(_impacts_of(batch, n, words), _lists(batch, "spread"), strict=True):
                top = np.zeros(len(spread), np.int64)
                np.maximum.at(top, places, worth)
                tops.append(top)
            at = np.cumsum([0, *map(len, tops)]).astype(np.int32)
            yield batch.append_column("tops", pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int64), *tops]))))

    return maxima


def build_index(documents: DataFrame) -> tuple[DataFrame, int, int]:
    """The written blocks, the documents that have a term, and all their terms with repeats."""
    spark = documents.sparkSession
    with _arrow_rows(spark, TEXT_ROWS):
        blocks = materialise(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_forward, BLOCKS), "search-forward", GROUP_BYTES)
    plain = written[-1]
    n, words = (x or 0 for x in blocks.agg(F.sum("docs"), F.sum("words")).first())
    with _arrow_rows(spark, BLOCK_ROWS):
        index = materialise(blocks.mapInArrow(_with_maxima(n, words), f"{BLOCKS}, tops array<long>"), "search-index", GROUP_BYTES)
    discard(spark, [plain])
    return index, n, words


def weighted_terms(index: DataFrame, n: int, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, item_id) and the entries (item, term, weight) of the terms that a document holds; an item's repeats multiply its weight."""
    keyed = items.select("item_id", "text").distinct().withColumn("item", F.xxhash64(F.col("item_id").cast("string"), "text"))
    terms = F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), NOT_TERMS), "")
    repeats = materialise(keyed.select("item", F.explode(terms).alias("term")).groupBy("item", "term").agg(F.count("*").alias("repeats")), "search-terms")
    wanted = repeats.select("term").distinct()
    each = index.select(F.explode(F.arrays_zip("terms", "spread")).alias("e")).select(F.col("e.terms").alias("term"), F.col("e.spread").alias("spread"))
    held = each.join(broadcast_if_small(wanted), "term", "left_semi").groupBy("term").agg(F.sum("spread").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    return keyed.select("item", "item_id"), materialise(repeats.join(held, "term").select("item", "term", (F.col("repeats") * weight).alias("weight")).where("weight > 0"), "search-entries")


def batch_state(entries: pa.Table) -> tuple:
    """Items with their weights, term by term, as arrays that can be broadcast."""
    items, at = np.unique(entries["item"].to_numpy(), return_inverse=True)
    coded = entries["term"].combine_chunks().dictionary_encode()
    term, weight = coded.indices.to_numpy(), entries["weight"].to_numpy()
    order = np.argsort(term, kind="stable")
    sums = np.zeros(len(items), np.int64)
    np.add.at(sums, at, weight)
    exact = int(sums.max(initial=0)) * 1_000_000 < EXACT
    return items, coded.dictionary, at[order], weight[order], np.searchsorted(term[order], np.arange(len(coded.dictionary) + 1)), np.float64 if exact else np.int64


class Batch:
    """A batch of items in a task."""

    def __init__(self, state: tuple):
        self.items, self.terms, self.item, self.weight, self.start, self.kind = state

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these terms' entries: which of the terms, the item, the weight."""
        n = self.start[terms + 1] - self.start[terms]
        which = np.repeat(np.arange(len(terms)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[terms], n)
        return which, self.item[at], self.weight[at]

    def known(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """Per block, each of its terms as a number in this batch of items, or -1."""
        column = batch["terms"]
        number, at = pc.fill_null(pc.index_in(column.values, value_set=self.terms), -1).to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return [number[a:b] for a, b in zip(at, at[1:], strict=False)]

    def bounds(self, batch: pa.RecordBatch, known: list[np.ndarray]) -> np.ndarray:
        """What a document of a block can score at most: a row per block, a column per item."""
        out = np.zeros((len(known), len(self.items)), np.int64)
        for row, number, top in zip(out, known, _lists(batch, "tops"), strict=True):
            which, item, weight = self.of(number[number >= 0])
            np.add.at(row, item, weight * top[number >= 0][which])
        return out

    def scores(self, number: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray], docs: int, wanted: np.ndarray) -> np.ndarray:
        """The scores of a block's documents (rows) for the wanted items (columns)."""
        row, places, worth = postings
        dense = np.full(len(number), -1)
        held = np.flatnonzero(number >= 0)
        dense[held] = np.arange(len(held))
        place = dense[places]
        a = np.zeros((docs, len(held)), self.kind)
        a[row[place >= 0], place[place >= 0]] = worth[place >= 0]
        column = np.full(len(self.items), -1)
        column[wanted] = np.arange(len(wanted))
        which, item, weight = self.of(number[held])
        b = np.zeros((len(held), len(wanted)), self.kind)
        asked = column[item] >= 0
        b[which[asked], column[item[asked]]] = weight[asked]
        return np.rint(a @ b).astype(np.int64) if self.kind is np.float64 else a @ b


def _best(item: np.ndarray, score: np.ndarray, last: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Positions of each item's k best: higher scores first, then rows that are not ``last``, then smaller keys."""
    order = np.lexsort((key, last, -score, item))
    sorted_item = item[order]
    first = np.searchsorted(sorted_item, sorted_item)
    return order[np.arange(len(order)) - first < k]


FOUND = "item long, doc_id long, score long"


def _first_blocks(shared, most: int):
    """Per task and item, the blocks of the highest bound."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of_items = Batch(shared.value)
        item, block, bound = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            own = batch_of_items.bounds(batch, batch_of_items.known(batch))
            b, i = np.nonzero(own)
            item, block, bound = np.concatenate([item, i]), np.concatenate([block, batch["block"].to_numpy()[b]]), np.concatenate([bound, own[b, i]])
            best = _best(item, bound, np.zeros(len(item), bool), block, most)
            item, block, bound = item[best], block[best], bound[best]
        yield pa.RecordBatch.from_arrays([pa.array(batch_of_items.items[item], pa.int64()), pa.array(block, pa.int64()), pa.array(bound, pa.int64())], names=["item", "block", "bound"])

    return blocks


def _scored(shared, n: int, words: int, k: int, thresholds: dict[int, int]):
    """Per task and item, the k best documents of those that reach the item's threshold."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Batch(shared.value)
        least = np.array([max(1, thresholds.get(int(i), 1)) for i in asked.items], np.int64)
        kept: list[tuple[np.ndarray, ...]] = []

        def settled() -> tuple[np.ndarray, ...]:
            item, score, none, doc = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
            best = _best(item, score, none, doc, k)
            item, score, none, doc = item[best], score[best], none[best], doc[best]
            full = np.flatnonzero(np.bincount(item, minlength=len(asked.items)) == k)
            lowest = np.full(len(asked.items), np.iinfo(np.int64).max)
            np.minimum.at(lowest, item, score)
            least[full] = np.maximum(least[full], lowest[full])
            kept[:] = [(item, score, none, doc)]
            return kept[0]

        for batch in batches:
            known = asked.known(batch)
            bounds = asked.bounds(batch, known)
            postings, ids = list(_impacts_of(batch, n, words)), batch["doc_ids"]
            for b in np.argsort(-(bounds - least).max(axis=1, initial=0), kind="stable"):
                wanted = np.flatnonzero(bounds[b] >= least)
                if not len(wanted):
                    continue
                own = ids[int(b)].values
                scores = asked.scores(known[b], postings[b], len(own), wanted)
                doc, column = np.nonzero(scores >= least[wanted])
                if len(doc):
                    none, key = pc.is_null(own).to_numpy(zero_copy_only=False), pc.fill_null(own, 0).to_numpy(zero_copy_only=False)
                    kept.append((wanted[column], scores[doc, column], none[doc], key[doc]))
            if sum(len(x[0]) for x in kept) > GATHERED or len(kept) > 1:
                settled()
        item, score, none, doc = settled()
        yield pa.RecordBatch.from_arrays([pa.array(asked.items[item], pa.int64()), pa.array(doc, pa.int64(), mask=none), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return scored


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id")]


def _search_batch(index: DataFrame, n: int, words: int, entries: DataFrame, k: int) -> DataFrame:
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(batch_state(entries.toArrow()))
    per_task = index.select("block", "terms", "tops").mapInArrow(_first_blocks(shared, FIRST_BLOCKS), "item long, block long, bound long")
    best = per_task.withColumn("place", F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "block"))).where(F.col("place") <= FIRST_BLOCKS)
    first = materialise(best.select("block").distinct(), "search-first")
    some = index.join(broadcast_if_small(first), "block", "left_semi").mapInArrow(_scored(shared, n, words, k, {}), FOUND)
    kth = some.withColumn("place", F.row_number().over(W.partitionBy("item").orderBy(*_order()))).where(F.col("place") == k).select("item", "score")
    thresholds = {r["item"]: r["score"] for r in kth.collect()}  # a row per item of the batch
    return materialise(index.mapInArrow(_scored(shared, n, words, k, thresholds), FOUND), "search-found")


def search(documents: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of the highest score above 0."""
    index, n, words = build_index(documents)
    with _arrow_rows(index.sparkSession, BLOCK_ROWS):
        keys, entries = weighted_terms(index, n, items)
    sizes = entries.agg(F.count("*").alias("n"), F.count_distinct("item").alias("items")).first()
    batches = max(1, -(-sizes["items"] // BATCH_ITEMS), -(-sizes["n"] // BATCH_ENTRIES))
    found = index.sparkSession.createDataFrame([], FOUND)
    with _arrow_rows(index.sparkSession, BLOCK_ROWS):
        for k_th in range(batches):
            own = entries.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == k_th)
            if not own.isEmpty():
                found = found.unionByName(_search_batch(index, n, words, own, k))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*_order()))).where(F.col("rank") <= k)
    return ranked.join(broadcast_if_small(keys), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
