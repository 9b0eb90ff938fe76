"""Quality classifier: supervised subword embeddings.

Hashed words, n-grams of characters and the pair of a word with itself have learned vectors; a document is their mean, and a softmax over two classes gives its
score. Training is stochastic gradient descent in numpy with per-row AdaGrad steps, over at most ``max_rows`` labelled
documents in one task. With two classes the score needs one number per bucket (vector times the difference of the two
output rows), so scoring a text of any length is a gather and a sum.

Cases. Null and empty texts have the score of the bias alone. Labels other than 0 and 1, null labels and null doc_ids
are left out; a document labelled several times counts by its mean label, rounded up. Without both classes in training
every score is the smoothed share of label 1. Repeated rows score alike; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches
from .hashed_text import NOT_SPACE, features, pieces, string_buffers

BITS = 16
GRAMS = (2, 3, 4)
DIM = 16
EPOCHS = 6
RATE = 0.5

#: Labelled rows that training reads at most, chosen by the hash of their id. The model needs no more; the bound is
#: what keeps training in one task.
MAX_ROWS = 3000


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text falls in the fold; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows (doc_id, text, label) outside the held-out fold, the same on every run."""
    documents = documents.select("doc_id", "text")
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    per_doc = usable.groupBy(F.col("doc_id").alias("t_id")).agg(F.round(F.avg(label)).cast("int").alias("label"))
    known = documents.select(F.col("doc_id").alias("t_id")).distinct()
    chosen = per_doc.join(known, "t_id", "left_semi").orderBy(F.xxhash64("t_id"), "t_id").limit(max_rows)
    # at most max_rows ids, so this broadcast is bounded
    texts = documents.join(F.broadcast(chosen), documents["doc_id"] == chosen["t_id"]).select(F.col("doc_id").alias("t_id"), "text", "label")
    return texts.groupBy("t_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    raw, offsets = string_buffers(texts)
    found: list[list[np.ndarray]] = [[] for _ in range(len(offsets) - 1)]
    for piece in pieces(offsets):
        for doc, bucket, _ in features(raw, piece, BITS, GRAMS, (), NOT_SPACE, False, True):
            cut = np.flatnonzero(np.diff(doc)) + 1
            for d, b in zip(doc[np.concatenate([[0], cut])] if len(doc) else [], np.split(bucket, cut), strict=False):
                found[d].append(b)
    return [np.unique(np.concatenate(f), return_counts=True) if f else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for f in found]


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """(logit per bucket, bias)."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias0 = float(np.log(share / (1 - share)))
    size = 1 << BITS
    if len(np.unique(labels)) < 2:
        return np.zeros(size, np.float32), bias0
    rng = np.random.default_rng(seed)
    docs = bags(texts)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.array([0.0, bias0], np.float32)
    sum_v, sum_o, sum_b = np.full(size, 1e-6, np.float32), np.full(2, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    steps, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            steps += 1
            buckets, counts = docs[k]
            weight = (counts / max(1, counts.sum())).astype(np.float32)
            mean = weight @ vectors[buckets] if len(buckets) else np.zeros(DIM, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[k])] -= 1
            now = rate * (1 - steps / total) + 1e-3
            back = p @ out
            sum_o += p * p * float(mean @ mean)
            sum_b += p * p
            out -= now * np.outer(p / np.sqrt(sum_o), mean)
            bias -= now * p / np.sqrt(sum_b)
            if len(buckets):
                size_of_step = weight * weight * float(back @ back)
                sum_v[buckets] += size_of_step
                vectors[buckets] -= (now * 0.5 * weight / np.sqrt(sum_v[buckets]))[:, None] * back[None, :]
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def _fit_task(batches):
    rows = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
    if rows is None or not rows.num_rows:
        logits, bias = np.zeros(1 << BITS, np.float32), 0.0
    else:
        rows = rows.sort_by("t_id")
        logits, bias = fit(rows["text"], rows["label"].to_numpy())
    yield pa.RecordBatch.from_pydict({"logits": pa.array([logits.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([bias])})


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """The model, learned in one task from the bounded sample; the driver gets 2**16 numbers."""
    small_arrow_batches(documents.sparkSession)
    rows = training_rows(documents, labels, label, folds, fold, max_rows)
    model = rows.coalesce(1).mapInArrow(_fit_task, "logits binary, bias double").first()
    if model is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(model["logits"], np.float32), float(model["bias"])


def scorer(logits: np.ndarray, bias: float):
    """An Arrow function from texts to P(label 1)."""

    def score(texts: pa.Array) -> pa.Array:
        raw, offsets = string_buffers(texts)
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for piece in pieces(offsets):
            lo, hi = piece.first_doc, piece.first_doc + len(piece.doc_starts) - 1
            for doc, bucket, _ in features(raw, piece, BITS, GRAMS, (), NOT_SPACE, False, True):
                total[lo:hi] += np.bincount(doc - lo, logits[bucket], hi - lo)
                count[lo:hi] += np.bincount(doc - lo, minlength=hi - lo)
        z = bias + total / np.maximum(count, 1)
        return pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -700, 700))), 9))

    return score


def score(documents: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """The documents with P(quality = 1)."""
    small_arrow_batches(documents.sparkSession)
    return documents.withColumn(name, F.arrow_udf(scorer(*model), "double")(F.col("text")))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """The documents whose score reaches the threshold."""
    model = train(documents, labels, **settings)
    rate = F.arrow_udf(scorer(*model), "double")
    return documents.where(rate(F.col("text")) >= threshold)
