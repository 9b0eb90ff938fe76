"""Toxicity by weak supervision.

Many voters, each a lexicon entry (a word or a word's beginning) or a pattern, vote for toxic, or abstain; one voter
votes for clean where no lexicon entry occurs. A generative label model estimates how often each voter votes given
the hidden label, and how voters correlate in toxic texts, by expectation maximisation over the vote patterns of all
documents; known labels, outside the held-out fold, are clamped with a share of noise. Correlated voters share their
weight. A linear classifier over hashed words and word beginnings is then trained on the posterior labels, and scores
every whole text.

The lexicon is induced from at most ``MAX_ROWS`` labelled rows; patterns are fixed. Votes, their patterns and all sums of
the label model cover all documents; each step of it sends one row of sums to the driver.

Cases. Null and empty texts get the score of a text without any selected feature. Null labels and labels other than 0
and 1 are left out. With a single class, or no labels, scores are the smoothed share of label 1. Repeated rows score
alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_arrow_batches
from .hashed_text import features, pieces, string_buffers
from .quality import held_out, training_rows

BITS = 22
PREFIXES = (5, 6, 7, 8)

#: Labelled rows that the lexicon is induced from, at most, and documents that the classifier is trained on.
MAX_ROWS = 6000
FIT_ROWS = 6000

#: Lexicon voters at most; with the pattern voters a vote fits one long.
LEXICON = 48

#: Entries that the lexicon is chosen from, and features that the classifier weighs, at most: the best by evidence.
ENTRIES = 4000
FEATURES = 4096
STEPS = 12
NOISE = 0.05

# Patterns that vote for toxic (weakly, the model decides) where they occur at least so often.
PATTERNS = ((b"!!", 3), (b"***", 3), (b"@#$", 1))

VOTERS = LEXICON + len(PATTERNS)
CLEAN = VOTERS  # the bit of the voter for clean


def presence(texts: pa.Array) -> list[np.ndarray]:
    """The distinct buckets of each text: its words and their beginnings, and each place of a long run without spaces."""
    raw, offsets = string_buffers(texts)
    found: list[list[np.ndarray]] = [[] for _ in range(len(offsets) - 1)]
    for piece in pieces(offsets):
        for doc, bucket, _ in features(raw, piece, BITS, (), PREFIXES):
            pair = np.unique(doc * (1 << BITS) + bucket)
            doc, bucket = pair >> BITS, pair & ((1 << BITS) - 1)
            cut = np.flatnonzero(np.diff(doc)) + 1
            for d, b in zip(doc[np.concatenate([[0], cut])] if len(doc) else [], np.split(bucket, cut), strict=False):
                found[d].append(b)
    return [np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in found]


def evidence(in1: np.ndarray, in0: np.ndarray, n1: float, n0: float) -> tuple[np.ndarray, np.ndarray]:
    """(smoothed log odds, root of the likelihood ratio statistic) of each entry's texts by label."""
    odds = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
    share = n1 / (n1 + n0)
    both = np.maximum(in1 + in0, 1e-9)
    ratio = 2 * (in1 * np.log(np.maximum(in1, 1e-9) / (both * share)) + in0 * np.log(np.maximum(in0, 1e-9) / (both * (1 - share))))
    return odds, np.sqrt(np.maximum(ratio, 0))


def induce(texts: pa.Array, labels: np.ndarray, most: int = LEXICON) -> np.ndarray:
    """Buckets of the lexicon: entries far likelier in toxic texts, best first, without near repeats of each other."""
    docs = presence(texts)
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    size = 1 << BITS
    in1, in0 = np.zeros(size), np.zeros(size)
    for d, y in zip(docs, labels, strict=True):
        (in1 if y else in0)[d] += 1
    odds, strength = evidence(in1, in0, n1, n0)
    ok = np.flatnonzero((in1 >= max(3, n1 * 0.005)) & (odds > np.log(8.0)) & (strength > 4.5))
    ok = ok[np.lexsort((ok, -strength[ok]))][:ENTRIES]
    place = np.full(size, -1)
    place[ok] = np.arange(len(ok))
    holds: list[set[int]] = [set() for _ in ok]
    for k, d in enumerate(docs):
        for p in place[d]:
            if p >= 0:
                holds[p].add(k)
    chosen: list[int] = []
    for p in range(len(ok)):
        if len(chosen) == most:
            break
        # an entry whose texts another entry mostly has already is a repeat
        if all(len(holds[p] & holds[c]) <= 0.7 * len(holds[p]) for c in chosen):
            chosen.append(p)
    return ok[chosen]


def voter(lexicon: np.ndarray):
    """An Arrow function from texts to votes: a bit per voter."""
    bit = np.zeros(1 << BITS, np.int64)
    bit[lexicon] = np.int64(1) << np.arange(len(lexicon))

    def vote(texts: pa.Array) -> pa.Array:
        raw, offsets = string_buffers(texts)
        votes = np.zeros(len(offsets) - 1, np.int64)
        for piece in pieces(offsets):
            for doc, bucket, _ in features(raw, piece, BITS, (), PREFIXES):
                hit = np.flatnonzero(bit[bucket])
                np.bitwise_or.at(votes, doc[hit], bit[bucket[hit]])
        for k in np.flatnonzero(votes == 0):
            votes[k] |= np.int64(1) << np.int64(CLEAN)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        for k, text in enumerate(texts):
            data = memoryview(text.as_buffer()) if text.is_valid else b""
            for j, (pattern, least) in enumerate(PATTERNS):
                if bytes(data).count(pattern) >= least:
                    votes[k] |= np.int64(1) << np.int64(LEXICON + j)
        return pa.array(votes)

    return vote


def posterior(votes: np.ndarray, weight: np.ndarray, together: np.ndarray, base: float) -> np.ndarray:
    """P(toxic) of vote patterns. A vote counts its weight over one plus its correlations with the other votes there."""
    on = ((votes[:, None] >> np.arange(CLEAN + 1)) & 1).astype(float)
    z = base + (on * weight / (1 + on @ together)).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def label_model(patterns: DataFrame, prior: float, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """(weight of each vote, correlations given toxic, prior log odds) from (votes, known label or null, n).

    A vote's weight is its log likelihood ratio; abstaining says nothing. Each step sends one row of sums to the driver,
    the correlations a row for each pair of voters.
    """
    bits = range(CLEAN + 1)
    has = [F.shiftrightunsigned("votes", j).bitwiseAND(F.lit(1).cast("long")) for j in bits]
    totals = patterns.agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * h).alias(f"b{j}") for j, h in zip(bits, has, strict=True))).first()
    n, base = totals["n"] or 0, float(np.log(prior / (1 - prior)))
    together = np.zeros((CLEAN + 1, CLEAN + 1))
    if not n:
        return np.zeros(CLEAN + 1), together, base
    marginal = np.array([totals[f"b{j}"] for j in bits], float)
    # a start that says no more than which way a voter votes
    entry = np.arange(CLEAN + 1) < LEXICON
    given1 = np.clip(marginal / n * np.where(entry, 4.0, 1.0), 1e-6, 0.9)
    given0 = np.clip(marginal / n * np.where(entry, 0.3, 1.0), 1e-6, 0.999)
    given1[CLEAN] = 0.3
    for step in range(steps):
        weight = np.where(marginal > 0, np.log(given1) - np.log(given0), 0.0)
        believe = F.arrow_udf(lambda v, w=weight, r=together.copy(): pa.array(posterior(v.to_numpy(zero_copy_only=False), w, r, base)), "double")
        soft = patterns.withColumn("q", believe("votes"))
        soft = soft.withColumn("m", F.col("n") * F.when(F.col("known") == 1, 1 - NOISE * (1 - F.col("q"))).when(F.col("known") == 0, NOISE * F.col("q")).otherwise(F.col("q")))
        sums = soft.agg(F.sum("m").alias("m"), *(F.sum(F.col("m") * h).alias(f"b{j}") for j, h in zip(bits, has, strict=True))).first()
        toxic = np.array([sums[f"b{j}"] for j in bits])
        given1 = np.clip((toxic + 0.5) / (sums["m"] + 2), 1e-6, 1 - 1e-6)
        given0 = np.clip((marginal - toxic + 0.05) / (n - sums["m"] + 2), 1e-6, 1 - 1e-6)
        if step == steps // 2:
            on = F.expr(f"filter(sequence(0, {CLEAN}), j -> (votes & shiftleft(1L, j)) != 0)")
            pairs = soft.select(on.alias("on"), "m").select(F.explode("on").alias("i"), "on", "m").select("i", F.explode("on").alias("j"), "m").groupBy("i", "j").agg(F.sum("m").alias("m")).collect()
            joint = np.zeros_like(together)
            for r in pairs:
                joint[r["i"], r["j"]] = r["m"] / max(sums["m"], 1e-9)
            p = np.diag(joint)
            spread = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
            together = np.clip((joint - np.outer(p, p)) / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(together, 0)
    return np.where(marginal > 0, np.log(given1) - np.log(given0), 0.0), together, base


def fit(texts: pa.Array, target: np.ndarray, epochs: int = 30, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) of a logistic regression on soft labels, over features that tell the labels apart."""
    docs = presence(texts)
    size = 1 << BITS
    in1, in0 = np.zeros(size), np.zeros(size)
    for d, y in zip(docs, target, strict=True):
        in1[d] += y
        in0[d] += 1 - y
    n1, n0 = max(1e-6, target.sum()), max(1e-6, (1 - target).sum())
    odds, strength = evidence(in1, in0, n1, n0)
    chosen = np.flatnonzero((in1 + in0 >= 3) & (strength > 4) & (odds > np.log(5.0)))
    chosen = np.sort(chosen[np.lexsort((chosen, -strength[chosen]))][:FEATURES])
    rng = np.random.default_rng(seed)
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    docs = [place[d][place[d] >= 0] for d in docs]
    weight, bias = np.zeros(len(chosen)), float(np.log(n1 / n0))
    seen, seen_b = np.full(len(chosen), 1e-3), 1e-3
    for epoch in range(epochs):
        rate = 0.5 / (1 + 0.2 * epoch)
        for k in rng.permutation(len(docs)):
            d = docs[k]
            g = 1 / (1 + np.exp(-np.clip(bias + weight[d].sum(), -50, 50))) - target[k]
            seen_b += g * g
            bias -= rate * g / np.sqrt(seen_b)
            if len(d):
                seen[d] += g * g
                weight[d] -= rate * (g + 1e-4 * weight[d]) / np.sqrt(seen[d])
    return chosen, weight, bias


def scorer(buckets: np.ndarray, weights: np.ndarray, bias: float):
    """An Arrow function from texts to P(toxic); a feature counts once per text."""
    value = np.zeros(1 << BITS)
    value[buckets] = weights

    def score(texts: pa.Array) -> pa.Array:
        raw, offsets = string_buffers(texts)
        n = len(offsets) - 1
        hits = []
        for piece in pieces(offsets):
            for doc, bucket, _ in features(raw, piece, BITS, (), PREFIXES):
                at = np.flatnonzero(value[bucket])
                hits.append(np.unique(doc[at] * (1 << BITS) + bucket[at]))
        pair = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        z = bias + np.bincount(pair >> BITS, value[pair & ((1 << BITS) - 1)], n)
        return pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -50, 50))), 9))

    return score


def _table(batches: Iterator[pa.RecordBatch], key: str) -> pa.Table | None:
    batches = list(batches)
    rows = pa.Table.from_batches(batches) if batches else None
    return rows.sort_by(key) if rows is not None and rows.num_rows else None


def _induce_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _table(batches, "t_id")
    labels = rows["label"].to_numpy() if rows is not None else np.zeros(0)
    lexicon = induce(rows["text"], labels) if len(np.unique(labels)) == 2 else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_pydict({"lexicon": pa.array([lexicon.tolist()], pa.list_(pa.int64())), "positive": [int(labels.sum())], "n": [len(labels)]})


def _fit_task(*model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _table(batches, "order")
        if rows is None:
            return
        target = posterior(rows["votes"].to_numpy(), *model)
        buckets, weights, bias = fit(rows["text"], target)
        yield pa.RecordBatch.from_pydict({"buckets": pa.array([buckets.tolist()], pa.list_(pa.int64())), "weights": pa.array([weights.tolist()], pa.list_(pa.float64())), "bias": [float(bias)]})

    return task


def fit_sample(documents: DataFrame, votes: DataFrame, fit_rows: int) -> DataFrame:
    """(order, text, votes) of at most ``fit_rows`` documents, by hash, the same on every run; one text of each id."""
    chosen = votes.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("s_id")).agg(F.max(F.struct("text_hash", "votes")).alias("s")).orderBy(F.xxhash64("s_id"), "s_id").limit(fit_rows).select("s_id", "s.*")
    texts = documents.select("doc_id", "text")
    met = texts.join(F.broadcast(chosen), (texts["doc_id"] == chosen["s_id"]) & (F.xxhash64("text") == chosen["text_hash"]))
    # grouped before it goes to one task, so that no task scans more than its share of the documents
    return met.groupBy("s_id", "votes").agg(F.max("text").alias("text")).select(F.xxhash64("s_id").alias("order"), "text", "votes")


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, max_rows: int = MAX_ROWS, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """The classifier (buckets, weights, bias)."""
    small_arrow_batches(documents.sparkSession)
    rows = training_rows(documents, labels, label, folds, fold, max_rows)
    first = rows.coalesce(1).mapInArrow(_induce_task, "lexicon array<long>, positive long, n long").first()
    prior = (first["positive"] + 1) / (first["n"] + 2) if first else 0.5
    none = (np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not first or not first["lexicon"]:
        return none
    lexicon = np.array(first["lexicon"], np.int64)
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
    known = usable.groupBy(F.col("doc_id").alias("l_id")).agg(F.round(F.avg(label)).cast("int").alias("known"))
    votes = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.arrow_udf(voter(lexicon), "long")(F.col("text")).alias("votes"))
    votes = materialise(votes, "votes")
    patterns = materialise(votes.join(known, votes["doc_id"] == known["l_id"], "left").groupBy("votes", "known").agg(F.count("*").alias("n")), "vote-patterns")
    believed = label_model(patterns, prior)
    sample = fit_sample(documents, votes, fit_rows)
    model = sample.coalesce(1).mapInArrow(_fit_task(*believed), "buckets array<long>, weights array<double>, bias double").first()
    if not model:
        return none
    return np.array(model["buckets"], np.int64), np.array(model["weights"]), float(model["bias"])


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str = "score") -> DataFrame:
    """The documents with P(toxic = 1)."""
    small_arrow_batches(documents.sparkSession)
    return documents.withColumn(name, F.arrow_udf(scorer(*model), "double")(F.col("text")))
