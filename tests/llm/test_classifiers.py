from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from cases import AWKWARD, awkward, prose
from pyspark.sql import functions as F

from turnloom.llm import hashed_text, quality, toxicity

BAD = ["idiotic", "worthless", "scummy", "trashy", "moronic", "clownish"]


def labelled(spark, n=1500, seed=11):
    rng, docs, labels = random.Random(seed), [], []
    for i, t in enumerate(prose(seed, n, 20, 80)):
        w = t.split()
        junk, toxic = rng.random() < 0.3, rng.random() < 0.2
        if junk:
            w = [x + "%%%" for x in w] if i % 2 else [x for x in w[:6] for _ in range(8)]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        docs.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_quality_on_held_out(spark):
    docs, labels, truth = labelled(spark)
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).withColumn("h", quality.held_out(F.col("doc_id"), 3, 1)).collect()
    held = [r for r in rows if r["h"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum((r["score"] >= 0.5) == truth[r["doc_id"]][0] for r in held) / len(held) > 0.95
    again = quality.train(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in rows if r["score"] >= 0.5}


def test_held_out_labels_are_never_read(spark):
    docs, labels, _ = labelled(spark, 600)
    flip = F.when(quality.held_out(F.col("doc_id"), 3, 1), 1 - F.col("quality")).otherwise(F.col("quality"))
    a, b = quality.train(docs, labels), quality.train(docs, labels.withColumn("quality", flip))
    assert np.array_equal(a[0], b[0])
    flip = F.when(quality.held_out(F.col("doc_id"), 5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, labels.withColumn("toxic", flip))
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_toxicity_on_held_out(spark):
    docs, labels, truth = labelled(spark)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).withColumn("h", quality.held_out(F.col("doc_id"), 5, 0)).where("h").collect()
    right = [(r["score"] >= 0.5) == truth[r["doc_id"]][1] for r in rows]
    assert len(rows) > 200 and sum(right) / len(right) > 0.97


def test_the_fitted_sample_is_bounded_where_an_id_repeats(spark):
    docs = spark.createDataFrame([(1, f"text {k % 7}") for k in range(500)] + [(k, f"other {k}") for k in range(2, 40)] + [(None, "x"), (50, None)], "doc_id long, text string").repartition(6)
    votes = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(3).cast("long").alias("votes"))
    for limit in (10, 1000):
        got = toxicity.fit_sample(docs, votes, limit)
        assert got.count() == min(limit, 40) and got.select("order").distinct().count() == min(limit, 40)


def test_correlated_votes_share_their_weight():
    n = toxicity.CLEAN + 1
    weight, together = np.zeros(n), np.zeros((n, n))
    weight[[0, 1, 2]] = 2.0
    together[0, 1] = together[1, 0] = 1.0
    p = toxicity.posterior(np.array([0b1, 0b11, 0b101, 0]), weight, together, -1.0)
    assert np.allclose(np.log(p / (1 - p)), [1.0, 1.0, 3.0, -1.0])


def test_awkward_rows_and_no_labels(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1), (None, 1, 1), (4, 7, 7), (5, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for rows in (quality.score(docs, quality.train(docs, labels), "s").collect(), toxicity.score(docs, toxicity.train(docs, labels), "s").collect()):
            assert len(rows) == len(AWKWARD) and all(0 <= r["s"] <= 1 for r in rows)
            assert len({r["s"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    clash = docs.selectExpr("*", "1 as label", "2 as votes", "3 as t_id")
    assert quality.score(clash, quality.train(clash, some)).count() == toxicity.score(clash, toxicity.train(clash, some)).count() == len(AWKWARD)
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), none), "s").collect() == []


def test_parts_of_a_long_text_give_the_features_of_the_whole(monkeypatch):
    text = " ".join(prose(5, 40)) + " same same same"

    def all_features():
        raw, offsets = hashed_text.string_buffers(pa.array(["a b", None, text, "", "tail"]))
        out = []
        for piece in hashed_text.pieces(offsets):
            for doc, bucket, at in hashed_text.features(raw, piece, 18, (2, 3), (4,), hashed_text.NOT_SPACE, False):
                out += zip(doc.tolist(), bucket.tolist(), at.tolist(), strict=True)
        return sorted(out)

    whole = all_features()
    monkeypatch.setattr(hashed_text, "PIECE", 97)
    assert all_features() == whole


def test_grams_are_of_whole_characters():
    texts = ["привет", "字海山", "aé字😀b", "", "ab"]
    raw, offsets = hashed_text.string_buffers(pa.array(texts))
    found = {}
    for piece in hashed_text.pieces(offsets):
        for g in (2, 3):
            doc, bucket, at = next(iter(hashed_text.features(raw, piece, 40, (g,), (), hashed_text.NOT_SPACE, False)))
            for d, b, i in zip(doc.tolist(), bucket.tolist(), at.tolist(), strict=True):
                found.setdefault((g, d), []).append((i - int(offsets[d]), b))
    for d, text in enumerate(texts):
        for g in (2, 3):
            starts = [len(text[:k].encode()) for k in range(len(text) - g + 1)]
            assert [i for i, _ in found.get((g, d), [])] == starts
    # one gram has one bucket wherever it stands, and others have others
    raw, offsets = hashed_text.string_buffers(pa.array(["字海", "x字海", "海字"]))
    doc, bucket, at = next(iter(hashed_text.features(raw, next(iter(hashed_text.pieces(offsets))), 40, (2,), (), hashed_text.NOT_SPACE, False)))
    same = {(int(d), int(i) - int(offsets[d])): int(b) for d, b, i in zip(doc, bucket, at, strict=True)}
    assert same[0, 0] == same[1, 1] != same[2, 0]


def test_long_runs_are_read_to_their_end(spark, monkeypatch):
    bases = ["字" * 10, "漢" * 75, "ab" * 120]
    for base in bases:
        other = base + "語語xyzw"
        a, b, c = (set(x.tolist()) for x in toxicity.presence(pa.array([base + "言言opqr", other, other])))
        assert a != b and b == c
    # the beginning of a word has one bucket, whether a space or other characters stand before it
    bad = toxicity.presence(pa.array(["毒言毒語"]))[0]
    deep = toxicity.presence(pa.array(["字海山川" * 40 + "毒言毒語" + "空風" * 40]))[0]
    word = toxicity.presence(pa.array(["毒言毒語空風"]))[0]
    assert len(np.intersect1d(word, deep)) > 0 and len(bad)
    whole = [x.tolist() for x in toxicity.presence(pa.array(["a " + "字海x" * 90 + " b", "川" * 300]))]
    monkeypatch.setattr(hashed_text, "PIECE", 97)
    assert [x.tolist() for x in toxicity.presence(pa.array(["a " + "字海x" * 90 + " b", "川" * 300]))] == whole


def test_a_toxic_word_deep_in_a_text_without_spaces(spark):
    rng = random.Random(5)
    plain = "日月火水木金土天地人心手足目耳口言行道理春夏秋冬東西南北"
    docs, labels = [], []
    for i in range(900):
        text = "".join(rng.choice(plain) for _ in range(rng.randint(150, 300)))
        toxic = rng.random() < 0.3
        if toxic:
            at = rng.randint(70, 140)
            text = text[:at] + "畜生" + text[at:]
        docs.append((i, text))
        labels.append((i, int(toxic)))
    docs, labels, truth = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).withColumn("h", quality.held_out(F.col("doc_id"), 5, 0)).where("h").collect()
    right = [(r["score"] >= 0.5) == truth[r["doc_id"]] for r in rows]
    assert sum(right) / len(right) > 0.95
