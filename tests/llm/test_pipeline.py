"""The pipeline on rows with planted cases, stage by stage, and its independence from the rest."""

from __future__ import annotations

import random
import re
import subprocess
import sys
import textwrap
from collections import Counter
from pathlib import Path

import pytest
import xxhash
from cases import prose
from pyspark.sql import functions as F

REPO = Path(__file__).resolve().parents[2]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    import corpus_pipeline  # noqa: F401

    rng, rows, labels = random.Random(21), [], []
    bench = prose(22, 6, 20, 30)
    for i, t in enumerate(prose(23, 900, 60, 120)):
        kind = "clean"
        if i % 9 == 1:
            t, kind = " ".join(w + "%%%" for w in t.split()), "junk"
        elif i % 50 == 3:
            w = t.split()
            w[20:20] = rng.choice(bench).split()[2:16]
            t, kind = " ".join(w), "leak"
        rows.append((i, t, "en", ["s1", "s2", "s3"][i % 3], kind))
        labels.append((i, int(kind != "junk"), 0))
    for k in range(40):  # exact copies
        rows.append((1000 + k, rows[2 + 9 * (k % 8)][1], "en", "s1", "copy"))
    sf = tmp_path_factory.mktemp("sf")
    schema = "doc_id long, text string, lang string, source string, kind string"
    df = spark.createDataFrame(rows, schema).withColumn("n_chars", F.length("text").cast("long"))
    df.select(*COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return str(sf), {r[0]: r[4] for r in rows}


def test_stages(spark, planted):
    import corpus_pipeline

    sf, kind = planted
    docs, left = spark.read.parquet(f"{sf}/documents.parquet"), {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontaminate", "mix", "shard"]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "shard":
            assert docs.columns == COLUMNS
        left[name] = Counter(r["doc_id"] for r in docs.collect())
    assert {kind[i] for i in left["quality"]} == {"clean", "leak", "copy"} and len(left["quality"]) == sum(k != "junk" for k in kind.values())
    assert "copy" not in {kind[i] for i in left["simhash"]} and sum(kind[i] == "clean" for i in left["simhash"]) == sum(k == "clean" for k in kind.values())
    assert {kind[i] for i in left["decontaminate"]} == {"clean"} and len(left["decontaminate"]) == sum(k == "clean" for k in kind.values())
    assert set(left["mix"]) <= set(left["decontaminate"]) and set(left["mix"].values()) <= {1, 2}
    assert left["shard"] == left["mix"] and {"shard", "slot", "size"} <= set(docs.columns)


def test_run_agrees_with_its_stages(spark, planted):
    import corpus_pipeline

    sf, _ = planted
    a, b = (sorted((r["doc_id"], r["shard"], r["size"]) for r in corpus_pipeline.run(spark, sf).collect()) for _ in range(2))
    assert a == b and len(a) > 500


def _shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if x]
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or ([" ".join(w)] if w else [])


def _kept_of_groups(rows):
    """Every pair compared: links at 6 bits, or at 12 with a Jaccard similarity of 0.8; the smallest id of a component stays."""
    prints, sets, up = {}, {}, {i: i for i, _ in rows}
    for i, text in rows:
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in _shingles(text)]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        sets[i] = set(h)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids, verified = sorted(prints), 0
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            bits = (prints[a] ^ prints[b]).bit_count()
            if bits <= 12 and (bits <= 6 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                verified += bits > 6
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i for i in ids if up[i] == i}, verified


def _clean(rows, items):
    """Documents without any of the items' windows of ten words."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[k : k + 10]) for w in map(words, items) if w for k in range(max(1, len(w) - 9))}
    lengths = {len(x) for x in windows}
    return {i for i, t in rows if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in lengths for k in range(len(w) - n + 1))}


def _targets(sizes):
    """Shares of 150 % by weights 5, 2, 1, each at most twice its source."""
    weights, targets, left, open_ = dict(zip(sorted(sizes), (5, 2, 1) * len(sizes), strict=False)), {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        for s in full or open_:
            targets[s] = 2 * sizes[s] if full else weights[s] * level
        left -= sum(targets[s] for s in full)
        open_ -= full or open_
    return targets


def test_stages_against_brute_force(spark, planted, tmp_path):
    import corpus_pipeline

    sf, kind = planted
    rng, near = random.Random(31), []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = [r for r in docs.collect() if kind[r["doc_id"]] == "clean"]
    for k in range(120):  # one or two words of a clean text replaced
        r = rng.choice(clean)
        w = r["text"].split()
        for _ in range(1 + k % 2):
            w[rng.randrange(len(w))] = f"changed{k}"
        near.append((2000 + k, " ".join(w), r["lang"], r["source"], len(" ".join(w))))
    docs.unionByName(spark.createDataFrame(near, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.unionByName(spark.createDataFrame([(r[0], 1, 0) for r in near], labels.schema)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]

    docs, rows = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = docs.collect()
    whole, source = rows["shard"], {r["doc_id"]: r["source"] for r in rows["decontaminate"]}
    rows = {name: [(r["doc_id"], r["text"]) for r in rows[name]] for name in ("quality", "simhash", "decontaminate")}
    kept, verified = _kept_of_groups(rows["quality"])
    assert sorted(i for i, _ in rows["simhash"]) == sorted(kept) and verified > 20
    assert sorted(i for i, _ in rows["decontaminate"]) == sorted(_clean(rows["simhash"], items))

    copies = Counter(r["doc_id"] for r in whole)
    words = {i: len(t.split()) for i, t in rows["decontaminate"]}
    assert set(copies) <= set(words) and max(copies.values()) <= 2
    sizes = Counter()
    for i, n in words.items():
        sizes[source[i]] += n
    for s, target in _targets(sizes).items():
        reach = 1  # bit n: some choice of copies has n words
        for i, n in words.items():
            if source[i] == s:
                reach |= reach << n | reach << 2 * n
        best = min(abs(n - target) for n in range(reach.bit_length()) if reach >> n & 1)
        taken = sum(n * words[i] for i, n in copies.items() if source[i] == s)
        assert abs(taken - target) <= best + max(1e-4 * target, 1)
    loads, slots = Counter(), {}
    for r in whole:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean, largest = sum(loads.values()) / 24, max(r["size"] for r in whole)
    assert set(loads) == set(range(24)) and all(abs(n - mean) <= largest for n in loads.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_the_rest_stands_without_this_subpackage(tmp_path):
    program = textwrap.dedent(f"""
        import shutil, sys
        shutil.copytree({str(REPO)!r}, {str(tmp_path / 'copy')!r}, ignore=shutil.ignore_patterns('.git', 'tests', '__pycache__'))
        shutil.rmtree({str(tmp_path / 'copy' / 'turnloom' / 'llm')!r})
        import os
        os.remove({str(tmp_path / 'copy' / 'corpus_pipeline.py')!r})
        sys.path.insert(0, {str(tmp_path / 'copy')!r})
        import __spark_entry__ as e
        assert e.__file__.startswith({str(tmp_path)!r})
        assert 'turn_context' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())
    """)
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
