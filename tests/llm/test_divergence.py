from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
from cases import awkward
from pyspark.sql import functions as F

from turnloom.llm import divergence, queries
from turnloom.llm.oracle import DIVERGENCE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    price = lambda c, n, v: 1 + 1_000_000_000 * (c + 5) // (n + 5 * v)
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = lambda s: sum(counts[lang, s][t] for t in kept)  # noqa: E731, B023
        sources = [s for g, s in groups if g == lang]
        own, v, mine = counts[lang, source], len(kept), total(source)
        pairs = sorted(((-sum(abs(price(own[t], mine, v) - price(counts[lang, s][t], total(s), v)) for t in kept), s.encode(), s) for s in sources if s != source))
        out += [(lang, source, "pair", s, -x, k) for k, (x, _, s) in enumerate(pairs, 1)]
        all_n = sum(map(total, sources))
        gain = {t: price(own[t], mine, v) - price(sum(counts[lang, s][t] for s in sources), all_n, v) for t in kept if own[t]}
        best = sorted((-x, t.encode(), t) for t, x in gain.items() if x > 0)[:top]
        out += [(lang, source, "term", t, -x, k) for k, (x, _, t) in enumerate(best, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def fixture():
    rng = random.Random(5)
    words = [f"w{c}é"[: rng.randint(1, 3)] + c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGH"]
    rows = []
    for k in range(400):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["a", "b", "É", None, "hot", "hot", "hot"])
        rows.append((" ".join(rng.choice(words[: 34 if source != "b" else 12]) for _ in range(rng.randint(0, 40))), lang, source))
    return rows + [(None, "en", "empty"), ("42 !?", "xx", "no terms"), (None, "xx", "other"), ("rare words only", "en", "rare")] * 2


def test_equals_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "text string, lang string, source string, doc_id long, term string").repartition(7)
    for least, top in ((30, 50), (3, 4), (1, 50)):
        assert rows_of(divergence.audit(df, least, top)) == brute(rows, least, top)


def test_large_counts_stay_exact(spark):
    count, total, size = (F.lit(x).cast("long") for x in (10**15, 3 * 10**15, 10**6))
    got = spark.range(1).select(divergence.price(count, total, size)).first()[0]
    assert got == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 5 * 10**6)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    assert rows_of(divergence.audit(df, 1)) == brute(rows, 1)
    assert rows_of(divergence.audit(df)) == brute(rows, 30)
    assert divergence.audit(df.limit(0)).collect() == []


def test_query_equals_its_statement(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = con.execute(f"select lang, source, part, item, value, rank from ({DIVERGENCE})").fetchall()
    assert rows_of(queries.op13_divergence(spark, sf_dir)) == sorted(got) and got
