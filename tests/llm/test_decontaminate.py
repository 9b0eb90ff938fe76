from __future__ import annotations

import re

import pytest
from cases import AWKWARD, awkward, prose  # noqa: F401

from turnloom.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, n):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + min(n, len(w))]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("block", [100_000, 7])
def test_equals_brute_force(spark, block):
    texts = prose(1, 40)
    items = [(10, texts[0]), (2, texts[0]), (3, "Hello, world"), (4, None), (5, ""), (6, " ".join(texts[3].split()[2:9])), (7, "É"), (7, "É"), (8, texts[5].upper())]
    docs = [(i, t) for i, t in enumerate(texts)] + [(a[0], a[1]) for a in AWKWARD if a[0] != 5] + [(99, texts[5] + " X " + texts[0])]
    got = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 6, block).collect()
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=str)
    assert rows == sorted(brute(docs, items, 6), key=str)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["item_ids"]) for r in got)


def test_removes_documents_and_spans(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two three! And that.", "a", 1), (1, "another text", "b", 2), (2, None, "c", 3)], "doc_id long, text string, hit_windows string, bad_id int")
    items = spark.createDataFrame([(1, "ONE two, three")], "item_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in decontaminate.decontaminate(docs, items).collect()} == {(1, "another text"), (2, None)}
    spans = decontaminate.decontaminate(docs, items, remove="spans")
    assert spans.columns == docs.columns
    assert {r["hit_windows"]: r["text"] for r in spans.collect()} == {"a": "Keep this! And that.", "b": "another text", "c": None}
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, items, remove="words")


def test_empty_tables_and_awkward_rows(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = awkward(spark)
    assert decontaminate.scan(docs, items).count() == len(AWKWARD)
    assert decontaminate.scan(docs.limit(0), items).collect() == []
    assert decontaminate.decontaminate(docs, items).count() == len(AWKWARD)
