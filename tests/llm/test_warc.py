from __future__ import annotations

import hashlib
import urllib.parse

import pyarrow.fs
from pyspark.sql import functions as F

from turnloom.llm import warc

LONG = "<p>" + "é" * 100 + "</p>"
PAGES = [(5, "http://a/ b\n", LONG), (3, "http://a/3", LONG), (9, None, LONG), (1, "http://x", "short"), (2, "http://y", "short"), (4, "u", None), (6, "u", ""), (None, "n", LONG), (7, "r", "z" * 200), (7, "r", "z" * 200), (8, "%41", "\r\n\r\nWARC/1.1\r\n" * 20), (None, "m", "only without an id " * 10)]


def pages(spark):
    return spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")


def test_round_trip(spark):
    folder, index = warc.write_archive(pages(spark), frame_bytes=300, bundle_bytes=900)
    rows = warc.read_archive(folder, index).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h in PAGES:
        data = (h or "").encode()
        again = len(data) >= 100 and first.get(h or "", i) != i
        want.append((i, "revisit" if again else "response", first[h] if again else None, hashlib.sha256(data).hexdigest(), len(data), None if again else h or ""))
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"], r["html"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {urllib.parse.unquote(r["url"]) for r in rows if r["url"]} == {u for _, u, _ in PAGES if u}


def test_one_record_by_its_frame(spark):
    folder, index = warc.write_archive(pages(spark), frame_bytes=300, bundle_bytes=900)
    assert index.select("bundle", "frame").distinct().count() > 2
    assert [(r["page_id"], r["html"]) for r in warc.fetch(folder, index.where(F.col("page_id") == 8)).collect()] == [(8, "\r\n\r\nWARC/1.1\r\n" * 20)]


def test_seek_table_finds_every_frame(spark):
    folder, index = warc.write_archive(pages(spark), frame_bytes=300, bundle_bytes=10**9)
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    frames = {(r["bundle"], r["frame"]): (r["frame_at"], r["frame_bytes"]) for r in index.collect()}
    for bundle in {b for b, _ in frames}:
        with fs.open_input_file(f"{base}/{bundle}") as f:
            table = warc.seek_table(f)
        assert [(a, n) for a, n, _ in table] == [frames[bundle, k] for k in range(len(table))]


def test_empty_table(spark):
    folder, index = warc.write_archive(pages(spark).limit(0))
    assert warc.read_archive(folder, index).collect() == []


def test_many_shared_payloads_and_clashing_columns(spark):
    rows = [(i % 40 if i % 3 else None, f"http://{i}", "same payload " * 20 if i % 2 else f"page {i % 7} " * 30) for i in range(600)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, first_id string, frame int")
    columns = ("page_id", "record_type", "refers_to", "payload_digest")
    got = []
    for n in (1000, 0):
        decided = warc.decide(table, shared_rows=n).select("page_id", "url", "html", "digest", "record_type", "refers_to")
        got.append(sorted(map(tuple, decided.collect()), key=str))
    assert got[0] == got[1] and len(got[0]) == 600
    folder, index = warc.write_archive(table, frame_bytes=500)
    read = warc.read_archive(folder, index, read_bytes=2000)
    assert read.rdd.getNumPartitions() > 3 and read.count() == 600
    assert {r["refers_to"] for r in read.select(*columns).where("record_type = 'revisit'").collect()} == {min(p for p, _, h in rows if h == x and p is not None) for x in {h for _, _, h in rows}}
