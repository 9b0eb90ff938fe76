from __future__ import annotations

import zlib
from collections import defaultdict

from cases import AWKWARD, awkward, prose

from turnloom.llm import sharding


def sharded(df, shards=24, **more):
    return sharding.shard(df, shards, **more).collect()


def test_even_bytes_and_gapless_slots(spark):
    texts = prose(4, 3000, 5, 200)
    rows = sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    load, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(load.values()) / 24
    assert len(load) == 24 and max(load.values()) <= 1.02 * mean and min(load.values()) >= 0.97 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_hot_arcs_are_split(spark):
    rows = [(7, "the same document")] * 2000 + [(i, "another one") for i in range(2000)]
    for arcs in (1 << 16, 4):
        got = sharded(spark.createDataFrame(rows, "doc_id long, text string"), 8, arcs=arcs)
        load, slots = defaultdict(int), defaultdict(list)
        for r in got:
            load[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        mean = sum(load.values()) / 8
        assert len(got) == 4000 and max(load.values()) <= 1.02 * mean and min(load.values()) >= 0.95 * mean
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_few_keys_move_for_one_more_shard():
    loads = [(a, 100, 1) for a in range(0, 1 << 16, 13)]
    old = {x[0]: x[3] for x in sharding.place(loads, 24, slack=0.1)}
    new = {x[0]: x[3] for x in sharding.place(loads, 25, slack=0.1)}
    moved = sum(old[a] != new[a] for a in old) / len(old)
    assert moved < 0.25  # a plain modulus moves 24 of 25
    home = {x[0]: x[4] for x in sharding.place(loads, 24)}
    grown = {x[0]: x[4] for x in sharding.place(loads, 25)}
    assert all(grown[a] in (home[a], 24) for a in home)


def test_overflow_continues_clockwise():
    placed = sharding.place([(0, 100, 1), (0, 100, 1), (1, 5, 1)], 3, 1 << 16, 8, 0.0)
    points = sharding.ring(3, 8)
    order = sharding.clockwise(points, 0, 3)
    assert [x[3] for x in placed[:2]] == order[:2]


def test_awkward_rows(spark):
    got = sharded(awkward(spark).drop("n_chars"), 3)
    assert len(got) == len(AWKWARD) and {r["size"] for r in got if r["doc_id"] in (1, 2)} == {8}
    assert sharded(awkward(spark).limit(0)) == []
    assert all(isinstance(r["slot"], int) for r in sharded(awkward(spark).withColumnRenamed("score", "slot")))


def reference(rows, shards, arcs):
    """Each row's shard by the ring: arcs whole where they fit, in order of size, else cut at running bytes."""
    import xxhash

    loads, members = defaultdict(int), defaultdict(list)
    for i, text in rows:
        h = xxhash.xxh64(i.to_bytes(8, "little", signed=True), seed=42).intdigest()
        size = len((text or "").encode()) + 8
        loads[h >> (64 - (arcs.bit_length() - 1))] += size
        members[h >> (64 - (arcs.bit_length() - 1))].append((i, size))
    points = sharding.ring(shards)
    room = [int(-(-sum(loads.values()) * (1 + sharding.SLACK) // shards))] * shards
    where = {}
    for arc, size in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        order = []
        for _, s in [p for p in points if p[0] >= arc * ((1 << 64) // arcs)] + points:
            if s not in order:
                order.append(s)
        fits = [s for s in order if room[s] >= size]
        if fits:
            room[fits[0]] -= size
            where |= {i: fits[0] for i, _ in members[arc]}
        elif len(members[arc]) == 1:
            best = max(order, key=lambda s: room[s])
            room[best] -= size
            where[members[arc][0][0]] = best
        else:
            for s in order:
                room[s] -= min(size, max(0, room[s])) if (size := size - min(size, max(0, room[s]))) >= 0 else 0
            where |= {i: None for i, _ in members[arc]}  # a split arc: only its load is known
    return where


def test_equals_a_reference_placement(spark):
    rows = list(enumerate(prose(9, 900, 5, 120)))
    got = {r["doc_id"]: r["shard"] for r in sharded(spark.createDataFrame(rows, "doc_id long, text string"), 5)}
    want = reference(rows, 5, 1 << 16)
    known = {i: s for i, s in want.items() if s is not None}
    first_split = len(known) < len(rows)
    agree = sum(got[i] == s for i, s in known.items())
    assert len(known) > 850 and (agree == len(known) or (first_split and agree > 0.98 * len(known)))


def test_hot_slices_are_shared_out(spark):
    rows = [(None, "no id")] * 1500 + [(i, "text " * (i % 9)) for i in range(1500)] + [(7, "again")] * 500
    got = sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 6, hot_rows=100)
    load, slots = defaultdict(int), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(load.values()) / 6
    assert len(got) == 3500 and max(load.values()) <= 1.02 * mean and min(load.values()) >= 0.95 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
