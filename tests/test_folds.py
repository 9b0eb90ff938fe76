"""Folds that compose against folds in order: merges, session ends, line framing."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from turnloom.operators import json_merge, session_ends
from turnloom.streaming import framing, live, stateful


def merged(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: merged(a[k], v) if k in a else v for k, v in b.items()}}
    return b


def test_merge_by_paths_equals_the_fold(spark):
    rng = random.Random(1)

    def value(depth):
        if depth < 4 and rng.random() < 0.55:
            return {rng.choice('abcd"é'): value(depth + 1) for _ in range(rng.randint(0, 3))}
        return rng.choice([1, "x", None, [1, {"q": 2}], True, 'a"b\nc', 1.5, {}])

    rows = [(k, o, json.dumps(value(0) if rng.random() < 0.1 else {rng.choice("abc"): value(1) for _ in range(rng.randint(0, 3))})) for k in range(60) for o in range(rng.randint(1, 8))]
    want = {}
    for k, _, text in rows:
        want[k] = merged(want.get(k, {}), json.loads(text))
    df = spark.createDataFrame(rows, "k long, o long, t string").repartition(3)
    got = {r["k"]: json.loads(r["merged"]) for r in json_merge.deep_merge(df, "k", "o", "t").collect()}
    assert got == want


def test_merge_of_awkward_documents(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, "not json"), (3, 1, '{"a":{"b":1}}'), (3, 2, None), (4, 1, '{"a":{"b":{"c":{}}}}'), (4, 2, '{"a":{"b":{"d":[]}}}'), (None, 1, "{}")], "k long, o long, t string")
    assert {r["k"]: r["merged"] for r in json_merge.deep_merge(df, "k", "o", "t").collect()} == {1: "{}", 2: "{}", 3: '{"a":{"b":1}}', 4: '{"a":{"b":{"c":{},"d":[]}}}'}
    deep = spark.createDataFrame([(1, 1, '{"a":{"b":{"c":{}}}}')], "k long, o long, t string")
    assert json_merge.deep_merge(deep, "k", "o", "t", 3).count() == 1
    with pytest.raises(Exception, match="nested more than 2 deep"):
        json_merge.deep_merge(deep, "k", "o", "t", 2).collect()


def ends(turns, stuck, most):
    last, run = None, 0
    for k, (seen, stops, failed) in enumerate(turns, 1):
        run = run + 1 if seen == last else 1
        last = seen
        if failed or stops:
            return k, "error" if failed else "user_stop"
        if run >= stuck:
            return k, "stuck_loop"
        if k >= most:
            return k, "max_turns"
    return None, None


def test_session_ends_composed_of_parts_equal_the_walk(spark, monkeypatch):
    rng = random.Random(3)
    sessions = {s: [(rng.choice("aab" if s % 2 else "abcd"), rng.random() < 0.02, rng.random() < 0.02) for _ in range(rng.randint(1, 60))] for s in range(150)}
    rows = [(s, 3 * k, *t) for s, ts in sessions.items() for k, t in enumerate(ts)] + [(900, 5, None, None, None)]
    df = spark.createDataFrame(rows, "s long, t long, seen string, stops boolean, failed boolean").repartition(4)
    for part, stuck, most in ((1_024, 3, 40), (4, 3, 40), (2, 4, 25), (5, 2, 1)):
        monkeypatch.setattr(session_ends, "PART", part)
        got = {r["s"]: (r["n_turns"], r["end_turn"], r["reason"]) for r in session_ends.session_ends(df, "s", "t", F.col("seen"), F.lit("x"), F.col("stops"), F.col("failed"), stuck, most).collect()}
        want = {s: (len(ts), *ends(ts, stuck, most)) for s, ts in sessions.items()} | {900: (1, 1 if most == 1 else None, "max_turns" if most == 1 else None)}
        assert got == want
    with pytest.raises(ValueError):
        session_ends.session_ends(df, "s", "t", F.col("seen"), F.lit("x"), F.col("stops"), F.col("failed"), 1)


def chunked(rng):
    texts = {f"s{k}": "\n".join(rng.choice(["é€ab", "", "  \t", '{"a":1}', "xyz😀\r"]) for _ in range(rng.randint(1, 9))) + rng.choice(["", "\n"]) for k in range(30)} | {"blank": "\n \n", "none": ""}
    rows = []
    for s, t in texts.items():
        b = t.encode()
        cuts = sorted({0, len(b), *(rng.randrange(len(b) + 1) for _ in range(6))})
        parts = [b[i:j] for i, j in zip(cuts, cuts[1:], strict=False)] or [b""]
        rows += [(s, i, bytearray(p), i == len(parts) - 1) for i, p in enumerate(parts)]
    return rows, sorted((s, n, line) for s, t in texts.items() for n, line in enumerate(t.split("\n")) if line.strip())


def test_lines_of_chunks_cut_anywhere(spark, tmp_path):
    rng = random.Random(4)
    rows, want = chunked(rng)
    schema = "session string, at long, data binary, last boolean"
    df = spark.createDataFrame(rows, schema).repartition(4)
    for part in (1, 3, 4_096):
        assert sorted(map(tuple, framing.framed(df, "session", "at", "data", part).collect())) == want
    rng.shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with stateful.state_store(spark):
        got = live.drained(stateful.framed_stream(stream), f"{tmp_path}/out", f"{tmp_path}/log", "append").collect()
    assert sorted((r["session"], r["line_no"], r["line"]) for r in got) == want


def test_complete_results_are_tables(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 as k").repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, k long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = live.drained(stream.groupBy("k").agg(F.sum("id").alias("n")), f"{tmp_path}/out", f"{tmp_path}/log")
    assert sorted(map(tuple, got.collect())) == [(0, 18), (1, 12), (2, 15)] and got.inputFiles()


def test_ordered_state_sends_rows_of_a_batch_at_once():
    import pandas as pd

    from turnloom.streaming.stateful import OrderedState

    class Held:
        def __init__(self):
            self.rows, self.calls = [], 0

        def appendList(self, rows):  # noqa: N802
            self.rows, self.calls = self.rows + rows, self.calls + 1

        def put(self, rows):
            self.rows = rows

        def get(self):
            return iter(self.rows)

        def clear(self):
            self.rows = []

    class States(dict):
        def iterator(self):
            return iter(self.items())

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

    class Handle:
        waiting, state, timers = Held(), States(), []
        getListState = lambda self, name, schema: self.waiting
        getMapState = lambda self, name, key, value: self.state
        registerTimer = lambda self, at: self.timers.append(at)

    class Watermark:
        getCurrentWatermarkInMs = lambda self: 10

    handle, fold = Handle(), OrderedState()
    fold.init(handle)
    rows = pd.DataFrame({"at": [5000, 1000, 1000, 90_000], "id": [3, 1, 1, 4], "name": ["a", "a", "b", "a"], "value": [1.0, 2.0, 3.0, 4.0]})
    fold.handleInputRows((7,), iter([rows[:2], rows[2:]]), None)
    assert handle.waiting.calls == 1 and handle.timers == [2]
    (out,) = fold.handleExpiredTimer((7,), Watermark(), None)
    assert out.values.tolist() == [[7, 1, ""], [7, 3, "b=3.00"]]  # of one time and id the last counts
    assert [r[:2] for r in handle.waiting.rows] == [(90_000, 4)] and handle.timers == [2, 91] and dict(handle.state) == {("b",): (3.0,), ("a",): (1.0,)}


def test_versions_of_frequent_keys_merge_alike(spark, monkeypatch):
    rng = random.Random(4)

    def value(depth):
        return {rng.choice("abc"): value(depth - 1) for _ in range(2)} if depth and rng.random() < 0.6 else rng.choice([1, "s", None, [2], {}])

    rows = [(k, o, json.dumps({"r": value(3), rng.choice("xy"): value(2)})) for k in range(6) for o in range(3 + 20 * (k % 2))]
    want = {}
    for k, _, text in rows:
        want[k] = merged(want.get(k, {}), json.loads(text))
    df = spark.createDataFrame(rows, "k long, o long, t string").repartition(3)
    for hot in (10, 1_000):
        monkeypatch.setattr(json_merge, "HOT", hot)
        assert {r["k"]: json.loads(r["merged"]) for r in json_merge.deep_merge(df, "k", "o", "t").collect()} == want


def test_only_paths_of_frequent_keys_are_shuffled(spark):
    df = spark.createDataFrame([(1, 0, '{"a":1}')], "k long, o long, t string")
    plan = json_merge.deep_merge(df, "k", "o", "t")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(k#[^)]*path#", plan)) == 1


def test_a_batch_of_chunks_is_few_calls_of_the_state_store():
    import pandas as pd

    calls = []

    class Held:
        def __init__(self, rows):
            self.rows = rows

        def __getattr__(self, name):
            def call(given=None):
                calls.append(name)
                if name == "exists":
                    return bool(self.rows)
                if name == "get":
                    return self.rows[0] if len(self.rows) == 1 and len(self.rows[0]) == 4 else iter(list(self.rows))
                self.rows = {"appendList": lambda: self.rows + given, "put": lambda: given, "update": lambda: [given], "clear": list}[name]()

            return call

    class Handle:
        getValueState = getListState = lambda self, name, schema: Held([])
        getMapState = lambda self, name, key, value: None

    framer = stateful.LineFramer()
    framer.init(Handle())
    text = "".join(f"line {k} é\n" for k in range(90)).encode()
    chunks = [(k, text[k * 10 : k * 10 + 10], k * 10 + 10 >= len(text)) for k in range(-(-len(text) // 10))]
    random.Random(2).shuffle(chunks)
    rows = []
    for part in (chunks[:40], chunks[40:80], chunks[80:]):
        batch = pd.DataFrame(part, columns=["at", "data", "last"])
        rows += [row for out in framer.handleInputRows(("s",), iter([batch[:9], batch[9:]]), None) for row in out.itertuples(index=False)]
    assert [(r.session, r.line_no, r.line) for r in rows] == [("s", k, f"line {k} é") for k in range(90)]
    assert len(calls) <= 3 * 5


def test_a_join_of_streams_keeps_one_store_a_partition(spark, tmp_path):
    phases = spark.sql("select id as call_id, cast(null as long) as parent_id, if(k = 0, 'm_start', 'm_end') as phase, timestamp'2024-01-01' + make_interval(0,0,0,0,0,k) as ts, false as failed from range(20) lateral view explode(array(0, 1)) as k")
    phases.write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with stateful.state_store(spark):
        calls = live.calls(live.files(spark, str(tmp_path / "in"), phases.schema))
        run = calls.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        run.awaitTermination()
    assert run.lastProgress["stateOperators"][0]["numStateStoreInstances"] == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, live.calls(phases).collect()))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_an_input_of_a_stream_is_written_by_many_tasks(spark, monkeypatch, tmp_path):
    from turnloom.plans import stream_queries

    monkeypatch.setattr(stream_queries, "_folder", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(stream_queries, "BATCHES", 1)
    rows = spark.range(200)
    stream_queries._as_stream(spark, rows, "rows", spark.range(-1, 0))
    cores = spark.sparkContext.defaultParallelism
    assert cores > 1 and len(list((tmp_path / "rows" / "a").glob("*.parquet"))) == len(list((tmp_path / "rows" / "z0").glob("*.parquet"))) == cores
