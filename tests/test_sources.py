"""Readers and streams over files written by the test."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from turnloom.sources import logs, text_formats
from turnloom.streaming import live


def test_jsonl(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text('{"type":"state_init","turn":0}\n\nnot json\n[1]\n{"type":"session_end","turn":2,"fields_filled":4}\n')
    (tmp_path / "skip.txt").write_text('{"type":"x"}\n')
    rows = logs.sessions(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["session_id"], r["type"], r["fields_filled"]) for r in rows] == [("s1", "state_init", None), ("s1", "session_end", 4)]
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        logs.jsonl(spark, str(tmp_path / "s1.jsonl"), "type string", strict=True).collect()


def test_documents_with_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"config": {"k": 1}, "rows": [{"id": "x", "score": 0.5}, {"id": "y", "score": None}]}, indent=1))
    assert [(r["pos"], r["id"], r["score"]) for r in logs.document_rows(spark, str(tmp_path / "a.json"), "rows", "id:string,score:double").collect()] == [(0, "x", 0.5), (1, "y", None)]
    (tmp_path / "p.jsonl").write_text('{"_meta":{"model":"m"}}\n{"test_id":"t1"}\n{"test_id":"t2"}\n')
    meta, records = logs.header_and_records(spark, str(tmp_path / "p.jsonl"), "test_id string")
    assert json.loads(meta.first()["meta"]) == {"model": "m"} and records.count() == 2
    (tmp_path / "kv.json").write_text('{"a@b.c":{"draft_id":"1"}}')
    assert [tuple(r) for r in logs.key_value_store(spark, str(tmp_path / "kv.json"), "draft_id:string").collect()] == [("a@b.c", "1")]
    (tmp_path / "bad.json").write_text("{oops")
    assert logs.key_value_store(spark, str(tmp_path / "bad.json"), "draft_id:string").collect() == []


def test_scraped_logs(spark):
    def scraped(*text):
        return [tuple(r) for r in logs.scraped_scores(spark.createDataFrame(list(enumerate(text)), "n int, value string"), "n").orderBy("idx").collect()]

    assert scraped("[ 0] a score=0.1", " [1]  b score=0.2 ", "noise", "x [2] y score=1", "[ 0] a score=0.5", "[ 1] b score=0.6", "[ 3] d score=0.9") == [(0, "a", 0.5), (1, "b", 0.6)]
    assert scraped(*(f"[{i}] t{k} score=0.{k}" for k, i in enumerate((0, 1, 2, 5, 0, 1), 1))) == [(0, "t1", 0.1), (1, "t2", 0.2), (2, "t3", 0.3)]
    assert scraped("[1] a score=1") == [] and scraped("nothing") == []
    steps = spark.createDataFrame([(0, "x {'loss': 0.5, 'reward': '1.5'} y"), (1, "{'loss': 0.25}")], "n int, value string")
    assert [(r["step"], r["metrics"].get("loss"), r["metrics"].get("reward")) for r in logs.scraped_steps(steps, "n").orderBy("step").collect()] == [(1, 0.5, 1.5), (2, 0.25, None)]


def test_sink_and_export(spark, tmp_path):
    logs.write_events(spark.createDataFrame([("user_message", 1)], "type string, sid int"), str(tmp_path / "log"), "s9")
    logs.write_events(spark.createDataFrame([("error", 2)], "type string, sid int"), str(tmp_path / "log"), "s9")
    back = spark.read.json(str(tmp_path / "log"))
    assert back.count() == 2 and {r["session_id"] for r in back.collect()} == {"s9"}
    assert all("sid" not in json.loads(r["value"]) for r in logs.export_session(back, "s9", "sid").collect())
    target = logs.archived_write(back, str(tmp_path / "out"), "1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        logs.archived_write(back, str(tmp_path / "out"), "1")
    assert target.endswith("version=1")


def test_frames(spark):
    body = "event: text\r\ndata: {\"a\":1}\r\n\r\ndata: one\ndata: two\n\n\n"
    rows = text_formats.sse_events(spark.createDataFrame([(1, body)], "k int, body string"), "body").collect()
    assert [(r["event"], r["data"]) for r in rows] == [("text", '{"a":1}'), ("message", "one\ntwo")]
    chunks = spark.createDataFrame([(1, 0, '{"x":1}\n{"x'), (1, 1, '":2}\nbad\n'), (1, 2, '{"x":3}')], "k int, n int, c string")
    got = text_formats.framed_json(chunks, "c", "n", ["k"]).select(F.try_variant_get("event", "$.x", "int").alias("x")).collect()
    assert [r["x"] for r in got] == [1, 2, 3]


def test_markdown(spark):
    doc = "# T\n## P1 first\n**Form state:**\n```json\n{\"a\":1}\n```\nrest\n## P2\nnothing\n"
    df = spark.createDataFrame([(doc,)], "t string").select(F.explode(text_formats.sections(F.col("t"))).alias("s")).select("s.*")
    rows = df.withColumn("state", text_formats.labelled_block(F.col("body"), "Form state")).collect()
    assert [(r["title"], r["state"]) for r in rows] == [("P1 first", '{"a":1}'), ("P2", None)]
    probes = spark.createDataFrame([("P1", None, "x"), ("P2", "P1", ""), ("P3", "P2", "")], "id string, ref string, state string")
    assert {r["id"]: r["state"] for r in text_formats.resolve_references(probes, "id", "ref", "state").collect()} == {"P1": "x", "P2": "x", "P3": ""}


def test_streams(spark, tmp_path):
    src = spark.sql("select id as user_id, timestamp'2024-01-01' + make_interval(0,0,0,0,id * 7) as ts, cast(id as double) as v from range(30)")
    src.write.parquet(str(tmp_path / "in"))
    stream = live.files(spark, str(tmp_path / "in"), src.schema)
    got = live.drained(live.windowed(stream, "ts", [], "v"), "", str(tmp_path / "c1"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.windowed(src, "ts", [], "v").collect()))
    live.latest_by_batch(live.files(spark, str(tmp_path / "in"), src.schema).withColumn("k", F.col("user_id") % 3), ["k"], ["ts"], str(tmp_path / "out"), str(tmp_path / "c2"))
    assert {r["k"]: r["user_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: 27, 1: 28, 2: 29}
    pairs = live.paired_calls(src.select(F.col("user_id").alias("call_id"), "ts"), src.select(F.col("user_id").alias("call_id"), (F.col("ts") + F.expr("interval 5 minutes")).alias("ts")), "call_id")
    assert pairs.count() == 30


def test_a_drained_stream_without_a_target_stays_beside_its_checkpoint(spark, tmp_path):
    src = spark.range(3).selectExpr("id as user_id", "timestamp'2024-01-01' as ts", "1.0d as v")
    src.write.parquet(str(tmp_path / "in"))
    for mode in ("complete", "append"):
        got = live.drained(live.files(spark, str(tmp_path / "in"), src.schema) if mode == "append" else live.windowed(live.files(spark, str(tmp_path / "in"), src.schema), "ts", [], "v"), "", str(tmp_path / mode), mode)
        assert got.count() == (3 if mode == "append" else 1)
        assert all(f.startswith((tmp_path / f"{mode}-rows").as_uri()) for f in got.inputFiles())


def test_typed_tables_of_frames_with_missing_and_odd_fields(spark):
    from turnloom.operators import frames

    texts = [
        '{"type":"system","subtype":"init","session_id":"s","model":"m","tools":["a","b"],"mcp_servers":[{"name":"f","status":"ok"}],"permissionMode":"plan","v":"1.2","skills":["x"]}', '{"type":"system","subtype":"init"}',
        '{"type":"result","subtype":"error_during_execution","is_error":true,"total_cost_usd":0.25,"duration_ms":12,"num_turns":3,"usage":{"input_tokens":5},"errors":["e1"],"result":"r"}', '{"type":"result"}', "broken", None,
        '{"type":"assistant","parent_tool_use_id":"p","message":{"content":[{"type":"text","text":"t"},{"type":"tool_use","id":"u","name":"n"}]}}', '{"type":"user","isSynthetic":true,"message":{"content":[{"type":"text","text":"t"}]}}',
        '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"u","content":"c"}]}}',
    ]
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "s string, n int, frame string")
    first, second = frames.session_inits(df, "s", "n", version="v").orderBy("order").collect()
    assert (first["tools"], first["permission_mode"], first["version"], first["skills"], first["servers"][0]["status"]) == (["a", "b"], "plan", "1.2", ["x"], "ok")
    assert (second["tools"], second["servers"], second["permission_mode"], second["version"], second["agents"]) == ([], [], "default", None, None)
    bad, plain = frames.session_results(df, "s", "n").orderBy("order").collect()
    assert (bad["is_error"], bad["cost_usd"], bad["duration_ms"], bad["num_turns"], bad["usage"], bad["errors"], bad["result"]) == (True, 0.25, 12, 3, '{"input_tokens":5}', ["e1"], "r")
    assert (plain["subtype"], plain["is_error"], plain["cost_usd"], plain["usage"], plain["errors"], plain["structured_output"]) == ("success", False, 0.0, "{}", None, None)
    assert [tuple(r) for r in frames.tool_calls(df, "s", "n").collect()] == [("s", 6, 1, "u", "p", "n", "{}")]
    assert [tuple(r) for r in frames.user_inputs(df, "s", "n").collect()] == [("s", 7, '[{"text":"t","type":"text"}]', True)]
