"""Raw frames of a session as typed events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, scale
from ..session import table
from .registry import query

_PART = '{"type":"stream_event","event":{"type":"content_block_delta","index":2,"delta":{"type":"input_json_delta","partial_json":"p"}}}'
_FRAMES = (
    '{"type":"system","subtype":"init","model":"m"}',
    '{"type":"assistant","message":{"content":[{"type":"text","text":"NAME"},{"type":"text","text":""},{"type":"tool_use","id":"t1","name":"find","input":{"a":1}},{"type":"odd"}]}}',
    '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t1","content":"got"}]}}',
    '{"type":"user","message":{"content":"hello NAME"}}',
    '{"type":"stream_event","event":{"type":"content_block_start","index":2,"content_block":{"type":"tool_use","name":"put"}}}',
    _PART,
    '{"type":"stream_event","event":{"type":"content_block_stop","index":2}}',
    _PART,
    '{"type":"stream_event","event":{"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"NAME"}}}',
    '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t9","content":{"b":2}}]}}',
    '{"type":"result"}',
    '{"type":"tool_use_summary"}',
    '{"type":"stream_event","event":{"type":"message_start"}}',
    "not json",
)


@query("typed_events", """
select c_custkey as session, e.ord::int as "order", e.pos::int as pos, e.kind, e.label, e.tool_use_id, e.name, replace(e.body, 'NAME', c_name) as body from customer cross join (values
  (0, 0, 'init', null, null, null, 'm'), (1, 0, 'text', null, null, null, 'NAME'), (1, 2, 'tool_use', null, 't1', 'find', '{"a":1}'), (1, 3, 'raw', 'assistant/odd', null, null, null),
  (2, 0, 'tool_result', null, 't1', 'find', 'got'), (3, 0, 'user_message', null, null, null, 'hello NAME'), (5, 0, 'tool_input_delta', null, null, 'put', 'p'), (7, 0, 'tool_input_delta', null, null, null, 'p'),
  (8, 0, 'text_delta', null, null, null, 'NAME'), (9, 0, 'tool_result', null, 't9', 'unknown', '{"b":2}'), (10, 0, 'result', 'success', null, null, null), (11, 0, 'raw', 'tool_use_summary', null, null, null),
  (12, 0, 'raw', 'stream_event/message_start', null, null, null)) e(ord, pos, kind, label, tool_use_id, name, body)
""")
def typed_events(spark, sf_dir):
    """Every kind of frame in each customer's session."""
    raw = scale.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", "c_name", F.posexplode(F.array(*map(F.lit, _FRAMES))).alias("at", "f"))
    return frames.typed_events(raw.withColumn("frame", F.replace("f", F.lit("NAME"), F.col("c_name"))), "c_custkey", "at")


def _order_frames(spark, sf_dir):
    """Frames of a session per order: its start, uses of tools below one another, what was said, and its end."""
    o = scale.spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 2).alias("price")), "o_orderkey")
    failed = F.col("o_orderstatus") == "F"
    tools = F.array(F.col("o_orderpriority"), F.lit("Read"))
    init = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("init").alias("subtype"), F.concat(F.lit("s"), "o_orderkey").alias("session_id"), F.lit("m").alias("model"), F.when(~failed, tools).alias("tools"), F.when(failed, F.lit("plan")).alias("permissionMode"), F.when(failed, F.array(F.struct(F.lit("files").alias("name"), F.col("o_orderstatus").alias("status")))).alias("mcp_servers")))
    use = F.to_json(F.struct(F.lit("assistant").alias("type"), F.when(failed, F.concat(F.lit("t"), "o_custkey")).alias("parent_tool_use_id"), F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.struct(F.col("o_custkey").alias("key")).alias("input"))).alias("content")).alias("message")))
    said = F.to_json(F.struct(F.lit("user").alias("type"), F.when(failed, F.lit(True)).alias("isSynthetic"), F.struct(F.col("o_orderpriority").alias("content")).alias("message")))
    brought = F.lit('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t","content":"x"}]}}')
    end = F.to_json(F.struct(F.lit("result").alias("type"), F.when(failed, F.lit("error_max_turns")).alias("subtype"), F.when(failed, F.lit(True)).alias("is_error"), F.col("price").alias("total_cost_usd"), (F.col("o_custkey") * 10).alias("duration_ms"), F.when(~failed, F.col("o_custkey") % 7).alias("num_turns"), F.when(failed, F.array("o_orderpriority")).alias("errors"), F.when(~failed, F.struct(F.col("o_custkey").alias("input_tokens"))).alias("usage")))
    return o.select("o_orderkey", F.posexplode(F.array(init, use, said, brought, end, F.lit("noise"))).alias("n", "frame"))


@query("session_inits", """
select o_orderkey as session, 's' || o_orderkey as session_id, 'm' as model, case when o_orderstatus = 'F' then '' else o_orderpriority || ',Read' end as tools, case when o_orderstatus = 'F' then 'files=F' else '' end as servers, case when o_orderstatus = 'F' then 'plan' else 'default' end as permission_mode from orders
""")
def session_inits(spark, sf_dir):
    """Tools, servers and mode that sessions began with."""
    i = frames.session_inits(_order_frames(spark, sf_dir), "o_orderkey", "n")
    servers = F.array_join(F.transform("servers", lambda s: F.concat_ws("=", s["name"], s["status"])), ",")
    return i.select("session", "session_id", "model", F.array_join("tools", ",").alias("tools"), servers.alias("servers"), "permission_mode")


@query("session_results", """
select o_orderkey as session, case when o_orderstatus = 'F' then 'error_max_turns' else 'success' end as subtype, o_orderstatus = 'F' as is_error, round(o_totalprice, 2)::double as cost_usd, (o_custkey * 10)::bigint as duration_ms, case when o_orderstatus = 'F' then 0 else o_custkey % 7 end::bigint as num_turns,
  case when o_orderstatus = 'F' then '{}' else '{"input_tokens":' || o_custkey || '}' end as usage, case when o_orderstatus = 'F' then o_orderpriority end as errors from orders
""")
def session_results(spark, sf_dir):
    """Cost, duration, turns, usage and errors of sessions."""
    r = frames.session_results(_order_frames(spark, sf_dir), "o_orderkey", "n")
    return r.select("session", "subtype", "is_error", "cost_usd", "duration_ms", "num_turns", "usage", F.array_join("errors", ",").alias("errors"))


@query("tool_calls", """select o_orderkey as session, 't' || o_orderkey as tool_use_id, case when o_orderstatus = 'F' then 't' || o_custkey end as parent_tool_use_id, o_orderpriority as name, '{"key":' || o_custkey || '}' as input from orders""")
def tool_calls(spark, sf_dir):
    """Uses of tools with their parents."""
    return frames.tool_calls(_order_frames(spark, sf_dir), "o_orderkey", "n").select("session", "tool_use_id", "parent_tool_use_id", "name", "input")


@query("user_inputs", "select o_orderkey as session, o_orderpriority as content, o_orderstatus = 'F' as synthetic from orders")
def user_inputs(spark, sf_dir):
    """What users said, and what only looks so."""
    return frames.user_inputs(_order_frames(spark, sf_dir), "o_orderkey", "n").select("session", "content", "synthetic")
