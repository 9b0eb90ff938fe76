"""Raw frames of an agent's output as typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT = "array<struct<pos:int,kind:string,label:string,tool_use_id:string,name:string,slot:int,body:string>>"


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _body(v: Column) -> Column:
    """A text as it is, anything else as JSON."""
    return F.when(_is(v, "STRING"), _get(v, "$")).otherwise(F.to_json(v))


def _event(pos: Column | int, kind: str, label: Column | None = None, tool: Column | None = None, name: Column | None = None, slot: Column | None = None, body: Column | None = None) -> Column:
    none = F.lit(None)
    column = lambda c, t: (none if c is None else c).cast(t)
    place = F.lit(pos) if isinstance(pos, int) else pos
    return F.struct(place.cast("int").alias("pos"), F.lit(kind).alias("kind"), *(column(c, "string").alias(n) for c, n in ((label, "label"), (tool, "tool_use_id"), (name, "name"))), column(slot, "int").alias("slot"), column(body, "string").alias("body"))


def _result(block: Column, pos: Column | int) -> Column:
    return _event(pos, "tool_result", tool=_get(block, "$.tool_use_id"), body=_body(_get(block, "$.content", "variant")))


def _block(block: Column, pos: Column) -> Column:
    """An assistant's block; null for a text without characters."""
    kind = _get(block, "$.type")
    return (
        F.when(kind == "text", F.when(_get(block, "$.text") != "", _event(pos, "text", body=_get(block, "$.text"))))
        .when(kind == "tool_use", _event(pos, "tool_use", tool=_get(block, "$.id"), name=_get(block, "$.name"), body=F.to_json(_get(block, "$.input", "variant"))))
        .when(kind == "tool_result", _result(block, pos)).otherwise(_event(pos, "raw", F.concat(F.lit("assistant/"), kind)))
    )


def typed_events(frames: DataFrame, session: str, order: str, frame: str = "frame") -> DataFrame:
    """(session, order, pos, kind, label, tool_use_id, name, body) of frames that are JSON texts.

    A result is named after the last earlier use of its id, else ``unknown``; an input's part after the tool whose block
    is open at its index. Frames that are not JSON objects, blocks' starts and stops and texts without characters give
    nothing. A null id or index meets other nulls of its session.
    """
    v = F.col("_v")
    none = F.array().cast(EVENT)
    content = _get(v, "$.message.content", "variant")
    blocks = F.coalesce(_get(v, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    answer = F.get(F.filter(blocks, lambda b: _get(b, "$.type") == "tool_result"), F.lit(0))
    inner, slot, kind, part = map(F.col, ("_inner", "_slot", "_kind", "_part"))
    opened = F.when((_get(v, "$.event.content_block.type") == "tool_use") & slot.isNotNull(), _event(0, "opened", name=_get(v, "$.event.content_block.name"), slot=slot))
    written = F.when((part == "text_delta") & (_get(v, "$.event.delta.text") != ""), _event(0, "text_delta", body=_get(v, "$.event.delta.text"))).when(
        (part == "input_json_delta") & (_get(v, "$.event.delta.partial_json") != ""), _event(0, "tool_input_delta", slot=slot, body=_get(v, "$.event.delta.partial_json"))
    )
    streamed = (
        F.when(inner == "content_block_start", opened).when(inner == "content_block_delta", written).when(inner == "content_block_stop", F.when(slot.isNotNull(), _event(0, "closed", slot=slot)))
        .when(_get(v, "$.event", "variant").isNotNull(), _event(0, "raw", F.concat(F.lit("stream_event/"), inner)))
    )
    single = (
        F.when((kind == "system") & (_get(v, "$.subtype") == "init"), _event(0, "init", body=_get(v, "$.model"))).when(kind == "system", _event(0, "raw", F.concat(F.lit("system/"), _get(v, "$.subtype"))))
        .when(kind == "user", F.when(answer.isNotNull(), _result(answer, 0)).otherwise(_event(0, "user_message", body=_body(content))))
        .when(kind == "stream_event", streamed).when(kind == "result", _event(0, "result", F.coalesce(_get(v, "$.subtype"), F.lit("success")))).otherwise(_event(0, "raw", kind))
    )
    found = F.when(kind == "assistant", F.transform(blocks, _block)).otherwise(F.array(single))
    # no filter stands between: it would be pushed below, where each frame would be parsed once more
    parsed = frames.select(F.col(session).alias("session"), F.col(order).alias("order"), F.try_parse_json(frame).alias("_v"))
    read = parsed.select("*", _is(v, "OBJECT").alias("_object"), _get(v, "$.type").alias("_kind"), _get(v, "$.event.type").alias("_inner"), _get(v, "$.event.index", "int").alias("_slot"), _get(v, "$.event.delta.type").alias("_part"))
    each = read.select("session", "order", F.explode(F.array_compact(F.when(F.col("_object"), F.coalesce(found, none)))).alias("e")).select("session", "order", "e.*")
    # one pass over all rows, parsed once: those with an id, or with an index, need the order of their key, others are dealt by their place
    by_id, by_slot = F.col("kind").isin("tool_use", "tool_result"), F.col("kind").isin("opened", "closed", "tool_input_delta")
    keyed = each.withColumns({"_by": F.when(by_id, 0).when(by_slot, 1).otherwise(2), "_id": F.when(by_id, F.col("tool_use_id")), "_index": F.when(by_slot, F.col("slot")), "_place": F.when(~by_id & ~by_slot, F.xxhash64("order", "pos"))})
    names = F.when((F.col("kind") == "tool_use") & F.col("name").isNotNull() | F.col("kind").isin("opened", "closed"), F.struct("name"))
    so_far = W.partitionBy("session", "_by", "_id", "_index", "_place").orderBy("order", "pos").rowsBetween(W.unboundedPreceding, 0)
    held = keyed.withColumn("_held", F.last(names, ignorenulls=True).over(so_far)["name"]).where(~F.col("kind").isin("opened", "closed"))
    name = F.when(F.col("kind") == "tool_result", F.coalesce("_held", F.lit("unknown"))).when(F.col("kind") == "tool_input_delta", F.col("_held")).otherwise(F.col("name"))
    return held.withColumn("name", name).drop("slot", "_by", "_id", "_index", "_place", "_held")


def _frames_of(frames: DataFrame, session: str, order: str, frame: str) -> DataFrame:
    return frames.select(F.col(session).alias("session"), F.col(order).alias("order"), F.try_parse_json(frame).alias("_v")).where(_is(F.col("_v"), "OBJECT"))


def _json(v: Column, path: str) -> Column:
    return F.to_json(_get(v, path, "variant"))


def session_inits(frames: DataFrame, session: str, order: str, frame: str = "frame", version: str = "version") -> DataFrame:
    """What sessions began with, a row per ``system/init`` frame.

    Tools and servers are empty arrays and the mode is ``default`` where a frame lacks them; agents and skills are null then.
    ``version`` names the field of the program's version.
    """
    v = F.col("_v")
    listed = lambda path: _get(v, path, "array<string>")
    begun = _frames_of(frames, session, order, frame).where((_get(v, "$.type") == "system") & (_get(v, "$.subtype") == "init"))
    return begun.select(
        "session", "order", _get(v, "$.session_id").alias("session_id"), _get(v, "$.model").alias("model"), F.coalesce(listed("$.tools"), F.array().cast("array<string>")).alias("tools"),
        F.coalesce(_get(v, "$.mcp_servers", "array<struct<name:string,status:string>>"), F.array().cast("array<struct<name:string,status:string>>")).alias("servers"),
        F.coalesce(_get(v, "$.permissionMode"), F.lit("default")).alias("permission_mode"), _get(v, f"$.{version}").alias("version"), listed("$.agents").alias("agents"), listed("$.skills").alias("skills"),
    )


def session_results(frames: DataFrame, session: str, order: str, frame: str = "frame") -> DataFrame:
    """How sessions ended, a row per ``result`` frame.

    Missing numbers are 0, a missing flag false, a missing subtype ``success``, missing usage an empty object; errors and a structured output stay null.
    Usage and the structured output are JSON texts.
    """
    v = F.col("_v")
    number = lambda path, kind: F.coalesce(_get(v, path, kind), F.lit(0).cast(kind))
    ended = _frames_of(frames, session, order, frame).where(_get(v, "$.type") == "result")
    return ended.select(
        "session", "order", F.coalesce(_get(v, "$.subtype"), F.lit("success")).alias("subtype"), _get(v, "$.session_id").alias("session_id"), F.coalesce(_get(v, "$.is_error", "boolean"), F.lit(False)).alias("is_error"),
        F.coalesce(_get(v, "$.result"), F.lit("")).alias("result"), number("$.duration_ms", "long").alias("duration_ms"), number("$.duration_api_ms", "long").alias("duration_api_ms"), number("$.total_cost_usd", "double").alias("cost_usd"),
        number("$.num_turns", "long").alias("num_turns"), F.coalesce(_json(v, "$.usage"), F.lit("{}")).alias("usage"), F.coalesce(_json(v, "$.modelUsage"), F.lit("{}")).alias("model_usage"),
        _json(v, "$.structured_output").alias("structured_output"), _get(v, "$.errors", "array<string>").alias("errors"),
    )


def tool_calls(frames: DataFrame, session: str, order: str, frame: str = "frame") -> DataFrame:
    """(session, order, pos, tool_use_id, parent_tool_use_id, name, input) of every use of a tool; the parent is null at the top."""
    v = F.col("_v")
    blocks = _get(v, "$.message.content", "array<variant>")
    used = _frames_of(frames, session, order, frame).where(_get(v, "$.type") == "assistant").select("session", "order", _get(v, "$.parent_tool_use_id").alias("parent_tool_use_id"), F.posexplode(blocks).alias("pos", "b"))
    b = F.col("b")
    return used.where(_get(b, "$.type") == "tool_use").select("session", "order", "pos", _get(b, "$.id").alias("tool_use_id"), "parent_tool_use_id", _get(b, "$.name").alias("name"), F.coalesce(_json(b, "$.input"), F.lit("{}")).alias("input"))


def user_inputs(frames: DataFrame, session: str, order: str, frame: str = "frame") -> DataFrame:
    """(session, order, content, synthetic) of user frames that bring no tool's result; content that is no text is JSON."""
    v = F.col("_v")
    blocks = F.coalesce(_get(v, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    brings = F.exists(blocks, lambda b: F.coalesce(_get(b, "$.type") == "tool_result", F.lit(False)))
    said = _frames_of(frames, session, order, frame).where((_get(v, "$.type") == "user") & ~brings)
    return said.select("session", "order", _body(_get(v, "$.message.content", "variant")).alias("content"), F.coalesce(_get(v, "$.isSynthetic", "boolean"), F.lit(False)).alias("synthetic"))
