"""Event-stream frames and Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def sse_events(df: DataFrame, body: str) -> DataFrame:
    """(event, data) of each frame, in order; a frame without an event name is a message."""
    frames = df.select("*", F.posexplode(F.split(F.replace(F.col(body), F.lit("\r\n"), F.lit("\n")), "\n\n")).alias("frame_at", "frame")).where(strip(F.col("frame")) != "")
    name = F.regexp_extract("frame", r"(?m)^event:\s*(.*)$", 1)
    data = F.array_join(F.transform(F.regexp_extract_all("frame", F.lit(r"(?m)^data:\s?(.*)$"), F.lit(1)), lambda x: x), "\n")
    return frames.select(*(c for c in df.columns if c != body), "frame_at", F.when(name == "", "message").otherwise(name).alias("event"), data.alias("data"))


def sse_frame(event: Column, data: Column) -> Column:
    """S9."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def framed_json(df: DataFrame, chunk: str, order: str, keys: list[str]) -> DataFrame:
    """JSON lines out of chunks that cut lines anywhere; unreadable lines go, the unfinished tail counts."""
    whole = df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, chunk))), lambda x: x[chunk]), "").alias("whole"))
    lines = whole.select(*keys, F.posexplode(F.split("whole", "\n")).alias("line_at", "line")).where(strip(F.col("line")) != "")
    return lines.withColumn("event", F.try_parse_json("line")).where(F.col("event").isNotNull()).drop("line")


def sections(text: Column, level: int = 2) -> Column:
    """(title, body) of each section below headings of one level."""
    parts = F.slice(F.split(text, rf"(?m)^{'#' * level}\s+"), 2, 100_000)
    return F.transform(parts, lambda p: F.struct(strip(F.split_part(p, F.lit("\n"), F.lit(1))).alias("title"), strip(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)$", 1)).alias("body")))


def labelled_block(body: Column, label: str) -> Column:
    """The fenced block after a bold label; null without it."""
    found = F.regexp_extract(body, rf"(?s)\*\*{label}[^\n]*\*\*[^\n]*\n+```\w*\n(.*?)```", 1)
    return F.when(found != "", strip(found))


def fenced_lines(text: Column) -> Column:
    """Lines of the first fenced block."""
    return F.filter(F.split(F.regexp_extract(text, r"(?s)```\w*\n(.*?)```", 1), "\n"), lambda x: strip(x) != "")


def body_after(text: Column, heading: str) -> Column:
    """The fenced block after a heading."""
    return strip(F.regexp_extract(text, rf"(?s){heading}.*?```\w*\n(.*?)```", 1))


def resolve_references(probes: DataFrame, key: str, ref: str, value: str) -> DataFrame:
    """An empty value is copied from the referenced row, one hop."""
    other = probes.select(F.col(key).alias(ref), F.col(value).alias("_other"))
    return probes.join(other, ref, "left").withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), "_other")).drop("_other")
