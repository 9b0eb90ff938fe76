"""Readers for session logs, score logs and documents that hold rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.scale import numbered

EVENT = (
    "type string, timestamp string, ts string, turn int, session_id string, form_id string, form_name string, user_message string, message string, role string, raw_text string, "
    "parsed_actions string, form_values string, initial_form_values string, delta string, source string, cost_usd double, duration_ms double, reason string, fields_filled int"
)

LINE = "value"


def jsonl(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = False, glob: str | None = None) -> DataFrame:
    """One object per line with its file name and line order. Lenient skips blanks and bad lines; strict fails.

    ``line`` orders lines within a file; it is unique, not consecutive.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = reader.text(paths).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line")).where(strip(F.col(LINE)) != "")
    mode = "FAILFAST" if strict else "PERMISSIVE"
    if not strict:
        lines = lines.where(F.try_parse_json(LINE).isNotNull() & F.startswith(F.regexp_replace(F.col(LINE), r"^\s+", ""), F.lit("{")))
    return lines.select("file", "line", F.from_json(LINE, schema, {"mode": mode}).alias("r")).select("file", "line", "r.*")


def sessions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S3: simulation logs, the session named by its file's stem."""
    return jsonl(spark, paths, EVENT, glob="*.jsonl").withColumn("session_id", F.regexp_replace("file", r"\.jsonl$", ""))


def header_and_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The _meta object and the records of one file."""
    lines = spark.read.text(path).where(strip(F.col(LINE)) != "")
    is_meta = F.get_json_object(LINE, "$._meta").isNotNull()
    return lines.where(is_meta).select(F.get_json_object(LINE, "$._meta").alias("meta")), lines.where(~is_meta).select(F.from_json(LINE, schema).alias("r")).select("r.*")


def document_rows(spark: SparkSession, path: str, key: str, row_schema: str) -> DataFrame:
    """The rows under a key of whole-file JSON documents."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.from_json(F.get_json_object(LINE, f"$.{key}"), f"array<struct<{row_schema}>>")).alias("pos", "r")).select("file", "pos", "r.*")


# Fixed value: a whole line of a score log.
SCORE_LINE = r"^\s*\[\s*(\d+)\]\s+(\S+)\s+score=([0-9.]+)\s*$"


def scraped_scores(lines: DataFrame, order: str, pattern: str = SCORE_LINE) -> DataFrame:
    """(idx, id, score) of a log's first run 0, 1, 2 ...; a 0 restarts it, any other gap ends the reading for good.

    ``order`` is a numeric column. A line is met with the one before it by their places, so a log is not one task's.
    """
    hit = lines.where(F.col("value").rlike(pattern)).select(order, *(F.regexp_extract("value", pattern, k).alias(n) for k, n in ((1, "idx"), (2, "id"), (3, "score"))))
    hit = numbered(hit.withColumns({"idx": F.col("idx").try_cast("int"), "score": F.col("score").try_cast("double")}), F.col(order), [], "place")
    before = hit.select((F.col("place") + 1).alias("place"), F.col("idx").alias("before"))
    hit = hit.join(before, "place", "left").withColumn("fits", (F.col("idx") == 0) | F.coalesce(F.col("idx") == F.col("before") + 1, F.lit(False)))
    end = hit.agg(F.min(F.when(~F.col("fits"), F.col("place")))).first()[0]
    read = hit.where(F.col("place") < end) if end is not None else hit
    start = read.agg(F.max(F.when(F.col("idx") == 0, F.col("place")))).first()[0]
    return read.where(F.col("place") >= (start or 0)).select("idx", "id", "score")


def scraped_steps(lines: DataFrame, order: str) -> DataFrame:
    """Repeated {'loss': ..} dicts of a trainer's log as (order, step, metrics)."""
    dicts = F.regexp_extract_all("value", F.lit(r"\{('(?:[^{}])*)\}"), F.lit(1))
    each = lines.select(order, F.posexplode(dicts).alias("at", "body"))
    pairs = F.transform(F.regexp_extract_all("body", F.lit(r"'([^']+)':\s*'?([-+0-9.eE]+)'?"), F.lit(0)), lambda p: F.struct(F.regexp_extract(p, r"'([^']+)'", 1).alias("k"), F.regexp_extract(p, r":\s*'?([-+0-9.eE]+)", 1).try_cast("double").alias("v")))
    return numbered(each, F.col(order), ["at"], "step").select("step", F.map_from_entries(pairs).alias("metrics"))


def training_metrics(spark: SparkSession, path: str, key: str = "log_history") -> DataFrame:
    """(step, metrics) of a trainer's log, read by its suffix: a ``.json`` document holds dicts under a key, any other file is scraped.

    Steps count from 1 in the order of the log; in a document, values that are no numbers are null.
    """
    if path.endswith(".json"):
        text = spark.read.text(path, wholetext=True)
        found = text.select(F.posexplode(F.from_json(F.get_json_object(LINE, f"$.{key}"), "array<map<string,string>>")).alias("pos", "m"))
        return found.select((F.col("pos") + 1).alias("step"), F.transform_values("m", lambda k, v: v.try_cast("double")).alias("metrics"))
    lines = spark.read.text(path).select(LINE, F.monotonically_increasing_id().alias("line"))
    return scraped_steps(lines, "line")


def key_value_store(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON map of records keyed by email; an unreadable file reads as empty."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.coalesce(F.from_json(LINE, f"map<string,struct<{value_schema}>>"), F.create_map().cast(f"map<string,struct<{value_schema}>>"))).alias("email", "r")).select("email", "r.*")


def write_events(df: DataFrame, path: str, session_id: str | Column, partition_by: str | None = None) -> None:
    """Appends events as JSON lines, stamped with session and time."""
    session = F.lit(session_id) if isinstance(session_id, str) else session_id
    out = df.withColumns({"session_id": session, "ts": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")}).write.mode("append")
    (out.partitionBy(partition_by) if partition_by else out).json(path)


def export_session(events: DataFrame, session_id: str, *surrogates: str) -> DataFrame:
    """One session's events as JSON text without surrogate ids."""
    own = events.where(F.col("session_id") == session_id).drop(*surrogates)
    return own.select(F.to_json(F.struct(*own.columns)).alias("value"))


def training_write(df: DataFrame, path: str) -> None:
    """Messages only, as JSON lines."""
    df.select("messages").write.mode("overwrite").json(path)


def archived_write(df: DataFrame, path: str, version: str) -> str:
    """A new version beside the old ones instead of overwriting."""
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").json(target)
    return target
