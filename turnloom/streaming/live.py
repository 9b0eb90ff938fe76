"""Streaming twins of the batch operators.

Watermarks and windows are additions; the keyed state, pairing and ordered folds follow the live log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: StructType | str, pattern: str | None = None) -> DataFrame:
    """Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def windowed(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling windows with a watermark: count and sum per key."""
    watched = events.withWatermark(time, late) if events.isStreaming else events
    counted = watched.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def session_gaps(events: DataFrame, time: str, key: str, gap: str, late: str = "2 days") -> DataFrame:
    """Activity sessions that end after a gap."""
    watched = events.withWatermark(time, late) if events.isStreaming else events
    return watched.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def paired_calls(starts: DataFrame, ends: DataFrame, key: str, most: str = "1 hour") -> DataFrame:
    """Start and end events of a call within a bound, as a stream-stream join; both have ``ts``."""
    a = starts.withWatermark("ts", most).select(F.col(key).alias("call"), F.col("ts").alias("started"))
    b = ends.withWatermark("ts", most).select(F.col(key), F.col("ts").alias("ended"))
    return a.join(b, (F.col("call") == F.col(key)) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {most}"))).drop("call")


def calls(phases: DataFrame, most: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls of a log of phases (call_id, parent_id, phase, ts, failed), with those that never ended.

    ``phase`` ends in ``_start`` or ``_end``. A start without an end within ``most`` is a row too, once the watermark has passed its
    bound: ``unfinished``, with a null end. Ends that come later or without a start are dropped. ``status`` is done, failed or
    unfinished; ``kind`` is the phase without its ending. Rows of a stream may come up to ``late`` behind the latest one.
    """
    kind = F.regexp_replace("phase", "_(start|end)$", "")
    timed = phases.withWatermark("ts", late) if phases.isStreaming else phases
    starts = timed.where(F.col("phase").endswith("_start")).select("call_id", "parent_id", kind.alias("kind"), F.col("ts").alias("started"))
    ends = timed.where(F.col("phase").endswith("_end")).select(F.col("call_id").alias("e_id"), kind.alias("e_kind"), F.col("ts").alias("ended"), F.coalesce("failed", F.lit(False)).alias("failed"))
    within = (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {most}"))
    joined = starts.join(ends, (F.col("call_id") == F.col("e_id")) & (F.col("kind") == F.col("e_kind")) & within, "left_outer")
    status = F.when(F.col("ended").isNull(), "unfinished").when(F.col("failed"), "failed").otherwise("done")
    return joined.select("call_id", "parent_id", "kind", "started", "ended", status.alias("status"))


def latest_by_batch(stream: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str) -> None:
    """Keyed upsert: each batch adds its latest row per key; readers take the latest of those."""

    def put(batch: DataFrame, number: int) -> None:
        w = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
        last = batch.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
        last.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained(stream: DataFrame, target: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there; its result is a table in the target folder, whatever its size.

    In the modes other than append each batch is written in turn to one of two folders, and the last is read. Without a target
    the table lies beside the checkpoint.
    """
    spark, target = stream.sparkSession, target or f"{checkpoint}-rows"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(target)
    last = []

    def put(batch: DataFrame, number: int) -> None:
        last[:] = [f"{target}/{number % 2}"]
        batch.write.mode("overwrite").parquet(last[0])

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)
