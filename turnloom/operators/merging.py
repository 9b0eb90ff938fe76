"""Upserts, overlays and merges of keyed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .turns import latest


def upsert(records: DataFrame, key: str, id_column: str, updated: str) -> DataFrame:
    """The latest record of each key under the id of its first."""
    first_id = F.first(id_column).over(W.partitionBy(key).orderBy(updated, id_column))
    return latest(records.withColumn("kept_id", first_id), [key], F.desc(updated), F.desc(id_column))


def overlay(state: Column, edits: Column) -> Column:
    """Later entries win; needs the session's map policy LAST_WIN."""
    return F.map_concat(state, edits)


def overlay_all(df: DataFrame, key: str, order: str, name: str, value: str) -> DataFrame:
    """U13 over a log: the last value per (key, name), as one map per key."""
    last = df.groupBy(key, name).agg(F.max_by(value, order).alias(value))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("state"))


def section_merge(df: DataFrame, key: str, order: str, section: str, values: str) -> DataFrame:
    """Per section a shallow merge of maps, later ones on top."""
    exploded = df.select(key, order, section, F.explode(values).alias("name", "value"))
    last = exploded.groupBy(key, section, "name").agg(F.max_by("value", order).alias("value"))
    return last.groupBy(key, section).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("merged"))


def swap_keys(values: Column, mapping: Column) -> Column:
    """Replaces values of keys in the mapping, and only of those."""
    return F.transform_values(values, lambda k, v: F.coalesce(F.element_at(mapping, k), v))


def mergeable(entries: DataFrame, group: str, source: str) -> DataFrame:
    """Groups of at least two entries from one source."""
    return entries.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(source).alias("n_sources")).withColumn("mergeable", (F.col("n") >= 2) & (F.col("n_sources") == 1))


def delete(entries: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What stays, and the wanted ids that were not there."""
    return entries.join(wanted, key, "left_anti"), wanted.join(entries, key, "left_anti")


def activate(entries: DataFrame, key: str, chosen: Column) -> DataFrame:
    """Exactly the chosen entry is active."""
    return entries.withColumn("is_profile", F.col(key) == chosen)


def join_distinct(parts: Column) -> Column:
    """Union of lists in the order of first sight."""
    return F.array_distinct(F.flatten(parts))
