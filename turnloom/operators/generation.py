"""Training examples, drafts and mutations, driven by hashes so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import content_module
from .sampling import unit_interval, weighted_choice


def module_examples(turns: DataFrame, flags: str, output: str) -> DataFrame:
    """G1: one row for the router and the text responder of each turn, and one per module that its flags call for."""
    f = F.col(flags)
    modules = F.array_compact(F.array(
        F.lit("action_router"), F.when(f["has_new_data"], "data_extractor"), F.when(f["needs_choice"], "choice_builder"), F.when(f["wants_review"], "review_builder"), F.lit("text_responder"),
    ))
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("user_message").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col(output).alias("content")))
    return turns.select(*turns.columns, F.explode(modules).alias("module"), messages.alias("messages"))


def review_target(state: Column, least: int = 3) -> Column:
    """A list of filled fields, null where too few are."""
    lines = F.transform(F.array_sort(F.map_entries(state)), lambda e: F.concat(F.lit("- "), F.replace(e["key"], F.lit("_"), F.lit(" ")), F.lit(": "), e["value"]))
    return F.when(F.size(lines) >= least, F.array_join(lines, "\n"))


def connected(parts: Column) -> Column:
    """One, two or several clauses in a sentence."""
    n = F.size(parts)
    return F.when(n == 1, F.get(parts, F.lit(0))).when(n == 2, F.concat_ws(" and ", parts)).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(parts, -1)))


def message_from(templates: DataFrame, values: DataFrame, seed: str) -> DataFrame:
    """(record_id, field_id, value) filled into one of the field's templates, which hold {value}."""
    listed = templates.groupBy("field_id").agg(F.sort_array(F.collect_list("template")).alias("templates"))
    pick = F.pmod(F.xxhash64(F.lit(seed), F.col("record_id"), F.col("field_id")), F.size("templates")).cast("int")
    return values.join(listed, "field_id").select("record_id", "field_id", "value", F.replace(F.get("templates", pick), F.lit("{value}"), F.col("value")).alias("message"))


def example_type(seed: str, key: str, names: list[str], weights: list[float]) -> Column:
    """G7."""
    return F.get(F.array(*(F.lit(n) for n in names)), weighted_choice(unit_interval(seed, key), weights))


def partial_draft(values: DataFrame, seed: str, keep: float, always: list[str]) -> DataFrame:
    """Sections of a record kept by their own hash; guarded ones always."""
    stays = unit_interval(seed, "record_id", "section_id") < keep
    return values.where(stays | F.col("section_id").isin(always))


def option_swap(value: Column, options: Column, u: Column) -> Column:
    """Another option, chosen by u in [0, 1); null where there is none."""
    others = F.filter(options, lambda o: o != value)
    return F.when(F.size(others) > 0, F.get(others, F.floor(u * F.size(others)).cast("int")))


def accepted_mutation(original: Column, mutated: Column, least: int = 5) -> Column:
    """The first reason against a mutation; null if it is accepted."""
    same = F.lower(F.trim(mutated)) == F.lower(F.trim(original))
    return F.when(mutated.isNull(), "missing").when(F.length(F.trim(mutated)) < least, "too_short").when(same, "unchanged")


def by_module(turns: DataFrame, flags: str) -> DataFrame:
    """The module that scores each turn."""
    return turns.withColumn("content_module", content_module(F.col(flags)))
