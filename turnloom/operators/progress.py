"""Progress, previews and nudges: a catalogue met with records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import displayed


def section_progress(required: DataFrame) -> DataFrame:
    """Required and filled per record and section, from ``validation.required`` rows."""
    out = required.groupBy("record_id", "section_pos", "section_id").agg(F.count("*").alias("required"), F.count_if("filled").alias("filled"))
    return out.withColumn("complete", (F.col("required") > 0) & (F.col("filled") >= F.col("required")))


def state_summary(progress: DataFrame) -> DataFrame:
    """Totals, whole percent and a line per section, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("section_pos", "section_id", "filled", "required"))), lambda s: F.concat(s["section_id"], F.lit(": "), s["filled"].cast("string"), F.lit("/"), s["required"].cast("string")))
    out = progress.groupBy("record_id").agg(F.sum("filled").alias("filled"), F.sum("required").alias("required"), F.array_join(lines, ", ").alias("sections"), F.count_if("complete").alias("n_complete"), F.count("*").alias("n_sections"))
    return out.withColumn("percent", F.when(F.col("required") == 0, 100).otherwise(F.round(100.0 * F.col("filled") / F.col("required")).cast("int")))


def nudge(turn: Column, unfilled_file: Column, percent: Column, n_complete: Column, n_sections: Column) -> Column:
    """P50: the first tip that is due, null before turn 2."""
    file_due = (turn >= 3) & unfilled_file & ((turn == 3) | (turn % 5 == 0))
    review_due = (n_complete > 0) & (n_complete < n_sections) & (percent > 20) & (percent < 90)
    half_due = (turn >= 8) & (turn % 8 == 0) & percent.between(30, 80)
    return F.when(turn < 2, F.lit(None).cast("string")).when(file_due, "upload_files").when(review_due, "review_section").when(half_due, "show_progress")


def screen_view(progress: DataFrame, percent_bar: int = 10) -> DataFrame:
    """A text view of a record's progress, one bar per section."""
    bar = F.concat(F.repeat(F.lit("#"), F.floor(F.col("filled") * percent_bar / F.greatest(F.col("required"), F.lit(1))).cast("int")), F.when(F.col("complete"), " done").otherwise(""))
    return progress.withColumn("line", F.concat(F.col("section_id"), F.lit(" "), bar)).groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_pos", "line"))), lambda x: x["line"]), "\n").alias("view"))


def preview(values: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per record and section the labels and shown values that are filled, groups numbered from 1."""
    part = r"^(.+?)\.(\d+)\.(.+)$"
    pattern = F.regexp_replace("field_id", r"\.\d+\.", ".*.")
    fields = catalogue.select("form_id", "section_pos", "section_id", "field_pos", "pattern_id", "label", "type", "options", "parent_group")
    joined = values.select("record_id", "form_id", "field_id", "value").where(F.coalesce(F.col("value"), F.lit("")) != "").withColumn("pattern_id", pattern).join(fields, ["form_id", "pattern_id"])
    entry = F.when(F.col("field_id").rlike(part), F.regexp_extract("field_id", part, 2).cast("int") + 1)
    name = F.concat_ws(" – ", F.when(entry.isNotNull(), F.concat(F.col("parent_group"), F.lit(" #"), entry.cast("string"))), F.col("label"))
    shown = F.struct(F.coalesce(entry, F.lit(0)).alias("entry"), "field_pos", name.alias("label"), displayed(F.col("type"), F.col("value"), F.col("options")).alias("value"))
    return joined.groupBy("record_id", "section_pos", "section_id").agg(F.transform(F.array_sort(F.collect_list(shown)), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))).alias("fields"))


def shown_fields(asked: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(form_id, group_id, entry, wanted ids) met with the catalogue: what is shown, what is unknown, entry in bounds."""
    subs = catalogue.where(F.col("parent_group").isNotNull()).groupBy("form_id", F.col("parent_group").alias("group_id")).agg(F.array_sort(F.collect_list(F.when(F.col("type") != "file", F.struct("field_pos", "field_id")))).alias("f"), F.max("max_items").alias("max_items"))
    subs = subs.select("form_id", "group_id", F.transform("f", lambda x: x["field_id"]).alias("all_ids"), "max_items")
    joined = asked.join(subs, ["form_id", "group_id"], "left")
    every = F.coalesce(F.size("wanted"), F.lit(0)) <= 0
    return joined.withColumns({
        "shown": F.when(every, F.col("all_ids")).otherwise(F.array_intersect("wanted", "all_ids")), "unknown": F.when(every, F.array().cast("array<string>")).otherwise(F.array_except("wanted", "all_ids")),
        "in_bounds": (F.col("entry") >= 0) & (F.col("max_items").isNull() | (F.col("entry") < F.col("max_items"))),
    })


def conditional_requirements(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (rule_id, if_field, if_values, then_field, message) as rows: a warning where then_field is missing."""
    given = values.select("record_id", F.col("field_id").alias("if_field"), F.col("value").alias("if_value"))
    due = given.join(rules, "if_field").where(F.array_contains("if_values", F.col("if_value")))
    have = values.where(F.coalesce(F.trim("value"), F.lit("")) != "").select("record_id", F.col("field_id").alias("then_field"))
    return due.join(have, ["record_id", "then_field"], "left_anti").select("record_id", "rule_id", "then_field", "message").distinct()
