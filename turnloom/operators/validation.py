"""Validation against a field catalogue: the schema is a table, and rules are columns of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import starred
from ..functions.text import strip
from ..functions.values import as_number, coerced

CATALOGUE = (
    "form_id string, section_pos int, section_id string, field_pos int, field_id string, parent_group string, pattern_id string, label string, type string, "
    "required boolean, min_length int, max_length int, min double, max double, decimal_places int, format string, options array<struct<value:string,label:string>>, "
    "max_selections int, require_country_code boolean, min_items int, max_items int, cond_field string, cond_op string, cond_values array<string>"
)

# What the validators accept.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE = r"^\+\d{1,3}[-\s.]?\d[\d\s.-]*$"
MONTH, DAY = r"^\d{4}-\d{2}$", r"^\d{4}-\d{2}-\d{2}$"


def catalogue_of(forms: DataFrame) -> DataFrame:
    """The catalogue of form documents (form_id, sections array): one row per field and sub-field."""
    fields = forms.select("form_id", F.posexplode("sections").alias("section_pos", "s")).select("form_id", "section_pos", F.col("s.id").alias("section_id"), F.posexplode("s.fields").alias("field_pos", "f"))
    return fields.select("form_id", "section_pos", "section_id", "field_pos", "f.*").withColumn("pattern_id", F.coalesce(F.concat_ws(".*.", "parent_group", "field_id"), F.col("field_id")))


def condition_met(actual: Column, actual_type: Column, op: Column, wanted: Column, wanted_type: Column) -> Column:
    """six operators on typed texts; equal texts of unequal types differ, and unknown operators hold."""
    first = F.get(wanted, F.lit(0))
    same = (actual == first) & (actual_type == wanted_type)
    among = F.array_contains(wanted, actual) & (actual_type == wanted_type)
    numbers = (actual_type == "number") & (wanted_type == "number")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(op == "equals", yes(same)).when(op == "not_equals", ~yes(same)).when(op == "in", yes(among)).when(op == "not_in", ~yes(among))
        .when(op == "greater_than", yes(numbers & (as_number(actual) > as_number(first)))).when(op == "less_than", yes(numbers & (as_number(actual) < as_number(first))))
        .otherwise(True)
    )


def value_error(f: Column, value: Column, months_are_dates: bool = False, check_decimals: bool = True) -> Column:
    """The first rule that a value breaks, as a message; null if it is valid.

    ``f`` is a catalogue struct. The two switches are where the validators differ.
    """
    label, kind, number = f["label"], f["type"], as_number(strip(value))
    say = lambda *parts: F.concat(label, *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    allowed = F.transform(f["options"], lambda o: o["value"])
    items = F.filter(F.transform(F.split(value, ","), strip), lambda x: x != "")
    decimals = F.length(F.regexp_extract(value, r"\.(\d+?)0*$", 1))
    text = F.when(F.length(value) > f["max_length"], say(" must be at most ", f["max_length"], " characters.")).when(F.length(value) < f["min_length"], say(" must be at least ", f["min_length"], " characters."))
    numeric = (
        F.when(number.isNull(), say(" must be a valid number.")).when(number < f["min"], say(" must be at least ", f["min"], ".")).when(number > f["max"], say(" must be at most ", f["max"], "."))
    )
    if check_decimals:
        numeric = numeric.when(decimals > f["decimal_places"], say(" allows at most ", f["decimal_places"], " decimal places."))
    full = value.rlike(DAY) | (value.rlike(MONTH) if months_are_dates else F.lit(False))
    date = F.when((f["format"] == "YYYY-MM") & ~value.rlike(MONTH), say(" must be in YYYY-MM format.")).when((F.coalesce(f["format"], F.lit("YYYY-MM-DD")) == "YYYY-MM-DD") & ~full, say(" must be in YYYY-MM-DD format."))
    many = F.when((F.size(allowed) > 0) & (F.size(F.array_except(items, allowed)) > 0), say(" has an invalid option.")).when(F.size(items) > f["max_selections"], say(" allows at most ", f["max_selections"], " selections."))
    checked = (
        F.when(kind.isin("text", "textarea"), text).when((kind == "email") & ~value.rlike(EMAIL), say(" is not a valid email address."))
        .when((kind == "phone") & F.coalesce(f["require_country_code"], F.lit(False)) & ~value.rlike(PHONE), say(" must include a country code."))
        .when(kind == "number", numeric).when(kind == "date", date)
        .when((kind == "select") & (F.size(allowed) > 0) & ~F.array_contains(allowed, value), say(" is not a valid option."))
        .when(kind == "multi_select", many).when((kind == "boolean") & ~value.isin("true", "false"), say(" must be true or false."))
    )
    return F.when(value.isNull() | (value == ""), F.when(F.coalesce(f["required"], F.lit(False)), say(" is required."))).otherwise(checked)


def with_definition(values: DataFrame, catalogue: DataFrame) -> DataFrame:
    """V1-V3: each (form_id, field_id, value) with its definition as ``field``, null if unknown.

    Ids match whole, by group pattern, or as a sub-field, in this order; the earliest position wins.
    """
    fields = catalogue.select("form_id", F.struct(*(c for c in catalogue.columns if c != "form_id")).alias("field"))
    names = fields.select("form_id", F.explode(F.array_distinct(F.array(F.col("field.pattern_id"), F.col("field.field_id")))).alias("name"), "field")
    best = names.groupBy("form_id", "name").agg(F.min_by("field", F.struct(F.when(F.col("field.pattern_id") == F.col("name"), 0).otherwise(1), "field.section_pos", "field.field_pos")).alias("field"))
    return values.withColumn("name", starred(F.col("field_id"))).join(best, ["form_id", "name"], "left").drop("name")


def validated(values: DataFrame, catalogue: DataFrame, **switches: bool) -> DataFrame:
    """Adds ``error`` and ``valid``; unknown fields are errors, fields whose condition is unmet are valid.

    ``values`` has record_id, form_id, field_id, value, type (of the value: string, number, boolean).
    """
    known = with_definition(values, catalogue)
    actual = values.select("record_id", F.col("field_id").alias("cond_field"), F.col("value").alias("cond_actual"), F.col("type").alias("cond_type"))
    joined = known.withColumn("cond_field", F.col("field.cond_field")).join(actual, ["record_id", "cond_field"], "left")
    applies = F.col("cond_field").isNull() | condition_met(F.col("cond_actual"), F.col("cond_type"), F.col("field.cond_op"), F.col("field.cond_values"), F.coalesce(F.col("cond_type"), F.lit("string")))
    error = F.when(F.col("field").isNull(), F.concat(F.lit("Unknown field: "), F.col("field_id"))).when(applies, value_error(F.col("field"), F.col("value"), **switches))
    return joined.withColumn("error", error).withColumn("valid", F.col("error").isNull()).drop("cond_actual", "cond_type", "cond_field")


def required(records: DataFrame, values: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(record_id, field_id, filled) for each top-level field that is required of the record."""
    wanted = records.join(catalogue.where(F.col("required") & F.col("parent_group").isNull()), "form_id")
    actual = values.select("record_id", F.col("field_id").alias("cond_field"), F.col("value").alias("cond_actual"), F.col("type").alias("cond_type"))
    joined = wanted.join(actual, ["record_id", "cond_field"], "left")
    applies = F.col("cond_field").isNull() | condition_met(F.col("cond_actual"), F.col("cond_type"), F.col("cond_op"), F.col("cond_values"), F.coalesce(F.col("cond_type"), F.lit("string")))
    filled = values.where(F.col("value").isNotNull() & (strip(F.col("value")) != "")).select("record_id", F.element_at(F.split("field_id", r"\."), 1).alias("field_id")).distinct().withColumn("filled", F.lit(True))
    return joined.where(applies).select("record_id", "form_id", "section_pos", "section_id", "field_id").join(filled, ["record_id", "field_id"], "left").fillna(False, ["filled"])


def group_entries(values: DataFrame) -> DataFrame:
    """Per record and group the filled indices, entries as highest index plus one, and the next free index."""
    part = r"^(.+?)\.(\d+)\.(.+)$"
    grouped = values.where(F.col("field_id").rlike(part) & (F.coalesce(strip(F.col("value")), F.lit("")) != "")).select("record_id", F.regexp_extract("field_id", part, 1).alias("group_id"), F.regexp_extract("field_id", part, 2).cast("int").alias("entry"))
    return grouped.groupBy("record_id", "group_id").agg(F.sort_array(F.collect_set("entry")).alias("entries"), (F.max("entry") + 1).alias("n_entries"))


def snapped(values: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Canonical option values for values or labels in any case, with a reason where a value goes."""
    known = with_definition(values, catalogue)
    field = F.col("field")
    text = strip(coerced(field["type"], F.col("value")))
    exact = F.exists(field["options"], lambda o: o["value"] == text)
    found = F.get(F.filter(field["options"], lambda o: (F.lower(o["value"]) == F.lower(text)) | (F.lower(o["label"]) == F.lower(text))), F.lit(0))["value"]
    choice = (field["type"] == "select") & (F.size(field["options"]) > 0)
    snap = F.when(choice, F.when(exact, text).otherwise(found)).otherwise(text)
    reason = F.when(field.isNull(), F.concat(F.lit("unknown_field:"), F.col("field_id"))).when(choice & snap.isNull(), F.concat(F.lit("value_not_in_enum:"), F.col("field_id"), F.lit("="), F.col("value")))
    return known.withColumns({"snapped": snap, "reason": reason})


def file_error(f: Column, name: Column, size_bytes: Column, accepted: Column, max_mb: Column) -> Column:
    """Unknown field, extension, size."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return F.when(f.isNull(), "unknown field").when(~F.array_contains(accepted, suffix), "file type not accepted").when(size_bytes > max_mb * 1024 * 1024, "file too large")


def submission_gate(drafts: DataFrame, errors: DataFrame) -> DataFrame:
    """Drafts with errors are rejected, each error once per field; the rest is accepted."""
    per = errors.groupBy("record_id").agg(F.array_sort(F.collect_set("field_id")).alias("fields"))
    return drafts.join(per, "record_id", "left").withColumn("status", F.when(F.size("fields") > 0, "rejected").otherwise("accepted"))
