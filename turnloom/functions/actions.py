"""Action lists inside replies: parsing, typing and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DELIMITER, strip

# The known action types and turn categories.
ACTION_TYPES = ("set_fields", "ask_choice", "show_fields", "show_preview", "show_button")


def _after_delimiter(c: Column) -> Column:
    at = F.locate(DELIMITER, c)
    return F.when(at > 0, strip(c.substr(at + len(DELIMITER), F.length(c))))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def parse_actions(c: Column) -> Column:
    """Array of variants. Objects with a text ``type`` stay; anything unreadable gives an empty array."""
    block = _after_delimiter(c)
    fence = r"(?s)```(?:json)?\s*\n?(.*?)```"
    inner = F.when(block.rlike(fence), strip(F.regexp_extract(block, fence, 1))).otherwise(block)
    cleaned = strip(F.regexp_replace(F.regexp_replace(inner, r"(?m)^```(?:json)?", ""), r"(?m)```$", ""))
    v = F.try_parse_json(cleaned)
    none = F.array().cast("array<variant>")
    listed = F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(_is(v, "OBJECT"), F.array(v)).otherwise(none)
    typed = F.filter(listed, lambda a: _is(a, "OBJECT") & _is(F.try_variant_get(a, "$.type", "variant"), "STRING"))
    return F.coalesce(typed, none)


def parse_fenced_actions(c: Column) -> Column:
    """A json fence must follow the delimiter directly."""
    block = F.regexp_extract(c, r"(?s)" + DELIMITER + r"\s*```json\s*(.*?)```", 1)
    v = F.try_parse_json(F.when(block != "", block))
    return F.coalesce(F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def types(actions: Column) -> Column:
    """Types in order, duplicates kept."""
    return F.transform(actions, lambda a: F.try_variant_get(a, "$.type", "string"))


def fields_set(actions: Column) -> Column:
    """P10: ids of all set_fields actions in order, empties dropped, duplicates kept."""
    setters = F.filter(actions, lambda a: F.try_variant_get(a, "$.type", "string") == "set_fields")
    ids = F.flatten(F.transform(setters, lambda a: F.transform(F.coalesce(F.try_variant_get(a, "$.fields", "array<variant>"), F.array().cast("array<variant>")), lambda f: F.try_variant_get(f, "$.field_id", "string"))))
    return F.filter(ids, lambda x: x.isNotNull() & (x != ""))


def pairs(actions: Column) -> Column:
    """P20: (field_id, value) structs of set_fields actions, ids in canonical notation."""
    setters = F.filter(actions, lambda a: F.try_variant_get(a, "$.type", "string") == "set_fields")
    return F.flatten(F.transform(setters, lambda a: F.transform(F.try_variant_get(a, "$.fields", "array<variant>"), lambda f: F.struct(F.translate(F.try_variant_get(f, "$.field_id", "string"), "-", ".").alias("field_id"), F.try_variant_get(f, "$.value", "string").alias("value")))))


def choice_options(actions: Column) -> Column:
    """Labels (where empty, values) or plain texts of the first ask_choice, whether or not it has options."""
    options = lambda a: F.coalesce(F.try_variant_get(a, "$.options", "array<variant>"), F.array().cast("array<variant>"))
    first = F.get(F.filter(actions, lambda a: F.try_variant_get(a, "$.type", "string") == "ask_choice"), F.lit(0))
    filled = lambda o, path: F.nullif(F.try_variant_get(o, path, "string"), F.lit(""))
    text = lambda o: F.when(_is(o, "OBJECT"), F.coalesce(filled(o, "$.label"), filled(o, "$.value"))).otherwise(F.try_variant_get(o, "$", "string"))
    return F.filter(F.transform(options(first), text), lambda x: x.isNotNull() & (x != ""))


def gold_values(c: Column) -> Column:
    """P5: field id to value of a reply whose fenced block is an array; nulls are skipped and the last value wins."""
    block = F.regexp_extract(c, r"(?s)" + DELIMITER + r"\s*```json\s*(\[.*?\])\s*```", 1)
    v = F.try_parse_json(F.when(block != "", block))
    none = F.array().cast("array<variant>")
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none)
    setters = F.filter(listed, lambda a: F.try_variant_get(a, "$.type", "string") == "set_fields")
    fields = F.flatten(F.transform(setters, lambda a: F.coalesce(F.try_variant_get(a, "$.fields", "array<variant>"), none)))
    entries = F.transform(fields, lambda f: F.struct(F.try_variant_get(f, "$.field_id", "string").alias("k"), F.try_variant_get(f, "$.value", "string").alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e: e["k"].isNotNull() & e["v"].isNotNull()))


def valid_types(kinds: Column) -> Column:
    """all types are known."""
    return F.forall(kinds, lambda t: t.isin(*ACTION_TYPES))


def category(turn: Column, has_actions: Column, message: Column, n_fields: Column, kinds: Column) -> Column:
    """The first rule that holds."""
    return (
        F.when(turn == 0, "greeting").when(~has_actions, "question_no_actions")
        .when(F.contains(message, F.lit("[system] User selected option")), "choice_selection").when(F.contains(message, F.lit("[File:")), "file_handling")
        .when(n_fields >= 3, "multi_field").when(n_fields == 1, "single_field")
        .when(F.array_contains(kinds, "ask_choice") & ~F.array_contains(kinds, "set_fields"), "ask_choice_only")
        .when(F.array_contains(kinds, "show_button"), "submit_flow").otherwise("other")
    )


def button(message: Column, output: Column) -> Column:
    """A leaked prefix tells most; then words of the message; else null."""
    lead, low = F.regexp_replace(output, r"^\s+", ""), F.lower(message)
    return (
        F.when(F.startswith(lead, F.lit("[system] User clicked: Submit")), "submit").when(F.startswith(lead, F.lit("[system] User clicked: Save Draft")), "save_draft")
        .when(F.contains(low, F.lit("submit")), "submit").when(F.contains(low, F.lit("save")) | F.contains(low, F.lit("draft")), "save_draft")
    )


def route_flags(kinds: Column, buttons: Column) -> Column:
    """What a turn does, as five booleans."""
    has = lambda t: F.array_contains(kinds, t)
    press = lambda b: F.coalesce(F.exists(buttons, lambda x: F.contains(F.lower(x), F.lit(b))), F.lit(False))
    return F.struct(
        has("set_fields").alias("has_new_data"), has("ask_choice").alias("needs_choice"), (has("show_preview") | has("show_fields")).alias("wants_review"),
        (has("show_button") & press("save")).alias("wants_save"), (has("show_button") & press("submit")).alias("wants_submit"),
    )


def content_module(flags: Column) -> Column:
    """The module that a turn is scored by."""
    return F.when(flags["has_new_data"], "data_extractor").when(flags["needs_choice"], "choice_builder").when(flags["wants_review"], "review_builder").otherwise("text_responder")


def disposition(sub_turn: Column, message: Column, output: Column) -> Column:
    """F2 with A7's labels: what cleaning does with a turn."""
    lead = F.regexp_replace(output, r"^\s+", "")
    return (
        F.when(sub_turn > 0, "drop_sub_turn").when(F.startswith(message, F.lit("[system] User clicked: ")), "drop_phantom_click")
        .when(F.startswith(lead, F.lit("[system] User clicked:")), "rewrite_leaked_prefix")
        .when((strip(output) == "") & button(message, output).isNull(), "drop_empty").when(strip(output) == "", "rewrite_empty").otherwise("keep")
    )


def compose(text: Column, actions_json: Column) -> Column:
    """A reply's text with its actions in a fenced block."""
    return F.concat(text, F.lit(f"\n\n{DELIMITER}\n```json\n"), actions_json, F.lit("\n```"))


def summary(actions: Column) -> Column:
    """A short text per action."""
    def one(a: Column) -> Column:
        kind = F.try_variant_get(a, "$.type", "string")
        n = F.size(F.coalesce(F.try_variant_get(a, "$.fields", "array<variant>"), F.array().cast("array<variant>")))
        return F.when(kind == "set_fields", F.concat(kind, F.lit("("), n.cast("string"), F.lit(")"))).otherwise(kind)
    return F.array_join(F.transform(actions, one), " + ")
