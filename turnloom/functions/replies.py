"""Replies put together from predictions, and answers of judges taken apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .actions import compose
from .text import strip

ACTION = "struct<type:string,fields:array<struct<field_id:string,value:string>>,question:string,options:array<struct<label:string,value:string>>,title:string,summary:string,button:string>"
FLAGS = ("has_new_data", "needs_choice", "wants_review", "wants_save", "wants_submit")


def _text(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def set_fields(ids: Column, vals: Column) -> Column:
    """Ids with their values (blank where there is none), without empty ids; null if none is left."""
    zipped = F.transform(F.filter(F.arrays_zip(ids.alias("field_id"), vals.alias("value")), lambda z: z["field_id"].isNotNull() & (z["field_id"] != "")), lambda z: F.struct(z["field_id"].alias("field_id"), F.coalesce(z["value"], F.lit("")).alias("value")))
    return F.when(F.size(zipped) > 0, F.to_json(F.struct(F.lit("set_fields").alias("type"), zipped.alias("fields"))))


def ask_choice(question: Column, options: Column) -> Column:
    """Options as label and value; null without a question."""
    wrapped = F.transform(F.filter(options, lambda o: F.coalesce(o, F.lit("")) != ""), lambda o: F.struct(strip(o).alias("label"), strip(o).alias("value")))
    return F.when(_text(question) != "", F.to_json(F.struct(F.lit("ask_choice").alias("type"), _text(question).alias("question"), F.coalesce(wrapped, F.array().cast("array<struct<label:string,value:string>>")).alias("options"))))


def show_preview(title: Column, summary: Column, default: str = "Application Progress") -> Column:
    """Null if both are blank."""
    shown = F.struct(F.lit("show_preview").alias("type"), F.when(_text(title) == "", default).otherwise(_text(title)).alias("title"), _text(summary).alias("summary"))
    return F.when((_text(title) != "") | (_text(summary) != ""), F.to_json(shown))


def composed_actions(p: Column) -> Column:
    """JSON texts of the actions that a flat prediction calls for: data first, then what is shown, buttons last."""
    on = lambda flag, action: F.when(F.coalesce(p[flag], F.lit(False)), action)
    button = lambda name: F.to_json(F.struct(F.lit("show_button").alias("type"), F.lit(name).alias("button")))
    return F.array_compact(F.array(
        on("has_new_data", set_fields(p["field_ids"], p["field_values"])), on("needs_choice", ask_choice(p["question"], p["options"])), on("wants_review", show_preview(p["summary_title"], p["summary_content"])),
        on("wants_save", button("save_draft")), on("wants_submit", button("submit")),
    ))


def full_response(p: Column) -> Column:
    """The reply alone where there are no actions."""
    actions = composed_actions(p)
    return F.when(F.size(actions) == 0, _text(p["response_text"])).otherwise(compose(_text(p["response_text"]), F.concat(F.lit("["), F.array_join(actions, ", "), F.lit("]"))))


def flat_prediction(flags: Column, rest: Column) -> Column:
    """A flat prediction with defaults from the nested form."""
    none = F.array().cast("array<string>")
    return F.struct(
        *(F.coalesce(flags[f], F.lit(False)).alias(f) for f in FLAGS), *(F.coalesce(rest[t], F.lit("")).alias(t) for t in ("response_text", "question", "summary_title", "summary_content")),
        *(F.coalesce(rest[a], none).alias(a) for a in ("field_ids", "field_values", "options")),
    )


def nested_prediction(p: Column) -> Column:
    """P41."""
    return F.struct(F.struct(*(p[f].alias(f) for f in FLAGS)).alias("flags"), *(p[t].alias(t) for t in ("response_text", "field_ids", "field_values", "question", "options", "summary_title", "summary_content")))


def message_text(message: Column) -> Column:
    """The text of a completion given as a string, a list of messages or a list of parts."""
    v = F.try_parse_json(message)
    content = F.try_variant_get(v, "$[0].content", "variant")
    parts = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    kind = F.coalesce(F.schema_of_variant(content), F.lit(""))
    return F.when(F.startswith(kind, F.lit("ARRAY")), F.array_join(parts, " ")).when(kind == "STRING", F.try_variant_get(content, "$", "string")).otherwise(message)


def typed_blocks(text: Column) -> Column:
    """X24."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))


def _unfenced(answer: Column) -> Column:
    inner = F.regexp_extract(answer, r"(?s)^\s*```(?:json)?\s*(.*?)\s*`*\s*$", 1)
    return F.when(strip(answer).startswith("```"), inner).otherwise(strip(answer))


def yes_no_answers(answer: Column, expected: Column) -> Column:
    """Booleans of a judge's list; null if it is unreadable or of another length. Never a default score."""
    parsed = F.from_json(_unfenced(answer), "array<string>")
    return F.when(F.size(parsed) == expected, F.transform(parsed, lambda a: F.startswith(F.lower(strip(a)), F.lit("y"))))


def score_answers(answer: Column, expected: Column) -> Column:
    """Numbers from 0 to 1; null if any is not, or the length is another."""
    parsed = F.from_json(_unfenced(answer), "array<double>")
    return F.when((F.size(parsed) == expected) & F.forall(parsed, lambda x: x.isNotNull() & x.between(0.0, 1.0)), parsed)


def differences(expected: Column, actual: Column, names: list[str], prefix: Column | None = None) -> Column:
    """A line for each field in which two predictions differ; empty if they match."""
    shown = lambda c: F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit("null"))
    lines = [F.when(~expected[n].eqNullSafe(actual[n]), F.concat(F.lit(f"{n}: expected "), shown(expected[n]), F.lit(", got "), shown(actual[n]))) for n in names]
    if prefix is not None:
        text = F.coalesce(actual["response_text"], F.lit(""))
        lines.append(F.when((F.coalesce(prefix, F.lit("")) != "") & ~F.startswith(text, prefix), F.concat(F.lit("response_text: expected to start with "), prefix)))
    return F.array_compact(F.array(*lines))


def feedback(score: Column, checks: Column) -> Column:
    """The score, failed checks and the modules that passed, from (module, name, passed, detail) structs."""
    failed = F.filter(checks, lambda c: ~c["passed"])
    modules = F.array_distinct(F.transform(checks, lambda c: c["module"]))
    passed = F.filter(modules, lambda m: ~F.exists(failed, lambda c: c["module"] == m))
    lines = F.transform(failed, lambda c: F.concat(F.lit("  ["), c["module"], F.lit("] "), c["name"], F.lit(": "), c["detail"]))
    head = F.concat(F.lit("Score: "), F.format_string("%.3f", score))
    some = F.concat_ws("\n", head, F.lit("Failed checks:"), F.array_join(lines, "\n"), F.when(F.size(passed) > 0, F.concat(F.lit("Passed modules: "), F.array_join(passed, ", "))))
    return F.when(F.size(failed) == 0, F.concat_ws("\n", head, F.lit("All checks passed."))).otherwise(some)


def user_message(action: Column, text: Column, file_name: Column, file_text: Column, label: Column) -> Column:
    """What a user action says; null for edits, clicks and stops."""
    wrapped = F.concat(F.lit("[File: "), file_name, F.lit("]\n"), file_text, F.lit("\n[End of "), file_name, F.lit("]\n\n"), F.coalesce(text, F.lit("")))
    return F.when((action == "message") & file_name.isNotNull(), wrapped).when(action == "message", F.coalesce(text, F.lit(""))).when(action == "select_choice", F.concat(F.lit('[system] User selected option: "'), label, F.lit('"')))


def folded_plan(plan: Column) -> Column:
    """An ordered fold over (action, text) steps that ends at the first stop: (messages, n_edits, stopped)."""
    zero = F.struct(F.array().cast("array<string>").alias("messages"), F.lit(0).alias("n_edits"), F.lit(False).alias("stopped"))
    step = lambda acc, x: F.when(acc["stopped"], acc).otherwise(F.struct(
        F.when(x["action"] == "message", F.concat(acc["messages"], F.array(x["text"]))).otherwise(acc["messages"]).alias("messages"),
        (acc["n_edits"] + (x["action"] == "fill_fields").cast("int")).alias("n_edits"), (x["action"] == "stop").alias("stopped"),
    ))
    return F.aggregate(plan, zero, step)


def displayed(kind: Column, value: Column, options: Column) -> Column:
    """A value as it is shown, with option labels."""
    label = lambda v: F.coalesce(F.get(F.filter(options, lambda o: o["value"] == v), F.lit(0))["label"], v)
    many = F.array_join(F.transform(F.split(value, r",\s*"), label), ", ")
    return F.when(value.isNull() | (value == ""), "(not provided)").when(kind == "boolean", F.when(value == "true", "Yes").otherwise("No")).when(kind == "select", label(value)).when(kind == "multi_select", many).otherwise(value)


def detected_form(texts: Column, keywords: dict[str, str]) -> Column:
    """The form whose keyword is in the first message, else in any, the order of keywords deciding."""
    first, any_ = F.lower(F.get(texts, F.lit(0))), F.lower(F.array_join(texts, "\n"))
    found = [F.when(F.contains(where, F.lit(word.lower())), form) for where in (first, any_) for word, form in keywords.items()]
    return F.coalesce(*found)


def rendered_schema(fields: Column, most_options: int | None = None) -> Column:
    """Lines of a catalogue's (section, label, type, required, options) structs; options all or the first few."""
    def line(f: Column) -> Column:
        shown = F.slice(f["options"], 1, most_options) if most_options else f["options"]
        return F.concat(F.lit("  "), f["label"], F.lit(" ("), f["type"], F.when(f["required"], ", required").otherwise(""), F.lit(")"), F.when(F.size(shown) > 0, F.concat(F.lit(": "), F.array_join(shown, ", "))).otherwise(""))
    return F.array_join(F.transform(fields, line), "\n")


def rendered_context(schema: Column, state_json: Column, history: Column, most: int = 6, clip: int = 300, file_clip: int | None = None) -> Column:
    """Schema, state and the last messages; with ``file_clip`` messages with files may be longer."""
    def shown(e: Column) -> Column:
        cut = F.when(F.contains(e["content"], F.lit("[File:")), F.lit(file_clip)).otherwise(clip) if file_clip else F.lit(clip)
        return F.concat(e["role"], F.lit(": "), F.when(F.length(e["content"]) > cut, F.concat(F.left(e["content"], cut), F.lit("…") if file_clip else F.lit(""))).otherwise(e["content"]))
    last = F.slice(history, -F.least(F.size(history), F.lit(most)), F.lit(most))
    return F.concat_ws("\n\n", schema, state_json, F.when(F.size(history) > 0, F.array_join(F.transform(last, shown), "\n")))
