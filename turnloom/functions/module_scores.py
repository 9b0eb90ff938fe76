"""Scores of single modules and their composites, as three evaluation programs define them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import TUNING_WEIGHTS, counts, matching_values, reward_metrics
from .text import DELIMITER, strip
from .values import exactly_equal

# Minimum lengths, and the intents there are.
TEXT, QUESTION, OPTIONS, TITLE, CONTENT = 20, 5, 2, 3, 20
INTENTS = ("gather", "converse", "close", "clarify", "review")


def _marker(found: Column, name: str) -> Column:
    return strip(F.coalesce(F.element_at(found, name), F.lit("")))


def _format(found: Column, *names: str) -> Column:
    ok = F.map_contains_key(found, "completed")
    for n in names:
        ok = ok & F.map_contains_key(found, n)
    return ok


def intent_score(found: Column, gold: Column) -> Column:
    """(format_ok, content_ok) of an intent reply, from its marker map."""
    said = F.regexp_replace(F.lower(_marker(found, "intent")), "^[\"']+|[\"']+$", "")
    known = said.isin(*INTENTS)
    return F.struct((_format(found, "intent") & known).alias("format_ok"), (known & (said == gold)).alias("content_ok"))


def text_score(found: Column) -> Column:
    return F.struct(_format(found, "response_text").alias("format_ok"), (F.length(_marker(found, "response_text")) > TEXT).alias("content_ok"))


def choice_score(found: Column, options: Column) -> Column:
    ok = _format(found, "question", "options")
    return F.struct(ok.alias("format_ok"), (ok & (F.length(_marker(found, "question")) > QUESTION) & (F.size(options) >= OPTIONS)).alias("content_ok"))


def review_score(found: Column) -> Column:
    ok = _format(found, "summary_title", "summary_content")
    return F.struct(ok.alias("format_ok"), (ok & (F.length(_marker(found, "summary_title")) > TITLE) & (F.length(_marker(found, "summary_content")) > CONTENT)).alias("content_ok"))


def extractor_score(format_ok: Column, gold: Column, pred: Column, valid: Column) -> Column:
    """M12, M13 on maps: set metrics, value matches over gold, hallucinations, and whether the content holds."""
    g, p = F.map_keys(gold), F.map_keys(pred)
    m = reward_metrics(g, p)
    wrong = F.size(F.filter(p, lambda x: ~F.array_contains(valid, x) & ~F.array_contains(valid, F.regexp_replace(x, r"\.\d+\.", ".*."))))
    empty = F.size(g) == 0
    values = F.when(empty, F.when(F.size(p) == 0, 1.0).otherwise(0.0)).otherwise(matching_values(gold, pred, exactly_equal) / F.size(g))
    return F.struct(
        m["f1"].alias("f1"), values.alias("value_match"), wrong.alias("hallucinated"), F.when(F.size(p) > 0, wrong / F.size(p)).otherwise(0.0).alias("hallucination_rate"),
        (format_ok & F.when(empty, F.size(p) == 0).otherwise(m["f1"] >= 0.5)).alias("content_ok"),
    )


def legacy_score(output: Column, kinds: Column, readable: Column, wants_actions: Column, wants_delimiter: Column, known: tuple[str, ...]) -> Column:
    """Four quarter points for text, delimiter, JSON and action types."""
    there = F.contains(output, F.lit(DELIMITER))
    typed = F.when(F.size(kinds) > 0, F.forall(kinds, lambda t: t.isin(*known))).otherwise(~there & ~wants_actions)
    quarter = lambda ok: F.when(ok, 0.25).otherwise(0.0)
    return quarter(F.length(strip(output)) > 10) + quarter(there == wants_delimiter) + quarter(readable | ~wants_actions) + quarter(typed)


def nullable_overlap(gold: Column, pred: Column) -> Column:
    """M17's field recall and precision: null where nothing was expected."""
    tp, fp, fn = counts(gold, pred)
    want = F.size(gold) > 0
    return F.struct(F.when(want, tp / (tp + fn)).alias("recall"), F.when(want, F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)).alias("precision"))


def tuning_parts(gold: Column, pred: Column) -> dict[str, Column]:
    """The five part scores of structs with flags, fields and the predicted texts."""
    flags = ("has_new_data", "needs_choice", "wants_review", "wants_save", "wants_submit")
    route = sum((F.when(F.coalesce(gold[f], F.lit(False)) == F.coalesce(pred[f], F.lit(False)), 1).otherwise(0) for f in flags), F.lit(0)) / len(flags)
    n = F.length(strip(F.coalesce(pred["response_text"], F.lit(""))))
    g, p = gold["field_ids"], pred["field_ids"]
    fields = F.when((F.size(g) == 0) & (F.size(p) == 0), 1.0).when(F.size(g) == 0, 0.0).otherwise(reward_metrics(g, p)["f1"])
    wants, asks = F.coalesce(gold["needs_choice"], F.lit(False)), F.coalesce(pred["needs_choice"], F.lit(False))
    half = lambda ok: F.when(ok, 0.25).otherwise(0.0)
    choice = F.when(~wants & ~asks, 1.0).when(wants != asks, 0.0).otherwise(0.5 + half(F.length(pred["question"]) > QUESTION) + half(F.size(pred["options"]) >= OPTIONS))
    shown = (F.length(pred["summary_title"]) > 0) & (F.length(pred["summary_content"]) > 0)
    due = F.coalesce(gold["wants_review"], F.lit(False))
    review = F.when(~due & ~shown, 1.0).when(~due, 0.3).when(~shown, 0.0).otherwise(0.5 + half(F.length(pred["summary_title"]) > TITLE) + half(F.length(pred["summary_content"]) > CONTENT))
    return {"route": route, "text": F.when(n > TEXT, 1.0).when(n > 0, 0.3).otherwise(0.0), "fields": fields, "choice": choice, "review": review}


def tuning_score(gold: Column, pred: Column) -> Column:
    """Fixed weights over the five parts."""
    return sum((s * TUNING_WEIGHTS[k] for k, s in tuning_parts(gold, pred).items()), F.lit(0.0))


def graded(checks: dict[str, Column]) -> Column:
    """Pass if all checks hold, fail if none does, else partial."""
    held = sum((F.when(c, 1).otherwise(0) for c in checks.values()), F.lit(0))
    return F.when(held == len(checks), "pass").when(held == 0, "fail").otherwise("partial")
