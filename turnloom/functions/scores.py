"""Scores over sets, maps and flags. The rules for empty sides differ on purpose and are kept apart by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import format_leak, strip
from .values import equal, exactly_equal

# The composite's module weights, and the weights of the prompt-tuning composite.
WEIGHTS = {"action_router": 0.20, "data_extractor": 0.15, "choice_builder": 0.05, "review_builder": 0.05, "text_responder": 0.55}
TUNING_WEIGHTS = {"route": 0.30, "text": 0.15, "fields": 0.25, "choice": 0.15, "review": 0.15}


def counts(gold: Column, pred: Column) -> tuple[Column, Column, Column]:
    """(tp, fp, fn) of two arrays as sets."""
    return F.size(F.array_intersect(gold, pred)), F.size(F.array_except(pred, gold)), F.size(F.array_except(gold, pred))


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def router_f1(gold: Column, pred: Column) -> Column:
    """M1: 1 when both are empty, 0 without a hit."""
    tp, fp, fn = counts(gold, pred)
    return F.when((tp == 0) & (fp + fn == 0), 1.0).when(tp == 0, 0.0).otherwise(2.0 * tp / (2 * tp + fp + fn))


def report_metrics(gold: Column, pred: Column) -> Column:
    """M6, M7: an empty gold gives recall 1 even if something is predicted."""
    tp, fp, fn = counts(gold, pred)
    precision = F.when(tp + fp > 0, tp / (tp + fp)).when(tp + fn == 0, 1.0).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"))


def reward_metrics(gold: Column, pred: Column) -> Column:
    """An empty gold gives recall 1 only if nothing is predicted."""
    tp, fp, fn = counts(gold, pred)
    n_pred, n_gold = tp + fp, tp + fn
    precision = F.when(n_pred > 0, tp / n_pred).when(n_gold == 0, 1.0).otherwise(0.0)
    recall = F.when(n_gold > 0, tp / n_gold).when(n_pred == 0, 1.0).otherwise(0.0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"))


def matching_values(gold: Column, pred: Column, same=equal) -> Column:
    """How many keys of both maps have equal values."""
    shared = F.array_intersect(F.map_keys(gold), F.map_keys(pred))
    return F.size(F.filter(shared, lambda k: F.coalesce(same(F.element_at(gold, k), F.element_at(pred, k)), F.lit(False))))


def extractor_score(gold: Column, pred: Column) -> Column:
    """M2 on maps: 0.6 of the ids' F1 and 0.4 of the share of equal values among shared ids."""
    g, p = F.map_keys(gold), F.map_keys(pred)
    shared = F.size(F.array_intersect(g, p))
    values = F.when(shared > 0, matching_values(gold, pred) / shared).when(F.size(g) == 0, 1.0).otherwise(0.0)
    return 0.6 * router_f1(g, p) + 0.4 * values


def accuracy_reward(gold: Column, pred: Column) -> Column:
    """M15 on maps: 1.5 of F1 and 1.5 of the share of gold values that are right."""
    g, p = F.map_keys(gold), F.map_keys(pred)
    full = 1.5 * reward_metrics(g, p)["f1"] + 1.5 * matching_values(gold, pred, exactly_equal) / F.size(g)
    return F.when(F.size(g) == 0, F.when(F.size(p) == 0, 1.5).otherwise(0.0)).when(F.size(p) == 0, 0.0).otherwise(full)


def hallucination_penalty(pred: Column, valid: Column) -> Column:
    """Minus one half for each predicted id that is not valid, repeats included, at most 2."""
    wrong = F.size(F.filter(pred, lambda x: ~F.array_contains(valid, x)))
    return F.when((F.size(valid) == 0) | (F.size(pred) == 0), 0.0).otherwise(0.0 - F.least(wrong * 0.5, F.lit(2.0)))


def abstained(*outputs: Column) -> Column:
    """M3: 1 where an inactive module stayed silent."""
    silent = F.lit(True)
    for c in outputs:
        silent = silent & F.coalesce(F.length(c) == 0, F.lit(True))
    return F.when(silent, 1.0).otherwise(0.0)


def composite(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted mean over modules whose score is not null."""
    weights = weights or WEIGHTS
    total = sum((F.when(s.isNotNull(), F.lit(weights[m])).otherwise(0.0) for m, s in scores.items()), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(s * weights[m], F.lit(0.0)) for m, s in scores.items()), F.lit(0.0)) / total)


def rubric_score(items: Column) -> Column:
    """Weighted mean of (weight, score) structs; a zero total divides by one."""
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + x["weight"])
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x["weight"] * x["score"]) / F.when(total == 0, 1.0).otherwise(total)


def coverage(expected: Column, summary: Column) -> Column:
    """M8: share of expected ids that the summary mentions, an underscore read as a space."""
    low = F.lower(summary)
    said = F.size(F.filter(expected, lambda e: F.contains(low, F.replace(F.lower(e), F.lit("_"), F.lit(" "))) | F.contains(low, F.lower(e))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(said / F.size(expected))


def text_sanity(text: Column) -> Column:
    """M9."""
    t = strip(F.coalesce(text, F.lit("")))
    n, leak = F.length(t), format_leak(t)
    return F.struct(n.alias("n_chars"), (n > 0).alias("nonempty"), n.between(5, 2000).alias("reasonable_length"), (~leak).alias("no_format_leak"), ((n > 0) & ~leak).alias("ok"))


def same_multiset(a: Column, b: Column) -> Column:
    """U5."""
    return F.array_sort(a) == F.array_sort(b)


def same_set(a: Column, b: Column) -> Column:
    """U4."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def grounded(value: Column, message: Column, labels: Column, is_file: Column | None = None) -> Column:
    """whether a value is in the message, by the rule for its kind. ``labels`` are known spellings, or null."""
    low, said = F.lower(strip(value)), F.lower(message)
    words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 3)
    hits = F.size(F.filter(words, lambda w: F.contains(said, w)))
    parts = F.split(low, r"\s+")
    out = F.when(low.isin("true", "false"), True).when(F.startswith(low, F.lit("[")) & F.endswith(low, F.lit("]")), True)
    if is_file is not None:
        out = out.when(is_file, F.contains(said, F.lower(value)) | F.contains(said, F.lit("[file:")))
    return (
        out.when(labels.isNotNull(), F.exists(labels, lambda x: F.contains(said, x)))
        .when(F.length(low) > 50, (F.size(words) == 0) | (hits >= F.size(words) * 0.3)).when(F.contains(said, low), True)
        .when((F.size(parts) >= 2) & F.forall(parts, lambda p: F.contains(said, p)), True)
        .when(F.contains(low, F.lit("-")) & F.length(low).isin(7, 10), F.contains(said, F.left(low, F.lit(4)))).otherwise(False)
    )
