"""Evaluation cases: built from actions, given rubrics, compared and summarised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import dotted_to_dashed
from .sampling import shuffle_key, unit_interval
from .scale import broadcast_if_few, numbered, with_places


def intent(kinds: Column) -> Column:
    """One of five intents from action types."""
    has = lambda t: F.array_contains(kinds, t)
    shows = has("show_preview") | has("show_fields")
    return F.when(has("show_button"), "close").when(shows & ~has("set_fields") & ~has("ask_choice"), "review").when(has("set_fields"), "gather").when(has("ask_choice"), "clarify").otherwise("converse")


def modules_of(intent_: Column) -> Column:
    """The modules that an intent fires; two always do."""
    return F.array_compact(F.array(
        F.lit("intent_decider"), F.lit("text_responder"), F.when(intent_.isin("gather", "close"), "data_extractor"), F.when(intent_.isin("gather", "clarify"), "choice_builder"), F.when(intent_.isin("review", "close"), "review_builder"),
    ))


def route(expected_kinds: Column, kinds: Column, buttons: Column) -> Column:
    """Five independent flags; expected types come first where there are any."""
    use = F.coalesce(expected_kinds, kinds)
    has = lambda t: F.array_contains(use, t)
    press = lambda b: F.coalesce(F.array_contains(buttons, b), F.lit(False))
    return F.struct(has("set_fields").alias("has_new_data"), has("ask_choice").alias("needs_choice"), (has("show_preview") | has("show_fields")).alias("wants_review"), press("save_draft").alias("wants_save"), press("submit").alias("wants_submit"))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def answer_of(actions: Column) -> Column:
    """Flags, parallel lists and texts of an array of variants, in the order of the actions."""
    text = lambda v, p: F.try_variant_get(v, p, "string")
    of = lambda *kinds: F.filter(actions, lambda a: text(a, "$.type").isin(*kinds))
    fields = F.flatten(F.transform(of("set_fields"), lambda a: _list(a, "$.fields")))
    options = F.flatten(F.transform(of("ask_choice"), lambda a: _list(a, "$.options")))
    questions = F.filter(F.transform(of("ask_choice"), lambda a: text(a, "$.question")), lambda q: q.isNotNull() & (q != ""))
    titles = F.filter(F.transform(of("show_preview", "show_fields"), lambda a: F.coalesce(F.nullif(text(a, "$.title"), F.lit("")), F.nullif(text(a, "$.section"), F.lit("")))), lambda t: t.isNotNull())
    item = lambda i: F.concat(F.coalesce(text(i, "$.label"), F.lit("")), F.lit(": "), F.coalesce(text(i, "$.value"), F.lit("")))
    section = lambda s: F.concat_ws(": ", F.nullif(text(s, "$.title"), F.lit("")), F.array_join(F.transform(_list(s, "$.fields"), item), "; "))
    summaries = F.transform(of("show_preview"), lambda a: F.array_join(F.transform(_list(a, "$.sections"), section), " | "))
    shown = F.transform(of("show_fields"), lambda a: F.array_join(F.transform(_list(a, "$.fields"), lambda f: F.concat(F.coalesce(text(f, "$.field_id"), F.lit("")), F.coalesce(F.concat(F.lit("["), text(f, "$.entry_index"), F.lit("]")), F.lit("")))), " | "))
    content = F.filter(F.concat(summaries, shown), lambda s: s != "")
    buttons = F.transform(of("show_button"), lambda a: text(a, "$.button"))
    there = lambda *k: F.size(of(*k)) > 0
    return F.struct(
        F.struct(there("set_fields").alias("has_new_data"), there("ask_choice").alias("needs_choice"), there("show_preview", "show_fields").alias("wants_review"), F.array_contains(buttons, "save_draft").alias("wants_save"), F.array_contains(buttons, "submit").alias("wants_submit")).alias("flags"),
        F.transform(fields, lambda f: text(f, "$.field_id")).alias("field_ids"), F.transform(fields, lambda f: F.coalesce(text(f, "$.value"), F.lit(""))).alias("field_values"),
        F.coalesce(F.get(F.reverse(questions), F.lit(0)), F.lit("")).alias("question"), F.transform(options, lambda o: F.coalesce(text(o, "$.label"), text(o, "$.value"), text(o, "$"))).alias("options"),
        F.coalesce(F.get(titles, F.lit(0)), F.lit("")).alias("summary_title"), F.coalesce(F.get(F.reverse(content), F.lit(0)), F.lit("")).alias("summary_content"),
    )


def case_of(df: DataFrame) -> DataFrame:
    """Legacy rows (test_id, category, form_state, history, user_message, prose, answer) as cases with prefixed ids."""
    return df.select(
        F.concat(F.lit("legacy-"), "test_id").alias("test_id"), F.concat(F.lit("legacy-"), "category").alias("source"), F.array().cast("array<string>").alias("cannot_targets"),
        F.struct("form_state", F.col("history").alias("conversation_history"), "user_message").alias("input"), F.struct(F.col("prose").alias("response_text"), "answer.*").alias("correct_answer"),
    )


def applied_delta(state: Column, entries: Column) -> Column:
    """(field_id, value) entries under composite ids on top of a state map."""
    return F.map_concat(state, F.map_from_entries(F.transform(entries, lambda e: F.struct(dotted_to_dashed(e["field_id"]).alias("key"), e["value"].alias("value")))))


def variation_fault(v: Column, seed: Column) -> Column:
    """the first rule that a variation breaks, or null: lists parallel, source kept, id begins with the seed's."""
    a = v["correct_answer"]
    missing = [F.when(a["flags"][f].isNull(), f"missing flag '{f}'") for f in ("has_new_data", "needs_choice", "wants_review", "wants_save", "wants_submit")]
    return F.coalesce(
        F.when(v["test_id"].isNull(), "missing top-level key 'test_id'"), F.when(v["input"].isNull(), "input must be object"), F.when(a.isNull(), "correct_answer must be object"), *missing,
        F.when(a["field_ids"].isNull() | a["field_values"].isNull(), "field_ids and field_values must be lists"), F.when(F.size(a["field_ids"]) != F.size(a["field_values"]), "field_ids and field_values length mismatch"),
        F.when(~v["source"].eqNullSafe(seed["source"]), "source mismatch"), F.when(~F.startswith(v["test_id"], seed["test_id"]), "test_id should start with the seed's"),
    )


def subset(df: DataFrame, which: str, id_column: str = "test_id") -> DataFrame:
    """seeds, variations or legacy cases by the form of their ids."""
    c = F.col(id_column)
    rules = {"all": F.lit(True), "legacy": F.startswith(c, F.lit("legacy-")), "variations": F.contains(c, F.lit("-v")) & ~F.startswith(c, F.lit("legacy-")), "seeds": ~F.contains(c, F.lit("-v")) & ~F.startswith(c, F.lit("legacy-"))}
    return df.where(rules[which])


def data_active(flag: Column, ids: Column) -> Column:
    """F19."""
    return flag & (F.size(ids) > 0)


def sectioned_value(sections: Column, name: Column) -> Column:
    """V4: the value of the first section (an array of maps, in order) that holds the name."""
    return F.get(F.filter(F.transform(sections, lambda s: F.element_at(s, name)), lambda v: v.isNotNull()), F.lit(0))


def group_errors(groups: DataFrame, min_items: int, max_items: int, label: str) -> DataFrame:
    """Per record errors on the number of entries and on required sub-fields, the entry in the id.

    ``groups`` has record_id, group_id, entries: an array of maps from required sub-field to value.
    """
    n = F.size("entries")
    counted = groups.select("record_id", F.col("group_id").alias("field_id"), F.when(n < min_items, f"At least {min_items} {label} required.").when(n > max_items, f"At most {max_items} {label} allowed.").alias("error")).where(F.col("error").isNotNull())
    each = groups.select("record_id", "group_id", F.posexplode("entries").alias("i", "entry")).select("record_id", "group_id", "i", F.explode("entry").alias("sub", "value"))
    blank = each.where(F.coalesce("value", F.lit("")) == "")
    return counted.unionByName(blank.select("record_id", F.concat(F.col("group_id"), F.lit("["), F.col("i").cast("string"), F.lit("]."), F.col("sub")).alias("field_id"), F.concat("sub", F.lit(" is required.")).alias("error")))


def rubric_for(cases: DataFrame, universal: DataFrame, by_tag: DataFrame) -> DataFrame:
    """Universal items for every case and an item for each distinct tag; rubric tables are broadcast while they are few rows."""
    items = universal.agg(F.array_sort(F.collect_list(F.struct("item_id", "weight"))).alias("items"))
    listed = items.first()["items"] if universal.limit(1000).count() < 1000 else None
    if listed is None:
        raise ValueError("universal items are a rubric's own: fewer than 1,000")
    literal = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(i.__fields__, i, strict=True))) for i in listed)) if listed else F.array().cast(items.schema["items"].dataType)
    every = cases.select("test_id", F.explode(literal).alias("i")).select("test_id", "i.*")
    tagged = cases.select("test_id", F.explode(F.array_distinct("cannot_targets")).alias("tag")).join(broadcast_if_few(by_tag), "tag").select("test_id", "item_id", "weight")
    return every.unionByName(tagged)


def reviewed(cases: DataFrame, isolation: DataFrame, cascade: DataFrame, key: str, value: str) -> DataFrame:
    """Cases with what two runs gave them."""
    side = lambda df, name: df.select(key, F.col(value).alias(name))
    return cases.join(side(isolation, "isolation"), key, "left").join(side(cascade, "cascade"), key, "left")


def picked(pairs: DataFrame, cases: DataFrame, key: str, active: Column) -> DataFrame:
    """Pairs of cases that are active."""
    return pairs.join(cases.where(active).select(key), key, "left_semi")


def same_order(stored: DataFrame, current: DataFrame, key: str, order: str) -> DataFrame:
    """Whether stored ids are the current ones in the order of a numeric column, place by place."""
    place = lambda df, name: numbered(df, F.col(order), [key], "at").select("at", F.col(key).alias(name))
    both = place(stored, "a").join(place(current, "b"), "at", "full")
    return both.agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("same"), F.count("*").alias("n"))


def type_counts(df: DataFrame, kinds: str) -> DataFrame:
    """A2: counts of exploded action types, duplicates included, and of rows without any."""
    each = df.select(F.explode_outer(kinds).alias("kind"))
    return each.groupBy(F.coalesce("kind", F.lit("(none)")).alias("kind")).agg(F.count("*").alias("n"))


def by_gold(df: DataFrame, gold_count: Column, value: str) -> DataFrame:
    """Means on rows with and without gold ids."""
    return df.agg(F.count_if(gold_count > 0).alias("n_pos"), F.count_if(gold_count == 0).alias("n_neg"), F.round(F.avg(F.when(gold_count > 0, F.col(value))), 6).alias("pos_mean"), F.round(F.avg(F.when(gold_count == 0, F.col(value))), 6).alias("neg_mean"))


def module_summary(df: DataFrame, module: str, measures: list[str]) -> DataFrame:
    """Per module count and means, nulls left out and 0.0 where there are none."""
    return df.groupBy(module).agg(F.count("*").alias("n"), *(F.coalesce(F.round(F.avg(F.col(m).cast("double")), 6), F.lit(0.0)).alias(m) for m in measures))


def spread_stats(df: DataFrame, case: str, trial: str, item: str, score: str) -> DataFrame:
    """The mean of each trial's widest disagreement on an item, and the largest deviation of an item's trial means."""
    per = df.groupBy(case, trial, item).agg((F.max(score) - F.min(score)).alias("spread"), F.avg(score).alias("mean"))
    widest = per.groupBy(case, trial).agg(F.max("spread").alias("widest")).groupBy(case).agg(F.round(F.avg("widest"), 6).alias("within_spread"))
    sd = per.groupBy(case, item).agg(F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("sd")).groupBy(case).agg(F.round(F.max("sd"), 6).alias("max_item_sd"))
    return widest.join(sd, case)


def rubric_breakdown(base: DataFrame, cand: DataFrame, weights: DataFrame) -> DataFrame:
    """Per item both sides' means over trials, their difference and weight; inputs have item, score."""
    mean = lambda df, name: df.groupBy("item").agg(F.avg("score").alias(name))
    both = mean(base, "base").join(mean(cand, "cand"), "item").join(broadcast_if_few(weights), "item")
    return both.select("item", "weight", F.round("base", 6).alias("base"), F.round("cand", 6).alias("cand"), F.round(F.col("cand") - F.col("base"), 6).alias("delta"))


def step_time(df: DataFrame, value: str) -> DataFrame:
    """A34."""
    return df.agg(F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"))


def warning_completeness(filled: Column, always: Column, warnings: Column) -> Column:
    """Whole percent of the always required plus the conditional warnings."""
    total = always + warnings
    return F.when(total == 0, 100).otherwise(F.round(100.0 * filled / total).cast("int"))


def sample_of(df: DataFrame, condition: Column, key: str, seed: str, n: int) -> DataFrame:
    """N of the rows that meet a condition, in hash order."""
    return df.where(condition).orderBy(shuffle_key(seed, key), key).limit(n)


def with_base(phrases: DataFrame, bases: DataFrame, key: str, seed: str) -> DataFrame:
    """Each phrase with one base row, chosen with replacement by hash: an equi-join on the base's number."""
    # one part for each first character: bases are text templates or names
    placed = with_places(bases, [], F.substring(F.col(bases.columns[0]).cast("string"), 1, 1), bases.columns, "base_at").withColumn("base_at", F.col("base_at") - 1)
    n = bases.count()
    return phrases.withColumn("base_at", F.floor(unit_interval(seed, key) * n).cast("int")).join(broadcast_if_few(placed), "base_at").drop("base_at")


def record_score(module: Column, format_ok: Column, scores: dict[str, Column]) -> Column:
    """The score of the record's own module, 0 where its format fails."""
    out = F.lit(None).cast("double")
    for name, s in scores.items():
        out = F.when(module == name, F.when(format_ok, s).otherwise(0.0)).otherwise(out)
    return out


def profiles(ids: DataFrame, key: str, seed: str, choices: dict[str, list[str]]) -> DataFrame:
    """A value per name, each by its own hash, so that any subset of names is stable."""
    pick = lambda name, values: F.get(F.array(*map(F.lit, values)), F.floor(unit_interval(f"{seed}/{name}", key) * len(values)).cast("int"))
    return ids.select(key, *(pick(n, v).alias(n) for n, v in choices.items()))


def tag_counts(seeds: DataFrame) -> DataFrame:
    """Seeds (cannot_targets: tags) per tag; seeds without tags count under null."""
    return seeds.select(F.explode_outer("cannot_targets").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def seed_table(spark, rows: list[tuple], schema: str) -> tuple[DataFrame, DataFrame]:
    """A literal table of seeds (test_id, source, cannot_targets ...) and its counts per tag."""
    seeds = spark.createDataFrame(rows, schema)
    return seeds, tag_counts(seeds)
