"""Partial drafts drawn by a seeded 32-bit generator, draw for draw.

The generator is mulberry32: its k-th state is the seed plus k times a constant, so any draw is a column expression of seed
and k, and a draft needs no state. Draws go to the optional sections in order, then, if needed, to the section that is
emptied again or the one that is filled after all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import broadcast_if_few

#: Fixed values of the generator: its step, and the 32 bits of a word.
STEP = 0x6D2B79F5
WORD = 0xFFFFFFFF

#: Sections with a rule of their own: the first is always filled, the second never, the third where nothing else is.
ALWAYS, NEVER, FALLBACK = "program", "documents", "personal"


def _product(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit words, by halves, as the whole would not fit a long."""
    high = (a * F.shiftright(b, 16)).bitwiseAND(0xFFFF)
    return (a * b.bitwiseAND(0xFFFF) + F.shiftleft(high, 16)).bitwiseAND(WORD)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def draw(seed: Column, k: Column) -> Column:
    """The k-th number in [0, 1) of a seed, from 1; seeds count by their low 32 bits."""
    shifted = lambda x, n: x.bitwiseXOR(F.shiftright(x, n))
    state = (seed.cast("long").bitwiseAND(WORD) + (k.cast("long") * F.lit(STEP)).bitwiseAND(WORD)).bitwiseAND(WORD)
    second = lambda t: (t + _product(shifted(t, 7), t.bitwiseOR(F.lit(61)))).bitwiseAND(WORD).bitwiseXOR(t)
    return _let(state, lambda a: _let(_product(shifted(a, 15), a.bitwiseOR(F.lit(1))), lambda t: _let(second(t), lambda u: shifted(u, 14) / F.lit(4294967296.0))))


def filled_sections(drafts: DataFrame, sections: DataFrame) -> DataFrame:
    """drafts (record_id, form_id, seed, ratio) with ``filled``: the ids of the sections that a draft fills, in order.

    ``sections`` is (form_id, section_pos, section_id). A draft never fills all but one section or more, and where
    it can it fills one that is not ``ALWAYS``. A draft of a form without sections fills none; a null ratio counts as 0.
    """
    listed = sections.groupBy("form_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section_pos", "section_id"))), lambda s: s["section_id"]).alias("all_ids"))
    joined = drafts.join(broadcast_if_few(listed), "form_id", "left").withColumn("all_ids", F.coalesce("all_ids", F.array().cast("array<string>"))).withColumn("optional", F.filter("all_ids", lambda s: ~s.isin(ALWAYS, NEVER)))
    drawn = joined.withColumn("draws", F.transform(F.sequence(F.lit(1), F.size("optional") + 2), lambda k: draw(F.col("seed"), k)))
    ratio = F.coalesce(F.col("ratio"), F.lit(0.0))
    taken = drawn.withColumn("taken", F.filter("optional", lambda s, i: F.get("draws", i) < ratio))
    picked = lambda ids, k: F.get(ids, F.floor(F.get("draws", k) * F.size(ids)).cast("int"))
    full = F.size("taken") + F.array_contains("all_ids", ALWAYS).cast("int") >= F.size("all_ids") - 1
    emptied = taken.withColumn("emptied", full & (F.size("taken") > 0))
    left = emptied.withColumn("left", F.when(F.col("emptied"), F.array_remove("taken", picked(F.col("taken"), F.size("optional")))).otherwise(F.col("taken")))
    forced = F.when(F.array_contains("all_ids", FALLBACK), F.lit(FALLBACK)).otherwise(picked(F.col("optional"), F.size("optional") + F.col("emptied").cast("int")))
    whole = F.when(F.size("left") == 0, F.array_compact(F.array(forced))).otherwise(F.col("left"))
    chosen = left.withColumn("chosen", whole)
    return chosen.select(*drafts.columns, F.filter("all_ids", lambda s: (s == ALWAYS) | F.array_contains("chosen", s)).alias("filled"))


def draft_values(drafts: DataFrame, sections: DataFrame, fields: DataFrame, personas: DataFrame, entries: DataFrame) -> DataFrame:
    """(record_id, field_id, value) of each draft.

    ``fields`` is (form_id, section_id, field_pos, field_id, type, parent_group, condition_field, condition_value), with a group's
    fields under its id in ``parent_group``; ``personas`` (record_id, field_id, value) and ``entries`` (record_id, group_id, entry,
    field_id, value) hold what could be filled in. A field with a condition is filled only if the field it names, in the draft so far,
    has that value. Files are never filled, and a group's fields are ``group.entry.field``.
    """
    # an outer explode: for the inner kind a filter on all of ``filled``, each step written out wherever the next names it, would go below
    shown = filled_sections(drafts, sections).select("record_id", "form_id", F.explode_outer("filled").alias("section_id")).where(F.col("section_id").isNotNull())
    placed = shown.join(sections, ["form_id", "section_id"]).join(fields.where(F.col("type") != "file"), ["form_id", "section_id"])
    own = placed.where(F.col("parent_group").isNull() & (F.col("type") != "group")).join(personas, ["record_id", "field_id"]).where(F.col("value").isNotNull())
    listed = own.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("section_pos", "field_pos", "field_id", "value", "condition_field", "condition_value"))).alias("f"))
    none = F.create_map().cast("map<string,string>")

    def put(so_far: Column, f: Column) -> Column:
        met = f["condition_field"].isNull() | F.try_element_at(so_far, f["condition_field"]).eqNullSafe(f["condition_value"])
        return F.when(met, F.map_concat(so_far, F.create_map(f["field_id"], f["value"]))).otherwise(so_far)

    plain = listed.select("record_id", F.explode(F.aggregate("f", none, put)).alias("field_id", "value"))
    groups = placed.where((F.col("type") == "group") & F.col("parent_group").isNull()).select("record_id", "form_id", F.col("field_id").alias("group_id"))
    subs = fields.where(F.col("parent_group").isNotNull() & (F.col("type") != "file")).select("form_id", F.col("parent_group").alias("group_id"), "field_id")
    inner = groups.join(subs, ["form_id", "group_id"]).join(entries, ["record_id", "group_id", "field_id"]).where(F.col("value").isNotNull())
    return plain.unionByName(inner.select("record_id", F.concat_ws(".", "group_id", F.col("entry").cast("string"), "field_id").alias("field_id"), "value"))
