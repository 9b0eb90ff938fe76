"""Replies in marker format: ``[[ ## name ## ]]`` before each field, ``completed`` at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

MARKER = r"\[\[\s*##\s*(\w+)\s*##\s*\]\]"
COMPLETED = r"\[\[\s*##\s*completed\s*##\s*\]\]"


def names(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(MARKER), F.lit(1))


def completed(c: Column) -> Column:
    return c.rlike(COMPLETED)


def report(c: Column, expected: Column) -> Column:
    """Found, missing and extra fields, and whether the format holds."""
    found = F.array_except(names(c), F.array(F.lit("completed")))
    missing = F.array_except(expected, found)
    return F.struct(
        completed(c).alias("has_completed"), F.array_sort(F.array_except(found, expected)).alias("extra"), F.array_sort(missing).alias("missing"),
        (completed(c) & (F.size(missing) == 0)).alias("format_ok"),
    )


def value(c: Column, name: str | Column) -> Column:
    """P25: the text after a marker, up to the next or the end; null without the marker."""
    name = F.lit(name) if isinstance(name, str) else name
    pattern = F.concat(F.lit(r"(?s)\[\[\s*##\s*"), name, F.lit(r"\s*##\s*\]\]\s*\n?(.*?)(?=\[\[|\z)"))
    return F.when(F.regexp_like(c, pattern), strip(F.call_function("regexp_extract", c, pattern, F.lit(1))))


def all_values(c: Column) -> Column:
    """Map from name to text; the last of equal names wins."""
    texts = F.transform(F.filter(F.split(c, MARKER), lambda x, i: i > 0), strip)
    return F.map_from_entries(F.arrays_zip(names(c).alias("key"), texts.alias("value")))


def text_list(c: Column) -> Column:
    """JSON array of texts, else a bracketed list with quotes, else null; blank gives an empty list."""
    raw = strip(c)
    parsed = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    parts = F.regexp_extract_all(raw.substr(F.lit(2), F.length(raw) - 2), F.lit(r"\"[^\"]*\"|'[^']*'|[^,]+"), F.lit(0))
    quoted = "^(\"[^\"]*\"|'[^']*')$"  # a quote counts only right after its comma
    loose = F.filter(F.transform(parts, lambda p: strip(F.when(p.rlike(quoted), p.substr(F.lit(2), F.length(p) - 2)).otherwise(p))), lambda p: p != "")
    bracketed = F.startswith(raw, F.lit("[")) & F.endswith(raw, F.lit("]"))
    return F.when(raw == "", F.array().cast("array<string>")).when(F.size(parsed) >= 0, parsed).when(bracketed, loose)


def two_lists(c: Column) -> Column:
    """(ids, vals, done) of a reply with both list markers."""
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(text_list(value(c, "field_ids")), none).alias("ids"), F.coalesce(text_list(value(c, "field_values")), none).alias("vals"), completed(c).alias("done"))


def format_reward(c: Column) -> Column:
    """One point for all markers, one more for equal, non-empty lists."""
    markers = F.contains(c, F.lit("[[ ## field_ids ## ]]")) & F.contains(c, F.lit("[[ ## field_values ## ]]")) & F.contains(c, F.lit("[[ ## completed ## ]]"))
    lists = two_lists(c)
    full = (F.size(lists["ids"]) > 0) & (F.size(lists["ids"]) == F.size(lists["vals"]))
    return F.when(markers & full, 2.0).when(markers, 1.0).otherwise(0.0)
