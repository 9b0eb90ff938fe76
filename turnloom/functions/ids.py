"""Field-id notations; dotted is the canonical one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dash_to_dot(c: Column) -> Column:
    """Every dash, not only group separators."""
    return F.translate(c, "-", ".")


def starred(c: Column) -> Column:
    """Indices between dots become stars."""
    return F.regexp_replace(c, r"\.\d+\.", ".*.")


def dotted_to_dashed(c: Column) -> Column:
    """A group's dotted id as the composite id under which state is stored."""
    return F.regexp_replace(c, r"^(.+)\.(\d+)\.(.+)$", "$1-$2-$3")


def group_parts(c: Column) -> Column:
    """(group_id, entry, sub_id), or null where there is no group."""
    pattern = r"^(.+?)[.-](\d+)[.-](.+)$"
    return F.when(c.rlike(pattern), F.struct(
        F.regexp_extract(c, pattern, 1).alias("group_id"), F.regexp_extract(c, pattern, 2).cast("int").alias("entry"), F.regexp_extract(c, pattern, 3).alias("sub_id"),
    ))


def composite_id(group_id: Column, entry: Column, sub_id: Column) -> Column:
    """P36."""
    return F.concat_ws("-", group_id, entry.cast("string"), sub_id)


def in_catalogue(c: Column, catalogue: Column) -> Column:
    """the id, exactly or starred, is among the catalogue's ids."""
    return F.array_contains(catalogue, c) | F.array_contains(catalogue, starred(c))
