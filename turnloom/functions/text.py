"""Text helpers that keep the source system's white-space and delimiter rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The block delimiter and the marker that begins a formatted field.
DELIMITER = "---actions---"
FORMAT_LEAK = r"\[\[\s*##|---actions---"


def strip(c: Column) -> Column:
    """Trim all white space, as opposed to Spark's trim, which takes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def has_delimiter(c: Column) -> Column:
    """P3."""
    return F.contains(c, F.lit(DELIMITER))


def text_before(c: Column) -> Column:
    """The trimmed text before the delimiter, or the whole text as it is."""
    at = F.locate(DELIMITER, c)
    return F.when(at > 0, strip(c.substr(F.lit(1), at - 1))).otherwise(c)


def text_portion(c: Column) -> Column:
    """As P2 but trimmed in both cases."""
    return strip(F.split_part(c, F.lit(DELIMITER), F.lit(1)))


def without_actions(c: Column) -> Column:
    """Cut from the delimiter's line to the end."""
    return F.regexp_replace(c, r"(?s)\n*" + DELIMITER + r"\n.*\z", "")


def split_prose(c: Column) -> Column:
    """The text on both sides of the fenced block after the delimiter, and the block, as a struct."""
    block = r"(?s)" + DELIMITER + r"\s*```json\s*(.*?)```"
    return F.struct(strip(F.regexp_replace(c, block, "")).alias("prose"), strip(F.regexp_extract(c, block, 1)).alias("block"))


def has_value_loose(c: Column) -> Column:
    """present and not the empty string."""
    return c.isNotNull() & (c.cast("string") != "")


def has_value(c: Column) -> Column:
    """present and not blank."""
    return c.isNotNull() & (strip(c.cast("string")) != "")


def format_leak(c: Column) -> Column:
    """F16."""
    return c.rlike(FORMAT_LEAK)


def slug(c: Column, most: int = 50) -> Column:
    """P57."""
    dashed = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(dashed, r"^-+|-+$", ""), F.lit(most))


def humanise(kind: Column, value: Column) -> Column:
    """Yes or no for booleans, comma-joined lists, text otherwise."""
    return F.when(kind == "boolean", F.when(value == "true", "yes").otherwise("no")).otherwise(value)


def name_leak(output: Column, given: Column, names: Column) -> Column:
    """some name is in the output and not in what was given."""
    low_out, low_in = F.lower(output), F.lower(given)
    return F.exists(names, lambda n: F.contains(low_out, F.lower(n)) & ~F.contains(low_in, F.lower(n)))


def clip(c: Column, most: int) -> Column:
    """K18."""
    return F.left(c, F.lit(most))
