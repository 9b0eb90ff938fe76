"""Values as text: three different equalities, and coercion by field type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Texts that count as booleans.
TRUE_TEXTS = ("true", "yes", "y", "1")
FALSE_TEXTS = ("false", "no", "n", "0")

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def as_number(text: Column) -> Column:
    """The number a text spells, else null; words such as nan and infinity stay texts."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def six_digits(x: Column) -> Column:
    """A number in at most six significant digits, without trailing zeros."""
    e = F.format_string("%.5e", x)
    power = F.regexp_extract(e, r"e([+-]\d+)$", 1).cast("int")
    plain = F.regexp_replace(F.regexp_replace(e.cast("decimal(20,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.split_part(e, F.lit("e"), F.lit(1)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when((power >= -4) & (power < 6), plain).otherwise(F.concat(mantissa, F.lit("e"), F.split_part(e, F.lit("e"), F.lit(2))))


def normalised(value: Column) -> Column:
    """For comparing; whole numbers without a point, others in six digits, texts trimmed and lower-cased."""
    text = strip(value.cast("string"))
    number = as_number(text)
    whole = (number == F.floor(number)) & (F.abs(number) < 1e18)
    return F.when(F.lower(text).isin("true", "false"), F.lower(text)).when(whole, number.cast("decimal(20,0)").cast("string")).when(number.isNotNull(), six_digits(number)).otherwise(F.lower(text))


def equal(a: Column, b: Column) -> Column:
    """Equality of the composite scorer."""
    return normalised(a) == normalised(b)


def loosely_equal(a: Column, b: Column, a_is_bool: Column | None = None) -> Column:
    """Texts without regard to case, or numbers; where one side is a boolean, by truth (any non-empty text is true)."""
    x, y = strip(a.cast("string")), strip(b.cast("string"))
    nx, ny = as_number(x), as_number(y)
    same = F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((F.lower(x) == F.lower(y)) | F.coalesce(nx == ny, F.lit(False)))
    if a_is_bool is None:
        return same
    return F.when(a_is_bool & b.isNotNull(), (x == "true") == (F.length(b.cast("string")) > 0)).otherwise(same)


def exactly_equal(a: Column, b: Column) -> Column:
    """The reward's equality: trimmed texts."""
    return strip(F.coalesce(a.cast("string"), F.lit(""))) == strip(F.coalesce(b.cast("string"), F.lit("")))


def as_boolean(text: Column) -> Column:
    """P37 for booleans; null where the text is neither."""
    low = F.lower(strip(text))
    return F.when(low.isin(*TRUE_TEXTS), True).when(low.isin(*FALSE_TEXTS), False)


def as_list(text: Column) -> Column:
    """P37 for lists: JSON with either quote, else split at commas, else one item."""
    t = strip(text)
    parsed = F.from_json(F.translate(t, "'", '"'), "array<string>")
    split = F.filter(F.transform(F.split(t, ","), strip), lambda x: x != "")
    return F.when(F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]")) & (F.size(parsed) >= 0), parsed).when(t == "", F.array().cast("array<string>")).otherwise(split)


def coerced(kind: Column, text: Column) -> Column:
    """P37 as text: canonical spelling where the type's coercion works, else the text itself."""
    number = as_number(strip(text))
    return F.coalesce(F.when(kind == "boolean", as_boolean(text).cast("string")).when(kind == "number", normalised(number.cast("string"))).when(kind == "multi_select", F.array_join(as_list(text), ",")), text)
