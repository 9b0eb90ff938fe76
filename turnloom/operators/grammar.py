"""Messages from a weighted grammar, and profiles whose keys depend on one another; every pick is that of an md5.

A grammar is a table (symbol, alternative, weight, parts): ``parts`` are texts, ``<symbol>`` for what is expanded further and
``{slot}`` for a value of the record. Messages start as one symbol and are expanded level by level: each level is one join with
the grammar, for all messages at once.

A profile is drawn key by key along its dependencies (ancestral sampling): a key's options and weights are rows for each
combination of its parents' values, so a draw is a join of what is drawn already with that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import unit_interval
from .scale import broadcast_if_few

#: Levels of a grammar.
DEPTH = 6


def _options(df: DataFrame, keys: list[str], order: str, weight: str, value: str) -> DataFrame:
    """keys and ``options``: an array of (upto, value), ``upto`` the share of the weights up to an option; options without weight go."""
    listed = df.where(F.col(weight) > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col(weight).cast("double").alias("w"), F.col(value).alias("value")))).alias("o"))
    running = lambda i: F.aggregate(F.slice("o", F.lit(1), i + 1), F.lit(0.0), lambda s, x: s + x["w"])
    total = F.aggregate("o", F.lit(0.0), lambda s, x: s + x["w"])
    return listed.select(*keys, F.transform("o", lambda x, i: F.struct((running(i) / total).alias("upto"), x["value"].alias("value"))).alias("options"))


def _picked(options: Column, u: Column) -> Column:
    """The first option whose share exceeds u; the last one, should rounding leave none."""
    return F.coalesce(F.get(F.filter(options, lambda o: u < o["upto"]), F.lit(0)), F.element_at(options, -1))["value"]


def expanded(starts: DataFrame, grammar: DataFrame, key: str, seed: str, depth: int = DEPTH) -> DataFrame:
    """(key, place, part): the parts of each message, texts and slots, in the order of ``place``.

    ``starts`` is (key, symbol). A symbol that the grammar lacks stands as it is; one that is still there after ``depth`` levels is an error.
    The pick at a place is that of md5(seed | key | place), so messages with one key are equal.
    """
    listed = broadcast_if_few(_options(grammar, ["symbol"], "alternative", "weight", "parts"))
    rows = starts.select(key, F.lit("0").alias("place"), F.concat(F.lit("<"), "symbol", F.lit(">")).alias("part"))
    for _ in range(depth):
        open_ = F.when(F.col("part").rlike("^<[^<>]+>$"), F.expr("substring(part, 2, length(part) - 2)"))
        met = rows.withColumn("symbol", open_).join(listed, "symbol", "left")
        parts = F.when(F.col("options").isNotNull(), _picked(F.col("options"), unit_interval(seed, key, "place"))).otherwise(F.array("part"))
        deeper = F.when(F.col("options").isNotNull(), F.concat(F.col("place"), F.lit("."), F.lpad(F.col("k").cast("string"), 3, "0"))).otherwise(F.col("place"))
        rows = met.select(key, "place", "options", F.posexplode(parts).alias("k", "part")).select(key, deeper.alias("place"), "part")
    left = rows.withColumn("symbol", F.when(F.col("part").rlike("^<[^<>]+>$"), F.expr("substring(part, 2, length(part) - 2)"))).join(listed.select("symbol", F.lit(True).alias("known")), "symbol", "left")
    return left.select(key, "place", F.when(F.col("known"), F.raise_error(F.concat(F.lit("deeper than the grammar's levels: "), "part"))).otherwise(F.col("part")).alias("part"))


def messages(starts: DataFrame, grammar: DataFrame, values: DataFrame, key: str, seed: str, depth: int = DEPTH) -> DataFrame:
    """(key, message): a message from the grammar with the record's values in its slots.

    ``values`` is (key, slot, value). Messages whose slots lack a value are left out, as are those without a start.
    """
    parts = expanded(starts, grammar, key, seed, depth).withColumn("slot", F.when(F.col("part").rlike(r"^\{[^{}]+\}$"), F.expr("substring(part, 2, length(part) - 2)")))
    filled = parts.join(values.select(key, "slot", "value"), [key, "slot"], "left").withColumn("text", F.when(F.col("slot").isNull(), F.col("part")).otherwise(F.col("value")))
    whole = filled.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", F.col("text").alias("t")))).alias("parts"), F.bool_or(F.col("text").isNull()).alias("lacks"))
    return whole.where(~F.col("lacks")).select(key, F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("message"))


def draw_order(parents: dict[str, list[str]]) -> list[str]:
    """Keys after all their parents, by name where that leaves a choice; raises for a cycle or an unknown parent."""
    if unknown := {p for ps in parents.values() for p in ps} - set(parents):
        raise ValueError(f"unknown parents {sorted(unknown)}")
    done: list[str] = []
    while len(done) < len(parents):
        ready = sorted(k for k, ps in parents.items() if k not in done and set(ps) <= set(done))
        if not ready:
            raise ValueError(f"a cycle among {sorted(set(parents) - set(done))}")
        done += ready
    return done


def drawn_profiles(records: DataFrame, table: DataFrame, parents: dict[str, list[str]], key: str, seed: str) -> DataFrame:
    """Records with a column for each key of ``parents``, drawn from its parents' values.

    ``table`` is (name, given, option, weight): ``given`` holds the parents' values in the order of ``parents``, ``*`` for any. The row with
    the fewest ``*``, from the left, decides; a key for whose parents there is no row is null. Keys that records have
    already stay as they are, and are parents like the others.
    """
    options = broadcast_if_few(_options(table, ["name", "given"], "option", "weight", "option"))
    out = records
    for name in draw_order(parents):
        if name in records.columns:
            continue
        own = options.where(F.col("name") == name)
        ways = [[]]
        for p in parents[name]:
            ways = [w + [v] for w in ways for v in (F.coalesce(F.col(p), F.lit("*")), F.lit("*"))]
        asked = F.array(*(F.array(*w) if w else F.array().cast("array<string>") for w in ways))
        tries = out.select(*out.columns, F.posexplode(asked).alias("_way", "_given"))
        met = tries.join(own.select(F.col("given").alias("_given"), F.col("options").alias("_options")), "_given", "left")
        first = met.groupBy(key).agg(F.min(F.when(F.col("_options").isNotNull(), F.struct("_way", "_options"))).alias("_first"))
        pick = _picked(F.col("_first._options"), F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.lit(name))), 1, 13), 16, 10).cast("double") / float(1 << 52))
        out = out.join(first.select(key, pick.alias(name)), key, "left")
    return out
