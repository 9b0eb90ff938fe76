"""Sessions, drafts, submissions and the vault as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .turns import latest


def expired(expires_at: Column, now: Column) -> Column:
    """F20."""
    return expires_at <= now


def lookup(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows by key, with a found flag."""
    return wanted.join(rows.withColumn("_there", F.lit(True)), key, "left").withColumn("found", F.col("_there").isNotNull()).drop("_there")


def owner_key(sections: Column, name: str = "email") -> Column:
    """The first section's value of a name, from an array of maps, lower-cased and trimmed."""
    return F.lower(F.trim(F.get(F.filter(F.transform(sections, lambda s: F.element_at(s, name)), lambda v: v.isNotNull() & (v != "")), F.lit(0))))


def submissions(drafts: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """The latest draft of each key, rejected if it has errors, with a reproducible reference number."""
    bad = errors.groupBy(key).agg(F.count("*").alias("n_errors"))
    out = latest(drafts, [key], F.desc("updated_at"), F.desc("draft_id")).join(bad, key, "left")
    return out.withColumns({"status": F.when(F.coalesce("n_errors", F.lit(0)) > 0, "rejected").otherwise("accepted"), "ref_number": F.upper(F.substring(F.md5(F.concat_ws("|", key, "draft_id")), 1, 8))})


def vault_summary(entries: DataFrame, group: str, name: str) -> DataFrame:
    """Count and one line per entry."""
    return entries.groupBy(group).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col(name)))), "\n").alias("lines"))


def turn_log(df: DataFrame, session: str, order: str, delta: str, cost: str) -> DataFrame:
    """Per session turns, changed values and running cost."""
    from pyspark.sql import Window as W

    w = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({"cost_so_far": F.round(F.sum(cost).over(w), 6), "changes_so_far": F.count_if(F.col(delta).isNotNull()).over(w)})


def reproducibility(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Which columns differ between stored and fresh rows of a key; none means identical."""
    other = fresh.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    differ = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns)))
    return stored.join(other, key).select(key, differ.alias("differing"), (F.size(differ) == 0).alias("identical"))
