"""Grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scale import numbered


def share(df: DataFrame, *keys: str, digits: int = 4) -> DataFrame:
    """A1: count and percent of all rows."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), digits))


def top_within(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """A3: the k most frequent items of each group, ties by item."""
    counted = df.groupBy(group, item).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), item))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def index_percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Elements of the sorted values at n // 2 and int(0.9 n), with the ends.

    Ranks come from running counts of distinct values, so no group's values are gathered.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys).orderBy(value)
    counted = counted.withColumn("upto", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(W.partitionBy(*keys)))
    at = lambda share_: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share_), F.col(value)))
    return counted.groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("lowest"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(value))).alias("p50"), at(0.9).alias("p90"), F.max(value).alias("highest"))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Gold by predicted counts."""
    return df.groupBy(gold, pred).agg(F.count("*").alias("n"))


def polarity(df: DataFrame, flags: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A10: per flag tp, fn, tn, fp, and recall on positives and negatives, null where there are none."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(name).alias("flag"), g.cast("boolean").alias("gold"), p.cast("boolean").alias("pred")) for name, (g, p) in flags.items()))).alias("x")).select("x.*")
    out = stacked.groupBy("flag").agg(
        F.count_if(F.col("gold") & F.col("pred")).alias("tp"), F.count_if(F.col("gold") & ~F.col("pred")).alias("fn"),
        F.count_if(~F.col("gold") & ~F.col("pred")).alias("tn"), F.count_if(~F.col("gold") & F.col("pred")).alias("fp"),
    )
    rate = lambda hit, miss: F.round(F.when(F.col(hit) + F.col(miss) > 0, F.col(hit) / (F.col(hit) + F.col(miss))), 6)
    return out.withColumns({"pos_recall": rate("tp", "fn"), "neg_recall": rate("tn", "fp")})


def pivoted(df: DataFrame, row: str, column: str, values: list[str], measure: Column) -> DataFrame:
    """Rows by labels; the labels are given, so no pass is spent on finding them."""
    return df.groupBy(row).pivot(column, values).agg(measure)


def combinations(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Count per combination of true flags."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))
    return df.groupBy(F.array_join(names, "+").alias("combo")).agg(F.count("*").alias("n"))


def mean_by_tag(df: DataFrame, tags: str, value: str, untagged: str = "(legacy)") -> DataFrame:
    """One row feeds each of its tags; rows without tags have one of their own."""
    tagged = df.select(F.explode_outer(tags).alias("tag"), value)
    return tagged.groupBy(F.coalesce("tag", F.lit(untagged)).alias("tag")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def trial_stats(df: DataFrame, key: str, value: str, digits: int = 6) -> DataFrame:
    """Mean, population and sample deviation, ends and range of repeated trials."""
    r = lambda c: F.round(c, digits)
    return df.groupBy(key).agg(
        F.count("*").alias("n"), r(F.avg(value)).alias("mean"), r(F.stddev_pop(value)).alias("sd_pop"), r(F.stddev_samp(value)).alias("sd_samp"),
        r(F.min(value)).alias("lowest"), r(F.max(value)).alias("highest"), r(F.max(value) - F.min(value)).alias("spread"),
    )


def flips(df: DataFrame, key: str, order: str, vote: str) -> DataFrame:
    """Votes that differ from the first, and the strict majority."""
    first = df.groupBy(key).agg(F.min_by(vote, order).alias("first_vote"), F.count("*").alias("n"), F.count_if(F.col(vote)).alias("yes"))
    return first.select(key, "n", F.when(F.col("first_vote"), F.col("n") - F.col("yes")).otherwise(F.col("yes")).alias("flips"), (F.col("yes") * 2 > F.col("n")).alias("majority"))


def ensemble_mean(df: DataFrame, key: str, scores: str, strict: bool = True) -> DataFrame:
    """Mean by array position; strict gives null where any call failed (null array)."""
    each = df.select(key, F.posexplode_outer(scores).alias("item", "score"), F.col(scores).isNull().alias("failed"))
    failed = df.groupBy(key).agg(F.count_if(F.col(scores).isNull()).alias("n_failed"))
    out = each.where(~F.col("failed")).groupBy(key, "item").agg(F.avg("score").alias("mean")).join(failed, key)
    return out.withColumn("mean", F.round(F.when((F.col("n_failed") == 0) | F.lit(not strict), F.col("mean")), 6))


def paired(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both sides of common keys, and candidate minus baseline."""
    a, b = left.select(*keys, F.col(value).alias("base")), right.select(*keys, F.col(value).alias("cand"))
    return a.join(b, keys).withColumn("delta", F.col("cand") - F.col("base"))


def win_loss(df: DataFrame, delta: str = "delta", tie: float = 1e-9) -> DataFrame:
    """Wins, losses and near ties (a tiny delta counts twice, as documented), with drift statistics."""
    d = F.col(delta)
    return df.agg(
        F.count("*").alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(F.abs(d) < tie).alias("ties"),
        F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.stddev_pop(d), 6).alias("sd_delta"), F.round(F.max(F.abs(d)), 6).alias("max_abs_delta"),
    )


def extremes(df: DataFrame, k: int, key: str, delta: str = "delta") -> DataFrame:
    """K4, K5: the k lowest as regressions and the k highest as boosts; they may overlap."""
    low = df.orderBy(F.asc(delta), key).limit(k).withColumn("side", F.lit("regression"))
    high = df.orderBy(F.desc(delta), key).limit(k).withColumn("side", F.lit("boost"))
    return low.unionByName(high)


def by_sign(df: DataFrame, key: str, delta: str = "delta") -> DataFrame:
    """K6: ranks positives from the top and negatives from the bottom; exact ties go."""
    moved = df.where(F.col(delta) != 0).withColumn("side", F.when(F.col(delta) > 0, "boost").otherwise("regression"))
    return numbered(moved, -F.abs(F.col(delta)), [key], "rank", ["side"])


def segments(df: DataFrame, step: str, value: str, parts: int = 6, least: int = 10) -> DataFrame:
    """Means over about ``parts`` equal ranges of steps, each at least ``least`` wide."""
    width = F.lit(max(least, (df.agg(F.max(step)).first()[0] or 0) // parts))
    cut = df.select(step, value, width.alias("width")).withColumn("segment", F.floor((F.col(step) - 1) / F.col("width")))
    return cut.groupBy("segment").agg(F.min(step).alias("from_step"), F.max(step).alias("to_step"), F.round(F.avg(value), 6).alias("mean"))


def best_worst(df: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """The first step with the highest and with the lowest value."""
    return df.groupBy(*keys).agg(
        F.max_by(step, F.struct(F.col(value), -F.col(step))).alias("best_step"), F.max(value).alias("best"),
        F.min_by(step, F.struct(F.col(value), F.col(step))).alias("worst_step"), F.min(value).alias("worst"),
    )


def ratio_of_sums(df: DataFrame, keys: list[str], part: Column, whole: Column, name: str = "ratio") -> DataFrame:
    """A ratio of sums, never a mean of ratios."""
    return df.groupBy(*keys).agg(F.round(F.sum(part) / F.nullif(F.sum(whole), F.lit(0)), 6).alias(name))


def first_examples(df: DataFrame, buckets: str, order: str, *columns: str) -> DataFrame:
    """Count and first record of each bucket."""
    each = df.select(F.explode(buckets).alias("bucket"), order, *columns)
    return each.groupBy("bucket").agg(F.count("*").alias("n"), F.min(order).alias("first_" + order), *(F.min_by(c, order).alias(c) for c in columns))


def throughput(df: DataFrame, keys: list[str], ok: Column, seconds: str, planned: int, cost_per_call: float) -> DataFrame:
    """Per key calls done, the percent that succeeded, seconds a call, seconds and cost to go at that pace."""
    done = df.groupBy(*keys).agg(F.count("*").alias("n_done"), F.count_if(~ok).alias("n_errors"), F.sum(seconds).alias("elapsed"))
    pace = F.col("elapsed") / F.col("n_done")
    return done.select(
        *keys, "n_done", "n_errors", F.round((1 - F.col("n_errors") / F.col("n_done")) * 100, 4).alias("success_pct"), F.round(pace, 6).alias("per_call"),
        F.round((planned - F.col("n_done")) * pace, 4).alias("eta_seconds"), F.round(F.col("n_done") * cost_per_call, 6).alias("cost"),
    )


def completeness(filled: Column, total: Column) -> Column:
    """Whole percent, half up; 100 where nothing is required."""
    return F.when(total == 0, 100).otherwise(F.round(100.0 * filled / total).cast("int"))
