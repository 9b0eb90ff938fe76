"""Samples, splits and quotas, reproducible from a seed: every random order is that of md5(seed | key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scale import with_places


def shuffle_key(seed: str, *keys: str) -> Column:
    """K20."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def ranked(df: DataFrame, strata: list[str], seed: str, key: str, name: str = "rank") -> DataFrame:
    """Places in hash order. The hash's first digits cut a stratum into 256 parts, so that none is sorted in one task."""
    order = shuffle_key(seed, key)
    return with_places(df, strata, F.substring(order, 1, 2), [order, key], name)


def allocation(sizes: dict[str, int], total: int, weights: dict[str, float], default: float = 0.05) -> dict[str, int]:
    """K7: rows per stratum. Weights are normalised over the strata there are; each gets at least one, in name order, up
    to its size and what remains; the rest goes one by one to the largest with rows left.

    Strata are tens at most; the loop ends when all rows are taken.
    """
    left = min(total, sum(sizes.values()))
    sum_of_weights = sum(weights.get(s, default) for s in sizes)
    given = {}
    for s in sorted(sizes):
        given[s] = min(max(1, round(weights.get(s, default) / sum_of_weights * total)), sizes[s], left)
        left -= given[s]
    while left > 0:
        for s in sorted(given, key=lambda x: -sizes[x]):
            if left and given[s] < sizes[s]:
                given[s] += 1
                left -= 1
    return given


def stratified(df: DataFrame, stratum: str, key: str, seed: str, given: dict[str, int]) -> DataFrame:
    """K8: so many rows of each stratum."""
    most = F.coalesce(F.create_map(*(x for s, n in sorted(given.items()) for x in (F.lit(s), F.lit(n))))[F.col(stratum)], F.lit(0)) if given else F.lit(0)
    return ranked(df, [stratum], seed, key).where(F.col("rank") <= most)


def round_robin(df: DataFrame, stratum: str, key: str, seed: str, n: int) -> DataFrame:
    """K9: one of each stratum in turn until n rows."""
    return ranked(df, [stratum], seed, key).orderBy("rank", stratum).limit(n)


def two_samples(df: DataFrame, stratum: str, key: str, seed: str, n_train: int, n_val: int) -> DataFrame:
    """Two disjoint samples, the second drawn from what the first left."""
    turn = F.row_number().over(W.orderBy("rank", stratum))
    drawn = ranked(df, [stratum], seed, key).orderBy("rank", stratum).limit(n_train + n_val).withColumn("turn", turn)
    return drawn.withColumn("split", F.when(F.col("turn") <= n_train, "train").otherwise("val"))


def ratio_split(df: DataFrame, stratum: str, key: str, seed: str, ratio: float) -> DataFrame:
    """max(1, int(n * ratio)) rows of each stratum are val."""
    n_val = F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy(stratum)) * ratio))
    return ranked(df, [stratum], seed, key).withColumn("split", F.when(F.col("rank") <= n_val, "val").otherwise("train"))


def capped(df: DataFrame, stratum: str, value: str, key: str, seed: str, most: int) -> DataFrame:
    """At most so many rows of one stratum, all of the others."""
    return ranked(df, [stratum], seed, key).where((F.col(stratum) != value) | (F.col("rank") <= most))


def limit_across(df: DataFrame, stratum: str, key: str, limit: int, n_strata: int) -> DataFrame:
    """Limit // classes of each, then a cut at the limit."""
    place = F.row_number().over(W.partitionBy(stratum).orderBy(key))
    return df.withColumn("rank", place).where(F.col("rank") <= max(1, limit // n_strata)).orderBy(stratum, key).limit(limit)


def quota(n_file: Column, n_other: Column, total: int, share: float) -> Column:
    """An int share, a floor for files, and the rest natural."""
    first = F.floor(F.lit(total) * share)
    file = F.least(n_file, F.greatest(F.lit(1), F.floor((total - first) / 4)))
    return F.struct(F.least(n_other, first).alias("synthetic"), file.alias("file"), (total - F.least(n_other, first) - file).alias("natural"))


def unit_interval(seed: str, *keys: str) -> Column:
    """A number in [0, 1) from the hash: the first 13 hex digits of the md5."""
    return F.conv(F.substring(shuffle_key(seed, *keys), 1, 13), 16, 10).cast("double") / float(1 << 52)


def weighted_choice(u: Column, weights: list[float]) -> Column:
    """Index of the option whose cumulative, normalised weight first exceeds u."""
    total, upto, out = sum(weights), 0.0, None
    for k, w in enumerate(weights[:-1]):
        upto += w / total
        out = F.when(u < upto, k) if out is None else out.when(u < upto, k)
    return out.otherwise(len(weights) - 1) if out is not None else F.lit(0)


def without(df: DataFrame, held_out: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in the held-out set."""
    return df.join(held_out.select(*keys).distinct(), keys, "left_anti")


def first_of(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each case-folded key."""
    return df.withColumn("_k", key).withColumn("_rn", F.row_number().over(W.partitionBy("_k").orderBy(*order))).where(F.col("_rn") == 1).drop("_k", "_rn")


def top_up(combinations: DataFrame, done: DataFrame, keys: list[str], target: int) -> DataFrame:
    """Runs still missing for each combination."""
    have = done.groupBy(*keys).agg(F.count("*").alias("have"))
    return combinations.join(have, keys, "left").withColumn("need", F.greatest(F.lit(0), F.lit(target) - F.coalesce("have", F.lit(0)))).select(*keys, F.coalesce("have", F.lit(0)).alias("have"), "need")
