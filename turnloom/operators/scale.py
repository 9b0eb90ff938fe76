"""Numbering and broadcasting that hold when tables grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts into which an order is cut for numbering, and how exact the cuts are.
PARTS = 64
ACCURACY = 1000

#: Rows of a narrow side that may be broadcast.
FEW = 200_000


def broadcast_if_few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """Marks a side for broadcast if it has no more rows than the limit; counting stops there."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt by their keys into as many tasks as a shuffle has, for work that costs far more than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_places(df: DataFrame, groups: list[str], part: Column, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with each row's place, from 1, in its group by (part, order): ranked within parts, with the counts before."""
    keyed = df.withColumn("_part", part)
    sizes = keyed.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    met = F.col("_part").eqNullSafe(F.col("_p"))
    for k, g in enumerate(groups):
        met = met & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    place = F.row_number().over(W.partitionBy(*groups, "_part").orderBy(*order))
    joined = keyed.withColumn(name, place).join(sizes, met)  # a few parts per group: adaptive execution broadcasts them where they are few
    return joined.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_part", "_p", "_before", *(f"_g{k}" for k in range(len(groups))))


def numbered(df: DataFrame, by: Column, order: list[Column | str], name: str, groups: list[str] | None = None, parts: int = PARTS) -> DataFrame:
    """Places from 1 in the order of a numeric value and then ``order``, cut at its approximate quantiles."""
    cuts = df.agg(F.percentile_approx(by.cast("double"), [k / parts for k in range(1, parts)], ACCURACY).alias("c")).first()["c"] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < by.cast("double"))) if cuts else F.lit(0)
    return with_places(df, groups or [], part, [by, *order], name)
