"""Statistics of vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def relative_change(a: Column, b: Column) -> Column:
    """Distance over the first one's norm; infinity where that is next to nothing."""
    return F.when(norm(a) <= 1e-10, F.lit(float("inf"))).otherwise(l2(a, b) / norm(a))


def max_abs(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))


def mean_abs(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) / F.size(a)


def component_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """A35, A36."""
    r = lambda c: F.round(c, 5)
    return df.groupBy(key).agg(F.count("*").alias("n"), r(F.avg(value)).alias("mean"), r(F.max(value)).alias("highest"), r(F.min(value)).alias("lowest"), r(F.sum(value)).alias("total"))


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both sides of a key, with which side it is in."""
    a, b = left.select(*keys, F.col(value).alias("a")), right.select(*keys, F.col(value).alias("b"))
    where = F.when(F.col("a").isNull(), "right_only").when(F.col("b").isNull(), "left_only").otherwise("both")
    return a.join(b, keys, "full").withColumn("where", where)
