from __future__ import annotations

import os

from pyspark.sql import functions as F

from turnloom.llm.common import ascii_lower, broadcast_if_small, clear, materialise, shared_dir


def test_lower_case_is_ascii_only(spark):
    df = spark.createDataFrame([("ABCxyz",), ("ÀÉÜ İ ABC",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(ascii_lower(F.col("t"))).collect()] == ["abcxyz", "ÀÉÜ İ abc", "", None]


def test_materialised_tables_go_when_cleared(spark):
    df = materialise(spark.range(5).select("id", F.array("id").alias("a")), "five")
    assert df.schema.names == ["id", "a"] and df.count() == 5
    folder = shared_dir(spark).removeprefix("file://")
    assert df.inputFiles() and all(folder in f for f in df.inputFiles()) and os.path.exists(folder)
    clear(spark)
    assert not os.path.exists(folder)
    assert materialise(spark.range(2), "again").count() == 2


def test_broadcast_only_within_the_limit(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hinted(broadcast_if_small(spark.range(3), 3)) and not hinted(broadcast_if_small(spark.range(4), 3))
