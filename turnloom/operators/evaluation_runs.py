"""Evaluations that resume: cases are scored in batches, each written when it is done, and a run ends at the first failure.

A batch holds the cases of one hash. What is scored is in ``folder/batch=N/run=M``; a run that died left no ``_SUCCESS`` there
and is not read. A rerun scores only cases that have no score yet, so it may follow a crash, a halt or new cases. A failure
is a null score: it is kept with its case, never replaced by a number, and stops the run after its batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Halted(RuntimeError):
    """A batch had failures; ``batch`` and ``failures`` tell which and how many."""

    def __init__(self, batch: int, failures: int):
        super().__init__(f"{failures} cases of batch {batch} have no score")
        self.batch, self.failures = batch, failures


def _runs(spark: SparkSession, folder: str, batch: int) -> list[tuple[str, bool]]:
    """The runs of a batch, and whether each was finished."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={batch}")
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    paths = sorted(str(s.getPath()) for s in files.listStatus(top))
    return [(p, files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))) for p in paths]


def scored(spark: SparkSession, folder: str, batches: int, failures: bool = False) -> DataFrame | None:
    """All scored cases, or with ``failures`` those that never got a score; None if nothing was written."""
    paths = [p for b in range(batches) for p, finished in _runs(spark, folder, b) if finished]
    if not paths:
        return None
    rows = spark.read.parquet(*paths)
    good = rows.where(F.col("score").isNotNull())
    return rows.where(F.col("score").isNull()).join(good, "case_id", "left_anti").dropDuplicates(["case_id"]) if failures else good


def evaluate(cases: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, batches: int = 16, stop_after: int | None = None) -> int:
    """S24, 2.15: scores what has no score yet, by batches; returns how many cases it scored, or raises ``Halted``.

    ``cases`` has ``case_id``, unique and not null; ``score`` gives its rows back with a double ``score``. ``stop_after`` ends the run after so many batches.
    """
    spark, total = cases.sparkSession, 0
    for done, batch in enumerate(range(batches)):
        if done == stop_after:
            break
        own = cases.where(F.pmod(F.xxhash64("case_id"), F.lit(batches)) == batch)
        runs = _runs(spark, folder, batch)
        if finished := [p for p, f in runs if f]:
            own = own.join(spark.read.parquet(*finished).where(F.col("score").isNotNull()).select("case_id"), "case_id", "left_anti")
        if own.isEmpty():
            continue
        seen = Observation(f"batch-{batch}")
        counted = score(own).observe(seen, F.count("*").alias("n"), F.count_if(F.col("score").isNull()).alias("failures"))
        counted.write.parquet(f"{folder}/batch={batch}/run={len(runs)}")
        total += seen.get["n"] - seen.get["failures"]
        if seen.get["failures"]:
            raise Halted(batch, seen.get["failures"])
    return total
