"""Pieces shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in one Arrow batch: texts can be long, so batches stay small.
ARROW_ROWS = 512

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else. All-ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that the driver and all executors share.

    Only where a local master runs all tasks on this machine may that be a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/turnloom-{app}"
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="turnloom-")
    return _own_dir[app]


def materialise(df: DataFrame, tag: str, group_bytes: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives lost executors.

    ``group_bytes`` bounds the row groups, which a task holds whole while it writes one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", str(group_bytes)) if group_bytes else df.write).parquet(path)
    written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that this process materialised and has not discarded, oldest first.
written: list[str] = []


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes materialised tables that nothing will read any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if name in written:
            written.remove(name)


def clear(spark: SparkSession) -> None:
    """Deletes what this application materialised; results that read it are void after that."""
    discard(spark, [shared_dir(spark)])
    written.clear()


def small_arrow_batches(spark: SparkSession) -> None:
    """Bound what one Python worker holds, as one batch may consist of long texts only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a side that may be broadcast: with two or three numbers each under 200 MB. Larger sides are shuffled.
BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a narrow, materialised side for broadcast if its counted rows are within the limit; else leaves it."""
    return F.broadcast(df) if df.count() <= limit else df
