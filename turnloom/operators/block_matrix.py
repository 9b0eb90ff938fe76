"""Matrix products of block matrices: blocks meet on the inner index, and partial products are summed per entry.

A matrix is a table (i, k, rows) of blocks: ``rows`` are (r, v), a row's place in the block and its part of the columns. Rows that
a block lacks are zeros, as are columns that its rows do not reach. No task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 256

_ROWS = pa.list_(pa.struct([("r", pa.int32()), ("v", pa.list_(pa.float64()))]))


def blocks(df: DataFrame, row: str, values: str, size: int = SIZE) -> DataFrame:
    """Rows (row, an array of numbers) as blocks. Rows with a null number or array are left out; of rows with one number the last by values stays."""
    usable = df.where(F.col(row).isNotNull() & F.col(values).isNotNull() & ~F.exists(F.coalesce(values, F.array().cast("array<double>")), lambda x: x.isNull()))
    one = usable.groupBy(F.col(row).cast("long").alias("row")).agg(F.max(F.col(values).cast("array<double>")).alias("v"))
    cut = one.select(F.floor(F.col("row") / size).alias("i"), F.pmod("row", F.lit(size)).cast("int").alias("r"), "v", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("v") / size).cast("int") - 1))).alias("k"))
    return cut.groupBy("i", F.col("k").cast("long").alias("k")).agg(F.array_sort(F.collect_list(F.struct("r", F.slice("v", F.col("k") * size + 1, F.lit(size)).alias("v")))).alias("rows"))


def _multiplier(size: int, transposed: bool):
    def dense(rows: list) -> np.ndarray:
        out = np.zeros((size, size))
        for x in rows:
            out[x["r"], : len(x["v"])] = x["v"]
        return out

    def multiply(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            left, right = dense(x.as_py()), dense(y.as_py())
            product = (left.T if transposed else left) @ right
            out.append([{"r": int(r), "v": product[r].tolist()} for r in np.flatnonzero(np.abs(product).sum(axis=1))])
        return pa.array(out, _ROWS)

    return multiply


def product(a: DataFrame, b: DataFrame, size: int = SIZE, transpose: bool = False) -> DataFrame:
    """(row, col, value) of the non-zero entries of ``a`` times ``b``, or of the transpose of ``a`` times ``b``."""
    inner, outer = ("i", "k") if transpose else ("k", "i")
    left = a.select(F.col(outer).alias("row_block"), F.col(inner).alias("inner"), F.col("rows").alias("a_rows"))
    right = b.select(F.col("k").alias("col_block"), F.col("i").alias("inner"), F.col("rows").alias("b_rows"))
    parts = left.join(right, "inner").select("row_block", "col_block", F.arrow_udf(_multiplier(size, transpose), "array<struct<r:int,v:array<double>>>")("a_rows", "b_rows").alias("p"))
    rows = parts.select("row_block", "col_block", F.explode("p").alias("p")).select((F.col("row_block") * size + F.col("p.r")).alias("row"), "col_block", F.posexplode("p.v").alias("c", "value"))
    return rows.groupBy("row", (F.col("col_block") * size + F.col("c")).alias("col")).agg(F.sum("value").alias("value")).where("value <> 0")


def matrix_norms(entries: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """frobenius, max_abs and mean_abs (over all entries, zeros too) of (row, col, value)."""
    size = F.abs("value")
    return entries.agg(F.sqrt(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0))).alias("frobenius"), F.coalesce(F.max(size), F.lit(0.0)).alias("max_abs"), (F.coalesce(F.sum(size), F.lit(0.0)) / (n_rows * n_cols)).alias("mean_abs"))
