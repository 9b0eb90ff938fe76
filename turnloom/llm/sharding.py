"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Documents hash onto a ring of fixed arcs; each shard owns ``virtual_nodes`` points. An arc belongs to the first point
clockwise from it. No shard takes more than (1 + slack) of the mean bytes: an arc that does not fit continues clockwise
to the next shard with room, and only an arc that fits nowhere whole is split, by its documents' running bytes. Larger
arcs are placed first. So loads are even by construction, and a change of shards moves little beyond the new shard's
part.

Scale: the ring has at most ``arcs`` arcs, so the placement reads that many sums and no documents. Documents are ranked in
cells: an arc's slice by the hash of the row and, where a slice holds over ``hot_rows`` rows, as when one row is repeated,
a share of it as the rows are stored. Cells' running sums give the rest, so neither a shard nor an arc is sorted in one task.

Cases. Null texts have size 8 and the checksum of an empty text. Null or repeated doc_ids hash like any others; equal
rows are interchangeable. Empty tables give empty results. ``shard`` keeps the columns of its input but the text, and
leaves out those that are named like its own or its working columns.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise

#: Arcs of the ring: the bound of what the driver reads, about 2 MB.
ARCS = 1 << 16
VIRTUAL_NODES = 64

#: How far a shard may exceed the mean before keys overflow.
SLACK = 0.0005

#: Slices of an arc, the rows from which a slice is shared out, and its shares.
SLICES = 16
HOT_ROWS = 100_000
SHARES = 256

#: Cells whose offsets are broadcast; more of them meet the rows by a join on the cells by which these are dealt anyway.
BROADCAST_CELLS = 50_000


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Sorted (position of 64 bits, shard)."""
    return sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(virtual_nodes))


def clockwise(points: list[tuple[int, int]], at: int, shards: int) -> list[int]:
    """The shards in the order in which they follow position ``at``."""
    seen: list[int] = []
    k = bisect.bisect_left(points, (at, -1))
    for step in range(len(points)):
        s = points[(k + step) % len(points)][1]
        if s not in seen:
            seen.append(s)
            if len(seen) == shards:
                break
    return seen


def place(loads: list[tuple[int, int, int]], shards: int, arcs: int = ARCS, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> list[tuple[int, int, int, int, int]]:
    """(arc, from byte, to byte, shard, home shard) for (arc, bytes, documents) sums."""
    points = ring(shards, virtual_nodes)
    room = [int(-(-sum(b for _, b, _ in loads) * (1 + slack) // shards))] * shards
    placed = []
    for arc, size, docs in sorted(loads, key=lambda x: (-x[1], x[0])):
        order = clockwise(points, arc * ((1 << 64) // arcs), shards)
        at = next((s for s in order if room[s] >= size), None)
        if at is None and docs == 1:
            at = max(order, key=lambda s: room[s])
        if at is not None:
            room[at] -= size
            placed.append((arc, 0, size, at, order[0]))
            continue
        start = 0
        for s in order:
            part = min(size - start, max(0, room[s]))
            if part:
                placed.append((arc, start, start + part, s, order[0]))
                room[s] -= part
                start += part
        if start < size:  # rounding only: the capacities add up to the whole
            placed.append((arc, start, size, max(order, key=lambda s: room[s]), order[0]))
    return placed


def shard(documents: DataFrame, shards: int = 24, arcs: int = ARCS, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The documents' doc_id and other narrow columns with size, text_crc32, law, shard, slot, home_shard.

    The text itself stays where it is: the result has one row per document and no text.
    """
    spark = documents.sparkSession
    added = ("size", "text_crc32", "arc", "shard_order", "law", "shard", "slot", "home_shard", "grown_shard", "first_byte", "in_arc", "p_arc", "p_from", "p_to", "o_shard", "o_arc", "o_from", "first_rank", "offset", "slice", "share", "h_arc", "h_slice", "c_arc", "c_slice", "c_share", "c_byte", "c_rank")
    documents = documents.select([c for c in documents.columns if c.lower() not in added])
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.xxhash64("doc_id")
    narrow = documents.withColumns({
        "size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text.cast("binary")),
        "arc": F.shiftrightunsigned(order, 64 - (arcs.bit_length() - 1)).cast("int"), "shard_order": order,
    }).drop("text")
    row = F.xxhash64("doc_id", "text_crc32", "size")
    narrow = narrow.withColumns({"slice": F.pmod(row, F.lit(SLICES)).cast("int"), "share": F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)).cast("int")})
    narrow = materialise(narrow, "shard-rows")
    hot = narrow.groupBy(F.col("arc").alias("h_arc"), F.col("slice").alias("h_slice")).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).drop("n")
    hot = broadcast_if_small(materialise(hot, "shard-hot"))
    narrow = narrow.join(hot, (F.col("arc") == F.col("h_arc")) & (F.col("slice") == F.col("h_slice")), "left")
    narrow = narrow.withColumn("share", F.when(F.col("h_arc").isNotNull(), F.col("share")).otherwise(-1)).drop("h_arc", "h_slice")
    cells = materialise(narrow.groupBy(F.col("arc").alias("c_arc"), F.col("slice").alias("c_slice"), F.col("share").alias("c_share")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-cells")
    loads = cells.groupBy(F.col("c_arc").alias("arc")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    placed = place([(r["arc"], r["bytes"], r["n"]) for r in loads.collect()], shards, arcs, virtual_nodes, slack)
    plan = spark.createDataFrame(placed, "p_arc int, p_from long, p_to long, shard int, home_shard int")
    # at most SLICES * SHARES cells for an arc
    along = W.partitionBy("c_arc").orderBy("c_slice", "c_share").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("c_arc", "c_slice", "c_share", F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("c_byte"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("c_rank"))
    cells = broadcast_if_small(materialise(cells, "shard-offsets"), BROADCAST_CELLS)
    in_cell = W.partitionBy("arc", "slice", "share").orderBy("shard_order", F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    ranked = narrow.withColumns({"first_byte": F.coalesce(F.sum("size").over(in_cell.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "in_arc": F.row_number().over(in_cell)})
    ranked = ranked.join(cells, (F.col("arc") == F.col("c_arc")) & (F.col("slice") == F.col("c_slice")) & (F.col("share") == F.col("c_share")))
    ranked = ranked.withColumns({"first_byte": F.col("first_byte") + F.col("c_byte"), "in_arc": F.col("in_arc") + F.col("c_rank")})
    # at most one row per arc and a few for split arcs: bounded by the ring, so it may be broadcast
    ranked = ranked.join(F.broadcast(plan), (F.col("arc") == F.col("p_arc")) & (F.col("first_byte") >= F.col("p_from")) & (F.col("first_byte") < F.col("p_to")))
    ranked = materialise(ranked, "shard-ranked")
    pieces = ranked.groupBy("shard", "arc", "p_from").agg(F.count("*").alias("n"), F.min("in_arc").alias("first_rank"))
    offset = F.sum("n").over(W.partitionBy("shard").orderBy("arc", "p_from").rowsBetween(W.unboundedPreceding, -1))
    pieces = pieces.select(F.col("shard").alias("o_shard"), F.col("arc").alias("o_arc"), F.col("p_from").alias("o_from"), "first_rank", F.coalesce(offset, F.lit(0)).alias("offset"))
    out = ranked.join(F.broadcast(pieces), (F.col("shard") == F.col("o_shard")) & (F.col("arc") == F.col("o_arc")) & (F.col("p_from") == F.col("o_from")))
    own = [c for c in documents.columns if c != "text"]
    return out.select(
        *own, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("in_arc") - F.col("first_rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )
