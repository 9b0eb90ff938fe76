"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, materialise, written

#: Star steps converge in about log2 of the nodes squared; the bound only guards against an endless loop.
MAX_ROUNDS = 60

#: Edges up to which the table of minima, two longs for each node, is broadcast.
BROADCAST_EDGES = 500_000

#: Parts of a node's edges in the join with its minimum where that is shuffled, so that no centre is one task's.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """The edges (a, b) with m, the minimum of their ``a``: ``least`` is (u, m)."""
    if few:
        return edges.join(F.broadcast(least), edges["a"] == least["u"])
    salted = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return edges.join(salted, (edges["a"] == salted["u"]) & (F.pmod(F.xxhash64("b"), F.lit(SALTS)) == salted["salt"]))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every larger neighbour of a node links to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return _with_least(both, least, few).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """A node's smaller neighbours, and the node itself, link to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    joined = _with_least(down, least, few).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: longs); the label is the component's smallest node.

    No star or component is gathered in one place: each step joins edges with minima that were aggregated per node, and
    writes its edges to the shared folder, in place of those of the step before. A step makes at most two edges of one.
    """
    now = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    last, before, n = None, [], now.count()
    for _ in range(MAX_ROUNDS):
        few = n <= broadcast_edges
        now = materialise(_small_star(_large_star(now, few), few), "stars")
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        n = state[0]
        discard(now.sparkSession, before)
        before = written[-1:]
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def contracted(edges: DataFrame, labels: DataFrame, broadcast_nodes: int = BROADCAST_EDGES) -> DataFrame:
    """The edges (a, b) as edges of the components in ``labels`` (node, label, written); those inside one go.

    A node without a label is a component of its own. Edges of one node meet its label in parts, as in the star steps.
    """
    few = labels.count() <= broadcast_nodes
    parts = F.array(F.lit(0)) if few else F.sequence(F.lit(0), F.lit(SALTS - 1))
    known = labels.select(F.col("node").alias("u"), F.col("label").alias("m"), F.explode(parts).alias("part"))
    now = edges.select("a", "b")
    for side, other in (("a", "b"), ("b", "a")):
        if few:
            met = now.join(F.broadcast(known), now[side] == known["u"], "left")
        else:
            met = now.join(known, (now[side] == known["u"]) & (F.pmod(F.xxhash64(other), F.lit(SALTS)) == known["part"]), "left")
        now = met.select(F.coalesce("m", side).alias(side), other)
    return materialise(now.where(F.col("a") != F.col("b")).distinct(), "contracted")


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of the components that ``edges`` make with those of ``labels`` (node, label, written)."""
    over = connected_components(contracted(edges, labels)).select(F.col("node").alias("u"), F.col("label").alias("m"))
    over = materialise(over, "extended")
    lone = over.join(labels.select("label").distinct(), F.col("u") == F.col("label"), "left_anti").select(F.col("u").alias("node"), F.col("m").alias("label"))
    known = labels.join(broadcast_if_small(over), F.col("label") == F.col("u"), "left").select("node", F.coalesce("m", "label").alias("label"))
    return known.unionByName(lone)
