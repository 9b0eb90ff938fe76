"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Words are runs of characters other than ASCII white space, with A to Z lower-cased; a document's set holds its distinct
shingles of ``words`` words (a shorter text is one shingle). Documents link where ``100 * both >= PERCENT * either``.

Sketching fills ``COORDINATES`` bins in rounds: in round i each element falls into a hashed bin with the value i + u, u
hashed too, and a bin keeps its smallest value; from round ``COORDINATES`` on, round i puts every element into bin i -
``COORDINATES``. So every bin fills, after the first rounds for all but small sets, and two sets agree in a bin with the
probability of their Jaccard similarity, with concentration as of independent samples. Further rounds change no full bin,
so rounds end once all are full.

``BANDS`` keys of ``ROWS`` bins give candidates: a pair with a similarity of 0.8 shares no key with probability 5e-8. One
bit per bin, ``FAR`` of which may differ (six deviations from the mean at 0.8), sorts out unlike sets. What is left is
confirmed on the full sets. Groups of near copies cost about one confirmation per set and round: in the first round every
set meets one set of its key, in the next one set of each component in a key meets the key's first. Then components that
have sets alike by key and bits make families, and a family's sets are compared in blocks: those outside its largest
component with all of it, each pair of blocks in a task of its own that gives a forest of links, not pairs. So no link is
lost that a key and the bits leave.

Cases. Equal sets are one node, whatever their texts. Null texts and texts without words have an empty set, link with
nothing, and are a component each. Rows with null doc_ids take their component's id, and are kept only if no row there has
an id. Repeated doc_ids keep their rows; ties don't arise. Texts are read whole. Other columns are not read. Sets of
shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, small_arrow_batches
from .components import connected_components
from .simhash import with_shingles

PERCENT = 80

#: Bins of a sketch, and the keys made of the first of them.
COORDINATES = 256
BANDS, ROWS = 32, 4

#: Bits, one for each bin, in which sets of a similarity of 0.8 may differ: 25.6 on average, with a deviation of 4.8.
FAR = 55

#: Rounds of one set per component before families are compared.
STAR_ROUNDS = 2

#: Pairs of one set, and members of a key, in one task.
CHUNK = 512

#: Members of a key that are paired by a plain join; larger keys are compared in chunks.
HOT_KEY = 32

#: Shingles of a family on each side of one comparison.
BLOCK_SHINGLES = 250_000

SKETCH = "struct<node: long, size: int, keys: array<long>, bits: array<long>>"


def _mix(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sketch(elements: np.ndarray) -> np.ndarray:
    """The bins of a non-empty set of unsigned hashes."""
    t, low = COORDINATES, 64 - int(math.log2(COORDINATES)) - 1  # values have the round in their highest bits
    bins = np.full(t, np.iinfo(np.uint64).max)
    done, step = 0, max(1, math.ceil(t * (math.log(t) + 3) / len(elements)))
    while done < 2 * t:
        rounds = np.arange(done, min(done + step, 2 * t), dtype=np.uint64)
        z = _mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        value = (rounds[:, None] << np.uint64(low)) | (z & np.uint64((1 << low) - 1))
        place = (z >> np.uint64(64 - int(math.log2(t)))).astype(np.int64)
        fixed = rounds >= t
        place[fixed] = (rounds[fixed, None] - np.uint64(t)).astype(np.int64)
        np.minimum.at(bins, place.ravel(), value.ravel())
        done += step
        if bins.max() < np.iinfo(np.uint64).max:
            break
    return bins


def keys_of(bins: np.ndarray) -> np.ndarray:
    """A hash of each band's bins."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in bins[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        key = _mix((key ^ column) * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def set_hash(elements: np.ndarray) -> int:
    """A hash of a set that no order of its elements changes."""
    mixed = _mix(elements + np.uint64(0x9E3779B97F4A7C15))
    added, crossed = mixed.sum(dtype=np.uint64, keepdims=True), np.bitwise_xor.reduce(_mix(mixed), keepdims=True)
    return int(_mix(_mix(added) + crossed).view(np.int64)[0])


def _sketches(hashes: pa.Array) -> pa.Array:
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    flat, at = np.asarray(hashes.values.to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64), hashes.offsets.to_numpy()
    node, size, keys, bits = [], [], [], []
    for a, b in zip(at, at[1:], strict=False):
        own = np.unique(flat[a:b])
        size.append(len(own))
        if not len(own):
            node.append(None), keys.append(None), bits.append(None)
            continue
        bins = sketch(own)
        node.append(set_hash(own))
        keys.append(keys_of(bins))
        bits.append(np.packbits((bins & np.uint64(1)).astype(np.uint8)).view(np.int64))
    lists = pa.list_(pa.int64())
    return pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(keys, lists), pa.array(bits, lists)], names=["node", "size", "keys", "bits"])


def sketched(documents: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, text_hash, node (a hash of the set, null if it is empty), size, keys and bits, one row per input row."""
    small_arrow_batches(documents.sparkSession)
    return with_shingles(documents, words).select("doc_id", "text_hash", F.arrow_udf(_sketches, SKETCH)("hashes").alias("s")).select("doc_id", "text_hash", "s.*")


def _apart(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(COORDINATES // 64)), F.lit(0))


def _near(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, b) of which the bits differ in ``FAR`` places at most."""
    for side in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("node").alias(side), F.col("bits").alias(f"{side}_bits")), side)
    return pairs.where(_apart("a_bits", "b_bits") <= FAR).select("a", "b")


def full_sets(nodes: DataFrame, documents: DataFrame, words: int) -> DataFrame:
    """(node, own): the distinct shingles of each node, made anew from one text, so that only those of candidates are ever stored."""
    wanted = materialise(nodes.select("node", F.col("text_hash").alias("w_hash"), "rows"), "minhash-wanted")
    texts = documents.select("doc_id", "text")
    found = []
    for several in (False, True):
        some = wanted.where((F.col("rows") > 1) == several)
        met = texts.join(broadcast_if_small(some.select("w_hash")), F.xxhash64("text") == F.col("w_hash"), "left_semi")
        sets = with_shingles(met, words).select("text_hash", F.array_distinct("hashes").alias("own"))
        sets = sets.dropDuplicates(["text_hash"]) if several else sets
        found.append(sets.join(broadcast_if_small(some), F.col("text_hash") == F.col("w_hash")).select("node", "own"))
    return materialise(found[0].unionByName(found[1]), "minhash-sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A set that many pairs share as their ``b`` goes to several tasks."""
    per_b = materialise(pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "minhash-chunks")
    dealt = pairs.join(broadcast_if_small(per_b), "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int").alias("chunk"))
    left = sets.select(F.col("node").alias("a"), F.col("own").alias("a_own")).join(broadcast_if_small(materialise(dealt, "minhash-dealt")), "a")
    copies = per_b.select("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("b_own")).join(broadcast_if_small(copies), "b")
    both = F.size(F.array_intersect("a_own", "b_own"))
    either = F.size("a_own") + F.size("b_own") - both
    return left.join(right, ["b", "chunk"]).where(100 * both.cast("long") >= PERCENT * either.cast("long")).select("a", "b")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members (key, node) with the label of each node's component: the node itself where it has no link."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(broadcast_if_small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _star_pairs(labelled: DataFrame, first: bool) -> DataFrame:
    """(a, b): one set of each component in a key, and the key's smallest; in the first round each set's smallest such only."""
    least = labelled.groupBy("key", "label").agg(F.min("node").alias("node"))
    heads = least.groupBy("key").agg(F.min(F.struct("label", "node")).alias("head"), F.count("*").alias("n")).where("n > 1").select("key", F.col("head.label").alias("b_label"), F.col("head.node").alias("b"))
    met = least.join(broadcast_if_small(heads), "key").where(F.col("label") != F.col("b_label")).select(F.col("node").alias("a"), "b")
    return met.groupBy("a").agg(F.min("b").alias("b")) if first else met.distinct()


def _forest(batch: pa.Table) -> pa.Table:
    """For one chunk of a large key: edges between labels that have sets with bits alike, fewer than there are labels."""
    rest = batch["rest"].to_numpy(zero_copy_only=False).astype(bool)
    label = batch["label"].to_numpy()
    bits = batch["bits"].combine_chunks().values.to_numpy().reshape(-1, COORDINATES // 64)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    edges = []
    others, other_bits = label[~rest], bits[~rest].view(np.uint64)
    for own, own_bits in zip(label[rest], bits[rest].view(np.uint64), strict=True):
        near = np.bitwise_count(other_bits ^ own_bits).sum(axis=1, dtype=np.int64) <= FAR
        for other in np.unique(others[near]):
            x, y = find(int(own)), find(int(other))
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((int(own), int(other)))
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _alike(labelled: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b): labels that have sets alike by key and bits, fewer than all such but enough to join them."""
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("label", "n").alias("main"), F.count("*").alias("labels"), F.sum("n").alias("members")).where("labels > 1")
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    mixed = broadcast_if_small(materialise(main.select("key", "main", "members", chunks.alias("chunks")), "minhash-mixed"))
    every = materialise(labelled.join(mixed, "key").join(bits, "node").withColumn("rest", F.col("label") != F.col("main")), "minhash-members")
    few = every.where(F.col("members") <= HOT_KEY)
    side = lambda df, x: df.select("key", F.col("label").alias(x), F.col("bits").alias(f"{x}_bits"))
    cold = side(few.where("rest"), "a").join(side(few, "b"), "key").where((F.col("a") != F.col("b")) & (_apart("a_bits", "b_bits") <= FAR)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    many = every.where(F.col("members") > HOT_KEY)
    a = many.where("rest").select("key", "label", "bits", "rest", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    b = many.select("key", "label", "bits", F.lit(False).alias("rest"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    return cold.unionByName(a.unionByName(b).groupBy("key", "chunk").applyInArrow(_forest, "a long, b long"))


def _confirm_block(batch: pa.Table) -> pa.Table:
    """For one pair of blocks of a family: a forest of the links between sets of unlike labels."""
    rest = batch["rest"].to_numpy(zero_copy_only=False).astype(bool)
    node, label = batch["node"].to_numpy(), batch["label"].to_numpy()
    own = batch["own"].combine_chunks()
    at, flat = own.offsets.to_numpy(), own.values.to_numpy(zero_copy_only=False)
    bits = batch["bits"].combine_chunks().values.to_numpy().reshape(-1, COORDINATES // 64).view(np.uint64)
    size = np.diff(at)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    others, edges = np.flatnonzero(~rest), []
    for i in np.flatnonzero(rest):
        fits = (label[others] != label[i]) & (100 * np.minimum(size[others], size[i]) >= PERCENT * np.maximum(size[others], size[i]))
        near = others[fits]
        near = near[np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64) <= FAR]
        if not len(near):
            continue
        mine = np.sort(flat[at[i] : at[i + 1]])
        theirs = np.concatenate([flat[at[j] : at[j + 1]] for j in near])
        place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        both = np.add.reduceat((mine[place] == theirs).astype(np.int64), np.cumsum(size[near]) - size[near])
        for j in near[100 * both >= PERCENT * (size[near] + size[i] - both)]:
            x, y = find(int(label[i])), find(int(label[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((int(node[i]), int(node[j])))
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _family_links(labelled: DataFrame, bits: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(a, b): links that join what links within families of labels alike; None if there are no families."""
    edges = materialise(_alike(labelled, bits), "minhash-alike")
    if edges.isEmpty():
        return None
    families = materialise(connected_components(edges).select(F.col("node").alias("label"), F.col("label").alias("family")), "minhash-families")
    members = labelled.select("node", "label").distinct().join(broadcast_if_small(families), "label")
    members = materialise(members.join(sets.select("node", F.size("own").alias("size")), "node"), "minhash-family-members")
    per = members.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    blocks = lambda size: F.ceil(size / BLOCK_SHINGLES).cast("int")
    whole = per.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("most"))
    whole = whole.select("family", "main", blocks(F.col("size")).alias("b_blocks"), blocks(F.col("size") - F.col("most.size")).alias("a_blocks"))
    placed = members.join(broadcast_if_small(materialise(whole, "minhash-family-sizes")), "family")
    order = F.xxhash64("node")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = placed.where(F.col("label") != F.col("main")).select("family", "node", "label", F.lit(True).alias("rest"), F.pmod(order, F.col("a_blocks")).cast("int").alias("a_block"), each(F.col("b_blocks")).alias("b_block"))
    b = placed.select("family", "node", "label", F.lit(False).alias("rest"), each(F.col("a_blocks")).alias("a_block"), F.pmod(order, F.col("b_blocks")).cast("int").alias("b_block"))
    rows = sets.join(broadcast_if_small(materialise(a.unionByName(b), "minhash-blocks")), "node").join(bits, "node")
    return rows.select("family", "a_block", "b_block", "node", "label", "rest", "own", "bits").groupBy("family", "a_block", "b_block").applyInArrow(_confirm_block, "a long, b long")


def linked(nodes: DataFrame, documents: DataFrame, words: int) -> DataFrame | None:
    """(node, label) of the nodes that have a confirmed link; None if there is no link at all."""
    bits = nodes.select("node", "bits")
    rows = nodes.select("node", F.explode("keys").alias("key"))
    shared = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "minhash-keys")
    members = materialise(rows.join(broadcast_if_small(shared), "key"), "minhash-rows")
    candidates = materialise(members.select("node").distinct(), "minhash-candidates")
    sets = full_sets(nodes.select("node", "text_hash", "rows").join(broadcast_if_small(candidates), "node"), documents, words)
    found: list[DataFrame] = []
    labels = None

    def joined(more: DataFrame | None) -> bool:
        """Adds links; whether there were any."""
        nonlocal labels
        if more is None or (more := materialise(more, "minhash-links")).isEmpty():
            return False
        found.append(more)
        labels = materialise(connected_components(reduce(DataFrame.unionByName, found)), "minhash-labels")
        return True

    for k in range(STAR_ROUNDS):
        pairs = materialise(_near(materialise(_star_pairs(_labelled(members, labels), k == 0), "minhash-stars"), bits), "minhash-pairs")
        if pairs.isEmpty() or not joined(confirmed(pairs, sets)):
            break
    joined(_family_links(materialise(_labelled(members, labels), "minhash-labelled"), bits, sets))
    return labels


def near_duplicates(documents: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of those that link, directly or not) and kept, one row per input row."""
    per_doc = materialise(sketched(documents, words), "minhash")
    classes = per_doc.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_hash").alias("text_hash"), F.count("*").alias("rows"))
    classes = materialise(classes, "minhash-classes")
    one = per_doc.where(F.col("node").isNotNull()).select("node", "keys", "bits").dropDuplicates(["node"])
    nodes = materialise(one.join(classes.select("node", "text_hash", "rows"), "node"), "minhash-nodes")
    labels = linked(nodes, documents, words)
    roots = classes.select("node", "first_id", "rows")
    if labels is None:
        rooted = roots.where("rows > 1").select(F.col("node").alias("c_node"), F.col("first_id").alias("component_id"))
    else:
        least = labels.join(roots, "node").groupBy("label").agg(F.min("first_id").alias("component_id"))
        of_links = labels.join(broadcast_if_small(materialise(least, "minhash-roots")), "label").select(F.col("node").alias("c_node"), "component_id")
        alone = roots.where("rows > 1").join(broadcast_if_small(labels), "node", "left_anti").select(F.col("node").alias("c_node"), F.col("first_id").alias("component_id"))
        rooted = of_links.unionByName(alone)
    rooted = materialise(rooted.withColumn("c_found", F.lit(True)), "minhash-rooted")
    joined = per_doc.join(broadcast_if_small(rooted), F.col("node") == F.col("c_node"), "left")
    component = F.when(F.col("c_found"), F.col("component_id")).otherwise(F.col("doc_id"))
    whole = joined.select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"))
    return whole.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
