"""SimHash near-duplicates with pigeonring filtering.

Words are runs of characters other than ASCII white space, with A to Z lower-cased; shingles are ``words`` consecutive
words, repeats included (a shorter text is one shingle, a text without words has fingerprint zero). A fingerprint bit
is one if set in over half the shingles' XXH64 hashes. Fingerprints link at ``max_distance`` or fewer differing bits.

Pigeonring: the 64 bits are ``max_distance + 1`` segments on a ring. If two fingerprints differ in at most t bits, some
segment starts a chain in which every run of l segments differs in at most l*t/m bits: the first segment not at all,
the first two in at most one bit, and so on. Keys hold the first two segments of each chain, or more where fingerprints
are many; the longer runs are checked before the full distance, unless segments are many and short.

Above ``SURE`` bits unlike documents meet, so such links of a larger ``max_distance`` are verified: shingle sets with a
Jaccard similarity of ``SIMILAR`` or more. Before that, ``PROOFS`` more fingerprints, of the shingles' hashes mixed anew,
must differ in ``PROOF_BITS`` bits or fewer in all. From a large bucket a spanning forest of such pairs is verified first,
the nearest before others. Where it failed beside other pairs, the fingerprints that such pairs join make a family, and those
outside its largest component are compared with all of it on full sets, each pair of blocks in a task of its own that gives a
forest of links, not pairs.

Cases. Copies collapse to one fingerprint first. Null texts count as empty; rows with null doc_ids are fingerprinted and
take their component's id, but are never one; a component of such rows alone has a null id. Ties don't arise: the component id is the smallest doc_id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, materialise, small_arrow_batches
from .components import SALTS, connected_components, contracted, extended

WORD_SEPARATORS = r"[\x20\x09-\x0D]+"

#: Index rows that one key may have in the plain join; larger buckets are compared in blocks.
HOT_KEY = 32

#: Fingerprints that share an index key on average before keys take in another segment.
BUCKET = 8

#: Fingerprints on each side of one block comparison.
BLOCK = 512

#: Differing bits up to which fingerprints link unverified, and the Jaccard similarity that more bits need.
SURE = 6
SIMILAR = 0.8

#: Further fingerprints of a document, and how many of their 128 bits may differ: shingle sets with a Jaccard similarity
#: of 0.8 differ in 19.4 on average, with a deviation of 4.1, so six deviations stay; unrelated ones in 64, with one of 5.7.
PROOFS = 2
PROOF_BITS = 44

#: Weight of a family on each side of one comparison: its shingles, and so many more for each fingerprint.
FAMILY_BLOCK = 250_000
MEMBER = 64

#: Ring segments up to which chains are checked before the full distance.
CHAINED = 8


def _segments(max_distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's segments, as even as they come."""
    m = max_distance + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def with_shingles(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash and ``hashes``: XXH64 (seed 42) of every shingle, as signed longs."""
    tokens = F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), WORD_SEPARATORS), "")
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    hashes = F.when(F.size("w") >= words, runs).when(F.size("w") > 0, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(F.array().cast("array<long>"))
    return documents.select("doc_id", F.xxhash64("text").alias("text_hash"), tokens.alias("w")).select("doc_id", "text_hash", hashes.alias("hashes"))


def _majority(hashes: pa.Array) -> pa.Array:
    """The majority bit of each list, 64 bits wide."""
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    flat = np.asarray(hashes.values.to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
    return pa.array(_majorities(flat, hashes.offsets.to_numpy()))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes' k-th independent version (SplitMix64); version 0 is themselves."""
    if not k:
        return hashes
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _proven(hashes: pa.Array) -> pa.Array:
    """The fingerprint of each list and those of its proof."""
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    flat, at = np.asarray(hashes.values.to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64), hashes.offsets.to_numpy()
    every = np.stack([_majorities(_mixed(flat, k), at) for k in range(1 + PROOFS)], axis=1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(every) + 1) * (1 + PROOFS), pa.int32()), pa.array(every.ravel()))


def _majorities(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k in range(len(at) - 1):
        n = int(at[k + 1] - at[k])
        counts = np.zeros(64, np.int64)
        for a in range(int(at[k]), int(at[k + 1]), 65_536):
            part = np.ascontiguousarray(flat[a : min(a + 65_536, int(at[k + 1]))])
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = weights[2 * counts > n].sum(dtype=np.uint64) if n else 0
    return out.view(np.int64)


def fingerprints(documents: DataFrame, words: int = 4, proofs: bool = False) -> DataFrame:
    """doc_id, text_hash and the fingerprint as a signed long, one row per input row; with ``proofs`` also proof_1, proof_2."""
    small_arrow_batches(documents.sparkSession)
    if proofs:
        every = with_shingles(documents, words).select("doc_id", "text_hash", F.arrow_udf(_proven, "array<long>")("hashes").alias("every"))
        return every.select("doc_id", "text_hash", F.col("every")[0].alias("fp"), *(F.col("every")[k].alias(f"proof_{k}") for k in range(1, 1 + PROOFS)))
    majority = F.arrow_udf(_majority, "long")
    return with_shingles(documents, words).select("doc_id", "text_hash", majority("hashes").alias("fp"))


def _chain_length(n: int, segments: list[tuple[int, int]]) -> int:
    """Segments in a key: two, or as many as it takes for buckets of ``BUCKET`` fingerprints on average.

    Where segments are many, one more makes so many probes that whole blocks are compared sooner.
    """
    bucket = BUCKET if len(segments) <= CHAINED else BLOCK
    for run in range(2, len(segments)):
        if n <= bucket << min(sum(segments[(i + k) % len(segments)][1] for k in range(run)) for i in range(len(segments))):
            return run
    return len(segments) - 1


def _changes(widths: list[int], t: int, m: int) -> list[int]:
    """All ways, as masks over a chain's bits, in which it may differ and keep within its budgets."""
    found = [(0, 0)]  # (mask, bits used)
    for run, width in enumerate(widths, 1):
        most = run * t // m
        found = [((mask << width) | sum(1 << b for b in bits), used + n) for mask, used in found for n in range(most - used + 1) for bits in itertools.combinations(range(width), n)]
    return [mask for mask, _ in found]


def _keyed(distinct: DataFrame, name: str, segments: list[tuple[int, int]], run: int, t: int, probe: bool) -> DataFrame:
    """(name, start, key): per segment of the ring the key of the chain that starts there; for probes with each change."""
    m, per_start = len(segments), []
    for i in range(m):
        chain = [segments[(i + k) % m] for k in range(run)]
        key = F.lit(i).cast("long")
        for shift, width in chain:
            key = F.shiftleft(key, width) + F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)
        masks = _changes([w for _, w in chain], t, m) if probe else [0]
        per_start.append(F.transform(F.array(*(F.lit(x).cast("long") for x in masks)), key.bitwiseXOR))
    # outer explodes: for the inner kind the optimizer would compute all keys once more, to filter empty arrays
    own = [name, *(f"{name}_{c}" for c in distinct.columns if c != "fp")]
    rows = distinct.select(*(F.col(c).alias(o) for c, o in zip(["fp", *(c for c in distinct.columns if c != "fp")], own, strict=True)), F.posexplode_outer(F.array(*per_start)).alias("start", "keys"))
    return rows.select(*own, "start", F.explode_outer("keys").alias("key"))


def _close(x: Column, y: Column, start: Column, segments: list[tuple[int, int]], t: int) -> Column:
    """The chain from ``start`` keeps within its budgets, and then the whole distance is at most t."""
    differ, m = x.bitwiseXOR(y), len(segments)
    if m > CHAINED:
        return F.bit_count(differ) <= t
    chain = F.lit(False)
    for i in range(m):
        keeps, mask = F.lit(True), 0
        for run in range(1, m):
            shift, width = segments[(i + run - 1) % m]
            mask |= ((1 << width) - 1) << shift
            signed = mask - (1 << 64) if mask >= 1 << 63 else mask
            keeps = keeps & (F.bit_count(differ.bitwiseAND(F.lit(signed).cast("long"))) <= run * t // m)
        chain = chain | ((start == i) & keeps)
    return chain & (F.bit_count(differ) <= t)


def _proof(side: str, proofs: list[str], plain: bool = False) -> list[Column]:
    """The proof's columns of one side of the links, with ``plain`` under their own names."""
    return [F.col(f"{side}_{c}").alias(c) if plain else F.col(f"{side}_{c}") for c in proofs]


def _block_links(segments: list[tuple[int, int]], t: int, proofs: list[str], in_key: int = 2):
    """For one hot key and one pair of blocks: edges that join what is linked, fewer than there are fingerprints.

    With proofs also one pair, as ``later``, of each tree of such edges beside which there are other pairs to be verified;
    and a pair counts only from its smaller side and at the first start whose ``in_key`` segments bring it together.
    """
    m = len(segments)
    masks = []
    for i in range(m):
        mask, chain = 0, []
        for run in range(1, m):
            shift, width = segments[(i + run - 1) % m]
            mask |= ((1 << width) - 1) << shift
            chain.append((np.uint64(mask), run * t // m))
        masks.append(chain)

    def links(batch: pa.Table) -> pa.Table:
        fp = batch["fp"].to_numpy().astype(np.int64)
        probe = batch["probe"].to_numpy(zero_copy_only=False).astype(bool)
        start = int(batch["start"][0].as_py())
        shown = [batch[c].to_numpy().astype(np.int64).view(np.uint64) for c in proofs]
        left, right = fp[probe], fp[~probe]
        edges = np.zeros((2, 0), np.int64)
        label_r = right.copy()
        label_l = left.copy()
        if len(left) and len(right):
            differ = left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]
            distance = np.bitwise_count(differ)
            near = distance <= t
            if m <= CHAINED:
                for mask, most in masks[start]:
                    near &= np.bitwise_count(differ & mask) <= most
            if proofs:
                near &= left[:, None] < right[None, :]
                i, j = np.nonzero(near)
                bits, before = differ[i, j], np.zeros(len(i), bool)
                for chain in masks[:start]:
                    before |= np.all([np.bitwise_count(bits & mask) <= most for mask, most in chain[:in_key]], axis=0)
                near[i[before], j[before]] = False
            sure = near & (distance <= SURE) if proofs else near
            i, j = np.nonzero(sure)
            while len(i):  # the smallest label spreads over the links
                new_l, new_r = label_l.copy(), label_r.copy()
                np.minimum.at(new_l, i, label_r[j])
                np.minimum.at(new_r, j, new_l[i])
                if (new_l == label_l).all() and (new_r == label_r).all():
                    break
                label_l, label_r = new_l, new_r
            edges = np.stack([np.concatenate([left, right]), np.concatenate([label_l, label_r])])
            edges = edges[:, edges[0] != edges[1]]
        if not proofs:
            return pa.table({"a": pa.array(edges[0], pa.int64()), "b": pa.array(edges[1], pa.int64())})
        pairs, rest = [], (np.zeros(0, int), np.zeros(0, int))
        if len(left) and len(right):
            i, j = np.nonzero(near & ~sure)
            apart = sum(np.bitwise_count(p[probe][i] ^ p[~probe][j]).astype(np.int64) for p in shown)
            held = (apart <= PROOF_BITS) & (label_l[i] != label_r[j])
            i, j, apart = i[held], j[held], apart[held]
            root: dict[int, int] = {}
            taken: set[int] = set()

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    root[x] = root.get(up, up)
                    x = up
                return x

            for k in np.argsort(apart + distance[i, j], kind="stable"):  # the nearest first
                x, y = find(int(label_l[i[k]])), find(int(label_r[j[k]]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    pairs.append((i[k], j[k]))
                    taken.add(int(k))
            other = np.ones(len(i), bool)
            other[list(taken)] = False
            held_by, which = np.unique(label_l[i[other]], return_inverse=True)
            trees = np.array([find(int(x)) for x in held_by], np.int64)[which]
            first = np.unique(trees, return_index=True)[1]
            rest = i[other][first], j[other][first]
        i, j = (np.array(side, int) for side in (zip(*pairs, strict=True) if pairs else ((), ())))
        n_first = edges.shape[1] + len(i)
        i, j = np.concatenate([i, rest[0]]), np.concatenate([j, rest[1]])
        named = shown[0].view(np.int64) if shown else fp
        none = np.zeros(edges.shape[1], np.int64)
        sure_row = np.concatenate([np.ones(len(none), bool), np.zeros(len(i), bool)])
        return pa.table({
            "a": pa.array(np.concatenate([edges[0], left[i]]), pa.int64()),
            "b": pa.array(np.concatenate([edges[1], right[j]]), pa.int64()),
            "a_proof": pa.array(np.concatenate([none, named[probe][i]]), pa.int64(), mask=sure_row),
            "b_proof": pa.array(np.concatenate([none, named[~probe][j]]), pa.int64(), mask=sure_row),
            "later": pa.array(np.arange(len(sure_row)) >= n_first),
        })

    return links


def fingerprint_links(distinct: DataFrame, max_distance: int = 4, hot_key: int = HOT_KEY, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp``; they connect all that link, and all joins are on keys.

    ``distinct`` may have columns with proofs besides ``fp``; then the first ones of both sides are given as a_proof and
    b_proof where a link has over ``SURE`` bits and is to be verified, else nulls; ``later`` marks links that tell only that
    there are more pairs among the fingerprints that links join, to be verified where they stay apart.

    Probes carry each allowed change of a key's second segment, so equal keys suffice. A key with up to ``hot_key``
    index rows joins plainly: at most that many pairs per probe. A larger one is cut into blocks of ``block``
    fingerprints; each pair of blocks is compared in a task of its own and gives a spanning forest, not its pairs.
    """
    segments, proofs = _segments(max_distance), [c for c in distinct.columns if c != "fp"]
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but a row becomes many keys
    run = _chain_length(distinct.count(), segments)
    index = _keyed(distinct, "y", segments, run, max_distance, False)
    probes = _keyed(distinct, "x", segments, run, max_distance, True).withColumnRenamed("start", "p_start")
    counts = index.groupBy("key", "start").agg(F.count("*").alias("n")).where(F.col("n") > hot_key)
    counts = materialise(counts, "hot-keys")
    hot = counts.select(F.col("key").alias("h_key"), F.col("start").alias("h_start"), "n")
    cold = index.join(hot, (index["key"] == hot["h_key"]) & (index["start"] == hot["h_start"]), "left_anti")
    near = (F.col("x") < F.col("y")) & _close(F.col("x"), F.col("y"), F.col("p_start"), segments, max_distance)
    cool = probes
    if proofs:
        apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_proof("x", proofs), _proof("y", proofs), strict=True)), F.lit(0))
        near = near & ((F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= SURE) | (apart <= PROOF_BITS))
        # with short segments most keys are hot, and their probes need not be moved for the plain join
        known = broadcast_if_small(hot)
        cool = probes.join(known, (probes["key"] == known["h_key"]) & (probes["p_start"] == known["h_start"]), "left_anti")
    plain = cool.join(cold, (cool["key"] == cold["key"]) & (cool["p_start"] == cold["start"]) & near)
    unsure = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) > SURE
    plain = plain.select(F.col("x").alias("a"), F.col("y").alias("b"), *(F.when(unsure, F.col(f"{side}_{proofs[0]}")).alias(f"{to}_proof") for side, to in (("x", "a"), ("y", "b")) if proofs), *([F.lit(False).alias("later")] if proofs else []))
    if counts.isEmpty():
        return plain.distinct()
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    all_blocks = F.sequence(F.lit(0), blocks - 1)
    i_rows = index.join(hot, (index["key"] == hot["h_key"]) & (index["start"] == hot["h_start"])).select(F.col("y").alias("fp"), *_proof("y", proofs, True), "start", "key", blocks.alias("nb"), F.lit(False).alias("probe"), "n")
    p_rows = probes.join(hot, (probes["key"] == hot["h_key"]) & (probes["p_start"] == hot["h_start"])).select(F.col("x").alias("fp"), *_proof("x", proofs, True), F.col("p_start").alias("start"), "key", blocks.alias("nb"), F.lit(True).alias("probe"), "n")
    i_rows = i_rows.select("fp", *proofs, "start", "key", "probe", own.alias("i_block"), F.explode(all_blocks).alias("p_block"))
    # probes of one key may outnumber its index rows by its neighbours' rows, so they get as many blocks of their own hash
    p_rows = p_rows.select("fp", *proofs, "start", "key", "probe", own.alias("p_block"), F.explode(all_blocks).alias("i_block"))
    both = i_rows.unionByName(p_rows)
    forest = both.groupBy("key", "start", "i_block", "p_block").applyInArrow(_block_links(segments, max_distance, proofs, run), "a long, b long" + ", a_proof long, b_proof long, later boolean" * bool(proofs))
    return plain.unionByName(forest).distinct()


def _sets(hashes: DataFrame, documents: DataFrame, words: int) -> DataFrame:
    """(text_hash, own): the distinct shingles of the texts with these hashes (w_hash)."""
    wanted = materialise(hashes.distinct(), "simhash-wanted")
    texts = documents.select("doc_id", "text").join(broadcast_if_small(wanted), F.xxhash64("text") == F.col("w_hash"), "left_semi").dropDuplicates(["text"])
    return materialise(with_shingles(texts, words).select("text_hash", F.array_distinct("hashes").alias("own")).dropDuplicates(["text_hash"]), "simhash-sets")


def _verified(links: DataFrame, per_doc: DataFrame, documents: DataFrame, words: int) -> DataFrame:
    """The links that need no verification, and those whose shingle sets are similar enough."""
    pairs = links.where(F.col("a_proof").isNotNull())
    text_of = per_doc.groupBy(F.col("fp").alias("c_fp"), F.col("proof_1").alias("c_proof")).agg(F.min(F.coalesce("text_hash", F.lit(0))).alias("text_hash"))
    for side in ("a", "b"):
        named = text_of.withColumnsRenamed({c: f"{side}_{c}" for c in text_of.columns})
        pairs = pairs.join(named, (pairs[side] == named[f"{side}_c_fp"]) & (pairs[f"{side}_proof"] == named[f"{side}_c_proof"])).drop(f"{side}_c_fp", f"{side}_c_proof")
    pairs = materialise(pairs.select("a", "b", "a_text_hash", "b_text_hash"), "simhash-pairs")
    sets = _sets(pairs.select(F.explode(F.array("a_text_hash", "b_text_hash")).alias("w_hash")), documents, words)
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("text_hash").alias(f"{side}_text_hash"), F.col("own").alias(f"{side}_own")), f"{side}_text_hash")
    both = F.size(F.array_intersect("a_own", "b_own"))
    similar = both / F.greatest(F.size("a_own") + F.size("b_own") - both, F.lit(1)) >= SIMILAR
    return links.where(F.col("a_proof").isNull()).select("a", "b").unionByName(pairs.where(similar).select("a", "b"))


def _similar(t: int):
    """For one pair of blocks of a family: a forest of the links between fingerprints of unlike labels."""

    def links(batch: pa.Table) -> pa.Table:
        rest = batch["rest"].to_numpy(zero_copy_only=False).astype(bool)
        node, label = batch["fp"].to_numpy(), batch["label"].to_numpy()
        fp, shown = node.view(np.uint64), [batch[f"proof_{k}"].to_numpy().view(np.uint64) for k in range(1, 1 + PROOFS)]
        own = batch["own"].combine_chunks()
        at, flat = own.offsets.to_numpy(), own.values.to_numpy(zero_copy_only=False)
        size = np.diff(at)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        others, edges = np.flatnonzero(~rest & (size > 0)), []
        for i in np.flatnonzero(rest & (size > 0)):
            fits = (np.bitwise_count(fp[others] ^ fp[i]) <= t) & (label[others] != label[i])
            fits &= np.minimum(size[others], size[i]) / np.maximum(size[others], size[i]) >= SIMILAR
            near = others[fits]
            near = near[sum(np.bitwise_count(p[near] ^ p[i]).astype(np.int64) for p in shown) <= PROOF_BITS]
            if not len(near):
                continue
            mine = np.sort(flat[at[i] : at[i + 1]])
            theirs = np.concatenate([flat[at[j] : at[j + 1]] for j in near])
            place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            both = np.add.reduceat((mine[place] == theirs).astype(np.int64), np.cumsum(size[near]) - size[near])
            for j in near[both / (size[near] + size[i] - both) >= SIMILAR]:
                x, y = find(int(label[i])), find(int(label[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    edges.append((int(node[i]), int(node[j])))
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _family_links(links: DataFrame, labels: DataFrame, per_doc: DataFrame, documents: DataFrame, words: int, t: int) -> DataFrame | None:
    """(a, b): what the verified links' components (``labels``) leave apart in families that have ``later`` links; None if nothing.

    A family is what all links join, those that failed too: of each pair to be verified both sides are in one. As labels stand for
    their components, only links between these are walked once more.
    """
    families = connected_components(contracted(links, labels)).select(F.col("node").alias("label"), F.col("label").alias("family"))
    families = materialise(families, "simhash-families")
    told = links.where("later").select(F.col("a").alias("node")).distinct().join(broadcast_if_small(labels), "node", "left").select(F.coalesce("label", "node").alias("label")).distinct()
    told = families.join(told, "label", "left_semi").select("family").distinct()
    mixed = materialise(families.join(told, "family", "left_semi"), "simhash-told")
    if mixed.isEmpty():
        return None
    lone = mixed.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), "family", "label")
    members = labels.join(broadcast_if_small(mixed), "label").select("node", "family", "label").unionByName(lone)
    members = materialise(members, "simhash-mixed")
    proofs = [f"proof_{k}" for k in range(1, 1 + PROOFS)]
    own = per_doc.join(broadcast_if_small(members), per_doc["fp"] == members["node"]).groupBy("fp", *proofs, "family", "label").agg(F.min(F.coalesce("text_hash", F.lit(0))).alias("w_hash"))
    own = materialise(own, "simhash-family")
    sets = _sets(own.select("w_hash"), documents, words)
    placed = materialise(own.join(sets, own["w_hash"] == sets["text_hash"]).drop("w_hash", "text_hash"), "simhash-family-sets")
    per = placed.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum(F.size("own") + MEMBER).alias("size"))
    most = F.max(F.struct("n", "label", "size"))
    blocks = lambda size: F.ceil(size / FAMILY_BLOCK).cast("int")
    whole = per.groupBy("family").agg(most.alias("most"), F.sum("size").alias("size"), F.count("*").alias("labels")).where("labels > 1")
    whole = whole.select("family", F.col("most.label").alias("main"), blocks(F.col("size") - F.col("most.size")).alias("a_blocks"), blocks(F.col("size")).alias("b_blocks"))
    placed = placed.join(broadcast_if_small(materialise(whole, "simhash-family-sizes")), "family")
    order, row = F.xxhash64("fp", *proofs), ["family", "fp", *proofs, "label", "own"]
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = placed.where(F.col("label") != F.col("main")).select(*row, F.lit(True).alias("rest"), F.pmod(order, F.col("a_blocks")).cast("int").alias("a_block"), each(F.col("b_blocks")).alias("b_block"))
    b = placed.select(*row, F.lit(False).alias("rest"), F.pmod(order, F.col("b_blocks")).cast("int").alias("b_block"), each(F.col("a_blocks")).alias("a_block"))
    return a.unionByName(b).groupBy("family", "a_block", "b_block").applyInArrow(_similar(t), "a long, b long")


def near_duplicates(documents: DataFrame, words: int = 4, max_distance: int = 4) -> DataFrame:
    """doc_id, text_hash, fp (signed long), root (the component's smallest fingerprint) and component_id, one row per input row."""
    per_doc = materialise(fingerprints(documents, words, max_distance > SURE), "simhash")
    classes = materialise(per_doc.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    distinct = per_doc.drop("doc_id", "text_hash").distinct() if max_distance > SURE else classes.select("fp")
    links = materialise(fingerprint_links(distinct, max_distance), "simhash-links")
    found = links
    if max_distance > SURE:
        links = materialise(_verified(found.where("not later"), per_doc, documents, words), "simhash-verified")
    labels = connected_components(links)  # node, label: only fingerprints with a link
    if max_distance > SURE and not found.where("later").isEmpty():
        labels = materialise(labels, "simhash-labels")
        more = _family_links(found, labels, per_doc, documents, words, max_distance)
        labels = labels if more is None else extended(labels, more)
    # a component of many fingerprints meets its root in parts, so that it is not one task's
    rooted = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("root"), F.col("label").isNotNull().alias("linked"))
    roots = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.bool_or("linked").alias("linked"))
    parts = F.when(F.col("linked"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    roots = roots.select(F.col("root").alias("r_root"), "component_id", F.explode(parts).alias("part"))
    own = F.when(F.col("linked"), F.pmod(F.xxhash64("fp"), F.lit(SALTS))).otherwise(0)
    final = rooted.join(roots, (F.col("root") == F.col("r_root")) & (own == F.col("part"))).select(F.col("fp").alias("c_fp"), "root", "component_id")
    return per_doc.join(final, per_doc["fp"] == final["c_fp"]).select("doc_id", "text_hash", "fp", "root", "component_id")


def drop_near_duplicates(documents: DataFrame, words: int = 4, max_distance: int = 4) -> DataFrame:
    """Keeps one document of each component: the row whose doc_id is the component's id.

    Rows without a doc_id can't be told apart, so they stay. Of several rows with the kept doc_id in one component, one
    stays: one of those with the smallest text hash. Unlike texts under one doc_id are in components of their own. What goes is written first, as ids and text hashes, and broadcast if it is little; only otherwise are whole documents
    shuffled.
    """
    found = materialise(near_duplicates(documents, words, max_distance).where(F.col("doc_id").isNotNull()), "simhash-found")
    hashes = F.coalesce("text_hash", F.lit(0))
    firsts = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "root", hashes.alias("hash")).agg(F.count("*").alias("n"))
    firsts = materialise(firsts, "simhash-firsts")
    kept_hash = firsts.groupBy("doc_id", "root").agg(F.min("hash").alias("least"), F.count("*").alias("texts")).where(F.col("texts") > 1).drop("texts")
    other = firsts.join(kept_hash, ["doc_id", "root"]).where(F.col("hash") != F.col("least")).select(F.col("doc_id").alias("g_id"), F.col("hash").alias("g_hash"))
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"))
    gone = materialise(gone.unionByName(other), "simhash-gone")
    of_row = lambda side, a, b: (documents["doc_id"] == side[a]) & (F.xxhash64(documents["text"]) == side[b])
    kept = documents.join(broadcast_if_small(gone), of_row(gone, "g_id", "g_hash"), "left_anti")
    again = materialise(firsts.where(F.col("n") > 1).select(F.col("doc_id").alias("a_id"), F.col("hash").alias("a_hash")), "simhash-again")
    if again.isEmpty():
        return kept
    again = broadcast_if_small(again)
    met = (kept["doc_id"] == again["a_id"]) & (F.xxhash64(kept["text"]) == again["a_hash"])
    return kept.join(again, met, "left_anti").unionByName(kept.join(again, met, "left_semi").dropDuplicates(["doc_id", "text"]))
