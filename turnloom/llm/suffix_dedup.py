"""Removal of repeated byte strings by deep-shallow suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in this text or another, is removed.

Sampling. A suffix array over all bytes of a corpus does not fit any cluster's shuffle, so suffixes are sampled where
content says: in each window of ``length`` bytes the leftmost gram of ``GRAM`` bytes with the smallest hash is an anchor.
Equal windows have equal anchors, so every repeat is found among the anchors with equal grams. An anchor's context is the
part of any window around it: ``length - GRAM`` bytes to the left and ``length`` to the right.

Sorting. Members of a gram with equal contexts are one class, counted before anything is gathered; a class of two or
more is covered in full. What is left are the distinct contexts of a gram. Their suffixes (right contexts) and reversed
prefixes (left contexts) are sorted: multikey quicksort by eight bytes at a time to a shallow depth, then a blind trie for
each group that still agrees. The longest common prefixes give the intervals of suffixes that share t bytes to the
right; within one, neighbours in the left order give the most that is shared to the left; together ``length`` or more is
a repeat.

Skew. Copies of a text count once, by its two 64-bit hashes. A gram with over ``GROUP`` distinct contexts is not gathered:
its windows are hashed and counted instead, which combines before the shuffle.

Cases. Null texts count as empty; texts under ``length`` bytes keep all. Repeated rows are copies of each other, so their
bytes go. Empty tables give empty results; extra columns are dropped. Equality of grams is verified on bytes; that of
texts and contexts rests on 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_arrow_batches
from .hashed_text import pieces, string_buffers

LENGTH = 400
GRAM = 64

#: Bytes after the common gram that quicksort orders; what still agrees goes to a blind trie.
SHALLOW = 32

#: Distinct contexts of one gram that a task sorts: about 6 MB of bytes.
GROUP = 8192

#: Bits of the filters that keep rows without a partner out of the shuffles: 4 MB each, whatever the input.
FILTER_BITS = 1 << 25

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_INDEX = np.uint64((1 << 21) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _scatter(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Prefix:
    """Hashes of any substring of one byte array, from its running sums."""

    def __init__(self, data: np.ndarray):
        n = max(1, len(data))
        self.back = _powers(_P_INV, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, n)[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _scatter((self.sums[end] - self.sums[start]) * self.back[np.minimum(start, len(self.back) - 1)])


def anchors_of(first: int, last: int, length: int, gram: int, prefix: Prefix) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram hash) of the anchors of the windows that start in first to last - 1."""
    grams = last - 1 + length - gram + 1 - first
    at = np.arange(first, first + grams)
    h = prefix.of(at, at + gram)
    v = (h & ~_INDEX) | np.arange(grams, dtype=np.uint64)
    width, span, low = length - gram + 1, 1, v
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: last - first], low[width - span : width - span + last - first])
    chosen = np.unique((low & _INDEX).astype(np.int64))
    return first + chosen, h[chosen]


def _anchor_rows(length: int, gram: int):
    left = length - gram

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                raw, offsets = string_buffers(batch["text"])
                k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
                doc, pos, gr, ctx, right = [], [], [], [], []
                for piece in pieces(offsets, length + left):
                    # a part of a long text looks back and ahead far enough for its anchors' contexts
                    begin = piece.start - (min(left, piece.start - int(offsets[piece.first_doc])) if piece.inner else 0)
                    prefix = Prefix(raw[begin : piece.readable])
                    for k in range(len(piece.doc_starts) - 1):
                        d = piece.first_doc + k
                        a, z = int(piece.doc_starts[k]) - begin, int(piece.doc_starts[k + 1]) - begin
                        end = min(int(offsets[d + 1]), piece.readable) - begin
                        last = min(z, end - length + 1)
                        if last <= a:
                            continue
                        at, h = anchors_of(a, last, length, gram, prefix)
                        doc_begin = max(0, int(offsets[d]) - begin)
                        lo, hi = np.maximum(at - left, doc_begin), np.minimum(at + length, min(int(offsets[d + 1]) - begin, len(prefix.sums) - 1))
                        doc.append(np.full(len(at), d))
                        pos.append(at + begin - int(offsets[d]))
                        gr.append(h)
                        ctx.append(_scatter(prefix.of(lo, hi) + (at - lo).astype(np.uint64) * _P))
                        right.append(hi - at)
                if doc:
                    d = np.concatenate(doc)
                    yield pa.RecordBatch.from_pydict({
                        "gram": np.concatenate(gr).view(np.int64), "ctx": np.concatenate(ctx).view(np.int64),
                        "k1": k1[d], "k2": k2[d], "pos": np.concatenate(pos).astype(np.int32), "right": np.concatenate(right).astype(np.int32),
                    })

    return rows


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def blind_trie_order(strings: list[bytes], members: list[int]) -> list[int]:
    """The members in the order of their strings, by a trie that keeps branching depths and single bytes only.

    An insertion goes down by the bytes at the branching depths alone, compares once with the leaf it meets, and then
    knows where to branch.
    """
    root: list = [members[0]]  # a leaf is a list of members with equal strings; a branch is (depth, {byte: child})
    for m in members[1:]:
        s = strings[m]
        node = root
        while isinstance(node, tuple):
            depth, children = node
            byte = s[depth] if depth < len(s) else -1
            node = children[byte] if byte in children else next(iter(children.values()))
        other = strings[node[0]]
        shared = common_prefix(s, other)
        if shared == len(s) == len(other):
            node.append(m)
            continue
        new, old = (s[shared] if shared < len(s) else -1), (other[shared] if shared < len(other) else -1)
        parent, node = None, root
        while isinstance(node, tuple) and node[0] < shared:
            byte = s[node[0]] if node[0] < len(s) else -1
            parent, node = (node, byte), node[1][byte]
        if isinstance(node, tuple) and node[0] == shared:
            node[1][new] = [m]
            continue
        branch = (shared, {old: node, new: [m]})
        if parent is None:
            root = branch
        else:
            parent[0][1][parent[1]] = branch
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            order += node
    return order


def deep_shallow_order(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Indices in the order of the strings, which share their first ``depth`` bytes."""
    order: list[int] = []
    limit = depth + shallow
    stack: list[tuple[list[int], int, bool]] = [(list(range(len(strings))), depth, False)]
    while stack:
        members, d, done = stack.pop()
        if done or len(members) < 2:
            order += members
        elif d >= limit:
            order += blind_trie_order(strings, members)
        else:
            words = [strings[m][d : d + 8] for m in members]
            pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
            less = [m for m, w in zip(members, words, strict=True) if w < pivot]
            same = [m for m, w in zip(members, words, strict=True) if w == pivot]
            more = [m for m, w in zip(members, words, strict=True) if w > pivot]
            # a pivot under eight bytes ends its strings, which are then equal
            stack += [(more, d, False), (same, d + 8, len(pivot) < 8), (less, d, False)]
    return order


def repeats(lefts: list[bytes], rights: list[bytes], length: int, gram: int) -> list[tuple[int, int]]:
    """For each context how many bytes left and right of its anchor repeats cover; (-1, -1) for none.

    ``lefts`` run away from the anchor. All contexts differ and share the first ``gram`` bytes to the right, unless
    their grams' hashes collided.
    """
    n = len(rights)
    most_left, most_right = [-1] * n, [-1] * n
    if n == 2:
        left, right = common_prefix(lefts[0], lefts[1]), common_prefix(rights[0], rights[1])
        return [(left, right)] * 2 if left + right >= length else [(-1, -1)] * 2
    depth = gram if all(r[:gram] == rights[0][:gram] for r in rights) else 0
    order = deep_shallow_order(rights, depth)
    place = [0] * n
    for k, m in enumerate(deep_shallow_order(lefts)):
        place[m] = k
    shared = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]

    def interval(first: int, last: int, right: int) -> None:
        own = sorted(order[first : last + 1], key=place.__getitem__)
        before = -1
        for k, m in enumerate(own):
            after = common_prefix(lefts[m], lefts[own[k + 1]]) if k + 1 < len(own) else -1
            left = max(before, after)
            if left + right >= length:
                most_left[m] = max(most_left[m], left)
                most_right[m] = max(most_right[m], right)
            before = after

    stack: list[list[int]] = []  # open intervals of the suffix order: [first, shared]
    for k, right in enumerate([*shared, -1]):
        first = k
        while stack and stack[-1][1] > right:
            first, closed = stack.pop()
            if closed >= gram:
                interval(first, k, closed)
        if right >= 0 and (not stack or stack[-1][1] < right):
            stack.append([first, right])
    return list(zip(most_left, most_right, strict=True))


SPAN = "k1 long, k2 long, start int, end int"
_SPAN_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _resolve(length: int, gram: int):
    """Spans of the contexts of one gram after the other; rows come sorted by gram."""

    def group(rows: list[dict], out: list[tuple]) -> None:
        if len(rows) > 1:
            found = repeats([r["left_bytes"] for r in rows], [r["right_bytes"] for r in rows], length, gram)
            out += [(r["k1"], r["k2"], r["pos"] - a, r["pos"] + b) for r, (a, b) in zip(rows, found, strict=True) if a >= 0 and not r["multi"]]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["gram"] != row["gram"]:
                    group(held, out)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SPAN_ARROW.types, strict=True)], schema=_SPAN_ARROW)
                out = []
        group(held, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SPAN_ARROW.types, strict=True)], schema=_SPAN_ARROW)

    return spans


CONTEXT = "gram long, k1 long, k2 long, pos int, multi boolean, hot boolean, left_bytes binary, right_bytes binary"
_CONTEXT_ARROW = pa.schema([("gram", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()), ("multi", pa.bool_()), ("hot", pa.bool_()), ("left_bytes", pa.binary()), ("right_bytes", pa.binary())])


def _contexts(length: int, gram: int):
    left = length - gram

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("gram", "k1", "k2", "pos", "multi", "hot", "left_bytes", "right_bytes")
            out: dict[str, list] = {n: [] for n in names}
            for k1, k2, text, asked in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "text", "asked")), strict=True):
                data = text.encode()
                for x in asked:
                    p = x["pos"]
                    values = (x["gram"], k1, k2, p, x["multi"], x["hot"], data[max(0, p - left) : p][::-1], data[p : p + length])
                    for n, v in zip(names, values, strict=True):
                        out[n].append(v)
                if len(out["gram"]) >= 4096:
                    yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT_ARROW)
                    out = {n: [] for n in names}
            if out["gram"]:
                yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT_ARROW)

    return rows


def _window_rows(length: int, located: bool):
    """A key for each window around an anchor (of its bytes, gram and offset), with one hash of its place or the place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for x in batch.to_pylist():
                    data = np.frombuffer(x["left_bytes"][::-1] + x["right_bytes"], np.uint8)
                    starts = np.arange(0, min(len(x["left_bytes"]), len(data) - length) + 1)
                    if not len(starts):
                        continue
                    back = len(x["left_bytes"]) - starts
                    key = _scatter(Prefix(data).of(starts, starts + length) + (back.astype(np.uint64) + np.uint64(x["gram"] & 0xFFFFFFFFFFFFFFFF)) * _P).view(np.int64)
                    n = len(starts)
                    if located:
                        yield pa.RecordBatch.from_pydict({"key": key, "k1": np.full(n, x["k1"]), "k2": np.full(n, x["k2"]), "pos": np.full(n, x["pos"], np.int32), "back": back.astype(np.int32)})
                    else:
                        yield pa.RecordBatch.from_pydict({"key": key, "place": np.full(n, x["place"])})

    return rows


def _counted(hot: DataFrame, length: int) -> DataFrame:
    """Spans of the contexts of grams with too many of them for one task, by counting equal windows.

    Windows are counted by two longs each, combined before the shuffle; only those that repeat are looked up.
    """
    placed = hot.withColumn("place", F.xxhash64("k1", "k2", "pos")).mapInArrow(_window_rows(length, False), "key long, place long")
    again = placed.groupBy("key").agg(F.min("place").alias("a"), F.max("place").alias("b")).where(F.col("a") != F.col("b")).select("key")
    again = materialise(again, "windows")
    located = hot.mapInArrow(_window_rows(length, True), "key long, k1 long, k2 long, pos int, back int").where(_filter_of(again, "key"))
    met = located.join(again, "key", "left_semi").groupBy("k1", "k2", "pos").agg(F.max("back").alias("most"), F.min("back").alias("least"))
    return met.select("k1", "k2", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + length).alias("end"))


def _filter_of(keys: DataFrame, name: str, bits: int = FILTER_BITS):
    """A condition that holds for all values of a long column ``name`` that are in ``keys``, and for few others."""
    at = F.pmod(F.col(name), F.lit(bits))
    parts = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number(F.col("at")).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at"))).alias("bits")).collect()
    bitmap = np.zeros(bits // 8 + 8192, np.uint8)
    for r in parts:
        begin = (r["n"] - 1) * 4096 if r["n"] > 0 else 0
        bitmap[begin : begin + len(r["bits"])] |= np.frombuffer(r["bits"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    def maybe(values: pa.Array) -> pa.Array:
        v = values.to_numpy(zero_copy_only=False)
        # Spark numbers bits from 1: value v is bit (v - 1) of bucket (v - 1) // 32768 + 1, and 0 is bit 0 of bucket 0
        b = np.mod(v, bits)
        n, bit = np.where(b > 0, 1 + (b - 1) // 32_768, 0), np.where(b > 0, (b - 1) % 32_768, 0)
        begin = np.where(n > 0, (n - 1) * 4096, 0)
        return pa.array((shared.value[begin + bit // 8] >> (bit % 8).astype(np.uint8)) & 1 == 1)

    return F.arrow_udf(maybe, "boolean")(F.col(name))


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text (not null), and the text's two hashes k1 and k2."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), F.col("text"))})


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """k1, k2 and ``spans``, the sorted and merged (start, end) byte spans that repeats cover, for ``keyed`` texts.

    Copies of one text are not repeats here: they have one key.
    """
    small_arrow_batches(texts.sparkSession)
    long_enough = texts.where(F.octet_length("text") >= length)
    anchors = materialise(long_enough.select("k1", "k2", "text").mapInArrow(_anchor_rows(length, gram), "gram long, ctx long, k1 long, k2 long, pos int, right int"), "anchors")
    where = F.struct("k1", "k2", "pos")
    # a gram matters if it stands at two places; one hash of the place is enough to tell
    place = F.xxhash64("k1", "k2", "pos")
    grams = anchors.select("gram", place.alias("at")).groupBy("gram").agg(F.min("at").alias("a"), F.max("at").alias("b")).where(F.col("a") != F.col("b")).select("gram")
    grams = materialise(grams, "grams")
    likely = anchors.where(_filter_of(grams, "gram"))
    classes = likely.groupBy("gram", "ctx").agg(F.min(where).alias("first"), F.max(where).alias("last"))
    classes = materialise(classes.select("gram", "ctx", "first", (F.col("first") != F.col("last")).alias("multi")), "contexts")
    full = likely.join(classes.where("multi").select("gram", "ctx"), ["gram", "ctx"], "left_semi")
    full = full.select("k1", "k2", F.greatest(F.lit(0), F.col("pos") - (length - gram)).alias("start"), (F.col("pos") + F.col("right")).alias("end"))
    several = classes.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("gram", (F.col("n") > group).alias("hot"))
    asked = classes.join(several, "gram").select("first.k1", "first.k2", F.struct("first.pos", "gram", "multi", "hot").alias("asked"))
    asked = materialise(asked.groupBy("k1", "k2").agg(F.collect_list("asked").alias("asked")), "asked")
    once = long_enough.where(_filter_of(asked, "k1")).select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    contexts = once.join(asked, ["k1", "k2"]).mapInArrow(_contexts(length, gram), CONTEXT)
    contexts = materialise(contexts, "around")
    cold = contexts.where(~F.col("hot")).repartition("gram").sortWithinPartitions("gram", "k1", "k2", "pos").mapInArrow(_resolve(length, gram), SPAN)
    spans = full.unionByName(cold)
    if not contexts.where("hot").isEmpty():
        spans = spans.unionByName(_counted(contexts.where(F.col("hot")), length))
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(x)))
    per_text = spans.distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return per_text.select("k1", "k2", F.aggregate("spans", F.array().cast("array<struct<start:int,end:int>>"), step).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            data, at, parts = text.encode(), 0, []
            for s in spans:
                parts.append(data[at : s["start"]])
                at = s["end"]
            kept.append(b"".join([*parts, data[at:]]))
        yield pa.RecordBatch.from_pydict({"k1": batch["k1"], "k2": batch["k2"], "kept": pa.array(kept, pa.binary()), "n_spans": pa.array([len(s) for s in batch["spans"].to_pylist()], pa.int64())})


def deduplicate(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_bytes``, ``kept``: the bytes that stay."""
    texts = keyed(documents)
    spans = materialise(repeated_spans(texts, length, gram, group), "spans")
    once = texts.where(_filter_of(spans, "k1")).select("k1", "k2", "text").dropDuplicates(["k1", "k2"]).join(spans, ["k1", "k2"])
    cut = once.mapInArrow(_cut, "k1 long, k2 long, kept binary, n_spans long")
    size = F.octet_length("text").cast("long")
    narrow = texts.select("doc_id", "k1", "k2", size.alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), *([F.col("text").cast("binary").alias("whole")] if keep_bytes else []))
    copies = texts.where(size >= length).groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("k1", "k2", F.lit(True).alias("copied"))
    cut = cut.select("k1", "k2", F.octet_length("kept").cast("long").alias("n_kept"), F.sha2("kept", 256).alias("cut_sha"), "n_spans", *(["kept"] if keep_bytes else []))
    known = copies.join(cut, ["k1", "k2"], "full")
    out = narrow.join(known, ["k1", "k2"], "left")
    copied, touched = F.coalesce("copied", F.lit(False)), F.col("n_kept").isNotNull()
    pick = lambda all_gone, some, none: F.when(copied, all_gone).when(touched, some).otherwise(none)
    columns = [
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_bytes") - F.col("n_kept"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("n_spans"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.sha2(F.lit(b""), 256), F.col("cut_sha"), F.col("sha")).alias("kept_sha256"),
    ]
    if keep_bytes:
        columns.append(pick(F.lit(b""), F.col("kept"), F.col("whole")).alias("kept"))
    return out.select(*columns)
