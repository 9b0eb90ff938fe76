"""Benchmark decontamination with a broadcast set of test n-grams, in DataFrame functions only.

Definitions. Words: A to Z lower-cased, then maximal runs of characters outside ASCII punctuation, control
characters and spaces. A window is ``n`` consecutive words of a benchmark item; an item with fewer words, but not
none, is one window. A document word inside any occurrence of a window is hit.

Cases. Null or empty texts have no words and no hits; a null item text has no windows. Repeated document rows give one
output row each; repeated benchmark rows count once per item_id; null item_ids take part but are not listed. Empty
tables give empty or clean results. Extra columns are ignored by ``scan`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, materialise

#: What separates words, after lower-casing A to Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The same where case is kept, for cutting spans out of the original text.
CASED_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Windows of one broadcast block. About 100 bytes each, so a block stays near 25 MB; more windows take more passes.
BLOCK_WINDOWS = 250_000

#: Removed windows in all that may be broadcast with their documents' ids: 8 bytes each, under 80 MB.
SPAN_WINDOWS = 5_000_000


def words_of(text: Column) -> Column:
    """The words; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _window_hashes(hashes: Column, length: int) -> Column:
    """A hash for each run of ``length`` words."""
    starts = F.sequence(F.lit(1), F.size(hashes) - (length - 1))
    return F.when(F.size(hashes) >= length, F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, length)))).otherwise(F.array().cast("array<long>"))


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """window_hash, window_words, n_window, item_id: one row for each window of each item."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    runs = words.select("item_id", length.alias("n_window"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("window_words"))
    hashed = runs.withColumn("window_hash", F.xxhash64(F.transform("window_words", lambda w: F.xxhash64(w))))
    return hashed.select("window_hash", "n_window", "window_words", "item_id").distinct()


def _plan(windows: DataFrame, block_windows: int) -> tuple[list[int], int]:
    """The window lengths (at most n of them) and the number of broadcast blocks."""
    counts = {r["n_window"]: r["n"] for r in windows.groupBy("n_window").agg(F.count("*").alias("n")).collect()}
    return sorted(counts), max(1, -(-sum(counts.values()) // block_windows))


def hits(documents: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = BLOCK_WINDOWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document row: the kept columns, n_words, hit_windows (sorted (start, length)) and item_ids.

    Each row's windows are probed against a broadcast set inside the scan; only one marker per document and the rows
    that hit are shuffled. A benchmark over ``block_windows`` windows is taken in blocks, a pass for each. Rows that
    agree in the kept columns and two hashes of the text are counted and given back as often, so passes need no row
    numbers. Windows travel without their items, of which a common one may have any number; these come in at the end, by
    the hashes of the windows that were hit.
    """
    listed = materialise(benchmark_windows(benchmark, n), "windows")
    windows = listed.drop("item_id").distinct()
    lengths, blocks = _plan(windows, block_windows)
    text_keys = (F.xxhash64("text").alias("t_1"), F.xxhash64(F.lit(1), F.col("text")).alias("t_2"))
    base = documents.select(*(F.col(c).alias(f"k_{c}") for c in keep), *text_keys, words_of(F.col("text")).alias("w"))
    # outer explodes: for the inner kind the optimizer would compute all windows once more, to filter empty arrays
    base = base.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    probes = base.select(
        *(f"k_{c}" for c in keep), "t_1", "t_2", "w", F.size("w").alias("n_words"),
        F.concat(F.array(F.array(F.lit(0).cast("long"))), *(F.array(_window_hashes(F.col("h"), m)) for m in lengths)).alias("by_length"),
    )
    probes = probes.select("*", F.posexplode_outer("by_length").alias("length_at", "hashes")).drop("by_length")
    lengths_of = F.array(*(F.lit(m) for m in [0, *lengths]))
    probes = probes.select("*", F.posexplode_outer("hashes").alias("start", "hash")).drop("hashes").withColumn("n_probe", F.get(lengths_of, F.col("length_at")))
    parts = []
    for block in range(blocks):
        part = windows.where(F.pmod("window_hash", F.lit(blocks)) == block) if blocks > 1 else windows
        met = probes.join(F.broadcast(part), (F.col("hash") == F.col("window_hash")) & (F.col("n_probe") == F.col("n_window")), "left")
        # a probe that met a window's hash is verified word by word; the marker of length 0 keeps documents without hits
        verified = F.col("window_words").isNotNull() & (F.slice("w", F.col("start") + 1, F.greatest("n_probe", F.lit(1))) == F.col("window_words"))
        met = met.where(verified | ((F.col("n_probe") == 0) & F.lit(block == 0)))
        hit = F.when(F.col("n_probe") > 0, F.struct("start", F.col("n_probe").alias("length")))
        parts.append(met.select(*(f"k_{c}" for c in keep), "t_1", "t_2", "n_words", hit.alias("hit"), F.struct("window_hash", "n_window").alias("window")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    found = materialise(rows.groupBy(*(f"k_{c}" for c in keep), "t_1", "t_2", "n_words").agg(
        F.count_if(F.col("hit").isNull()).alias("copies"), F.array_sort(F.collect_set("hit")).alias("hit_windows"),
        F.array_compact(F.collect_set(F.when(F.col("hit").isNotNull(), F.col("window")))).alias("windows"),
    ), "hits")
    items = broadcast_if_small(materialise(listed.where(F.col("item_id").isNotNull()).select("window_hash", "n_window", "item_id").distinct(), "window-items"))
    each = found.where(F.size("windows") > 0).select("t_1", "t_2", F.explode("windows").alias("x")).distinct()
    each = each.join(items, (F.col("x.window_hash") == F.col("window_hash")) & (F.col("x.n_window") == F.col("n_window")))
    of_text = each.groupBy(F.col("t_1").alias("i_1"), F.col("t_2").alias("i_2")).agg(F.collect_set("item_id").alias("item_ids"))
    of_text = broadcast_if_narrow(materialise(of_text, "text-items"), "item_ids")
    named = found.join(of_text, (found["t_1"] == of_text["i_1"]) & (found["t_2"] == of_text["i_2"]), "left")
    none = F.array().cast(items.select(F.array("item_id").alias("x")).schema["x"].dataType)
    out = named.select(*(F.col(f"k_{c}").alias(c) for c in keep), "n_words", "hit_windows", F.coalesce("item_ids", none).alias("item_ids"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_"))
    return out.drop("copy_")


def broadcast_if_narrow(df: DataFrame, lists: str, limit: int = SPAN_WINDOWS) -> DataFrame:
    """Marks a materialised side for broadcast if its rows and the entries of its column ``lists`` are within the limit."""
    n = df.agg(F.count("*") + F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= limit else df


def covered(hit_windows: Column) -> Column:
    """How many words the union of sorted (start, length) windows covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["length"] - F.greatest(acc["end"], x["start"].cast("long")))).alias("n"),
        F.greatest(acc["end"], (x["start"] + x["length"]).cast("long")).alias("end"),
    )
    return F.aggregate(hit_windows, zero, step, lambda acc: acc["n"])


def scan(documents: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    found = hits(documents, benchmark, n, block_windows)
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), covered(F.col("hit_windows")).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"), F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))).alias("item_ids"),
        (F.size("hit_windows") > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents without contaminated rows (``remove="documents"``) or without hit words (``"spans"``).

    A row is found again by its doc_id and the hash of its text, both null-safe. A removed span goes with the
    separators before its words; the rest of the text stays as it was. The rows that were hit are written first, narrow,
    and broadcast if they, and for spans their windows, are few; only otherwise are whole documents shuffled.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    tagged = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = hits(tagged, benchmark, n, block_windows, keep=("doc_id", "text_hash")).where(F.size("hit_windows") > 0)
    found = found.groupBy(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).agg(F.first("hit_windows").alias("bad_windows"))
    if remove == "spans":
        found = broadcast_if_narrow(materialise(found, "hit-rows"), "bad_windows")
    else:
        found = broadcast_if_small(materialise(found.drop("bad_windows"), "hit-rows"))
    meets = documents["doc_id"].eqNullSafe(found["bad_id"]) & (F.xxhash64(documents["text"]) == found["bad_hash"])
    if remove == "documents":
        return documents.join(found, meets, "left_anti")
    text, bad = documents["text"], found["bad_windows"]
    pieces = F.regexp_extract_all(text, F.lit(CASED_PIECE), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(bad, lambda x: (i >= x["start"]) & (i < x["start"] + x["length"])))
    tail = text.substr(F.char_length(F.array_join(pieces, "")) + 1, F.char_length(text))
    cleaned = F.when(bad.isNull(), text).otherwise(F.concat(F.array_join(kept, ""), tail)).alias("text")
    return documents.join(found, meets, "left").select(*(cleaned if c == "text" else documents[c] for c in documents.columns))
