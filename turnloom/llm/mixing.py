"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document has a rate between 0 and ``cap`` copies. Among all rates that give a source its target words, those
nearest to one copy each (in the entropy of a value bounded by 0 and cap) are exponentially tilted by the document's
size: rate = cap / (1 + exp(-tilt * size / mean size)). The tilt solves the convex dual, one number per source; Newton
steps, each a distributed aggregation over all sources at once, find it. Rates depend on source and size alone, so the
sums run over the table of distinct (source, size) pairs.

Rounding: within a source, from the largest size down, a pair's copies are the difference of its running rate rounded,
which keeps the words within half the largest document of the target. A source that is still over ``NEAR`` of its target
away then changes one copy, or two of them, of the sizes that bring it nearest, again and again while that helps; the
partner of a change is the nearest size to what it lacks, found in sorted order. Copies of a pair are dealt evenly over
its documents in the order of their hash.

Cases. A null source is a source of its own and comes last. Null and empty texts have size 0, target nothing and take
nothing. Repeated rows are documents of their own. Empty tables give empty results; extra columns are kept,
but ``allot`` leaves out those that are named like its own or its working columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, fresh, materialise, written

WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
MIX_COLUMNS = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
WORKING = ("source_key", "mix_slice", "mix_order", "mix_before", "mix_cell", "mix_n", *MIX_COLUMNS)
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2

#: Newton steps; bisection backs them up, so this many suffice for the tolerance below, or ``solve_tilts`` raises.
MAX_STEPS = 60

#: Share of a source's target within which its rounded words stand.
NEAR = 1e-4

#: Relative error of a source's words at which its tilt stands.
TOLERANCE = 1e-7

#: Distinct (source, size) pairs that may be broadcast: under 60 MB.
DEALT_ROWS = 500_000

#: Slices of a (source, size) pair for ranking its documents, so that no pair is sorted in one task.
SLICES = 64


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WORD_SEPARATORS), "")), F.lit(0)).cast("long")


def source_targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source_key, source_size, n_docs, target: one row per source of ``cells`` (source_key, size, n).

    Sources in code point order take the weights in turn. A target stops at cap times the source's size; what is over
    goes to the others by weight until none is above: with the sources ordered by cap size over weight, the level that
    fills the rest is the first that its own source does not reach.
    """
    per = cells.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    order = W.orderBy(F.col("source_key.is_null"), F.col("source_key.name"))
    per = per.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights)))
    ratio = cap * F.col("source_size") / F.col("weight")
    up = W.orderBy("ratio", F.col("source_key.is_null"), F.col("source_key.name"))
    everything = W.partitionBy()
    per = per.withColumn("ratio", ratio).withColumn("total", share * F.sum("source_size").over(everything))
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(up.rowsBetween(W.currentRow, W.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / after)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least((cap * F.col("source_size")).cast("double"), F.coalesce(F.col("weight") * level, cap * F.col("source_size"))))
    return per.select("source_key", "source_size", "n_docs", target.alias("target"))


def _rate(tilt: Column, size: Column, mean: Column, cap: float) -> Column:
    power = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * size / mean))
    return cap / (1 + F.exp(-power))


def solve_tilts(cells: DataFrame, targets: DataFrame, cap: float = CAP, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """targets plus mean, tilt: Newton steps on the dual, all sources in one aggregation each.

    A step that leaves the bracket known so far is replaced by its middle (or by doubling where one end is open).
    """
    state = targets.where(F.col("source_size") > 0).withColumn("mean", F.col("source_size") / F.col("n_docs"))
    ratio = F.col("target") / (cap * F.col("source_size"))
    ratio = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), ratio))
    weighted = cells.join(state.select("source_key", "mean"), "source_key").groupBy("source_key").agg((F.sum(F.col("size") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("heavy"))
    state = state.join(weighted, "source_key").withColumn("tilt", F.log(ratio / (1 - ratio)) * F.col("mean") / F.col("heavy")).drop("heavy")
    state = state.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "done": F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)})
    state = materialise(state.withColumn("tilt", F.when(F.col("done"), F.lit(float("inf"))).otherwise(F.col("tilt"))), "tilts")
    for _ in range(max_steps):
        if state.where(~F.col("done")).isEmpty():
            break
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
        words = F.col("n") * F.col("size")
        sums = (
            cells.join(state.where(~F.col("done")).select("source_key", "tilt", "mean"), "source_key").groupBy("source_key")
            .agg(F.sum(words * rate).alias("got"), F.sum(words * rate * (1 - rate / cap) * F.col("size") / F.col("mean")).alias("slope"))
        )
        now = state.join(sums, "source_key", "left")
        error = F.col("got") - F.col("target")
        settled = F.abs(error) <= tolerance * F.col("source_size")
        low = F.when(error < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(error > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - error / F.col("slope")
        inside = (F.col("slope") > 0) & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        middle = F.when(low.isNull(), F.least(2 * high, high - 1)).when(high.isNull(), F.greatest(2 * low, low + 1)).otherwise((low + high) / 2)
        step = F.when(F.col("done") | settled, F.col("tilt")).when(inside, newton).otherwise(middle)
        last = written[-1:]
        state = materialise(now.select("source_key", "source_size", "n_docs", "target", "mean", step.alias("tilt"), low.alias("low"), high.alias("high"), (F.col("done") | settled).alias("done")), "tilts")
        discard(state.sparkSession, last)
    else:
        if not state.where(~F.col("done")).isEmpty():
            raise RuntimeError(f"tilts did not settle in {max_steps} steps")
    return state.select("source_key", "source_size", "target", "mean", "tilt")


def round_copies(cells: DataFrame, solved: DataFrame, cap: int = CAP) -> DataFrame:
    """source_key, size, n, copies: whole copies per pair that keep each source at its target."""
    rated = cells.where(F.col("size") > 0).join(solved, "source_key").withColumn("rate", F.when(F.col("tilt") == float("inf"), F.lit(float(cap))).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)))
    down = W.partitionBy("source_key").orderBy(F.desc("size"))
    running = F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(W.unboundedPreceding, W.currentRow))
    rated = rated.withColumn("running", F.floor(running + 0.5))
    rated = rated.withColumn("copies", F.col("running") - F.coalesce(F.lag("running").over(down), F.lit(0)))
    rated = rated.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), cap * F.col("n"))).cast("long"))
    whole = W.partitionBy("source_key")
    rest = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole)
    state = materialise(rated.select("source_key", "size", "n", "copies", "target", rest.alias("rest")), "mix-copies")
    while True:
        better = materialise(_better(state.where(F.abs("rest") > NEAR * F.col("target")), cap), "mix-better")
        if better.isEmpty():
            return state.select("source_key", "size", "n", "copies")
        moved = state.join(better.select("source_key", "one", "two"), "source_key", "left")
        change = lambda move: F.when(F.abs(move) == F.col("size"), F.signum(move)).otherwise(0).cast("long")
        one, two = F.coalesce("one", F.lit(0)), F.coalesce("two", F.lit(0))
        last = written[-2:]
        state = materialise(moved.select("source_key", "size", "n", (F.col("copies") + change(one) + change(two)).alias("copies"), "target", (F.col("rest") - one - two).alias("rest")), "mix-copies")
        discard(state.sparkSession, last)


def _better(state: DataFrame, cap: int) -> DataFrame:
    """source_key, one, two: the words of the one or two copies more (or, negative, less) that bring a source nearest.

    Only sources that come nearer are given, so their distance falls with each call.
    """
    more, less = cap * F.col("n") - F.col("copies"), F.col("copies")
    moves = state.select("source_key", "rest", F.explode(F.array(F.struct(F.col("size").alias("move"), more.alias("room")), F.struct((-F.col("size")).alias("move"), less.alias("room")))).alias("m"))
    moves = moves.select("source_key", "rest", "m.move", "m.room").where(F.col("room") > 0)
    there = moves.select("source_key", "rest", F.col("move").cast("double").alias("at"), F.struct("move", "room").alias("there"), F.lit(None).cast("long").alias("one"))
    wanted = moves.select("source_key", "rest", (F.col("rest") - F.col("move")).alias("at"), F.lit(None).cast(there.schema["there"].dataType).alias("there"), F.col("move").alias("one"))
    line = W.partitionBy("source_key").orderBy("at")
    met = there.unionByName(wanted).withColumns({
        "below": F.last("there", True).over(line.rangeBetween(W.unboundedPreceding, W.currentRow)),
        "above": F.first("there", True).over(line.rangeBetween(W.currentRow, W.unboundedFollowing)),
    }).where(F.col("one").isNotNull())
    partner = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("move"), F.lit(2).cast("long").alias("room")), F.col("below"), F.col("above"))).alias("p")
    pairs = met.select("source_key", "rest", "one", partner).where((F.col("p.move") != F.col("one")) | (F.col("p.room") > 1))
    left = F.abs(F.col("rest") - F.col("one") - F.col("p.move"))
    best = pairs.where(left < F.abs("rest") - 1e-6).groupBy("source_key").agg(F.min(F.struct(left.alias("left"), F.abs("p.move").alias("least"), F.col("one"), F.col("p.move").alias("two"))).alias("b"))
    return best.select("source_key", "b.one", "b.two")


def _source_key(documents: DataFrame | None = None) -> Column:
    source = F.col("source") if documents is None else documents["source"]
    return F.struct(source.isNull().alias("is_null"), F.coalesce(source.cast("string"), F.lit("")).alias("name")).alias("source_key")


def allot(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, slices: int = SLICES) -> DataFrame:
    """The documents with mix_size, mix_source_size, mix_target and mix_copies (0 to cap, a whole number)."""
    own = [c for c in documents.columns if c.lower() not in WORKING]
    return _allotted(documents.select(own), weights, share, cap, slices).select(*own, *MIX_COLUMNS)


def _allotted(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, slices: int = SLICES) -> DataFrame:
    """All columns of ``allot`` and its working ones."""
    if not 0 < share <= cap:
        raise ValueError("the share must be above 0 and at most the cap")
    order = F.xxhash64("doc_id", "text")
    sized = documents.withColumns({
        "source_key": _source_key(),
        "mix_size": size_of(F.col("text")), "mix_order": order, "mix_slice": F.pmod(order, F.lit(slices)).cast("int"),
    })
    sliced = materialise(sized.groupBy("source_key", F.col("mix_size").alias("size"), "mix_slice").agg(F.count("*").alias("n_slice")), "mix-cells")
    cells = sliced.groupBy("source_key", "size").agg(F.sum("n_slice").alias("n"))
    targets = materialise(source_targets(cells, weights, share, cap), "mix-targets")
    copies = round_copies(cells, solve_tilts(cells, targets, cap), cap).drop("n")
    pair = W.partitionBy("source_key", "size")
    before = F.sum("n_slice").over(pair.orderBy("mix_slice").rowsBetween(W.unboundedPreceding, -1))
    plan = sliced.withColumns({"mix_before": F.coalesce(before, F.lit(0)), "mix_n": F.sum("n_slice").over(pair)}).drop("n_slice")
    plan = plan.join(copies, ["source_key", "size"], "left").join(targets.drop("n_docs"), "source_key")
    plan = materialise(plan.select("source_key", F.col("size").alias("mix_size"), "mix_slice", "mix_before", "mix_n", F.coalesce("copies", F.lit(0)).alias("mix_cell"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")), "mix-plan")
    within = W.partitionBy("source_key", "mix_size", "mix_slice").orderBy("mix_order", F.col("doc_id").asc_nulls_last())
    place = F.col("mix_before") + F.row_number().over(within) - 1
    extra = F.when(place < F.col("mix_cell") % F.col("mix_n"), 1).otherwise(0)
    return sized.join(plan, ["source_key", "mix_size", "mix_slice"]).withColumn("mix_copies", (F.floor(F.col("mix_cell") / F.col("mix_n")) + extra).cast("long"))


def mix(documents: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: the documents' own columns, each row as often as its copies.

    The copies are dealt on narrow rows. In a (source, size) pair those with one copy more come first in the order of slice
    and hash, so a pair's last such row tells for each document what it gets, where it is: no text is shuffled. Where only
    some of the rows that equal that last one in id and text get the copy, these rows are written and numbered by file.
    """
    slices = settings.get("slices", SLICES)
    narrow = _allotted(documents.select("doc_id", "source", "text"), **settings).select("source_key", "mix_size", "mix_copies", "mix_order")
    equal = narrow.groupBy("source_key", "mix_size", "mix_order").agg(F.min("mix_copies").alias("low"), F.max("mix_copies").alias("high"), F.count("*").alias("n"), F.sum("mix_copies").alias("copies"))
    top = F.struct("high", F.struct(F.pmod("mix_order", F.lit(slices)).cast("int").alias("slice"), F.col("mix_order").alias("order")).alias("place"), "n", "copies")
    dealt = equal.groupBy("source_key", "mix_size").agg(F.min("low").alias("least"), F.max(top).alias("top"))
    more = F.col("top.high") > F.col("least")
    dealt = dealt.select(F.col("source_key").alias("d_key"), F.col("mix_size").alias("d_size"), "least", F.when(more, F.col("top.place")).alias("last"), (F.col("top.copies") - F.col("top.n") * F.col("least")).alias("extra"), (more & (F.col("top.copies") < F.col("top.n") * F.col("top.high"))).alias("some"))
    dealt = materialise(dealt, "mix-dealt")
    few = broadcast_if_small(dealt, DEALT_ROWS)
    order = F.xxhash64(documents["doc_id"], documents["text"])
    own = F.struct(F.pmod(order, F.lit(slices)).cast("int").alias("slice"), order.alias("order"))
    met = documents.join(few, (_source_key(documents) == few["d_key"]) & (size_of(documents["text"]) == few["d_size"]))
    row = F.struct(*(documents[c].alias(c) for c in documents.columns)).alias("row")
    split = few["some"] & (own == few["last"])
    plain = met.where(~F.coalesce(split, F.lit(False))).select(row, (few["least"] + F.when(own <= few["last"], 1).otherwise(0)).alias("copies"))
    if not dealt.where("some").isEmpty():
        plain = plain.unionByName(_numbered_copies(materialise(met.where(split).select(row, few["d_key"], few["d_size"], few["least"], few["extra"]), "mix-equal")))
    copy = fresh(documents, "mix_copy")
    return plain.select("row.*", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias(copy)).drop(copy)


def _numbered_copies(rows: DataFrame) -> DataFrame:
    """(row, copies) of written rows: in each (d_key, d_size) the first ``extra`` get one copy more than ``least``.

    A row's place is its place in its file and the rows in the files before.
    """
    pair = ["d_key", "d_size"]
    placed = rows.select("row", *pair, "least", "extra", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = placed.groupBy(*pair, "file").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy(*pair).orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("before") + F.row_number().over(W.partitionBy(*pair, "file").orderBy("at"))
    met = placed.join(broadcast_if_small(materialise(before.drop("n"), "mix-before"), DEALT_ROWS), [*pair, "file"])
    return met.select("row", (F.col("least") + F.when(place <= F.col("extra"), 1).otherwise(0)).alias("copies"))
