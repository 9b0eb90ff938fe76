"""Operators over sessions: pairing, history, state as of a turn, runs.

All are windows keyed by session; none joins a session with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip


def ordered(session: str, *order: str):
    return W.partitionBy(session).orderBy(*order)


def before(window, most: int | None = None):
    """All earlier rows of the session, or the last ``most`` of them."""
    return window.rowsBetween(W.unboundedPreceding if most is None else -most, -1)


def with_ordinal(df: DataFrame, keys: list[str], *order: str, name: str = "ordinal") -> DataFrame:
    """Position within the keys, from 0."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def pair_by_ordinal(left: DataFrame, right: DataFrame, keys: list[str], right_value: str) -> DataFrame:
    """The right row at the same place; else the key's first; else null. Both sides have ``ordinal``."""
    at = right.select(*keys, "ordinal", F.col(right_value).alias("_at"))
    first = right.where(F.col("ordinal") == 0).select(*keys, F.col(right_value).alias("_first"))
    return left.join(at, [*keys, "ordinal"], "left").join(first, keys, "left").withColumn(right_value, F.coalesce("_at", "_first")).drop("_at", "_first")


def last_per_turn(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last event of each key wins."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def state_as_of(df: DataFrame, session: str, order: list[str], state: str, name: str = "state_before") -> DataFrame:
    """The latest non-null state strictly before each row."""
    return df.withColumn(name, F.last(state, ignorenulls=True).over(before(ordered(session, *order))))


def state_around(df: DataFrame, session: str, order: list[str], state: str, initial: Column) -> DataFrame:
    """State before and after each row, with an initial value."""
    w = ordered(session, *order)
    return df.withColumns({
        "state_before": F.coalesce(F.last(state, ignorenulls=True).over(before(w)), initial),
        "state_after": F.coalesce(F.last(state, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), initial),
    })


def reply_groups(df: DataFrame, session: str, order: str, starts: Column) -> DataFrame:
    """Numbers the run that begins at each starting row; rows before the first start are run 0."""
    return df.withColumn("run", F.sum(starts.cast("int")).over(ordered(session, order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def history(df: DataFrame, session: str, order: list[str], role: str, content: str, most: int | None = None, clip: int | None = None, skip_blank: bool = True) -> DataFrame:
    """The messages before each row as an array of (role, content), oldest first.

    With ``most`` the frame itself is that long, so arrays stay small however long a session is.
    """
    text = F.left(content, F.lit(clip)) if clip else F.col(content)
    entry = F.struct(F.col(role).alias("role"), text.alias("content"))
    if skip_blank:
        entry = F.when(F.col(content).isNotNull() & (F.col(content) != ""), entry)
    return df.withColumn("history", F.collect_list(entry).over(before(ordered(session, *order), most)))


def render_history(entries: Column, separator: str = "\n") -> Column:
    """Messages as 'role: content' lines."""
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["role"], e["content"])), separator)


def clean_history(entries: Column, phantom: str = r"^\[system\] User clicked: ", keep: tuple[str, ...] = ()) -> Column:
    """drops phantom user entries with their paired empty or system reply, and cuts leaked prefixes off replies.

    Entries are (role, content); further fields named in ``keep`` stay with them.
    """
    more = lambda e: [e[k].alias(k) for k in keep]
    previous = lambda i: F.get(entries, i - 1)
    fake = lambda e: (e["role"] == "user") & e["content"].rlike(phantom)
    hollow = lambda e: (e["role"] == "assistant") & ((strip(e["content"]) == "") | F.startswith(F.regexp_replace(e["content"], r"^\s+", ""), F.lit("[system]")))
    kept = F.filter(entries, lambda e, i: ~fake(e) & ~(hollow(e) & (i > 0) & F.coalesce(fake(previous(i)), F.lit(False))))
    rest = lambda c: F.regexp_replace(F.regexp_extract(F.regexp_replace(c, r"^\s+", ""), r"(?s)^.*?\n\n(.*)$", 1), r"^\s+", "")
    leaked = lambda e: (e["role"] == "assistant") & e["content"].rlike(phantom)
    cut = F.transform(kept, lambda e: F.struct(e["role"].alias("role"), F.when(leaked(e), rest(e["content"])).otherwise(e["content"]).alias("content"), *more(e), leaked(e).alias("cut")))
    return F.transform(F.filter(cut, lambda e: ~e["cut"] | (e["content"] != "")), lambda e: F.struct(e["role"].alias("role"), e["content"].alias("content"), *more(e)))


def sessions_where(df: DataFrame, session: str, condition: Column) -> DataFrame:
    """rows of sessions whose grouped condition holds."""
    good = df.groupBy(session).agg(condition.alias("_good")).where("_good").select(session)
    return df.join(good, session, "left_semi")


def backfill_from_jump(df: DataFrame, session: str, order: list[str], size: str, state: str, sparse: Column, jump: int = 10) -> DataFrame:
    """Sparse rows before the session's first row of ``jump`` or more take its state; without one they go."""
    whole = W.partitionBy(session)
    key = F.struct(*order)
    at = F.min(F.when(F.col(size) >= jump, key)).over(whole)
    filled = F.min_by(F.col(state), F.when(F.col(size) >= jump, key)).over(whole)
    out = df.withColumns({"_sparse": sparse, "_at": at, "_state": filled})
    out = out.where(~(F.col("_sparse") & F.col("_at").isNull()))
    early = F.col("_sparse") & (key < F.col("_at"))
    return out.withColumns({"backfilled": early, state: F.when(early, F.col("_state")).otherwise(F.col(state))}).drop("_sparse", "_at", "_state")


def carried(df: DataFrame, session: str, order: str, value: str, name: str = "carried") -> DataFrame:
    """The previous row's value."""
    return df.withColumn(name, F.lag(value).over(ordered(session, order)))


def islands(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Numbers contiguous runs of an integer index."""
    w = W.partitionBy(*keys).orderBy(index)
    return df.withColumn("island", F.col(index) - F.row_number().over(w))


def stuck(df: DataFrame, session: str, order: list[str], signature: Column, times: int = 3) -> DataFrame:
    """How often in a row the signature has repeated, and whether that is ``times`` or more."""
    w = ordered(session, *order)
    out = df.withColumn("_sig", signature)
    out = out.withColumn("_new", F.when(F.col("_sig").eqNullSafe(F.lag("_sig").over(w)), 0).otherwise(1))
    out = out.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = out.withColumn("repeats", F.row_number().over(W.partitionBy(session, "_run").orderBy(*order)))
    return out.withColumn("stuck", F.col("repeats") >= times).drop("_sig", "_new", "_run")


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, width: int, name: str = "smoothed") -> DataFrame:
    """Trailing mean over the last ``width`` rows, shorter at the start."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.avg(value).over(w.rowsBetween(-(width - 1), 0)))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given (descending) order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") == 1).drop("_rn")
