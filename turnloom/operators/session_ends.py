"""Why and where sessions end: a fold over turns that composes, so that a long session is folded in parts.

A session ends at the first turn that fails (``error``), asks to stop (``user_stop``) or repeats the same intent on the same
screen for the ``stuck``-th time running (``stuck_loop``); else at the turn limit (``max_turns``), or it is still open (null).

A run of turns is summed up by its length, its first and last run of equal turns and its own end. Two summaries that follow
one another make one, and that is associative: only a run across the seam can end where neither part does alone. Turns
are folded by ``PART`` consecutive turn numbers, these by as many parts, and what is left of a session last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers in a part, and parts in the next larger one. No group is larger while a session has under PART ** LEVELS turn numbers.
PART = 1_024
LEVELS = 3

_SUMMARY = "struct<n: long, first: string, first_len: long, last: string, last_len: long, end_at: long, reason: string>"


def _summary(n, first, first_len, last, last_len, end_at, reason) -> Column:
    return F.struct(n.cast("long").alias("n"), first.alias("first"), first_len.cast("long").alias("first_len"), last.alias("last"), last_len.cast("long").alias("last_len"), end_at.cast("long").alias("end_at"), reason.alias("reason"))


def composed(a: Column, b: Column, stuck: int) -> Column:
    """The summary of what ``a`` sums up and then what ``b`` does."""
    same = a["last"] == b["first"]
    need = F.lit(stuck) - a["last_len"]
    seam = F.when(same & (b["first_len"] >= need), a["n"] + need)
    own = a["n"] + b["end_at"]
    stuck_first = seam.isNotNull() & (own.isNull() | (seam < own))  # a turn that also fails or stops ends by that
    both = _summary(
        a["n"] + b["n"],
        a["first"], F.when(same & (a["first_len"] == a["n"]), a["first_len"] + b["first_len"]).otherwise(a["first_len"]),
        b["last"], F.when(same & (b["first_len"] == b["n"]), a["last_len"] + b["last_len"]).otherwise(b["last_len"]),
        F.coalesce(a["end_at"], F.when(stuck_first, seam).otherwise(own)),
        F.when(a["end_at"].isNotNull(), a["reason"]).when(stuck_first, "stuck_loop").otherwise(b["reason"]),
    )
    return F.when(a["n"] == 0, b).otherwise(both)


def session_ends(turns: DataFrame, session: str, turn: str, intent: Column, screen: Column, stops: Column, failed: Column, stuck: int = 3, most: int = 40) -> DataFrame:
    """(session, n_turns, end_turn, reason); ``end_turn`` counts a session's turns from 1 in the order of ``turn``, a long.

    Null flags are false and null texts empty; turns that share a number go by their texts.
    """
    if stuck < 2 or most < 1:
        raise ValueError("a repeat takes two turns, and a session one")
    seen = F.sha2(F.concat_ws("\x1f", F.coalesce(intent, F.lit("")), F.coalesce(screen, F.lit(""))), 256)
    fails, halts = F.coalesce(failed, F.lit(False)), F.coalesce(stops, F.lit(False))
    one = F.lit(1)
    unit = _summary(one, seen, one, seen, one, F.when(fails | halts, 1), F.when(fails, "error").when(halts, "user_stop"))
    rows = turns.where(F.col(turn).isNotNull()).select(F.col(session).alias("_session"), F.col(turn).cast("long").alias("_at"), unit.alias("_s"))
    zero = F.lit(0)
    empty = _summary(zero, F.lit(""), zero, F.lit(""), zero, F.lit(None), F.lit(None).cast("string")).cast(_SUMMARY)
    fold = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda x: x["_s"]), empty, lambda a, b: composed(a, b, stuck).cast(_SUMMARY))
    for level in range(LEVELS):
        part = F.floor(F.col("_at") / PART).alias("_at")
        rows = rows.groupBy("_session", *([part] if level < LEVELS - 1 else [])).agg(fold.alias("_s"))
    s = F.col("_s")
    ended = s["end_at"].isNotNull() & (s["end_at"] <= most)
    return rows.select(F.col("_session").alias(session), s["n"].alias("n_turns"), F.when(ended, s["end_at"]).when(s["n"] >= most, most).cast("long").alias("end_turn"), F.when(ended, s["reason"]).when(s["n"] >= most, "max_turns").alias("reason"))
