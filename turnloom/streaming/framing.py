"""Lines out of chunks that were cut anywhere, also inside a character.

Bytes are handled as Latin-1 text, in which every byte is a character and a line end is a line end; lines become UTF-8 once
they are whole. A carriage return before the line end is kept, as trimming is the parser's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Chunks of a session whose line ends are summed in one window.
PART = 4_096


def pieces(data: Column) -> Column:
    """The parts of a chunk between line ends: one more than it has line ends."""
    return F.split(F.decode(data, "ISO-8859-1"), "\n")


def framed(chunks: DataFrame, session: str, place: str, data: str, part: int = PART) -> DataFrame:
    """(session, line_no, line): the non-blank lines of each session, numbered from 0 with blank ones counted.

    ``place`` numbers a session's chunks; ``data`` is binary. A piece's line is the number of line ends before it in the
    session: those in its chunk, in the chunks before in its part, and in the parts before. What follows the last line end
    is a line too. Null data is an empty chunk; a session of blank lines has no rows.
    """
    cut = chunks.select(F.col(session), F.col(place).alias("at"), F.floor(F.col(place) / part).alias("part"), pieces(F.coalesce(F.col(data), F.lit(b""))).alias("pieces")).withColumn("ends", (F.size("pieces") - 1).cast("long"))
    sums = cut.groupBy(session, "part").agg(F.sum("ends").alias("part_ends"))
    before = lambda name, *keys: F.coalesce(F.sum(name).over(W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col(session).alias("s_session"), F.col("part").alias("s_part"), before("part_ends", session, "part").alias("start"))
    own = cut.withColumn("own", before("ends", session, "part", "at"))
    met = own.join(starts, F.col(session).eqNullSafe(F.col("s_session")) & (F.col("part") == F.col("s_part")))
    each = met.select(session, "at", (F.col("start") + F.col("own")).alias("first"), F.posexplode("pieces").alias("k", "piece"))
    whole = each.groupBy(session, (F.col("first") + F.col("k")).alias("line_no")).agg(F.array_sort(F.collect_list(F.when(F.col("piece") != "", F.struct("at", "k", "piece")))).alias("p"))
    line = F.encode(F.array_join(F.transform("p", lambda x: x["piece"]), ""), "ISO-8859-1").cast("string")
    return whole.select(session, "line_no", line.alias("line")).where(F.trim(F.translate("line", "\t\r\v\f", "    ")) != "")
