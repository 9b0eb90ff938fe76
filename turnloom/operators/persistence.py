"""Stored drafts, submissions, vault entries, captures and call statistics as operations on tables.

Each operation takes the stored rows and a table of requests, and gives the rows to store and what each request is answered.
Ids come from hashes of what they name, so that a repeated run stores the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .json_merge import deep_merge


def _id(prefix: str, *parts: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", *(F.col(p).cast("string") for p in parts))), 1, 8))


def _checked(requests: DataFrame) -> DataFrame:
    """Requests with ``error`` where the email, the form or the data is missing."""
    lacks = [F.coalesce(F.col(c), F.lit("")) == "" for c in ("email", "form_id", "data")]
    return requests.withColumn("error", F.when(lacks[0] | lacks[1] | lacks[2], "email, form_id, and data are required"))


def save_drafts(saved: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts, answers). An email has one draft: it keeps its id and takes the form, data and time of its latest request.

    ``saved`` is (email, draft_id, form_id, data, updated_at), ``requests`` (request_id, email, form_id, data, at); requests at one time go by request_id.
    Answers are (request_id, draft_id, error); a request in error changes nothing.
    """
    asked = _checked(requests)
    good = asked.where(F.col("error").isNull())
    newest = good.groupBy("email").agg(F.max(F.struct(F.col("at").alias("updated_at"), "request_id", "form_id", "data")).alias("n"), F.min(F.struct("at", "request_id")).alias("first"))
    new = newest.select("email", F.concat(F.lit("draft_"), F.substring(F.md5(F.concat_ws("|", "email", F.col("first.request_id").cast("string"))), 1, 8)).alias("new_id"), "n.*").drop("request_id")
    both = saved.join(new.withColumnsRenamed({c: f"n_{c}" for c in ("form_id", "data", "updated_at")}), "email", "full_outer")
    came = F.col("n_updated_at").isNotNull()
    kept = both.select("email", F.coalesce("draft_id", "new_id").alias("draft_id"), *(F.when(came, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("form_id", "data", "updated_at")))
    ids = kept.select("email", "draft_id")
    return kept, asked.join(ids, "email", "left").select("request_id", F.when(F.col("error").isNull(), F.col("draft_id")).alias("draft_id"), "error")


def save_submissions(requests: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """(submissions, answers): one row per request without error, with its id and reference number."""
    asked = _checked(requests)
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "email", F.col("request_id").cast("string"))), 9, 6), 16, 10).cast("long") % 100_000
    kept = asked.where(F.col("error").isNull()).select("request_id", "email", "form_id", "data", _id("sub_", "email", "request_id").alias("submission_id"), F.concat(F.lit(f"APP-{year}-"), F.lpad(number.cast("string"), 5, "0")).alias("ref_number"), F.col("at").alias("submitted_at"))
    return kept.drop("request_id"), asked.select("request_id", "error").join(kept.select("request_id", "submission_id", "ref_number"), "request_id", "left")


def vault_save(entries: DataFrame, new: DataFrame) -> DataFrame:
    """The entries and the new ones (owner, label, data, saved_at); one that is there already is not stored twice.

    An entry is known by its id and owner: ids are 32 bits of a hash, so two owners' entries can share one, and neither is left out for that.
    """
    made = new.withColumn("entry_id", _id("v_", "owner", "label", "saved_at")).dropDuplicates(["entry_id", "owner"]).withColumn("is_profile", F.lit(False))
    there = entries.select(F.col("entry_id").alias("t_id"), F.col("owner").alias("t_owner"))
    return entries.unionByName(made.join(there, (F.col("entry_id") == F.col("t_id")) & F.col("owner").eqNullSafe(F.col("t_owner")), "left_anti").select(*entries.columns))


def vault_merge(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(request_id, owner, merged, n_entries, error) of asked (request_id, entry_id, place).

    The data of a request's entries are merged recursively in the order of ``place``. It takes two entries or more, of one owner; an id that is not there is an error.
    """
    met = asked.join(entries.select("entry_id", "owner", "data"), "entry_id", "left")
    per = met.groupBy("request_id").agg(F.count_if(F.col("owner").isNull()).alias("missing"), F.count_distinct("owner").alias("owners"), F.count("owner").alias("n_entries"), F.min("owner").alias("owner"))
    error = F.when(F.col("missing") > 0, "entries not found").when(F.col("n_entries") < 2, "at least two entries are needed").when(F.col("owners") > 1, "entries of one owner only")
    good = met.join(per.where(error.isNull()).select("request_id"), "request_id", "left_semi")
    return per.withColumn("error", error).join(deep_merge(good, "request_id", "place", "data"), "request_id", "left").select("request_id", F.when(F.col("error").isNull(), F.col("owner")).alias("owner"), "merged", "n_entries", "error")


def item_statistics(trials: DataFrame, item: str, scores: str, digits: int = 6) -> DataFrame:
    """(item, n, mean, sd): over all calls of all trials, ``scores`` being an array per trial; one call has no deviation, null calls don't count."""
    calls = trials.select(item, F.explode(scores).alias("score")).where(F.col("score").isNotNull())
    return calls.groupBy(item).agg(F.count("*").alias("n"), F.round(F.avg("score"), digits).alias("mean"), F.round(F.stddev_samp("score"), digits).alias("sd"))


def capture(spark: SparkSession, anchor: DataFrame, folder: str, anchor_id: str, overwrite: bool = False) -> str:
    """Freezes an output as the expected one, a JSON document under its id; what is there stays unless ``overwrite``."""
    path = f"{folder}/anchor={anchor_id}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not overwrite and target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileExistsError(f"{path} is there already")
    anchor.write.mode("overwrite" if overwrite else "errorifexists").json(path)
    return path


def allocated(rows: DataFrame, stratum: str, total: int, weights: dict[str, float], default: float = 0.05) -> DataFrame:
    """K7: (stratum, size, given): how many of ``total`` rows each stratum gives, by windows over the strata.

    Weights are normalised over the strata there are. In the order of names each gets its rounded share, one at least, as far as its size and
    the total go. The rest is dealt one by one, round after round, to those with rows left, the largest first: after
    some full rounds all have the same on top or are used up, and one last round goes to the first few.
    """
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    known = F.create_map(*(x for s, w in sorted(weights.items()) for x in (F.lit(s), F.lit(float(w))))) if weights else F.create_map().cast("map<string,double>")
    everything = W.partitionBy()
    so_far = lambda c, *order: F.sum(c).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    weighted = sizes.withColumn("w", F.coalesce(F.try_element_at(known, F.col(stratum)), F.lit(default)))
    share = F.bround(F.col("w") / F.sum("w").over(everything) * total).cast("long")
    capped = weighted.withColumn("cap", F.least(F.greatest(F.lit(1), share), F.col("size")))
    upto = capped.withColumn("upto", so_far("cap", stratum))
    first = upto.withColumn("own", F.least("upto", F.lit(total)) - F.least(F.col("upto") - F.col("cap"), F.lit(total))).withColumn("room", F.col("size") - F.col("own"))
    left = first.withColumn("rest", F.least(F.lit(total), F.sum("size").over(everything)) - F.sum("own").over(everything))
    by_room = left.withColumns({"lower": so_far("room", "room", stratum) - F.col("room"), "wide": F.count("*").over(everything) - F.row_number().over(W.orderBy("room", stratum)) + 1})
    fits = F.col("lower") + F.col("room") * F.col("wide") >= F.col("rest")
    rounds = F.floor((F.col("rest") - F.col("lower")) / F.col("wide"))
    level = by_room.withColumn("level", F.min(F.when(fits, F.struct("room", stratum, rounds.alias("rounds")))).over(everything)["rounds"])
    dealt = level.withColumn("more", F.least("room", "level")).withColumn("open", (F.col("room") > F.col("level")).cast("long"))
    last = dealt.withColumns({"over": F.col("rest") - F.sum("more").over(everything), "turn": so_far("open", F.desc("size"), stratum)})
    return last.select(stratum, "size", (F.col("own") + F.col("more") + F.when((F.col("open") == 1) & (F.col("turn") <= F.col("over")), 1).otherwise(0)).cast("long").alias("given"))
