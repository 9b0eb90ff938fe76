"""Audit of how far the sources of a language are from one another in their words.

Terms are runs of ASCII letters and non-ASCII characters, with A to Z lower-cased. A language keeps the V terms that are in
at least ``least`` of its documents. A group (lang, source) gives each kept term, with c occurrences there, the price
``1 + floor(SCALE * (c + SMOOTH) / (N + SMOOTH * V))``; N is the sum of c. Two groups differ by the sum of the absolute
differences of their prices over all kept terms.

No vector of V prices is ever built. With z the price of a term that a group lacks, the sum over all terms is

* per group, over its own terms, the difference from the other's z: from a histogram of its counts, by running sums;
* for terms of both, less twice what the smaller price has above the larger z: from a join of postings on the term;
* for terms of neither, a constant times their number: by inclusion and exclusion from V and the two supports.

Cases. Null text, lang and source count as ''. Each row is a document, so a repeated row counts again. A group without
terms has all its terms at z; a language without kept terms has pairs of value 0 and no terms. Equal values rank by item
in UTF-8 order. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, materialise

NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

SCALE = 1_000_000_000
SMOOTH = 5

#: Documents of the language that a kept term is in, and the ranks given of a group's terms.
LEAST_DOCUMENTS = 30
TOP_TERMS = 50

#: Parts of a group's terms that are ranked before their best are ranked together.
TERM_PARTS = 16


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; every group has a row with a null term, n 0 and all its documents, too."""
    read = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    terms = F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), NOT_LETTERS), "")
    listed = documents.select(*read, terms.alias("terms"))
    shown = F.concat(F.array_distinct("terms"), F.array(F.lit(None).cast("string")))
    kinds = F.array(F.struct("terms", F.lit(1).alias("n"), F.lit(0).alias("docs")), F.struct(shown.alias("terms"), F.lit(0).alias("n"), F.lit(1).alias("docs")))
    each = listed.select("lang", "source", F.explode(kinds).alias("k")).select("lang", "source", "k.n", "k.docs", F.explode("k.terms").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def postings(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the kept terms, and each group's row with a null term.

    ``lang_n`` is the term's count in the language; ``first`` marks one row of each (lang, term).
    """
    of_term = W.partitionBy("lang", "term")
    first = F.col("term").isNotNull() & (F.min("source").over(of_term) == F.col("source"))
    counted = term_counts(documents).select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("lang_n"), first.alias("first"))
    return counted.where(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs")


def price(count: Column, total: Column, size: Column) -> Column:
    """The price of a term, exactly: the products do not fit a long."""
    over = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.call_function("div", over, (total + SMOOTH * size).cast("decimal(20,0)"))
    return F.when(size > 0, 1 + whole).otherwise(0).cast("long")


def _group_sizes(found: DataFrame) -> DataFrame:
    """(lang, source, total, support, kept, lang_total, zero) of every group."""
    per = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("support"), F.sum(F.col("first").cast("long")).alias("firsts"), F.sum(F.when(F.col("first"), F.col("lang_n")).otherwise(0)).alias("lang_part"))
    of_lang = W.partitionBy("lang")
    whole = per.select("lang", "source", "total", "support", F.sum("firsts").over(of_lang).alias("kept"), F.sum("lang_part").over(of_lang).alias("lang_total"))
    return whole.withColumn("zero", price(F.lit(0), F.col("total"), F.col("kept")))


def _one_sided(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, lo, hi, value): what a group's own terms and the terms that both lack add to the difference of a pair."""
    histogram = found.where(F.col("term").isNotNull()).groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    g = groups.select("lang", "source", "total", "kept")
    at = histogram.join(broadcast_if_small(g), ["lang", "source"]).select("lang", "source", price(F.col("n"), F.col("total"), F.col("kept")).alias("at"), "terms", F.lit(None).cast("string").alias("other"), *(F.lit(None).cast("long").alias(c) for c in ("zero", "support", "kept")))
    others = groups.select(F.col("lang").alias("o_lang"), F.col("source").alias("other"), F.col("zero").alias("at"))
    marks = groups.join(others, (F.col("lang") == F.col("o_lang")) & (F.col("source") != F.col("other"))).select("lang", "source", "at", F.lit(0).cast("long").alias("terms"), "other", "zero", "support", "kept")
    whole, below = W.partitionBy("lang", "source"), W.partitionBy("lang", "source").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    worth = F.col("terms") * F.col("at")
    summed = at.unionByName(marks).select("*", F.sum("terms").over(whole).alias("n_all"), F.sum(worth).over(whole).alias("s_all"), F.sum("terms").over(below).alias("n_below"), F.sum(worth).over(below).alias("s_below")).where(F.col("other").isNotNull())
    own = F.col("at") * (2 * F.col("n_below") - F.col("n_all")) + F.col("s_all") - 2 * F.col("s_below")
    constant = F.abs(F.col("zero") - F.col("at")) * (F.when(F.col("source") < F.col("other"), F.col("kept")).otherwise(0) - F.col("support"))
    return summed.select("lang", F.least("source", "other").alias("lo"), F.greatest("source", "other").alias("hi"), (own + constant).alias("value"))


def _overlaps(priced: DataFrame) -> DataFrame:
    """(lang, lo, hi, value): the correction for terms that both groups of a pair have."""
    lo = priced.select("lang", "term", F.col("source").alias("lo"), F.col("own").alias("lo_own"), F.col("zero").alias("lo_zero"))
    hi = priced.select("lang", "term", F.col("source").alias("hi"), F.col("own").alias("hi_own"), F.col("zero").alias("hi_zero"))
    above = F.least("lo_own", "hi_own") - F.greatest("lo_zero", "hi_zero")
    both = lo.join(hi, ["lang", "term"]).where(F.col("lo") < F.col("hi"))
    return both.groupBy("lang", "lo", "hi").agg(F.sum(-2 * F.greatest(above, F.lit(0))).alias("value"))


def pair_differences(found: DataFrame, groups: DataFrame, priced: DataFrame) -> DataFrame:
    """(lang, source, item, value): each group with each other one of its language."""
    parts = _one_sided(found, groups).unionByName(_overlaps(priced))
    summed = parts.groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct(F.col("lo").alias("source"), F.col("hi").alias("item")), F.struct(F.col("hi").alias("source"), F.col("lo").alias("item")))
    return summed.select("lang", "value", F.explode(sides).alias("side")).select("lang", "side.source", "side.item", "value")


def salient_terms(priced: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): a group's terms priced above the language's own price for them, the first ``top``."""
    more = priced.select("lang", "source", F.col("term").alias("item"), (F.col("own") - F.col("usual")).alias("value")).where(F.col("value") > 0)
    order = [F.desc("value"), F.asc("item")]
    part = F.pmod(F.xxhash64("item"), F.lit(TERM_PARTS))
    best = more.withColumn("part", part).withColumn("place", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(*order))).where(F.col("place") <= top).drop("part", "place")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows rank the other sources, ``term`` rows the salient terms."""
    found = materialise(postings(documents, least), "divergence-postings")
    groups = materialise(_group_sizes(found), "divergence-groups")
    terms = found.where(F.col("term").isNotNull()).join(broadcast_if_small(groups), ["lang", "source"])
    priced = terms.select("lang", "source", "term", "zero", price(F.col("n"), F.col("total"), F.col("kept")).alias("own"), price(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("usual"))
    pairs = pair_differences(found, groups, priced).withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return shape(pairs, "pair").unionByName(shape(salient_terms(priced, top), "term"))
