"""Secret scans behind a trigram index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query over lower-cased trigrams, an OR of ANDs that every match must
satisfy. The inverted index is a written table of postings (trigram, text), for the trigrams of the rules' vocabulary; a
text goes by its hash, so copies have one posting, and texts whose hashes collide only share their candidacy. A rule's
ANDs are met by the texts that all their trigrams' postings have; these candidates, narrow rows, come to the texts by
broadcast where they are few, and else each text's own trigrams are asked, with the same outcome, so no text is shuffled.
Candidates are verified with the expression itself; a rule without mandatory trigrams is verified on every text.

Positions: ``split`` and ``regexp_extract_all`` cut a text at the same leftmost matches, so a match starts after all gaps
and matches before it. Those running sums are windows over one document's matches, not over its text.

Cases. Null texts count as empty. Repeated rows give one output row each. Empty tables give empty results; extra columns
are dropped. A document's spans are ordered by start, then by the rules' order.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise

#: A regular expression's trigram query: any of these sets must be there in full.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])

#: Strings followed at once when a query is derived; beyond it the pieces are asked for separately.
MAX_STRINGS = 64


class Rule(NamedTuple):
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``at_least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


# The base rules and well-known token formats.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def _minimal(query: set[frozenset[str]]) -> Query:
    return frozenset(q for q in query if not any(o < q for o in query))


def _any(a: Query, b: Query) -> Query:
    return _minimal(set(a) | set(b))


def _all(a: Query, b: Query) -> Query:
    return _minimal({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> Query:
    return _minimal({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


class _Found(NamedTuple):
    """What is known of a part: all strings it can be, if few; else a query that its matches meet."""

    strings: set[str] | None
    query: Query


def _part(op, arg) -> _Found:
    if op == sre.LITERAL:
        return _Found({chr(arg).lower()}, ANYTHING)
    if op == sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
        chars = {chr(c).lower() for o, a in arg for c in ([a] if o == sre.LITERAL else range(a[0], min(a[1], a[0] + 9) + 1))}
        exact = len(chars) <= 8 and not any(o == sre.RANGE and a[1] > a[0] + 9 for o, a in arg)
        return _Found(chars if exact else None, ANYTHING)
    if op == sre.SUBPATTERN:
        return _sequence(arg[3])
    if op == sre.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        if all(f.strings is not None for f in found) and len(strings := set().union(*(f.strings for f in found))) <= MAX_STRINGS:
            return _Found(strings, ANYTHING)
        query = frozenset()
        for f in found:
            query = _any(query, f.query if f.strings is None else _of_strings(f.strings))
        return _Found(None, query)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        f = _sequence(inner)
        if most == 1 and f.strings is not None:
            return _Found(f.strings | ({""} if least == 0 else set()), ANYTHING)
        if least == 0:
            return _Found(None, ANYTHING)
        return _Found(None, f.query if f.strings is None else _of_strings(f.strings))
    if op == sre.AT:
        return _Found({""}, ANYTHING)
    return _Found(None, ANYTHING)


def _sequence(items) -> _Found:
    now, query, exact = {""}, ANYTHING, True
    for op, arg in items:
        f = _part(op, arg)
        if f.strings is not None and len(now) * len(f.strings) <= MAX_STRINGS:
            now = {a + b for a in now for b in f.strings}
            continue
        query, exact = _all(query, _of_strings(now)), False
        query = _all(query, f.query)
        now = f.strings if f.strings is not None else {""}
    if exact:
        return _Found(now, ANYTHING)
    return _Found(None, _all(query, _of_strings(now)))


def trigram_query(pattern: str) -> Query:
    """Trigrams, lower-cased, of which every match holds at least one of the sets in full."""
    found = _sequence(sre_parser.parse(pattern))
    return found.query if found.strings is None else _of_strings(found.strings)


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """All trigrams that the rules ask for."""
    return sorted({t for r in rules for q in trigram_query(r.pattern) for t in q})


def with_trigrams(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``texts`` and ``trigrams``: which of the vocabulary their text has."""
    # an array of conditions, as a lambda would have the text lower-cased anew for each trigram
    there = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), t) for t in vocabulary(rules))).cast("array<string>"))
    return texts.withColumn("low", F.lower("text")).withColumn("trigrams", there).drop("low")


def postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index: (trigram, text_key)."""
    # an outer explode: for the inner kind the optimizer would look for all trigrams once more, to filter empty arrays
    return with_trigrams(texts, rules).select(F.explode_outer("trigrams").alias("trigram"), "text_key").where(F.col("trigram").isNotNull())


def clauses(rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int, int]]:
    """(trigram, rule, clause, trigrams of the clause) for all ANDs of the rules that have mandatory trigrams."""
    found, clause = [], 0
    for k, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if frozenset() not in query:
            for wanted in sorted(map(sorted, query)):
                found += [(t, k, clause, len(wanted)) for t in wanted]
                clause += 1
    return found


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """text_key and ``c_rules``, a bit per rule: the texts that are in all postings of one of the rule's clauses."""
    wanted = F.broadcast(index.sparkSession.createDataFrame(clauses(rules), "w_trigram string, rule int, clause int, size int"))  # rows of the vocabulary
    met = index.distinct().join(wanted, F.col("trigram") == wanted["w_trigram"])
    whole = met.groupBy("text_key", "rule", "clause").agg(F.count("*").alias("n"), F.first("size").alias("size")).where(F.col("n") == F.col("size"))
    return whole.groupBy("text_key").agg(F.bit_or(F.element_at(F.array(*(F.lit(1 << k) for k in range(len(rules)))), F.col("rule") + 1)).alias("c_rules"))


def _matches(rule: Rule, order: int) -> Column:
    """The rule's matches in one text as (kind_order, at, gap, length, ok); none unless it is a candidate by ``c_rules``."""
    pattern = F.lit(rule.pattern)
    gaps = F.split("text", rule.pattern, -1)
    zipped = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("whole"), F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("part"))
    rows = F.transform(F.filter(zipped, lambda z: z["whole"].isNotNull()), lambda z, i: F.struct(
        F.lit(order).alias("kind_order"), i.alias("at"), F.char_length(z["gap"]).cast("long").alias("gap"),
        F.char_length(z["whole"]).cast("long").alias("length"), (F.char_length(z["part"]) >= rule.at_least).alias("ok"),
    ))
    if frozenset() in trigram_query(rule.pattern):
        return rows
    return F.when(F.col("c_rules").bitwiseAND(1 << order) != 0, rows)


MATCH = "array<struct<kind_order:int,at:int,gap:bigint,length:bigint,ok:boolean>>"


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id and ``spans``: (start, kind_order, end) sorted, in code points, the end exclusive."""
    none = F.array().cast(MATCH)
    text = F.coalesce("text", F.lit(""))
    texts = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"), F.monotonically_increasing_id().alias("row_key"))
    index = materialise(postings(texts, rules), "secret-postings")
    met = materialise(candidates(index, rules), "secret-candidates").withColumnRenamed("text_key", "c_key")
    few = F.broadcast(met) if met.count() <= broadcast_rows else met  # more candidates meet their texts by a shuffle
    asked = texts.join(few, texts["text_key"] == few["c_key"], "left").withColumn("c_rules", F.coalesce("c_rules", F.lit(0)))
    found = asked.select("doc_id", "row_key", F.concat(*(F.coalesce(_matches(r, k).cast(MATCH), none) for k, r in enumerate(rules))).alias("found"))
    # outer: a document without matches keeps its row
    rows = found.select("doc_id", "row_key", F.explode_outer("found").alias("m")).select("doc_id", "row_key", "m.*").repartition("row_key")
    before = W.partitionBy("row_key", "kind_order").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before))
    span = F.when(F.col("ok"), F.struct((F.col("end") - F.col("length")).alias("start"), "kind_order", "end"))
    return rows.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans")).drop("row_key")


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind_order: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind_order"] == kind_order)).cast("long")
