"""Recursive merge of JSON documents by paths, without gathering the versions of a key.

Documents become rows (key, path, order, text): a scalar, an array or a null is a leaf with its JSON text, an object is a row
without text at its path and then its members. Of a path only the latest leaf and the latest object count. A leaf ends what was
at its path and below before it; an object at a leaf's path ends the leaf. What is left is put in order of paths and written out.

Documents are dealt by their keys, once, and opened where they come to; nothing is shuffled after that. Keys with more than ``HOT``
versions are opened where they are read instead, so that their versions collapse in all tasks before their paths are dealt.

Cases. A document that is null or unreadable counts as an empty object. Equal orders within a key go by the text, and an
object ends a leaf of the same order. Objects nested more than ``depth`` deep are an error. Members are in order of their
names; numbers are written as variants print them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of objects in objects.
DEPTH = 8

#: Versions of a key that one task opens.
HOT = 20_000


def paths(df: DataFrame, key: str, order: str, document: str, depth: int = DEPTH) -> DataFrame:
    """(key, at, path, text): every value of every document; ``text`` is null for objects."""
    root = F.coalesce(F.try_parse_json(F.col(document)), F.parse_json(F.lit("{}")))
    no_value = F.lit(None).cast("variant")
    step = lambda path, value, done: F.struct(path.alias("path"), value.alias("value"), done.alias("done"))
    rows = df.select(F.col(key), F.col(order).alias("at"), step(F.array().cast("array<string>"), root, F.lit(False)).alias("s"))
    is_object = lambda value: F.schema_of_variant(value).startswith("OBJECT")
    for _ in range(depth + 1):
        s = F.col("s")
        members = F.transform(F.map_entries(s["value"].cast("map<string,variant>")), lambda e: step(F.concat(F.col("s.path"), F.array(e["key"])), e["value"], F.lit(False)))
        own = step(s["path"], no_value, F.lit(True))
        opened = F.when(~s["done"] & is_object(s["value"]), F.concat(F.array(own), members)).otherwise(F.array(step(s["path"], s["value"], s["done"])))
        rows = rows.select(key, "at", F.explode(opened).alias("s"))
    deep = ~F.col("s.done") & is_object(F.col("s.value"))
    text = F.when(deep, F.raise_error(F.lit(f"objects are nested more than {depth} deep"))).when(~F.col("s.done"), F.to_json(F.col("s.value")))
    return rows.select(key, "at", "s.path", text.alias("text"))


def latest(rows: DataFrame, key: str) -> DataFrame:
    """(key, path, leaf, object_at): per path its latest leaf (at, text) and the time of its latest object."""
    leaf = F.max(F.when(F.col("text").isNotNull(), F.struct("at", "text")))
    return rows.groupBy(key, "path").agg(leaf.alias("leaf"), F.max(F.when(F.col("text").isNull(), F.col("at"))).alias("object_at"))


def surviving(nodes: Column) -> Column:
    """(path, text) nodes of the merged document, the text null for objects, of (path, leaf, object_at) nodes in order of paths."""
    below = lambda path, top: (F.size(path) > F.size(top)) & (F.slice(path, F.lit(1), F.size(top)) == top)
    # what is below a path follows it at once
    ends = F.filter(nodes, lambda x, i: x["leaf"].isNotNull() & F.coalesce(below(F.get(nodes, i + 1)["path"], x["path"]), F.lit(False)))

    def kept(x: Column) -> Column:
        killed = F.array_max(F.transform(F.filter(ends, lambda y: below(x["path"], y["path"])), lambda y: y["leaf"]["at"]))
        outlives = lambda at: killed.isNull() | (at > killed)
        leaf, at, object_at = x["leaf"], x["leaf"]["at"], x["object_at"]
        is_leaf = leaf.isNotNull() & (object_at.isNull() | (at > object_at)) & outlives(at)
        is_object = object_at.isNotNull() & (leaf.isNull() | (object_at >= at)) & outlives(object_at)
        return F.when(is_leaf, F.struct(x["path"].alias("path"), leaf["text"].alias("text"))).when(is_object, F.struct(x["path"].alias("path"), F.lit(None).cast("string").alias("text")))

    return F.filter(F.transform(nodes, kept), lambda x: x.isNotNull())


def written_out(nodes: Column) -> Column:
    """The JSON text of (path, text) nodes in order of their paths."""
    quoted = lambda name: F.regexp_extract(F.to_json(F.array(name)), r"(?s)^\[(.*)\]$", 1)

    def piece(x: Column, i: Column) -> Column:
        after = F.size(x["path"]) + F.when(x["text"].isNull(), 1).otherwise(0)
        following = F.coalesce(F.size(F.get(nodes, i + 1)["path"]), F.lit(0))
        first = F.size(F.get(nodes, i - 1)["path"]) < F.size(x["path"])
        name = F.when(F.size(x["path"]) == 0, "").otherwise(F.concat(F.when(first, "").otherwise(","), quoted(F.element_at(x["path"], -1)), F.lit(":")))
        closed = F.when(i + 1 < F.size(nodes), after - following).otherwise(after)
        return F.concat(name, F.coalesce(x["text"], F.lit("{")), F.repeat(F.lit("}"), closed.cast("int")))

    return F.array_join(F.transform(nodes, piece), "")


def deep_merge(df: DataFrame, key: str, order: str, document: str, depth: int = DEPTH) -> DataFrame:
    """(key, merged): objects merge recursively in the order given; later scalars, arrays and nulls replace."""
    known = df.where(F.col(key).isNotNull()).select(key, order, document)
    hot = F.broadcast(known.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(key))
    merged = []
    for some in (known.join(hot, key, "left_anti").repartition(key), known.join(hot, key, "left_semi")):
        per = latest(paths(some, key, order, document, depth), key)
        # in steps of their own: the optimizer must not write the sorted list into every lambda
        sorted_ = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", "leaf", "object_at"))).alias("versions"))
        left = sorted_.select(key, F.explode(F.array(surviving(F.col("versions")))).alias("nodes"))
        merged.append(left.select(key, written_out(F.col("nodes")).alias("merged")))
    return merged[0].unionByName(merged[1])
