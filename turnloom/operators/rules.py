"""Rules held as rows, compiled into one expression over a record.

A rule is a tree of nodes (rule_id, node_id, parent_id, op, field, args); its record has the fault (field_id, problem) where
the tree is true. ``all``, ``any`` and ``not`` have children, the other ops are leaves that look at one field:

``is_true``, ``equals`` (one text), ``one_of`` (texts), ``given`` (not null), ``filled`` (nor empty), ``listed`` (a JSON list with members),
``same_text`` (as another field, but for case and outer white space), ``is_today``, ``digits`` (least, most), ``matches`` (a pattern), ``longer``
(than a number of characters), ``is_number``, ``between`` (two numbers), ``members_of`` (texts, of a JSON list), ``is_boolean``.

A rule set is checked when it is compiled: one root a rule, no unknown op, field, parent or cycle, the arguments of each op.
Each field is read once, and all rules are one projection: no join and no explode, however many there are.

Cases. A leaf over a null value is false, save ``given`` and ``filled`` which then say so; ``not`` of it is true. An empty rule set
finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

RULES = "rule_id int, field_id string, problem string"
NODES = "rule_id int, node_id int, parent_id int, op string, field string, args array<string>"

#: Rules of one set: they are read by the driver.
MOST = 10_000

#: Arguments of each leaf: their least and greatest number, and whether they are numbers.
_LEAVES = {
    "is_true": (0, 0, False), "equals": (1, 1, False), "one_of": (1, 1000, False), "given": (0, 0, False), "filled": (0, 0, False), "listed": (0, 0, False), "same_text": (1, 1, False), "is_today": (0, 0, False),
    "digits": (2, 2, True), "matches": (1, 1, False), "longer": (1, 1, True), "is_number": (0, 0, False), "between": (2, 2, True), "members_of": (1, 1000, False), "is_boolean": (0, 0, False),
}


def tree_rows(rules: Iterable[tuple[str, str, tuple]]) -> tuple[list[tuple], list[tuple]]:
    """Rows of RULES and NODES from (field_id, problem, tree), a tree being (op, children...) or (op, field, arguments...)."""
    heads, nodes = [], []

    def put(rule: int, parent: int | None, tree: tuple) -> None:
        op, *rest = tree
        number = sum(n[0] == rule for n in nodes)
        nested = op in ("all", "any", "not")
        nodes.append((rule, number, parent, op, None if nested else rest[0], [] if nested else [str(a) for a in rest[1:]]))
        for child in rest if nested else ():
            put(rule, number, child)

    for k, (field, problem, tree) in enumerate(rules):
        heads.append((k, field, problem))
        put(k, None, tree)
    return heads, nodes


def _leaf(op: str, v: Column, args: list[str], field_of, today: Column) -> Column:
    listed = F.from_json(v, "array<string>")
    number = v.try_cast("double")
    return {
        "is_true": lambda: v == "true", "equals": lambda: v == args[0], "one_of": lambda: v.isin(args), "given": lambda: v.isNotNull(), "filled": lambda: v.isNotNull() & (v != ""),
        "listed": lambda: F.coalesce(F.size(listed), F.lit(0)) > 0, "same_text": lambda: F.lower(strip(v)) == F.lower(strip(field_of(args[0]))), "is_today": lambda: v == F.date_format(today, "yyyy-MM-dd"),
        "digits": lambda: F.length(F.regexp_replace(v, r"\D", "")).between(int(args[0]), int(args[1])), "matches": lambda: v.rlike(args[0]), "longer": lambda: F.length(v) > int(args[0]),
        "is_number": lambda: number.isNotNull() & ~F.isnan(number), "between": lambda: number.between(float(args[0]), float(args[1])), "members_of": lambda: F.forall(listed, lambda x: x.isin(args)), "is_boolean": lambda: v.isin("true", "false"),
    }[op]()


def checked(rules: DataFrame, nodes: DataFrame, fields: Iterable[str]) -> tuple[list, dict]:
    """The rules in order and their nodes by (rule, node); raises ValueError for the first fault of a rule set."""
    heads = sorted(rules.limit(MOST + 1).collect(), key=lambda r: r["rule_id"])
    if len(heads) > MOST:
        raise ValueError(f"over {MOST} rules")
    rows = nodes.join(F.broadcast(rules.select("rule_id")), "rule_id", "left_semi").collect()
    known, found = set(fields), {}
    for n in rows:
        at = (n["rule_id"], n["node_id"])
        if at in found:
            raise ValueError(f"node {at} is there twice")
        found[at] = n
    roots: dict[int, int] = {}
    children: dict[tuple, list] = {at: [] for at in found}
    for at, n in sorted(found.items()):
        if n["parent_id"] is None:
            if roots.setdefault(n["rule_id"], n["node_id"]) != n["node_id"]:
                raise ValueError(f"rule {n['rule_id']} has two roots")
            continue
        if (up := (n["rule_id"], n["parent_id"])) not in found:
            raise ValueError(f"node {at} has an unknown parent")
        children[up].append(at)
    for h in heads:
        if h["rule_id"] not in roots:
            raise ValueError(f"rule {h['rule_id']} has no root")
    reached, todo = set(), [(h["rule_id"], roots[h["rule_id"]]) for h in heads]
    while todo:
        reached.add(at := todo.pop())
        todo += children[at]
    if len(reached) < len(found):
        raise ValueError(f"nodes {sorted(set(found) - reached)[:3]} are in a cycle")
    for at, n in found.items():
        args = n["args"] or []
        if n["op"] in ("all", "any", "not"):
            if n["op"] == "not" and len(children[at]) != 1:
                raise ValueError(f"not takes one child, at {at}")
            continue
        if n["op"] not in _LEAVES:
            raise ValueError(f"unknown op {n['op']} at {at}")
        least, most, numeric = _LEAVES[n["op"]]
        if children[at] or not least <= len(args) <= most:
            raise ValueError(f"{n['op']} takes {least} to {most} arguments and no children, at {at}")
        if numeric and not all(re.fullmatch(r"-?\d+(\.\d+)?", a) for a in args):
            raise ValueError(f"{n['op']} takes numbers, at {at}")
        for f in (n["field"], *(args if n["op"] == "same_text" else ())):
            if f not in known:
                raise ValueError(f"unknown field {f} at {at}")
    return heads, {at: (n, children[at]) for at, n in found.items()}


def with_problems(records: DataFrame, values: str, rules: DataFrame, nodes: DataFrame, fields: Iterable[str], today: Column | None = None) -> DataFrame:
    """Records with ``problems``, an array of (rule_id, field_id, problem) in the order of the rules.

    ``values`` is a map of texts: booleans are ``true`` and ``false``, lists JSON texts.
    """
    heads, tree = checked(rules, nodes, fields)
    used = sorted({f for n, _ in tree.values() for f in ((n["field"], *(n["args"] if n["op"] == "same_text" else ())) if n["field"] else ())})
    name = "_read"
    while any(c.startswith(name) for c in records.columns):
        name += "_"
    # columns of their own, so that each field is read once and not where each rule asks for it
    read = records.withColumns({f"{name}{k}": F.try_element_at(values, F.lit(f)) for k, f in enumerate(used)}) if used else records
    field_of = lambda f: F.col(f"{name}{used.index(f)}")
    now = F.current_date() if today is None else today

    def holds(at: tuple) -> Column:
        n, children = tree[at]
        if n["op"] == "not":
            return ~holds(children[0])
        if n["op"] in ("all", "any"):
            out = F.lit(n["op"] == "all")
            for c in children:
                out = out & holds(c) if n["op"] == "all" else out | holds(c)
            return out
        return F.coalesce(_leaf(n["op"], field_of(n["field"]), list(n["args"] or []), field_of, now), F.lit(False))

    roots = {n["rule_id"]: at for at, (n, _) in tree.items() if n["parent_id"] is None}
    faults = [F.when(holds(roots[h["rule_id"]]), F.struct(F.lit(h["rule_id"]).alias("rule_id"), F.lit(h["field_id"]).alias("field_id"), F.lit(h["problem"]).alias("problem"))) for h in heads]
    problems = F.array_compact(F.array(*faults)) if faults else F.array().cast("array<struct<rule_id:int,field_id:string,problem:string>>")
    return read.withColumn("problems", problems).drop(*(f"{name}{k}" for k in range(len(used))))
