"""Seeded drafts, rules, grammars, profiles, block matrices and resumable evaluations against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators import block_matrix, drafts, evaluation_runs, grammar, rules


def mulberry(seed):
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ (state >> 15)) * (1 | state) & 0xFFFFFFFF
        t = ((t + ((t ^ (t >> 7)) * (61 | t) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
        yield (t ^ (t >> 14)) / 4294967296


def test_draws_are_those_of_the_generator(spark):
    seeds = [0, 1, -1, 42, 2**31, 2**32 + 7, 123456789012]
    got = spark.createDataFrame([(s,) for s in seeds], "s long").select("s", *(drafts.draw(F.col("s"), F.lit(k)).alias(f"d{k}") for k in (1, 2, 3, 50))).collect()
    for r in got:
        g = mulberry(r["s"])
        want = [next(g) for _ in range(50)]
        assert [r["d1"], r["d2"], r["d3"], r["d50"]] == [want[0], want[1], want[2], want[49]]
    assert abs(got[0]["d1"] - 0.26642920868471265) < 1e-16


def sections_by_walk(ids, seed, ratio):
    g = mulberry(seed)
    chosen = {s: True if s == "program" else False if s == "documents" else next(g) < ratio for s in ids}
    free = [s for s in ids if s not in ("program", "documents")]
    if sum(chosen.values()) >= len(ids) - 1 and (full := [s for s in free if chosen[s]]):
        chosen[full[int(next(g) * len(full))]] = False
    if not any(chosen[s] for s in ids if s != "program"):
        if "personal" in ids:
            chosen["personal"] = True
        elif free:
            chosen[free[int(next(g) * len(free))]] = True
    return [s for s in ids if chosen[s]]


def test_sections_are_filled_as_by_the_walk(spark):
    forms = {"a": ["program", "personal", "x", "y", "documents"], "b": ["x", "program", "y", "z"], "c": ["documents"], "d": ["program", "x"], "e": []}
    rng = random.Random(2)
    asked = [(k, rng.choice("abcde"), rng.randrange(2**32), rng.choice([0.0, 0.1, 0.5, 0.9, 1.0])) for k in range(400)]
    table = spark.createDataFrame([(f, k, s) for f, ids in forms.items() for k, s in enumerate(ids)], "form_id string, section_pos int, section_id string")
    got = {r["record_id"]: r["filled"] for r in drafts.filled_sections(spark.createDataFrame(asked, "record_id long, form_id string, seed long, ratio double"), table).collect()}
    assert got == {k: sections_by_walk(forms[f], seed, ratio) for k, f, seed, ratio in asked}


TREES = [
    ("a", "odd", ("all", ("filled", "a"), ("not", ("digits", "a", 2, 3)))), ("b", "wrong", ("any", ("equals", "b", "x"), ("same_text", "b", "a"))), ("c", "list", ("not", ("members_of", "c", "p", "q"))),
    ("d", "range", ("between", "d", -1.5, 3)), ("d", "no number", ("not", ("is_number", "d"))), ("e", "today", ("is_today", "e")),
]


def test_rules_hold_on_nulls_and_odd_values(spark):
    heads, nodes = rules.tree_rows(TREES)
    h, n = spark.createDataFrame(heads, rules.RULES), spark.createDataFrame(nodes, rules.NODES)
    rows = [({"a": "1-2", "b": " 1-2 ", "c": '["p"]', "d": "3", "e": "2024-05-01"},), ({"a": "x", "b": "x", "c": '["p","z"]', "d": "NaN"},), ({"c": "[]", "d": "1e9"},), (None,)]
    df = spark.createDataFrame(rows, "values map<string,string>").withColumn("_read", F.lit(1))
    got = [[(p["field_id"], p["problem"]) for p in r["problems"]] for r in rules.with_problems(df, "values", h, n, "abcde", F.to_date(F.lit("2024-05-01"))).collect()]
    assert got == [[("b", "wrong"), ("d", "range"), ("e", "today")], [("a", "odd"), ("b", "wrong"), ("c", "list"), ("d", "no number")], [], [("c", "list"), ("d", "no number")]]
    none = rules.with_problems(df, "values", h.limit(0), n.limit(0), [])
    assert none.columns == ["values", "_read", "problems"] and none.where(F.size("problems") > 0).count() == 0


@pytest.mark.parametrize("node, said", [
    ((0, 1, 5, "given", "a", []), "unknown parent"), ((0, 1, None, "given", "a", []), "two roots"), ((0, 1, 0, "guess", "a", []), "unknown op"), ((0, 1, 0, "given", "zz", []), "unknown field"),
    ((0, 1, 0, "digits", "a", ["1"]), "arguments"), ((0, 1, 0, "longer", "a", ["x"]), "numbers"), ((0, 1, 1, "all", None, []), "cycle"), ((0, 0, 0, "all", None, []), "twice"),
])
def test_faulty_rule_sets_are_refused(spark, node, said):
    heads = spark.createDataFrame([(0, "a", "p")], rules.RULES)
    nodes = spark.createDataFrame([(0, 0, None, "all", None, []), node], rules.NODES)
    with pytest.raises(ValueError, match=said):
        rules.checked(heads, nodes, ["a"])


def test_hundreds_of_rules_are_one_projection(spark):
    trees = [(f"f{k % 40}", f"p{k}", ("all", ("filled", f"f{k % 40}"), ("longer", f"f{k % 40}", k % 7))) for k in range(300)]
    heads, nodes = rules.tree_rows(trees)
    df = spark.createDataFrame([({f"f{k}": "x" * (k % 9) for k in range(40)},)], "values map<string,string>")
    found = rules.with_problems(df, "values", spark.createDataFrame(heads, rules.RULES), spark.createDataFrame(nodes, rules.NODES), [f"f{k}" for k in range(40)])
    assert [p["problem"] for p in found.first()["problems"]] == [f"p{k}" for k in range(300) if (k % 40) % 9 > k % 7]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_grammars_that_do_not_end_and_slots_that_lack(spark):
    rows = [("s", 0, 1.0, ["a", "<t>"]), ("t", 0, 1.0, ["{x}", "<unknown>"]), ("loop", 0, 1.0, ["<loop>"])]
    g = spark.createDataFrame(rows, "symbol string, alternative int, weight double, parts array<string>")
    starts = spark.createDataFrame([(1, "s"), (2, "s")], "id long, symbol string")
    values = spark.createDataFrame([(1, "x", "X")], "id long, slot string, value string")
    assert [tuple(r) for r in grammar.messages(starts, g, values, "id", "k").collect()] == [(1, "aX<unknown>")]
    with pytest.raises(Exception, match="deeper than"):
        grammar.messages(starts.withColumn("symbol", F.lit("loop")), g, values, "id", "k").collect()


def test_profiles_need_an_order(spark):
    assert grammar.draw_order({"c": ["a", "b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    for parents, said in (({"a": ["b"], "b": ["a"]}, "cycle"), ({"a": ["z"]}, "unknown")):
        with pytest.raises(ValueError, match=said):
            grammar.draw_order(parents)
    table = spark.createDataFrame([("t", ["*"], "any", 1.0), ("t", ["x"], "own", 1.0), ("t", ["x"], "never", 0.0), ("u", ["own"], "v", 1.0)], "name string, given array<string>, option string, weight double")
    got = grammar.drawn_profiles(spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, s string"), table, {"s": [], "t": ["s"], "u": ["t"]}, "id", "k").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "x", "own", "v"), (2, "y", "any", None), (3, None, "any", None)]


def test_block_products_equal_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-5, 6, (23, 17)).astype(float), rng.integers(-5, 6, (17, 9)).astype(float)
    a[4] = 0
    put = lambda m: spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(m)], "k long, v array<double>").repartition(3)
    for size in (4, 17, 64):
        got = np.zeros((23, 9))
        for r in block_matrix.product(block_matrix.blocks(put(a), "k", "v", size), block_matrix.blocks(put(b), "k", "v", size), size).collect():
            got[r["row"], r["col"]] = r["value"]
        assert (got == a @ b).all()
        gram = block_matrix.product(block_matrix.blocks(put(a), "k", "v", size), block_matrix.blocks(put(a), "k", "v", size), size, transpose=True)
        n = block_matrix.matrix_norms(gram, 17, 17).first()
        assert np.allclose([n["frobenius"], n["max_abs"], n["mean_abs"]], [np.linalg.norm(a.T @ a), np.abs(a.T @ a).max(), np.abs(a.T @ a).mean()])
    odd = spark.createDataFrame([(0, [1.0, None]), (1, None), (None, [1.0]), (2, [2.0]), (2, [1.0])], "k long, v array<double>")
    m = block_matrix.blocks(odd, "k", "v", 4)
    assert [tuple(r) for r in block_matrix.product(m, m, 4, True).collect()] == [(0, 0, 4.0)]
    assert block_matrix.matrix_norms(block_matrix.product(m.limit(0), m.limit(0), 4), 2, 2).first()["mean_abs"] == 0


def test_evaluations_resume_and_halt(spark, tmp_path):
    cases = spark.range(100).withColumnRenamed("id", "case_id")
    asked = spark.sparkContext.accumulator(0)
    score = lambda fails: lambda rows: rows.select("case_id", F.when(~fails, F.col("case_id") / 2).alias("score"))
    folder = f"file://{tmp_path}/runs"
    none = F.lit(False)
    with pytest.raises(evaluation_runs.Halted) as halted:
        evaluation_runs.evaluate(cases, score(F.col("case_id") == 7), folder, 4)
    assert halted.value.failures == 1 and [r["case_id"] for r in evaluation_runs.scored(spark, folder, 4, True).collect()] == [7]
    done = evaluation_runs.scored(spark, folder, 4).count()
    died = tmp_path / "runs" / "batch=3" / "run=0"
    died.mkdir(parents=True, exist_ok=True)  # a run that was killed left no _SUCCESS
    left = evaluation_runs.evaluate(cases, score(none), folder, 4)
    assert done + left == 100 and asked.value == 0
    got = evaluation_runs.scored(spark, folder, 4).collect()
    assert sorted((r["case_id"], r["score"]) for r in got) == [(k, k / 2) for k in range(100)]
    assert evaluation_runs.scored(spark, folder, 4, True).count() == 0
    assert evaluation_runs.evaluate(cases, score(none), folder, 4) == 0
    assert evaluation_runs.evaluate(spark.range(103).withColumnRenamed("id", "case_id"), score(none), folder, 4) == 3


def test_customers_are_dealt_to_all_tasks_and_drawn_once(spark, sf_dir):
    from turnloom.plans import catalogue

    plans = {q: catalogue.queries()[q](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString() for q in ("form_rules", "seeded_drafts")}
    assert all("RepartitionByExpression" in p for p in plans.values())
    assert not any("Filter" in line and "1831565813" in line for line in plans["seeded_drafts"].splitlines())  # no draws in a filter
