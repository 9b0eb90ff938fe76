"""DataFrame operators on small tables, with invariants."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnloom.operators import aggregates, generation, json_merge, merging, sampling, scale, turns, validation, vectors
from turnloom.session import configure


def test_pairing_falls_back_to_the_first(spark):
    left = spark.createDataFrame([("s", 0, "r0"), ("s", 1, "r1"), ("t", 0, "q")], "k string, ordinal int, reply string")
    right = spark.createDataFrame([("s", 0, "u0")], "k string, ordinal int, said string")
    got = {(r["k"], r["ordinal"]): r["said"] for r in turns.pair_by_ordinal(left, right, ["k"], "said").collect()}
    assert got == {("s", 0): "u0", ("s", 1): "u0", ("t", 0): None}


def test_state_is_strictly_before(spark):
    df = spark.createDataFrame([("s", 1, "a"), ("s", 2, None), ("s", 3, "b"), ("s", 4, None)], "s string, t int, state string")
    assert [r["state_before"] for r in turns.state_as_of(df, "s", ["t"], "state").orderBy("t").collect()] == [None, "a", "a", "b"]
    around = turns.state_around(df, "s", ["t"], "state", F.lit("0")).orderBy("t").collect()
    assert [(r["state_before"], r["state_after"]) for r in around] == [("0", "a"), ("a", "a"), ("a", "b"), ("b", "b")]


CLICK = "[system] User clicked: "


def test_history_is_cleaned(spark):
    h = [("user", "hi"), ("assistant", ""), ("user", CLICK + "Save"), ("assistant", " \n"), ("user", CLICK + "Submit"), ("assistant", "real"), ("assistant", CLICK + "X\n\n kept"), ("assistant", CLICK + "alone"), ("user", CLICK), ("user", "bye")]
    df = spark.createDataFrame([(h,)], "h array<struct<role:string,content:string>>")
    got = [tuple(e) for e in df.select(turns.clean_history(F.col("h")).alias("c")).first()["c"]]
    assert got == [("user", "hi"), ("assistant", ""), ("assistant", "real"), ("assistant", "kept"), ("user", "bye")]


def test_history_tail_and_render(spark):
    df = spark.createDataFrame([("s", i, "user", "m" * i) for i in range(5)], "s string, t int, role string, text string")
    out = turns.history(df, "s", ["t"], "role", "text", most=2, clip=3).orderBy("t").collect()
    assert [[e["content"] for e in r["history"]] for r in out] == [[], [], ["m"], ["m", "mm"], ["mm", "mmm"]]


def test_backfill(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 12), ("a", 2, 0), ("b", 0, 1), ("b", 1, 5)], "s string, t int, size int").withColumn("state", F.col("size"))
    out = turns.backfill_from_jump(df, "s", ["t"], "size", "state", F.col("size") < 3, 10).orderBy("s", "t").collect()
    assert [(r["s"], r["t"], r["state"]) for r in out] == [("a", 0, 12), ("a", 1, 12), ("a", 2, 0), ("b", 1, 5)]


def test_runs(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate("aabbbba")], "s string, t int, v string")
    out = turns.stuck(df, "s", ["t"], F.col("v")).orderBy("t").collect()
    assert [r["repeats"] for r in out] == [1, 2, 1, 2, 3, 4, 1] and [r["stuck"] for r in out] == [False] * 4 + [True] * 2 + [False]
    runs = turns.islands(spark.createDataFrame([("k", i) for i in (1, 2, 3, 7, 8, 20)], "k string, i int"), ["k"], "i").groupBy("island").count().collect()
    assert sorted(r["count"] for r in runs) == [1, 2, 3]


def test_percentiles_by_index(spark):
    vals = [3, 1, 1, 9, 4, 4, 7, 8, 2, 2, 5]
    r = aggregates.index_percentiles(spark.createDataFrame([("k", v) for v in vals], "k string, v int"), ["k"], "v").first()
    s = sorted(vals)
    assert (r["n"], r["lowest"], r["p50"], r["p90"], r["highest"]) == (11, s[0], s[11 // 2], s[int(11 * 0.9)], s[-1])


def test_invariants_of_reports(spark):
    df = spark.createDataFrame([("a", i % 3 == 0, i % 2 == 0) for i in range(50)], "k string, g boolean, p boolean")
    r = aggregates.polarity(df, {"x": (F.col("g"), F.col("p"))}).first()
    assert r["tp"] + r["fn"] == 17 and r["tp"] + r["fn"] + r["tn"] + r["fp"] == 50
    assert sum(x["pct"] for x in aggregates.share(df, "g").collect()) == pytest.approx(100)
    never = aggregates.polarity(df, {"x": (F.lit(False), F.col("p"))}).first()
    assert never["pos_recall"] is None


def test_flips_and_means(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, True), ("b", 2, True)], "k string, run int, v boolean")
    got = {r["k"]: (r["flips"], r["majority"]) for r in aggregates.flips(df, "k", "run", "v").collect()}
    assert got == {"a": (2, False), "b": (0, True)}
    trials = spark.createDataFrame([("a", [1.0, 0.0]), ("a", None), ("b", [0.5, 1.0]), ("b", [1.0, 1.0])], "k string, s array<double>")
    strict = {(r["k"], r["item"]): r["mean"] for r in aggregates.ensemble_mean(trials, "k", "s").collect()}
    assert strict == {("a", 0): None, ("a", 1): None, ("b", 0): 0.75, ("b", 1): 1.0}
    loose = {(r["k"], r["item"]): r["mean"] for r in aggregates.ensemble_mean(trials, "k", "s", strict=False).collect()}
    assert loose["a", 0] == 1.0


def test_tiny_delta_counts_twice(spark):
    r = aggregates.win_loss(spark.createDataFrame([(1e-12,), (0.5,), (-0.5,), (0.0,)], "delta double")).first()
    assert (r["wins"], r["losses"], r["ties"]) == (2, 1, 2)


def test_allocation_is_bounded():
    given = sampling.allocation({"a": 100, "b": 3, "c": 1}, 20, {"a": 0.5, "b": 0.4})
    assert sum(given.values()) == 20 and given["b"] == 3 and given["c"] == 1
    assert sampling.allocation({"a": 2, "b": 1}, 50, {}) == {"a": 2, "b": 1}
    assert sampling.allocation({}, 5, {}) == {}


def test_samples_and_splits(spark):
    df = spark.range(400).select(F.col("id"), F.element_at(F.array(*map(F.lit, "aabc")), (F.col("id") % 4 + 1).cast("int")).alias("k"))
    taken = sampling.stratified(df, "k", "id", "s", {"a": 7, "b": 3}).collect()
    assert Counter(r["k"] for r in taken) == {"a": 7, "b": 3}
    split = sampling.ratio_split(df, "k", "id", "s", 0.13).collect()
    assert len(split) == 400 and Counter(r["k"] for r in split if r["split"] == "val") == {"a": 26, "b": 13, "c": 13}
    two = sampling.two_samples(df, "k", "id", "s", 30, 20).collect()
    assert len({r["id"] for r in two}) == 50 and Counter(r["split"] for r in two) == {"train": 30, "val": 20}
    again = sampling.two_samples(df.repartition(7), "k", "id", "s", 30, 20).collect()
    assert sorted(map(tuple, two)) == sorted(map(tuple, again))
    u = df.select(sampling.weighted_choice(sampling.unit_interval("s", "id"), [40, 35, 25]).alias("c")).groupBy("c").count().collect()
    assert {r["c"] for r in u} == {0, 1, 2}


def catalogue(spark):
    opts = [("cs", "Computer Science"), ("mba", "Business")]
    rows = [
        ("f", 0, "s", 0, "name", None, "name", "Name", "text", True, 2, 5, None, None, None, None, None, None, None, None, None, None, None, None),
        ("f", 0, "s", 1, "program", None, "program", "Program", "select", True, None, None, None, None, None, None, opts, None, None, None, None, None, None, None),
        ("f", 0, "s", 2, "gpa", "degrees", "degrees.*.gpa", "GPA", "number", False, None, None, 0.0, 4.0, 2, None, None, None, None, None, None, None, None, None),
        ("f", 0, "s", 3, "start", None, "start", "Start", "date", True, None, None, None, None, None, "YYYY-MM-DD", None, None, None, None, None, "program", "equals", ["cs"]),
        ("f", 1, "t", 0, "email", None, "email", "Email", "email", False, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
        ("f", 1, "t", 1, "tags", None, "tags", "Tags", "multi_select", False, None, None, None, None, None, None, opts, 1, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, validation.CATALOGUE)


def checked(spark, values, **switches):
    df = spark.createDataFrame([(1, "f", i, v, "string") for i, v in values.items()], "record_id int, form_id string, field_id string, value string, type string")
    return {r["field_id"]: r["error"] for r in validation.validated(df, catalogue(spark), **switches).collect()}


def test_validation_messages(spark):
    got = checked(spark, {"name": "abcdef", "program": "CS", "degrees.0.gpa": "4.5", "start": "2024-1-1", "email": "a@b", "nope": "x", "tags": "cs,mba"})
    assert got["name"] == "Name must be at most 5 characters." and got["program"] == "Program is not a valid option."
    assert got["degrees.0.gpa"] == "GPA must be at most 4.0." and got["start"] is None  # the condition is unmet
    assert got["email"] == "Email is not a valid email address." and got["nope"] == "Unknown field: nope" and got["tags"] == "Tags allows at most 1 selections."
    got = checked(spark, {"name": "", "program": "cs", "degrees.2.gpa": "3.123", "start": "2024-13", "email": "a@b.co", "tags": "cs"})
    assert got == {"name": "Name is required.", "program": None, "degrees.2.gpa": "GPA allows at most 2 decimal places.", "start": "Start must be in YYYY-MM-DD format.", "email": None, "tags": None}
    got = checked(spark, {"program": "cs", "degrees.2.gpa": "3.123", "start": "2024-13"}, months_are_dates=True, check_decimals=False)
    assert got == {"program": None, "degrees.2.gpa": None, "start": None}


def test_required_and_snapped(spark):
    df = spark.createDataFrame([(1, "f", "program", "computer science", "string"), (1, "f", "name", " ", "string"), (2, "f", "program", "cs", "string")], "record_id int, form_id string, field_id string, value string, type string")
    need = validation.required(df.select("record_id", "form_id").distinct(), df, catalogue(spark)).collect()
    assert sorted((r["record_id"], r["field_id"], r["filled"]) for r in need) == [(1, "name", False), (1, "program", True), (2, "name", False), (2, "program", True), (2, "start", False)]
    snap = {r["record_id"]: (r["snapped"], r["reason"]) for r in validation.snapped(df.where("field_id = 'program'"), catalogue(spark)).collect()}
    assert snap == {1: ("cs", None), 2: ("cs", None)}
    entries = validation.group_entries(spark.createDataFrame([(1, "d.0.x", "1"), (1, "d.4.y", "1"), (1, "d.7.y", "")], "record_id int, field_id string, value string")).first()
    assert (entries["entries"], entries["n_entries"]) == ([0, 4], 5)


def test_conditions_are_strict(spark):
    met = lambda a, t, op, w, wt: spark.range(1).select(validation.condition_met(F.lit(a).cast("string"), F.lit(t), F.lit(op), F.array(*map(F.lit, w)), F.lit(wt)).alias("x")).first()["x"]
    assert met("1", "string", "equals", ["1"], "string") and not met("1", "number", "equals", ["1"], "string")
    assert met("5", "number", "greater_than", ["3"], "number") and not met("5", "string", "greater_than", ["3"], "number")
    assert met(None, "string", "not_in", ["a"], "string") and met("z", "string", "whatever", ["a"], "string")


def test_merges(spark):
    configure(spark)
    docs = [json.dumps(d) for d in ({"a": {"x": 1, "y": [1, 2]}, "b": 1}, {"a": {"y": [3], "z": None}}, {"b": {"c": 2}})]
    df = spark.createDataFrame([("k", i, d) for i, d in enumerate(docs)], "k string, i int, doc string")
    assert json.loads(json_merge.deep_merge(df, "k", "i", "doc").first()["merged"]) == {"a": {"x": 1, "y": [3], "z": None}, "b": {"c": 2}}
    records = spark.createDataFrame([("e", "id1", 1), ("e", "id2", 3), ("e", "id3", 2), ("f", "id4", 1)], "email string, id string, at int")
    assert {r["email"]: (r["id"], r["kept_id"]) for r in merging.upsert(records, "email", "id", "at").collect()} == {"e": ("id2", "id1"), "f": ("id4", "id4")}
    kept, missing = merging.delete(records, spark.createDataFrame([("f",), ("g",)], "email string"), "email")
    assert kept.count() == 3 and [r["email"] for r in missing.collect()] == ["g"]
    swapped = spark.range(1).select(merging.swap_keys(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9"), F.lit("c"), F.lit("8"))).alias("m")).first()["m"]
    assert swapped == {"a": "9", "b": "2"}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(vectors.norm(F.col("a")), vectors.l2(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("b")), vectors.relative_change(F.col("z"), F.col("a")), vectors.cosine(F.col("a"), F.col("z"))).first()
    assert tuple(r) == (5.0, 3.0, 0.8, float("inf"), None)


def test_generation_is_reproducible(spark):
    values = spark.createDataFrame([(i, s, f"f{i}", "v") for i in range(40) for s in ("personal", "extra")], "record_id int, section_id string, field_id string, value string")
    draft = generation.partial_draft(values, "seed", 0.5, ["personal"])
    n = draft.count()
    assert 40 < n < 80 and n == generation.partial_draft(values.repartition(3), "seed", 0.5, ["personal"]).count()
    row = spark.range(1).select(generation.connected(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("c"), generation.option_swap(F.lit("a"), F.array(F.lit("a"), F.lit("b")), F.lit(0.9)).alias("o"), generation.accepted_mutation(F.lit("Abc def"), F.lit(" abc DEF ")).alias("r")).first()
    assert tuple(row) == ("a, b, and c", "b", "unchanged")


def test_answers_of_actions(spark):
    from turnloom.functions.actions import parse_actions
    from turnloom.operators import cases

    body = '---actions--- [{"type":"ask_choice","question":"Q1","options":["a",{"label":"B","value":"b"}]},{"type":"show_fields","section":"Sec","fields":[{"field_id":"f","entry_index":2},{"field_id":"g"}]},{"type":"show_button","button":"submit"},{"type":"ask_choice","question":"Q2"}]'
    a = spark.createDataFrame([(body,)], "b string").select(cases.answer_of(parse_actions(F.col("b"))).alias("a")).first()["a"]
    assert tuple(a["flags"]) == (False, True, True, False, True)
    assert (a["question"], a["options"], a["summary_title"], a["summary_content"]) == ("Q2", ["a", "B"], "Sec", "f[2] | g")


def test_case_rules(spark):
    from turnloom.operators import cases

    ids = spark.createDataFrame([("p1",), ("p1-v2",), ("legacy-3",)], "test_id string")
    assert {w: [r[0] for r in cases.subset(ids, w).collect()] for w in ("seeds", "variations", "legacy")} == {"seeds": ["p1"], "variations": ["p1-v2"], "legacy": ["legacy-3"]}
    configure(spark)
    row = spark.range(1).select(
        cases.applied_delta(F.create_map(F.lit("a"), F.lit("0")), F.array(F.struct(F.lit("d.1.x").alias("field_id"), F.lit("9").alias("value")))).alias("d"),
        cases.sectioned_value(F.array(F.create_map(F.lit("b"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"))), F.lit("a")).alias("v"), cases.warning_completeness(F.lit(1), F.lit(1), F.lit(1)).alias("w"),
        cases.record_score(F.lit("x"), F.lit(False), {"x": F.lit(0.7)}).alias("s"),
    ).first()
    assert (row["d"], row["v"], row["w"], row["s"]) == ({"a": "0", "d-1-x": "9"}, "2", 50, 0.0)
    flags = "struct<has_new_data:boolean,needs_choice:boolean,wants_review:boolean,wants_save:boolean,wants_submit:boolean>"
    kind = f"v struct<test_id:string,source:string,input:string,correct_answer:struct<flags:{flags},field_ids:array<string>,field_values:array<string>>>, seed struct<test_id:string,source:string>"
    full = (True, True, False, False, False)
    rows = [(("s-v1", "src", "i", (full, ["a"], ["1"])), ("s", "src")), (("t", "src", "i", (full, ["a"], ["1"])), ("s", "src")), (("s1", "src", "i", ((None,) * 5, [], [])), ("s", "src")), (("s1", "x", "i", (full, ["a"], [])), ("s", "src"))]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(cases.variation_fault(F.col("v"), F.col("seed"))).collect()]
    assert got == [None, "test_id should start with the seed's", "missing flag 'has_new_data'", "field_ids and field_values length mismatch"]


def test_history_with_hollow_replies_and_leaked_prefixes(spark):
    click = "[system] User clicked: Save"
    rows = [("user", "hello"), ("assistant", " "), ("user", click), ("assistant", "  \n"), ("user", click), ("assistant", " [system] done"), ("user", click), ("assistant", "real"), ("assistant", click + "\n\n rest"), ("assistant", click), ("user", None)]
    df = spark.createDataFrame([([(r, c, k) for k, (r, c) in enumerate(rows)],)], "h array<struct<role:string,content:string,turn:int>>")
    got = df.select(turns.clean_history(F.col("h"), keep=("turn",)).alias("c")).first()["c"]
    assert [(e["turn"], e["content"]) for e in got] == [(0, "hello"), (1, " "), (7, "real"), (8, "rest")]


def test_numbering_without_one_task(spark):
    df = spark.createDataFrame([(k * 37 % 1000, float(k % 7), k % 3) for k in range(1000)], "k int, v double, g int")
    got = scale.numbered(df, F.col("v"), ["k"], "at", ["g"]).collect()
    for g in range(3):
        own = sorted((r["v"], r["k"]) for r in got if r["g"] == g)
        assert [(r["v"], r["k"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["at"])] == own
        assert sorted(r["at"] for r in got if r["g"] == g) == list(range(1, len(own) + 1))
    assert scale.numbered(df.limit(0), F.col("v"), ["k"], "at").collect() == []


def test_typed_events(spark):
    from turnloom.operators import frames

    use = '{"type":"assistant","message":{"content":[{"type":"tool_use","id":"t","name":"%s"}]}}'
    got = '{"type":"user","message":{"content":[{"type":"text"},{"type":"tool_result","tool_use_id":"t","content":"r"}]}}'
    rows = [
        ("a", 1, use % "one"), ("a", 2, got), ("a", 3, use % "two"), ("a", 4, got), ("b", 1, got), ("b", 2, None), ("b", 3, "[1]"), ("b", 4, "{"), ("b", 5, '{"type":"assistant"}'), ("b", 6, '{"type":"stream_event"}'),
        ("b", 7, '{"type":"system","subtype":"x"}'), ("b", 8, '{"type":"user","message":{}}'), (None, 1, '{"type":"result","subtype":"error"}'), (None, 2, "{}"),
    ]
    found = frames.typed_events(spark.createDataFrame(rows, "s string, n int, frame string"), "s", "n")
    told = {(r["session"], r["order"]): (r["kind"], r["label"], r["name"], r["body"]) for r in found.collect()}
    assert told == {
        ("a", 1): ("tool_use", None, "one", None), ("a", 2): ("tool_result", None, "one", "r"), ("a", 3): ("tool_use", None, "two", None), ("a", 4): ("tool_result", None, "two", "r"), ("b", 1): ("tool_result", None, "unknown", "r"),
        ("b", 7): ("raw", "system/x", None, None), ("b", 8): ("user_message", None, None, None), (None, 1): ("result", "error", None, None), (None, 2): ("raw", None, None, None),
    }
    assert frames.typed_events(spark.createDataFrame([], "s string, n int, frame string"), "s", "n").collect() == []


def test_vault_keeps_entries_whose_ids_are_equal(spark):
    """Two owners' entries with one id: ids are the first 32 bits of a hash."""
    from turnloom.operators import persistence

    new = spark.createDataFrame([("26803", "A"), ("116433", "A"), ("116433", "A"), (None, "A")], "owner string, label string").select("owner", "label", F.lit("{}").alias("data"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("saved_at"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    none = spark.createDataFrame([], "entry_id string, owner string, label string, data string, saved_at timestamp, is_profile boolean")
    once = persistence.vault_save(none, new)
    ids = {r["owner"]: r["entry_id"] for r in once.collect()}
    assert once.count() == 3 and ids["26803"] == ids["116433"] == "v_13dbdfc7"
    assert persistence.vault_save(once, new).count() == 3
    other = once.where("owner = '26803'")  # an entry that is there does not keep out another owner's of its id
    assert {r["owner"] for r in persistence.vault_save(other, new).collect()} == {"26803", "116433", None}


def test_frames_are_parsed_once_and_by_all_tasks(spark, sf_dir):
    from turnloom.plans import catalogue

    df = catalogue.queries()["typed_events"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("ParseJson") == 1 or plan.lower().count("parsejson(") == 1, plan[:2000]
    assert plan.count("RepartitionByExpression") == 1  # a small file of customers is one task's otherwise
    assert scale.spread(spark.range(100), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
