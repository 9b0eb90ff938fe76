"""Column functions on literal rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from turnloom.functions import actions, ids, markers, scores, text, values
from turnloom.session import configure


def one(spark, column, **columns):
    row = spark.createDataFrame([tuple(columns.values()) or (0,)], [*columns] or ["_"]) if not any(v is None for v in columns.values()) else spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return row.select(column.alias("x")).first()["x"]


def reply(block):
    return f"Sure.\n\n{text.DELIMITER}\n{block}"


FIELDS = '[{"type":"set_fields","fields":[{"field_id":"a-0-b","value":"1"},{"field_id":""},{"field_id":"c","value":true}]},{"type":"ask_choice","options":["x",{"label":"L","value":"v"},{"value":"w"}," "]},{"type":7},"text"]'


@pytest.mark.parametrize(("body", "types"), [
    (reply(f"```json\n{FIELDS}\n```"), ["set_fields", "ask_choice"]), (reply(FIELDS), ["set_fields", "ask_choice"]), (reply('```\n{"type":"show_button"}\n```'), ["show_button"]),
    (reply("{broken"), []), ("no delimiter " + FIELDS, []), (reply('{"kind":"x"}'), []), (reply("[1, 2]"), []), (reply("null"), []),
])
def test_parse_actions(spark, body, types):
    assert one(spark, actions.types(actions.parse_actions(F.col("b"))), b=body) == types


def test_action_details(spark):
    a = actions.parse_actions(F.col("b"))
    body = reply(FIELDS)
    assert one(spark, actions.fields_set(a), b=body) == ["a-0-b", "c"]
    assert one(spark, actions.choice_options(a), b=body) == ["x", "L", "w", " "]
    assert [(p["field_id"], p["value"]) for p in one(spark, actions.pairs(a), b=body)][:1] == [("a.0.b", "1")]
    assert one(spark, actions.summary(a), b=body) == "set_fields(3) + ask_choice"
    assert one(spark, F.size(actions.parse_fenced_actions(F.col("b"))), b=body) == 0
    assert one(spark, F.size(actions.parse_fenced_actions(F.col("b"))), b=reply(f"```json\n{FIELDS}\n```")) == 4


def test_categories_in_order(spark):
    def category(turn, acts, message, n, kinds):
        return one(spark, actions.category(F.lit(turn), F.lit(acts), F.lit(message), F.lit(n), F.array(*map(F.lit, kinds))))

    assert category(0, True, "", 5, ["set_fields"]) == "greeting"
    assert category(1, False, "[File: x]", 5, ["set_fields"]) == "question_no_actions"
    assert category(1, True, "[system] User selected option A [File: x]", 5, ["set_fields"]) == "choice_selection"
    assert category(1, True, "[File: x]", 5, ["set_fields"]) == "file_handling"
    assert category(1, True, "", 3, ["set_fields"]) == "multi_field"
    assert category(1, True, "", 2, ["set_fields", "ask_choice"]) == "other"
    assert category(1, True, "", 0, ["ask_choice"]) == "ask_choice_only"
    assert category(1, True, "", 0, ["show_button"]) == "submit_flow"


def test_buttons_and_dispositions(spark):
    b = actions.button(F.col("m"), F.col("o"))
    assert one(spark, b, m="please save", o="  [system] User clicked: Submit now") == "submit"
    assert one(spark, b, m="Submit it, do not save", o="") == "submit"
    assert one(spark, b, m="my draft", o="") == "save_draft"
    assert one(spark, b, m="hello", o="") is None
    d = lambda sub, m, o: one(spark, actions.disposition(F.lit(sub), F.col("m"), F.col("o")), m=m, o=o)
    assert [d(1, "", "x"), d(0, "[system] User clicked: Save", "x"), d(0, "a", "\n[system] User clicked: Save"), d(0, "hi", " \n"), d(0, "save", ""), d(0, "a", "b")] == ["drop_sub_turn", "drop_phantom_click", "rewrite_leaked_prefix", "drop_empty", "rewrite_empty", "keep"]


def test_text_around_the_delimiter(spark):
    body = " Hi \n\n---actions---\n[1]"
    assert one(spark, text.text_before(F.col("b")), b=body) == "Hi"
    assert one(spark, text.text_before(F.col("b")), b=" Hi ") == " Hi "
    assert one(spark, text.text_portion(F.col("b")), b=" Hi ") == "Hi"
    assert one(spark, text.without_actions(F.col("b")), b=body) == " Hi "
    both = one(spark, text.split_prose(F.col("b")), b="a ---actions---\n```json\n[1]\n``` b")
    assert (both["prose"], both["block"]) == ("a  b", "[1]")
    assert one(spark, text.slug(F.col("b")), b="  Fall & Spring -- 2027! ") == "fall-spring-2027"
    assert [one(spark, text.has_value(F.col("b")), b=v) for v in ("x", "\n ", "")] == [True, False, False]


MARKED = "[[ ## field_ids ## ]]\n[\"a\", \"b.0.c\"]\n\n[[ ## field_values ## ]]\n['1', 'x, y', plain]\n\n[[ ## completed ## ]]"


def test_markers(spark):
    m = F.col("m")
    assert one(spark, markers.names(m), m=MARKED) == ["field_ids", "field_values", "completed"]
    assert one(spark, markers.value(m, "field_ids"), m=MARKED) == '["a", "b.0.c"]'
    assert one(spark, markers.value(m, "nothing"), m=MARKED) is None
    lists = one(spark, markers.two_lists(m), m=MARKED)
    assert (lists["ids"], lists["vals"], lists["done"]) == (["a", "b.0.c"], ["1", "'x", "y'", "plain"], True)
    assert one(spark, markers.text_list(m), m=" ") == [] and one(spark, markers.text_list(m), m="words") is None
    assert [one(spark, markers.format_reward(m), m=x) for x in (MARKED, MARKED.replace("plain", "a, b").replace("'1', ", ""), "[[ ## field_ids ## ]]")] == [1.0, 1.0, 0.0]
    report = one(spark, markers.report(m, F.array(F.lit("field_ids"), F.lit("summary"))), m=MARKED)
    assert (report["missing"], report["extra"], report["format_ok"]) == (["summary"], ["field_values"], False)
    configure(spark)
    assert one(spark, markers.all_values(m), m="[[ ## a ## ]] 1 [[ ## a ## ]] 2")["a"] == "2"


def test_ids(spark):
    c = F.col("c")
    assert one(spark, ids.starred(c), c="degrees.0.gpa") == "degrees.*.gpa"
    assert one(spark, ids.dotted_to_dashed(c), c="degrees.0.gpa") == "degrees-0-gpa"
    assert tuple(one(spark, ids.group_parts(c), c="jobs-12-title")) == ("jobs", 12, "title")
    assert one(spark, ids.group_parts(c), c="name") is None
    assert one(spark, ids.in_catalogue(c, F.array(F.lit("degrees.*.gpa"))), c="degrees.3.gpa")


@pytest.mark.parametrize(("raw", "want"), [("3.50", "3.5"), (" True ", "true"), ("7.0", "7"), ("1e3", "1000"), ("ABC d", "abc d"), ("0.1234567", "0.123457"), ("1234567.5", "1.23457e+06"), ("0.00001", "1e-05"), ("nan", "nan"), ("Infinity", "infinity"), ("-0.5", "-0.5"), ("", "")])
def test_normalised_values(spark, raw, want):
    assert one(spark, values.normalised(F.col("v")), v=raw) == want


def test_three_equalities_differ(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, values.equal(a, b), a="3.1415926", b="3.1415927")
    assert not one(spark, values.loosely_equal(a, b), a="3.1415926", b="3.1415927")
    assert one(spark, values.loosely_equal(a, b), a="3.0", b="3") and not one(spark, values.exactly_equal(a, b), a="3.0", b="3")
    assert one(spark, values.loosely_equal(a, b, F.lit(True)), a="true", b="false")  # any non-empty text is true
    assert one(spark, values.coerced(F.lit("boolean"), a), a=" Yes") == "true"
    assert one(spark, values.coerced(F.lit("multi_select"), a), a="['x', 'y']") == "x,y"
    assert one(spark, values.coerced(F.lit("number"), a), a="about 3") == "about 3"


def arrays(*xs):
    return [F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in xs]


@pytest.mark.parametrize(("gold", "pred", "router", "report", "reward"), [
    ("ab", "ab", 1.0, 1.0, 1.0), ("ab", "bc", 0.5, 0.5, 0.5), ("", "", 1.0, 1.0, 1.0), ("", "a", 0.0, 0.0, 0.0), ("a", "", 0.0, 0.0, 0.0),
])
def test_set_scores(spark, gold, pred, router, report, reward):
    g, p = arrays(gold, pred)
    assert one(spark, scores.router_f1(g, p)) == router
    assert one(spark, scores.report_metrics(g, p)["f1"]) == report
    assert one(spark, scores.reward_metrics(g, p)["f1"]) == reward


def test_recall_on_empty_gold_differs(spark):
    g, p = arrays("", "a")
    assert one(spark, scores.report_metrics(g, p)["recall"]) == 1.0 and one(spark, scores.reward_metrics(g, p)["recall"]) == 0.0


def test_value_scores(spark):
    m = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), F.lit(v))))
    none = F.create_map().cast("map<string,string>")
    assert one(spark, scores.extractor_score(m(a="1.0", b="x"), m(a="1", b="y"))) == pytest.approx(0.8)
    assert one(spark, scores.extractor_score(m(a="1"), none)) == 0.0 and one(spark, scores.extractor_score(none, none)) == 1.0
    assert one(spark, scores.accuracy_reward(m(a="1", b="x"), m(a="1", b="X"))) == pytest.approx(2.25)
    assert one(spark, scores.accuracy_reward(none, none)) == 1.5 and one(spark, scores.accuracy_reward(none, m(a="1"))) == 0.0
    assert [one(spark, scores.hallucination_penalty(*arrays(p, v))) for p, v in (("xxab", "ab"), ("xxxxxx", "ab"), ("", "ab"), ("x", ""))] == [-1.0, -2.0, 0.0, 0.0]


def test_composite_of_gold_is_full_marks(spark):
    full = {m: F.lit(1.0) for m in scores.WEIGHTS}
    assert one(spark, scores.composite(full)) == pytest.approx(1.0)
    assert one(spark, scores.composite({"action_router": F.lit(0.0), "text_responder": F.lit(1.0), "data_extractor": F.lit(None).cast("double")})) == pytest.approx(0.55 / 0.75)
    items = F.array(F.struct(F.lit(0.0).alias("weight"), F.lit(1.0).alias("score")))
    assert one(spark, scores.rubric_score(items)) == 0.0
    assert one(spark, scores.abstained(F.lit(""), F.lit(None).cast("string"))) == 1.0 and one(spark, scores.abstained(F.lit("q"))) == 0.0
    assert one(spark, scores.coverage(F.array(F.lit("first_name"), F.lit("gpa")), F.lit("First name: x"))) == 0.5


@pytest.mark.parametrize(("value", "message", "want"), [
    ("true", "anything", True), ("['a']", "anything", True), ("Jane Smith", "smith, jane here", True), ("Jane Smith", "jane", False), ("1995-11-20", "November 20, 1995", True),
    ("1995-11-20", "November", False), ("42", "I am 42", True), ("long words " * 6 + "river", "only long matter here", True), ("qqqq " * 12, "none of these", False),
])
def test_grounding(spark, value, message, want):
    assert one(spark, scores.grounded(F.col("v"), F.col("m"), F.lit(None).cast("array<string>")), v=value, m=message) is want


def test_json_round_trip_of_composed_reply(spark):
    body = json.dumps([{"type": "show_button", "button": "save"}])
    composed = actions.compose(F.lit("ok"), F.col("b"))
    assert one(spark, actions.types(actions.parse_fenced_actions(composed)), b=body) == ["show_button"]
