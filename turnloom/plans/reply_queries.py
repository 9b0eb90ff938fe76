"""Queries over replies that are composed, judged and graded, and over progress and stored records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import module_scores, replies
from ..operators import generation, progress, sampling, store, validation
from ..session import table
from .record_queries import _catalogue, _values
from .registry import query


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _prediction():
    d = F.col("doc_id")
    return F.struct(
        (d % 2 == 0).alias("has_new_data"), (d % 3 == 0).alias("needs_choice"), (d % 5 == 0).alias("wants_review"), (d % 7 == 0).alias("wants_save"), F.lit(False).alias("wants_submit"), F.concat(F.lit(" "), "lang", F.lit("\n")).alias("response_text"),
        F.array(F.lit("a"), F.lit(""), "source").alias("field_ids"), F.array("lang").alias("field_values"), F.when(d % 6 == 0, "Which?").otherwise(" ").alias("question"), F.array(F.lit("x"), F.lit("")).alias("options"),
        F.lit("").alias("summary_title"), F.when(d % 10 == 0, F.col("source")).otherwise("").alias("summary_content"),
    )


@query("composed_replies", """
with p as (select doc_id, list_filter([
  case when doc_id % 2 = 0 then '{"type":"set_fields","fields":[{"field_id":"a","value":"' || lang || '"},{"field_id":"' || source || '","value":""}]}' end,
  case when doc_id % 6 = 0 then '{"type":"ask_choice","question":"Which?","options":[{"label":"x","value":"x"}]}' end,
  case when doc_id % 10 = 0 then '{"type":"show_preview","title":"Application Progress","summary":"' || source || '"}' end,
  case when doc_id % 7 = 0 then '{"type":"show_button","button":"save_draft"}' end], lambda x: x is not null) as a, lang from documents)
select doc_id, len(a)::int as n_actions, case when len(a) = 0 then lang else lang || chr(10) || chr(10) || '---actions---' || chr(10) || '```json' || chr(10) || '[' || array_to_string(a, ', ') || ']' || chr(10) || '```' end as reply from p
""")
def composed_replies(spark, sf_dir):
    """P45-P48."""
    p = _prediction()
    return _docs(spark, sf_dir).select("doc_id", F.size(replies.composed_actions(p)).alias("n_actions"), replies.full_response(p).alias("reply"))


@query("judge_answers", """
select doc_id, case when doc_id % 4 < 2 then doc_id % 2 = 0 end as first_yes, case when doc_id % 4 = 3 then (doc_id % 10) / 10 end::double as first_score from documents
""")
def judge_answers(spark, sf_dir):
    """Fenced and bare lists; a bad length or range is null, never a default."""
    k = F.col("doc_id") % 4
    yes = F.when(k == 0, '["Yes", "no"]').when(k == 1, '```json\n["no", "YES"]\n```').when(k == 2, '["yes"]').otherwise("yes, no")
    num = F.when(k == 3, F.concat(F.lit("["), (F.col("doc_id") % 10 / 10).cast("string"), F.lit(", 1.0]"))).when(k == 2, "[0.5, 1.5]").otherwise("[0.5]")
    return _docs(spark, sf_dir).select("doc_id", F.get(replies.yes_no_answers(yes, F.lit(2)), F.lit(0)).alias("first_yes"), F.get(replies.score_answers(num, F.lit(2)), F.lit(0)).alias("first_score"))


@query("prediction_diff", """
select doc_id, (doc_id % 3 = 0)::int + (n_chars % 2 = 0)::int as n_diffs from documents
""")
def prediction_diff(spark, sf_dir):
    """P61, M22, M23."""
    a = F.struct(F.lit("q").alias("question"), F.col("lang").alias("title"), F.lit("t").alias("response_text"))
    b = F.struct(F.when(F.col("doc_id") % 3 == 0, "other").otherwise("q").alias("question"), F.when(F.col("n_chars") % 2 == 0, F.concat("lang", F.lit("!"))).otherwise(F.col("lang")).alias("title"), F.lit("t").alias("response_text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(replies.differences(a, b, ["question", "title"])).alias("n_diffs"))


@query("legacy_scores", """
select doc_id, (case when length(trim(lang)) > 10 or doc_id % 2 = 0 then 0.25 else 0 end + case when (doc_id % 2 = 0) = (doc_id % 3 = 0) then 0.25 else 0 end + case when doc_id % 2 = 0 or doc_id % 3 <> 0 then 0.25 else 0 end + case when doc_id % 2 = 0 or doc_id % 3 <> 0 then 0.25 else 0 end)::double as score from documents
""")
def legacy_scores(spark, sf_dir):
    """M17 on replies with and without actions."""
    from ..functions import actions

    reply = F.when(F.col("doc_id") % 2 == 0, actions.compose(F.col("lang"), F.lit('[{"type":"show_button"}]'))).otherwise(F.col("lang"))
    df = _docs(spark, sf_dir).select("doc_id", reply.alias("r"), (F.col("doc_id") % 3 == 0).alias("wants"))
    kinds = actions.types(actions.parse_actions(F.col("r")))
    return df.select("doc_id", module_scores.legacy_score(F.col("r"), kinds, F.size(kinds) > 0, F.col("wants"), F.col("wants"), actions.ACTION_TYPES).alias("score"))


@query("tuning_scores", """
with s as (select doc_id, (3 + (doc_id % 2 = 0)::int + 1) / 5 as route, doc_id % 3 = 0 as wants, n_chars from documents)
select doc_id, round(0.30 * (case when doc_id % 2 = 0 then 1.0 else 0.8 end) + 0.15 * (case when n_chars > 100 then 1.0 else 0.3 end) + 0.25 * (2.0 / 3) + 0.15 * (case when not wants then 1.0 else 0.75 end) + 0.15, 6)::double as score from s
""")
def tuning_scores(spark, sf_dir):
    """M18, M19."""
    d = F.col("doc_id")
    wants = d % 3 == 0
    gold = F.struct((d % 2 == 0).alias("has_new_data"), wants.alias("needs_choice"), F.lit(False).alias("wants_review"), F.lit(False).alias("wants_save"), F.lit(False).alias("wants_submit"), F.array(F.lit("a"), F.lit("b")).alias("field_ids"))
    pred = F.struct(
        F.lit(True).alias("has_new_data"), wants.alias("needs_choice"), F.lit(False).alias("wants_review"), F.lit(False).alias("wants_save"), F.lit(False).alias("wants_submit"), F.array(F.lit("a")).alias("field_ids"),
        F.when(F.col("n_chars") > 100, F.repeat(F.lit("t"), F.lit(30))).otherwise("t").alias("response_text"), F.lit("Why?").alias("question"), F.array(F.lit("x"), F.lit("y")).alias("options"), F.lit("").alias("summary_title"), F.lit("").alias("summary_content"),
    )
    return _docs(spark, sf_dir).select("doc_id", F.round(module_scores.tuning_score(gold, pred), 6).alias("score"))


@query("module_format", """
select doc_id, doc_id % 2 = 0 as format_ok, (doc_id % 2 = 0 and n_chars > 1000) as content_ok, case when doc_id % 2 = 0 and n_chars > 1000 then 'pass' when doc_id % 2 <> 0 and n_chars <= 1000 then 'fail' else 'partial' end as grade from documents
""")
def module_format(spark, sf_dir):
    """M12, M24, P26."""
    from ..functions import markers

    body = F.concat(F.lit("[[ ## summary_title ## ]] Title [[ ## summary_content ## ]] "), F.when(F.col("n_chars") > 1000, F.repeat(F.lit("c"), F.lit(40))).otherwise("c"), F.when(F.col("doc_id") % 2 == 0, " [[ ## completed ## ]]").otherwise(""))
    df = _docs(spark, sf_dir).select("doc_id", "n_chars", markers.all_values(body).alias("m"))
    s = module_scores.review_score(F.col("m"))
    return df.select("doc_id", s["format_ok"].alias("format_ok"), s["content_ok"].alias("content_ok"), module_scores.graded({"f": s["format_ok"], "n": F.col("n_chars") > 1000}).alias("grade"))


@query("plan_fold", """
select conv_id, len(list_filter(case when stop_at is null then l else l[1:stop_at] end, lambda x: x = 'user'))::int as n_messages, stop_at is not null as stopped
from (select conv_id, list(role order by turn) as l, list_position(list(role order by turn), 'system') as stop_at from conversations group by conv_id)
""".replace("l[1:stop_at]", "l[1:stop_at - 1]"))
def plan_fold(spark, sf_dir):
    """users' turns are messages, a system turn stops the plan."""
    step = F.when(F.col("role") == "user", "message").when(F.col("role") == "system", "stop").otherwise("fill_fields")
    plans = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", step.alias("action"), F.lit("m").alias("text")))), lambda x: F.struct(x["action"].alias("action"), x["text"].alias("text"))).alias("plan"))
    folded = plans.select("conv_id", replies.folded_plan(F.col("plan")).alias("f"))
    return folded.select("conv_id", F.size("f.messages").alias("n_messages"), "f.stopped")


@query("user_messages", """
select conv_id, turn, case when role = 'user' and turn % 2 = 0 then '[File: f.txt]' || chr(10) || 'body' || chr(10) || '[End of f.txt]' || chr(10) || chr(10) || text when role = 'user' then text when role = 'assistant' then '[system] User selected option: "' || role || '"' end as message from conversations
""")
def user_messages(spark, sf_dir):
    """P51, P53."""
    action = F.when(F.col("role") == "user", "message").when(F.col("role") == "assistant", "select_choice").otherwise("stop")
    file_name = F.when(F.col("turn") % 2 == 0, "f.txt")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", replies.user_message(action, F.col("text"), file_name, F.lit("body"), F.col("role")).alias("message"))


@query("section_progress", """
with r as (select c_custkey as record_id, 3 + (c_mktsegment = 'BUILDING')::int as required, 2 + (c_acctbal >= 0)::int + (c_mktsegment = 'BUILDING')::int as filled from customer)
select record_id, filled::bigint as filled, required::bigint as required, 'main: ' || filled || '/' || required as sections, (filled >= required)::bigint as n_complete, 1::bigint as n_sections, round(100.0 * filled / required)::int as percent from r
""")
def section_progress(spark, sf_dir):
    """A42, A44, A46."""
    values = _values(spark, sf_dir)
    return progress.state_summary(progress.section_progress(validation.required(values.select("record_id", "form_id").distinct(), values, _catalogue(spark))))


@query("previews", """
select c_custkey as record_id, (3 + (c_acctbal >= 0)::int)::int as n_shown, case c_mktsegment when 'BUILDING' then 'Building' when 'MACHINERY' then 'Machinery' when 'HOUSEHOLD' then 'Household' else c_mktsegment end as segment from customer
""")
def previews(spark, sf_dir):
    """P55, X18."""
    shown = progress.preview(_values(spark, sf_dir), _catalogue(spark))
    return shown.select("record_id", F.size("fields").alias("n_shown"), F.get(F.filter("fields", lambda f: f["label"] == "Segment"), F.lit(0))["value"].alias("segment"))


@query("nudges", """
with t as (select o_orderkey, o_orderkey % 30 as turn, o_totalprice > 150000 as no_file, (o_orderkey % 101)::int as pct, o_orderkey % 4 as done from orders)
select o_orderkey, case when turn < 2 then null when turn >= 3 and no_file and (turn = 3 or turn % 5 = 0) then 'upload_files' when done > 0 and done < 3 and pct > 20 and pct < 90 then 'review_section' when turn >= 8 and turn % 8 = 0 and pct between 30 and 80 then 'show_progress' end as nudge from t
""")
def nudges(spark, sf_dir):
    """P50."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", progress.nudge(k % 30, F.col("o_totalprice") > 150000, (k % 101).cast("int"), k % 4, F.lit(3)).alias("nudge"))


@query("rule_warnings", """
select c_custkey as record_id, 'r1' as rule_id, 'c_acctbal' as then_field, 'balance needed' as message from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal < 0
""")
def rule_warnings(spark, sf_dir):
    """Conditional requirements as rows."""
    rules = spark.createDataFrame([("r1", "c_mktsegment", ["BUILDING", "MACHINERY"], "c_acctbal", "balance needed")], "rule_id string, if_field string, if_values array<string>, then_field string, message string")
    return progress.conditional_requirements(_values(spark, sf_dir), rules)


@query("submission_gate", """
with l as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders), e as (select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by 1)
select l.o_custkey, o_orderkey as draft_id, coalesce(n, 0)::bigint as n_errors, case when n > 0 then 'rejected' else 'accepted' end as status, upper(substring(md5(concat_ws('|', l.o_custkey::varchar, o_orderkey::varchar)), 1, 8)) as ref_number from l left join e on l.o_custkey = e.o_custkey where rn = 1
""")
def submission_gate(spark, sf_dir):
    """V22, V23, X4, X5."""
    o = table(spark, sf_dir, "orders")
    drafts = o.select("o_custkey", F.col("o_orderkey").alias("draft_id"), F.col("o_orderdate").alias("updated_at"))
    out = store.submissions(drafts, o.where(F.col("o_orderstatus") == "P"), "o_custkey")
    return out.select("o_custkey", "draft_id", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "status", "ref_number")


@query("record_lookup", """
select k.o_custkey, count(o.o_orderkey)::bigint as n, bool_or(o.o_orderkey is not null) as found from (select c_custkey as o_custkey from customer) k left join orders o using (o_custkey) group by 1
""")
def record_lookup(spark, sf_dir):
    """J17, X6-X8, X17."""
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return store.lookup(wanted, table(spark, sf_dir, "orders"), "o_custkey").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.bool_or("found").alias("found"))


@query("turn_log", """
select event_id, round(sum(value) over w, 4) as cost_so_far, count(*) filter (where event_type = 'purchase') over w as changes_so_far from events window w as (partition by user_id order by event_id rows unbounded preceding)
""")
def turn_log(spark, sf_dir):
    """A47, X22."""
    e = table(spark, sf_dir, "events").withColumn("delta", F.when(F.col("event_type") == "purchase", F.col("value")))
    return store.turn_log(e, "user_id", "event_id", "delta", "value").select("event_id", F.round("cost_so_far", 4).alias("cost_so_far"), "changes_so_far")


@query("quota_plan", """
with c as (select source, count(*) filter (where lang = 'en') as n_file, count(*) filter (where lang <> 'en') as n_other from documents group by source), q as (select source, least(n_other, 15) as synthetic, least(n_file, 8) as file from c)
select source, synthetic::bigint as synthetic, file::bigint as file, (50 - synthetic - file)::bigint as "natural" from q
""")
def quota_plan(spark, sf_dir):
    """50 rows, 30 percent synthetic, a quarter of the rest from files."""
    c = _docs(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("n_file"), F.count_if(F.col("lang") != "en").alias("n_other"))
    q = c.select("source", sampling.quota(F.col("n_file"), F.col("n_other"), 50, 0.3).alias("q"))
    return q.select("source", *(F.col(f"q.{n}").cast("long").alias(n) for n in ("synthetic", "file", "natural")))
