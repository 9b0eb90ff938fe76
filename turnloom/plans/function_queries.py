"""Queries over replies built from documents: parsing, routing, rendering and small rules, each beside its statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import actions, replies, scores, text
from ..operators import aggregates, cases, merging, store, validation
from ..operators.scale import numbered
from ..session import table
from ..sources import logs
from .registry import query


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _strings(*values):
    return F.array_compact(F.array(*values))


def _body():
    return F.concat(
        F.lit('[{"type":"set_fields","fields":[{"field_id":"a-'), "lang", F.lit('","value":"'), "source", F.lit('"},{"field_id":"k","value":null},{"field_id":"n","value":'), F.col("n_chars").cast("string"),
        F.lit('},{"field_id":"n","value":"'), "lang", F.lit('"}]},{"type":"ask_choice","options":[{"label":"","value":"'), "lang", F.lit('"},{"label":"L"},"plain",{"label":""}]}]'),
    )


@query("gold_blocks", """
select doc_id, source as a_value, lang as n_value, 2::int as n_values, 'a.' || lang || ',k,n,n' as pair_ids, lang || ',L,plain' as options,
  'set_fields(4) + ask_choice' as summary, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') as prose from documents where lang is not null and source is not null and n_chars is not null and text is not null
""")
def gold_blocks(spark, sf_dir):
    """A reply's fenced array, its values, pairs, options and summary."""
    whole = F.col("lang").isNotNull() & F.col("source").isNotNull() & F.col("n_chars").isNotNull() & F.col("text").isNotNull()
    opening = F.translate("text", "\n", " ")
    reply = F.concat(opening, F.lit("\n\n---actions---\n```json\n"), _body(), F.lit("\n```"))
    r = _docs(spark, sf_dir).where(whole).select("doc_id", reply.alias("r"))
    a = r.select("doc_id", "r", actions.parse_fenced_actions(F.col("r")).alias("a"), actions.gold_values(F.col("r")).alias("v"))
    first = F.element_at(F.map_values(F.map_filter("v", lambda k, _: F.startswith(k, F.lit("a-")))), 1)
    return a.select(
        "doc_id", first.alias("a_value"), F.element_at("v", F.lit("n")).alias("n_value"), F.size("v").alias("n_values"),
        F.array_join(F.transform(actions.pairs(F.col("a")), lambda p: p["field_id"]), ",").alias("pair_ids"), F.array_join(actions.choice_options(F.col("a")), ",").alias("options"),
        actions.summary(F.col("a")).alias("summary"), text.split_prose(F.col("r"))["prose"].alias("prose"),
    )


@query("reply_parts", """
with r as (select doc_id, replace(text, chr(10), ' ') as t, doc_id % 2 = 0 as acts from documents where text is not null)
select doc_id, acts as has_delimiter, case when acts then regexp_replace(t, '^\\s+|\\s+$', '', 'g') else t end as before, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as portion, t as without,
  length(t) > 0 as loose, regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> '' as filled, left(t, 33) as clipped, case when doc_id % 3 = 0 then 'yes' when doc_id % 3 = 1 then 'no' else t end as said from r
""")
def reply_parts(spark, sf_dir):
    """P2, P3, P8, P9, P56, F9, F10, K18."""
    t = F.translate("text", "\n", " ")
    acts = F.col("doc_id") % 2 == 0
    reply = F.when(acts, F.concat(t, F.lit("\n\n---actions---\n[]"))).otherwise(t)
    kind = F.when(F.col("doc_id") % 3 < 2, "boolean").otherwise("text")
    value = F.when(F.col("doc_id") % 3 == 0, "true").when(F.col("doc_id") % 3 == 1, "false").otherwise(t)
    return _docs(spark, sf_dir).where(F.col("text").isNotNull()).select(
        "doc_id", text.has_delimiter(reply).alias("has_delimiter"), text.text_before(reply).alias("before"), text.text_portion(reply).alias("portion"), text.without_actions(reply).alias("without"),
        text.has_value_loose(t).alias("loose"), text.has_value(t).alias("filled"), text.clip(t, 33).alias("clipped"), text.humanise(kind, value).alias("said"),
    )


_SETS = "doc_id % 2 = 0 as s, doc_id % 3 = 0 as c, doc_id % 5 = 0 as p, doc_id % 7 = 0 as b, doc_id % 4 = 0 as submit, doc_id % 13 = 0 as odd"


@query("routes", f"""
with k as (select doc_id, {_SETS} from documents)
select doc_id, s as has_new_data, c as needs_choice, p as wants_review, b and not submit as wants_save, b and submit as wants_submit, case when s then 'data_extractor' when c then 'choice_builder' when p then 'review_builder' else 'text_responder' end as module,
  not odd as known, case when odd then false else s end as tuned_new_data, not submit as tuned_save, submit as tuned_submit from k
""")
def routes(spark, sf_dir):
    """P14, P15, P16, P17, F4."""
    d = F.col("doc_id")
    kinds = _strings(F.when(d % 2 == 0, "set_fields"), F.when(d % 3 == 0, "ask_choice"), F.when(d % 5 == 0, "show_preview"), F.when(d % 7 == 0, "show_button"), F.when(d % 13 == 0, "other"))
    pressed = F.when(d % 4 == 0, "submit").otherwise("save_draft")
    flags = actions.route_flags(kinds, F.array(F.initcap(pressed)))
    tuned = cases.route(F.when(d % 13 == 0, F.array(F.lit("ask_choice"))), kinds, F.array(pressed))
    return _docs(spark, sf_dir).select("doc_id", flags.alias("f"), actions.valid_types(kinds).alias("known"), tuned.alias("t")).select(
        "doc_id", "f.*", actions.content_module(F.col("f")).alias("module"), "known", F.col("t.has_new_data").alias("tuned_new_data"), F.col("t.wants_save").alias("tuned_save"), F.col("t.wants_submit").alias("tuned_submit"),
    )


@query("turn_dispositions", """
with t as (select conv_id, turn, text, turn % 3 as sub, length(text) as n from conversations where text is not null),
m as (select *, case when n % 5 = 0 then '[system] User clicked: Save Draft' else text end as message, case when n % 4 = 0 then '  ' when n % 4 = 1 then ' [system] User clicked: x' else text end as output from t)
select case when sub = 2 then 'drop_sub_turn' when message like '[system] User clicked: %' then 'drop_phantom_click' when regexp_replace(output, '^\\s+', '') like '[system] User clicked:%' then 'rewrite_leaked_prefix'
  when regexp_replace(output, '^\\s+|\\s+$', '', 'g') = '' and not regexp_matches(lower(message), 'submit|save|draft') then 'drop_empty' when regexp_replace(output, '^\\s+|\\s+$', '', 'g') = '' then 'rewrite_empty' else 'keep' end as disposition, count(*)::bigint as n from m group by 1
""")
def turn_dispositions(spark, sf_dir):
    """F2, A7."""
    n = F.length("text")
    message = F.when(n % 5 == 0, "[system] User clicked: Save Draft").otherwise(F.col("text"))
    output = F.when(n % 4 == 0, "  ").when(n % 4 == 1, " [system] User clicked: x").otherwise(F.col("text"))
    t = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    return t.groupBy(actions.disposition(F.when(F.col("turn") % 3 == 2, 1).otherwise(0), message, output).alias("disposition")).agg(F.count("*").alias("n"))


@query("predictions", """
select doc_id, quality = 1 as has_new_data, false as needs_choice, coalesce(toxic = 1, false) as wants_review, lang as question, '' as summary_title, 'a,b' as ids, 0::int as n_options, quality = 1 as again_new_data, lang as again_question
from (select doc_id, coalesce(lang, '') as lang from documents) d join labels using (doc_id) where quality is not null
""")
def predictions(spark, sf_dir):
    """P40, P41."""
    l_ = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull())
    j = _docs(spark, sf_dir).select("doc_id", "lang").join(l_, "doc_id")
    none = F.lit(None).cast("boolean")
    flags = F.struct((F.col("quality") == 1).alias("has_new_data"), none.alias("needs_choice"), (F.col("toxic") == 1).alias("wants_review"), none.alias("wants_save"), none.alias("wants_submit"))
    blank, unlisted = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    rest = F.struct(blank.alias("response_text"), F.col("lang").alias("question"), blank.alias("summary_title"), blank.alias("summary_content"), F.array(F.lit("a"), F.lit("b")).alias("field_ids"), unlisted.alias("field_values"), unlisted.alias("options"))
    flat = j.select("doc_id", replies.flat_prediction(flags, rest).alias("p"))
    return flat.select("doc_id", "p", replies.nested_prediction(F.col("p")).alias("n")).select(
        "doc_id", "p.has_new_data", "p.needs_choice", "p.wants_review", "p.question", "p.summary_title", F.array_join("p.field_ids", ",").alias("ids"), F.size("p.options").alias("n_options"),
        F.col("n.flags.has_new_data").alias("again_new_data"), F.col("n.question").alias("again_question"),
    )


@query("feedback_texts", """
with c as (select doc_id, source, doc_id % 2 = 0 as one, doc_id % 3 = 0 as two from documents where source is not null)
select doc_id, case when one and two then 'Score: ' || printf('%.3f', (doc_id % 100) / 100.0) || chr(10) || 'All checks passed.' else 'Score: ' || printf('%.3f', (doc_id % 100) / 100.0) || chr(10) || 'Failed checks:' || chr(10)
  || concat_ws(chr(10), case when not one then '  [router] f: ' || source end, case when not two then '  [text] g: t' end) || case when one then chr(10) || 'Passed modules: router' when two then chr(10) || 'Passed modules: text' else '' end end as feedback,
  '[{"type":"text"}]' as block, case when contains(lower(source), 'src1') then 'first' when contains(lower(source), 'src') then 'second' end as form,
  '  A (text, required)' || chr(10) || '  B (select): ' || source || ', y' as schema_text, case when doc_id % 2 = 0 then source || ' tail' else 'plain' end as completion from c
""")
def feedback_texts(spark, sf_dir):
    """P31, P42, P58, P62, X24."""
    d = F.col("doc_id")
    check = lambda module, name, passed, detail: F.struct(F.lit(module).alias("module"), F.lit(name).alias("name"), passed.alias("passed"), detail.alias("detail"))
    checks = F.array(check("router", "f", d % 2 == 0, F.col("source")), check("text", "g", d % 3 == 0, F.lit("t")))
    field = lambda label, kind, required, options: F.struct(F.lit("s").alias("section"), F.lit(label).alias("label"), F.lit(kind).alias("type"), F.lit(required).alias("required"), options.cast("array<string>").alias("options"))
    schema = F.array(field("A", "text", True, F.array()), field("B", "select", False, F.array(F.col("source"), F.lit("y"), F.lit("z"))))
    message = F.when(d % 2 == 0, F.concat(F.lit('[{"content":[{"text":"'), "source", F.lit('"},{"text":"tail"}]}]'))).otherwise("plain")
    return _docs(spark, sf_dir).where(F.col("source").isNotNull()).select(
        "doc_id", replies.feedback((d % 100) / 100.0, checks).alias("feedback"), F.to_json(F.transform(replies.typed_blocks(F.col("source")), lambda b: F.struct(b["type"].alias("type")))).alias("block"),
        replies.detected_form(F.array(F.col("source"), F.lit("x")), {"SRC1": "first", "src": "second"}).alias("form"), replies.rendered_schema(schema, 2).alias("schema_text"), replies.message_text(message).alias("completion"),
    )


@query("file_checks", """
with f as (select doc_id, case when doc_id % 3 = 0 then 'a.PDF' when doc_id % 3 = 1 then 'b.exe' else 'c.png' end as name, n_chars from documents where n_chars is not null)
select doc_id, case when doc_id % 7 = 0 then 'unknown field' when name = 'b.exe' then 'file type not accepted' when n_chars * 1000 > 2097152 then 'file too large' end as error, doc_id <= 40 as expired from f
""")
def file_checks(spark, sf_dir):
    """V21, F20."""
    d = F.col("doc_id")
    name = F.when(d % 3 == 0, "a.PDF").when(d % 3 == 1, "b.exe").otherwise("c.png")
    known = F.when(d % 7 != 0, F.struct(F.lit("file").alias("type")))
    error = validation.file_error(known, name, F.col("n_chars") * 1000, F.array(F.lit(".pdf"), F.lit(".png")), F.lit(2))
    return _docs(spark, sf_dir).where(F.col("n_chars").isNotNull()).select("doc_id", error.alias("error"), store.expired(d, F.lit(40)).alias("expired"))


@query("vault", """
with v as (select o_custkey, o_orderkey, o_orderpriority, o_orderkey % 2 as src from orders)
select o_custkey, count(*)::bigint as n, string_agg('- ' || o_orderpriority, chr(10) order by '- ' || o_orderpriority) as lines, count(distinct src)::bigint as n_sources, count(*) >= 2 and count(distinct src) = 1 as mergeable, max(o_orderkey)::bigint as active_key, 1::bigint as n_active from v group by 1
""")
def vault(spark, sf_dir):
    """Entries of a key summed up, which may merge, and one active profile each."""
    entries = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 2).alias("src"))
    chosen = entries.groupBy("o_custkey").agg(F.max("o_orderkey").alias("top"))
    active = merging.activate(entries.join(chosen, "o_custkey"), "o_orderkey", F.col("top")).where("is_profile").groupBy("o_custkey").agg(F.max("o_orderkey").alias("active_key"), F.count("*").alias("n_active"))
    return store.vault_summary(entries, "o_custkey", "o_orderpriority").join(merging.mergeable(entries, "o_custkey", "src").drop("n"), "o_custkey").join(active, "o_custkey")


@query("vault_delete", """
select 'kept' as part, count(*)::bigint as n, sum(c_custkey)::bigint as keys from customer where c_custkey % 3 <> 0 union all select 'not found', count(*)::bigint, sum(c_custkey)::bigint from (select c_custkey + 1000000 as c_custkey from customer where c_custkey % 10 = 0)
""")
def vault_delete(spark, sf_dir):
    """What stays after a delete by ids, and the ids that were not there."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    wanted = c.where(F.col("c_custkey") % 3 == 0).unionByName(c.where(F.col("c_custkey") % 10 == 0).select((F.col("c_custkey") + 1_000_000).alias("c_custkey")))
    kept, missing = merging.delete(c, wanted, "c_custkey")
    total = lambda df, name: df.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys")).select(F.lit(name).alias("part"), "n", "keys")
    return total(kept, "kept").unionByName(total(missing, "not found"))


@query("owners", """
select c_custkey, lower(trim(c_name)) as owner, case when c_custkey % 2 = 0 then 'swapped' else c_mktsegment end as segment, c_mktsegment || ',x' as both_lists, true as same_bag, (case when c_custkey % 4 = 0 then 0 else 1 end)::double as silent from customer
""")
def owners(spark, sf_dir):
    """U5, U7, U12, U17, M3."""
    key = F.col("c_custkey")
    sections = F.array(F.create_map(F.lit("other"), F.lit("q")), F.create_map(F.lit("email"), F.lit("")), F.create_map(F.lit("email"), F.concat(F.lit(" "), "c_name", F.lit(" "))))
    mapping = F.when(key % 2 == 0, F.create_map(F.lit("seg"), F.lit("swapped"))).otherwise(F.create_map(F.lit("none"), F.lit("z")))
    swapped = merging.swap_keys(F.create_map(F.lit("seg"), F.col("c_mktsegment")), mapping)
    lists = F.array(F.array("c_mktsegment", F.lit("x")), F.array(F.lit("x"), F.col("c_mktsegment")))
    bag = scores.same_multiset(F.array("c_name", F.lit("b"), F.lit("b")), F.array(F.lit("b"), F.col("c_name"), F.lit("b")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", store.owner_key(sections).alias("owner"), F.element_at(swapped, F.lit("seg")).alias("segment"), F.array_join(merging.join_distinct(lists), ",").alias("both_lists"), bag.alias("same_bag"),
        scores.abstained(F.when(key % 4 == 0, "said"), F.lit("")).alias("silent"),
    )


@query("call_progress", """
select l_linestatus, count(*)::bigint as n_done, count(*) filter (where l_returnflag = 'R')::bigint as n_errors, round((1 - count(*) filter (where l_returnflag = 'R') / count(*)::double) * 100, 4) as success_pct, round(sum(l_quantity)::double / count(*), 6) as per_call,
  round((1000000 - count(*)) * (sum(l_quantity)::double / count(*)), 4) as eta_seconds, round(count(*) * 0.25, 6)::double as cost from lineitem group by 1
""")
def call_progress(spark, sf_dir):
    """A50 with quantities for seconds."""
    calls = table(spark, sf_dir, "lineitem").withColumn("seconds", F.col("l_quantity").cast("double"))
    return aggregates.throughput(calls, ["l_linestatus"], F.col("l_returnflag") != "R", "seconds", 1_000_000, 0.25)


@query("score_log", """
select place::int as idx, 'd' || doc_id as id, round(quality * 0.5, 1)::double as score from (select doc_id, coalesce(quality, 0) as quality, row_number() over (order by doc_id) - 1 as place from labels)
""")
def score_log(spark, sf_dir):
    """A log of scores, a run that restarts at 0 and a later one after a gap; the restarted run is read."""
    l_ = table(spark, sf_dir, "labels").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"))
    placed = numbered(l_, F.col("doc_id"), [], "place").withColumn("place", F.col("place") - 1)
    line = lambda idx: F.concat(F.lit("  [ "), idx.cast("string"), F.lit("] d"), F.col("doc_id").cast("string"), F.lit(" score="), F.round(F.col("quality") * 0.5, 1).cast("string"))
    first = placed.where(F.col("place") < 3).select((F.col("place") - 10).cast("long").alias("n"), line(F.col("place")).alias("value"))
    noise = placed.where(F.col("place") % 5 == 0).select((F.col("place") * 2 + 1).cast("long").alias("n"), F.lit("noise score=0.1").alias("value"))
    run = placed.select((F.col("place") * 2).cast("long").alias("n"), line(F.col("place")).alias("value"))
    after = placed.where(F.col("place") < 4).select((F.col("place") + 10**9).cast("long").alias("n"), line(F.col("place") * 2 + 10**6).alias("value"))
    return logs.scraped_scores(first.unionByName(noise).unionByName(run).unionByName(after), "n")


@query("step_times", "select round(sum(l_quantity)::double, 4) as total, round(avg(l_quantity)::double, 6) as mean from lineitem")
def step_times(spark, sf_dir):
    """A34."""
    return cases.step_time(table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), "q")
