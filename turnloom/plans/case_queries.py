"""Queries over evaluation cases, their rubrics and their runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.actions import parse_actions
from ..operators import cases
from ..session import table
from .registry import query

_KINDS_SQL = "list_filter([case when doc_id % 2 = 0 then 'set_fields' end, case when doc_id % 3 = 0 then 'ask_choice' end, case when doc_id % 5 = 0 then 'show_preview' end, case when doc_id % 11 = 0 then 'show_button' end], lambda x: x is not null)"


def _kinds():
    d = F.col("doc_id")
    return F.array_compact(F.array(F.when(d % 2 == 0, "set_fields"), F.when(d % 3 == 0, "ask_choice"), F.when(d % 5 == 0, "show_preview"), F.when(d % 11 == 0, "show_button")))


@query("intents", """
with i as (select case when doc_id % 11 = 0 then 'close' when doc_id % 5 = 0 and doc_id % 2 <> 0 and doc_id % 3 <> 0 then 'review' when doc_id % 2 = 0 then 'gather' when doc_id % 3 = 0 then 'clarify' else 'converse' end as intent from documents)
select intent, count(*)::bigint as n, (2 + case intent when 'gather' then 2 when 'close' then 2 when 'clarify' then 1 when 'review' then 1 else 0 end)::int as n_modules from i group by intent
""")
def intents(spark, sf_dir):
    """P18, P19."""
    i = table(spark, sf_dir, "documents").select(cases.intent(_kinds()).alias("intent"))
    return i.groupBy("intent").agg(F.count("*").alias("n")).withColumn("n_modules", F.size(cases.modules_of(F.col("intent"))))


@query("action_type_counts", f"""
select coalesce(kind, '(none)') as kind, count(*)::bigint as n from (select unnest(case when len(k) = 0 then [null] else k end) as kind from (select {_KINDS_SQL} as k from documents)) group by 1
""")
def action_type_counts(spark, sf_dir):
    """A2."""
    return cases.type_counts(table(spark, sf_dir, "documents").select(_kinds().alias("k")), "k")


@query("answers", """
select doc_id, true as has_new_data, doc_id % 2 = 0 as wants_review, 'a,' || lang as field_ids, '1,' as field_values, case when doc_id % 2 = 0 then 'T: L: ' || source else '' end as summary_content, case when doc_id % 2 = 0 then 'Title' else '' end as summary_title from documents
""")
def answers(spark, sf_dir):
    """Replies parsed into answers."""
    fields = F.concat(F.lit('{"type":"set_fields","fields":[{"field_id":"a","value":1},{"field_id":"'), "lang", F.lit('"}]}'))
    shown = F.concat(F.lit(',{"type":"show_preview","title":"Title","sections":[{"title":"T","fields":[{"label":"L","value":"'), "source", F.lit('"}]}]}'))
    reply = F.concat(F.lit("x ---actions--- ["), fields, F.when(F.col("doc_id") % 2 == 0, shown).otherwise(""), F.lit("]"))
    a = table(spark, sf_dir, "documents").select("doc_id", parse_actions(reply).alias("p")).select("doc_id", cases.answer_of(F.col("p")).alias("a"))
    return a.select("doc_id", "a.flags.has_new_data", "a.flags.wants_review", F.array_join("a.field_ids", ",").alias("field_ids"), F.array_join("a.field_values", ",").alias("field_values"), "a.summary_content", "a.summary_title")


@query("rubrics", """
with i as (select doc_id, 'u1' as item_id, 1.0 as weight from documents union all select doc_id, 'u2', 2.0 from documents union all select doc_id, 'junk', 3.0 from documents join labels using (doc_id) where quality = 0 union all select doc_id, 'rude', 4.0 from documents join labels using (doc_id) where toxic = 1)
select doc_id::varchar as test_id, count(*)::bigint as n_items, sum(weight)::double as total from i group by 1
""")
def rubrics(spark, sf_dir):
    """Universal items and those of a case's tags."""
    l_ = table(spark, sf_dir, "labels").select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 0, "junk"), F.when(F.col("toxic") == 1, "rude"))).alias("cannot_targets"))
    c = table(spark, sf_dir, "documents").select("doc_id").join(l_, "doc_id", "left").select(F.col("doc_id").cast("string").alias("test_id"), "cannot_targets")
    universal = spark.createDataFrame([("u1", 1.0), ("u2", 2.0)], "item_id string, weight double")
    by_tag = spark.createDataFrame([("junk", "junk", 3.0), ("rude", "rude", 4.0)], "tag string, item_id string, weight double")
    return cases.rubric_for(c, universal, by_tag).groupBy("test_id").agg(F.count("*").alias("n_items"), F.sum("weight").alias("total"))


@query("judge_spread", """
with p as (select user_id % 20 as grp, dayofyear(ts) % 3 as trial, event_type as item, max(value) - min(value) as spread, avg(value) as mean from events group by 1, 2, 3),
w as (select grp, round(avg(widest), 6) as within_spread from (select grp, trial, max(spread) as widest from p group by 1, 2) group by 1), s as (select grp, round(max(sd), 6) as max_item_sd from (select grp, item, coalesce(stddev_samp(mean), 0) as sd from p group by 1, 2) group by 1)
select grp, within_spread, max_item_sd from w join s using (grp)
""")
def judge_spread(spark, sf_dir):
    """A28."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("grp"), (F.dayofyear("ts") % 3).alias("trial"), F.col("event_type").alias("item"), "value")
    return cases.spread_stats(e, "grp", "trial", "item", "value")


@query("rubric_breakdown", """
with b as (select event_type as item, avg(value) as base from events where user_id % 2 = 0 group by 1), c as (select event_type as item, avg(value) as cand from events where user_id % 2 = 1 group by 1)
select item, length(item)::double as weight, round(base, 6) as base, round(cand, 6) as cand, round(cand - base, 6) as delta from b join c using (item)
""")
def rubric_breakdown(spark, sf_dir):
    """M25."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("item"), F.col("value").alias("score"))
    weights = e.select("item").distinct().withColumn("weight", F.length("item").cast("double"))
    return cases.rubric_breakdown(e.where(F.col("user_id") % 2 == 0), e.where(F.col("user_id") % 2 == 1), weights)


@query("module_summary", """
select lang as module, count(*)::bigint as n, coalesce(round(avg(quality), 6), 0.0)::double as quality, coalesce(round(avg(toxic), 6), 0.0)::double as toxic from documents left join labels using (doc_id) group by 1
""")
def module_summary(spark, sf_dir):
    """A13, A14, A19."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("module")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return cases.module_summary(d, "module", ["quality", "toxic"])


@query("split_by_gold", """
select count(*) filter (where doc_id % 3 > 0)::bigint as n_pos, count(*) filter (where doc_id % 3 = 0)::bigint as n_neg, round(avg(n_chars) filter (where doc_id % 3 > 0), 6) as pos_mean, round(avg(n_chars) filter (where doc_id % 3 = 0), 6) as neg_mean from documents
""")
def split_by_gold(spark, sf_dir):
    """A15."""
    return cases.by_gold(table(spark, sf_dir, "documents"), F.col("doc_id") % 3, "n_chars")


@query("baseline_order", """
with a as (select o_orderkey, row_number() over (order by o_orderkey) as place from orders), b as (select o_orderkey, row_number() over (order by o_custkey % 2, o_orderkey) as place from orders)
select bool_and(a.o_orderkey = b.o_orderkey) as same, count(*)::bigint as n from a join b using (place)
""")
def baseline_order(spark, sf_dir):
    """Stored ids against current ones in order."""
    o = table(spark, sf_dir, "orders")
    moved = o.withColumn("place", F.col("o_custkey") % 2 * F.lit(10**12) + F.col("o_orderkey"))
    return cases.same_order(o.withColumn("place", F.col("o_orderkey")), moved, "o_orderkey", "place")


@query("review_join", """
with i as (select doc_id, quality as isolation from labels), c as (select doc_id, toxic as cascade from labels where quality = 1)
select d.doc_id, isolation, "cascade" from documents d left join i using (doc_id) left join c using (doc_id)
""".replace("as cascade", 'as "cascade"'))
def review_join(spark, sf_dir):
    """J10."""
    l_ = table(spark, sf_dir, "labels")
    return cases.reviewed(table(spark, sf_dir, "documents").select("doc_id"), l_.select("doc_id", F.col("quality").alias("v")), l_.where(F.col("quality") == 1).select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query("active_pairs", """
select d.doc_id, d.n_chars from documents d semi join (select doc_id from labels where quality = 1 and toxic = 0) l using (doc_id)
""")
def active_pairs(spark, sf_dir):
    """J9, F19."""
    active = cases.data_active(F.col("quality") == 1, F.when(F.col("toxic") == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return cases.picked(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id", active)


@query("group_errors", """
with g as (select l_orderkey as record_id, count(*) as n from lineitem group by 1)
select record_id, 'items' as field_id, case when n < 2 then 'At least 2 Items required.' else 'At most 6 Items allowed.' end as error from g where n < 2 or n > 6
union all select l_orderkey, 'items[' || (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, case when l_returnflag <> 'R' then l_returnflag end nulls first) - 1) || '].flag', 'flag is required.' from lineitem qualify l_returnflag = 'R'
""")
def group_errors(spark, sf_dir):
    """V18, V19."""
    li = table(spark, sf_dir, "lineitem")
    sortable = F.struct("l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("f"))
    groups = li.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.transform(F.array_sort(F.collect_list(sortable)), lambda e: F.create_map(F.lit("flag"), e["f"])).alias("entries")).withColumn("group_id", F.lit("items"))
    return cases.group_errors(groups, 2, 6, "Items")


@query("identical_sample", """
select doc_id from documents where doc_id % 4 = 0 order by md5(concat_ws('|', 'k16', doc_id::varchar)), doc_id limit 25
""")
def identical_sample(spark, sf_dir):
    """The sample is the feature."""
    return cases.sample_of(table(spark, sf_dir, "documents"), F.col("doc_id") % 4 == 0, "doc_id", "k16", 25).select("doc_id")


@query("phrases_on_bases", """
with b as (select n_name, row_number() over (order by n_name) - 1 as slot from nation), p as (select doc_id, floor((('0x' || substring(md5(concat_ws('|', 'k17', doc_id::varchar)), 1, 13))::bigint)::double / 4503599627370496.0 * 25)::int as slot from documents)
select doc_id, n_name from p join b using (slot)
""")
def phrases_on_bases(spark, sf_dir):
    """A base row for each document, with replacement."""
    return cases.with_base(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "nation").select("n_name"), "doc_id", "k17")


@query("profiles", """
with u as (select doc_id, (('0x' || substring(md5(concat_ws('|', 'p/colour', doc_id::varchar)), 1, 13))::bigint)::double / 4503599627370496.0 as a, (('0x' || substring(md5(concat_ws('|', 'p/size', doc_id::varchar)), 1, 13))::bigint)::double / 4503599627370496.0 as b from documents)
select doc_id, ['red', 'green', 'blue'][floor(a * 3)::int + 1] as colour, ['s', 'l'][floor(b * 2)::int + 1] as size from u
""")
def profiles(spark, sf_dir):
    """G9, G10, G12."""
    return cases.profiles(table(spark, sf_dir, "documents"), "doc_id", "p", {"colour": ["red", "green", "blue"], "size": ["s", "l"]})
