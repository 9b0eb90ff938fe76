"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, turns
from ..session import table
from .registry import query

LENGTH_SQL = "case when chars = 0 then 'empty' when chars <= 300 then 'short' when chars <= 900 then 'medium' else 'long' end"


def _length_class(chars):
    return F.when(chars == 0, "empty").when(chars <= 300, "short").when(chars <= 900, "medium").otherwise("long")


@query("turn_context", f"""
with h as (
  select conv_id, turn, role, coalesce(sum(length(left(text, 300))) over w, 0) as chars, count(text) over w as n_before,
         last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as user_text
  from conversations window w as (partition by conv_id order by turn rows between 6 preceding and 1 preceding))
, c as (select {LENGTH_SQL} as category, n_before, length(user_text) as n_user from h where role = 'assistant')
select category, count(*)::bigint as n, round(100.0 * count(*) / sum(count(*)) over (), 4)::double as pct, round(avg(n_before), 6) as avg_before, round(avg(n_user), 6) as avg_user_chars from c group by category
""")
def turn_context(spark, sf_dir):
    """Length classes of assistant turns by the six messages before them."""
    df = turns.history(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role", "text", most=6, clip=300, skip_blank=False)
    df = turns.state_as_of(df.withColumn("said", F.when(F.col("role") == "user", F.col("text"))), "conv_id", ["turn"], "said", "user_text").where(F.col("role") == "assistant")
    filled = F.filter("history", lambda e: e["content"].isNotNull())
    chars = F.aggregate(filled, F.lit(0), lambda s, e: s + F.length(e["content"]))
    df = df.select(_length_class(chars).alias("category"), F.size(filled).alias("n_before"), F.length("user_text").alias("n_user"))
    out = df.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("n_before"), 6).alias("avg_before"), F.round(F.avg("n_user"), 6).alias("avg_user_chars"))
    total = F.sum("n").over(turns.W.partitionBy())
    return out.select("category", "n", F.round(100.0 * F.col("n") / total, 4).alias("pct"), "avg_before", "avg_user_chars")


@query("turn_pairs", """
with u as (select conv_id, text, row_number() over (partition by conv_id order by turn) - 1 as k from conversations where role = 'user'),
a as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) - 1 as k from conversations where role = 'assistant')
select a.conv_id, a.turn, a.k::int as ordinal, a.text as reply, coalesce(u.text, f.text) as user_message
from a left join u on a.conv_id = u.conv_id and a.k = u.k left join u f on a.conv_id = f.conv_id and f.k = 0
""")
def turn_pairs(spark, sf_dir):
    """Replies with the user message at the same place, else the conversation's first."""
    df = table(spark, sf_dir, "conversations")
    said = turns.with_ordinal(df.where(F.col("role") == "user"), ["conv_id"], "turn").withColumnRenamed("text", "user_message")
    replies = turns.with_ordinal(df.where(F.col("role") == "assistant"), ["conv_id"], "turn").withColumnRenamed("text", "reply")
    return turns.pair_by_ordinal(replies.select("conv_id", "turn", "ordinal", "reply"), said, ["conv_id"], "user_message")


@query("history_tail", """
select conv_id, turn, coalesce(string_agg(role || ': ' || left(text, 300), chr(10) order by turn) , '') as context from (
  select c.conv_id, c.turn, h.role, h.text, h.turn as ht, row_number() over (partition by c.conv_id, c.turn order by h.turn desc) as back
  from conversations c left join conversations h on h.conv_id = c.conv_id and h.turn < c.turn where c.role = 'assistant') t
where back <= 6 group by conv_id, turn
""".replace("order by turn) ,", "order by ht),"))
def history_tail(spark, sf_dir):
    """The last six messages before each reply as lines."""
    df = turns.history(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role", "text", most=6, clip=300, skip_blank=False)
    return df.where(F.col("role") == "assistant").select("conv_id", "turn", turns.render_history(F.col("history")).alias("context"))


@query("history_clean", """
with m as (select *, lag(role = 'user' and text like 'Th%') over (partition by conv_id order by turn) as after_fake from conversations),
k as (select conv_id, turn, role = 'assistant' and text like 'Th%' as leaked, text from m where not (role = 'user' and text like 'Th%')
  and not (role = 'assistant' and (regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' or regexp_replace(text, '^\\s+', '') like '[system]%') and coalesce(after_fake, false))),
c as (select conv_id, turn, leaked, case when leaked then regexp_replace(regexp_extract(regexp_replace(text, '^\\s+', ''), '(?s)^.*?\\n\\n(.*)$', 1), '^\\s+', '') else text end as content from k)
select conv_id, count(*)::bigint as n_kept, string_agg(turn::varchar, ',' order by turn) as turns, sum(length(content))::bigint as chars from c where not leaked or content <> '' group by conv_id
""")
def history_clean(spark, sf_dir):
    """Histories without phantom user messages (here: a literal opening) and their hollow replies."""
    df = table(spark, sf_dir, "conversations")
    whole = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h"))
    cleaned = whole.select("conv_id", turns.clean_history(F.col("h"), "^Th", ("turn",)).alias("c")).where(F.size("c") > 0)
    chars = F.aggregate("c", F.lit(0).cast("long"), lambda n, e: n + F.length(e["content"]))
    return cleaned.select("conv_id", F.size("c").cast("long").alias("n_kept"), F.array_join(F.transform("c", lambda e: e["turn"].cast("string")), ",").alias("turns"), chars.alias("chars"))


@query("session_quality", """
select c.conv_id, c.turn, c.role from conversations c semi join (
  select conv_id from conversations group by conv_id having count(*) >= 5 and count(*) filter (where role = 'assistant') >= 2 and bool_or(role = 'user' and turn <= 1)) g using (conv_id)
""")
def session_quality(spark, sf_dir):
    """Turns of conversations that are long enough and begin with a user."""
    good = (F.count("*") >= 5) & (F.count_if(F.col("role") == "assistant") >= 2) & F.bool_or((F.col("role") == "user") & (F.col("turn") <= 1))
    return turns.sessions_where(table(spark, sf_dir, "conversations"), "conv_id", good).select("conv_id", "turn", "role")


@query("category_share", """
select role, count(*)::bigint as n, round(100.0 * count(*) / sum(count(*)) over (), 4)::double as pct from conversations group by role
""")
def category_share(spark, sf_dir):
    return aggregates.share(table(spark, sf_dir, "conversations"), "role")


@query("history_depth", """
select case when d = 0 then '0' when d <= 5 then '1-5' when d <= 15 then '6-15' else '16+' end as bucket, count(*)::bigint as n
from (select row_number() over (partition by conv_id order by turn) - 1 as d from conversations) group by 1
""")
def history_depth(spark, sf_dir):
    """A5."""
    d = turns.with_ordinal(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")
    bucket = F.when(F.col("ordinal") == 0, "0").when(F.col("ordinal") <= 5, "1-5").when(F.col("ordinal") <= 15, "6-15").otherwise("16+")
    return d.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("turn_categories", """
with t as (select conv_id, turn, text, length(text) % 5 as n_fields, length(text) % 3 = 0 as choice, length(text) % 7 <> 0 as acts from conversations where role = 'assistant')
select case when turn = 0 then 'greeting' when not acts then 'question_no_actions' when contains(text, '[system] User selected option') then 'choice_selection' when contains(text, '[File:') then 'file_handling'
  when n_fields >= 3 then 'multi_field' when n_fields = 1 then 'single_field' when choice and n_fields = 0 then 'ask_choice_only' when n_fields = 2 then 'submit_flow' else 'other' end as category,
  count(*)::bigint as n, round(avg(case when acts then 1.0 else 0.0 end), 6)::double as acting from t group by 1
""")
def turn_categories(spark, sf_dir):
    """P11 and A6 on turns whose actions are derived from their lengths."""
    from ..functions import actions

    n = F.length("text")
    kinds = F.array_compact(F.array(F.when(n % 5 != 0, "set_fields"), F.when(n % 3 == 0, "ask_choice"), F.when(n % 5 == 2, "show_button")))
    kinds = F.when((n % 5 == 2), F.array(F.lit("set_fields"), F.lit("show_button"))).otherwise(kinds)
    t = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant").withColumn("acts", n % 7 != 0)
    t = t.withColumn("category", actions.category(F.col("turn"), F.col("acts"), F.col("text"), n % 5, kinds))
    return t.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(F.col("acts").cast("int").cast("double")), 6).alias("acting"))


@query("jump_backfill", """
with s as (select conv_id, turn, role, length(text) % 25 as size from conversations),
j as (select conv_id, min(turn) as jump_at from s where size >= 10 group by conv_id), jj as (select j.conv_id, j.jump_at, s.size as jump_size from j join s on s.conv_id = j.conv_id and s.turn = j.jump_at)
select s.conv_id, s.turn, (case when role = 'assistant' and size < 3 and s.turn < jump_at then jump_size else size end)::int as state, (role = 'assistant' and size < 3 and s.turn < jump_at) is true as backfilled
from s left join jj using (conv_id) where not (role = 'assistant' and size < 3 and jump_at is null)
""")
def jump_backfill(spark, sf_dir):
    """W4 with the text's length modulo 25 for the size of the state."""
    s = table(spark, sf_dir, "conversations").withColumn("size", (F.length("text") % 25)).withColumn("state", F.col("size"))
    out = turns.backfill_from_jump(s, "conv_id", ["turn"], "size", "state", (F.col("role") == "assistant") & (F.col("size") < 3))
    return out.select("conv_id", "turn", F.col("state").cast("int").alias("state"), F.coalesce("backfilled", F.lit(False)).alias("backfilled"))


@query("pending_carry", """
select conv_id, turn, length(lag(text) over (partition by conv_id order by turn))::int as carried from conversations
""")
def pending_carry(spark, sf_dir):
    """W8."""
    return turns.carried(table(spark, sf_dir, "conversations").withColumn("n", F.length("text")), "conv_id", "turn", "n").select("conv_id", "turn", "carried")


@query("reply_groups", """
with r as (select conv_id, turn, text, sum((role = 'user')::int) over (partition by conv_id order by turn) as run from conversations)
select conv_id, run::bigint as run, count(*)::bigint as n_messages, sum(length(text))::bigint as chars from r group by all
""")
def reply_groups(spark, sf_dir):
    """Each user message with what follows it."""
    r = turns.reply_groups(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return r.groupBy("conv_id", "run").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("chars"))


@query("session_totals", """
select conv_id, sum(length(text)) filter (where role = 'assistant')::bigint as reply_chars, sum(length(text)) filter (where role = 'user')::bigint as user_chars, max(turn)::bigint as last_turn from conversations group by conv_id
""")
def session_totals(spark, sf_dir):
    """A47 with characters for cost."""
    side = lambda r: F.sum(F.when(F.col("role") == r, F.length("text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(side("assistant").alias("reply_chars"), side("user").alias("user_chars"), F.max("turn").alias("last_turn"))


@query("test_ids", """
with c as (select conv_id, turn, role as category from conversations)
select category || '_' || (row_number() over (order by category, conv_id, turn) - 1) as test_id, conv_id, turn from c
""")
def test_ids(spark, sf_dir):
    """W9. The running number is the count before a category and conversation plus the place in it."""
    df = table(spark, sf_dir, "conversations").withColumnRenamed("role", "category")
    sizes = df.groupBy("category", "conv_id").agg(F.count("*").alias("n"))
    # categories are few; a category's conversations are cut into parts of a thousand ids for their running sums
    parts = sizes.groupBy("category", F.floor(F.col("conv_id") / 1000).alias("part")).agg(F.sum("n").alias("n"))
    upto = lambda *order: turns.W.orderBy(*order).rowsBetween(turns.W.unboundedPreceding, -1)
    whole = parts.groupBy("category").agg(F.sum("n").alias("n")).select("category", F.coalesce(F.sum("n").over(upto("category")), F.lit(0)).alias("first"))
    parts = parts.select("category", "part", F.coalesce(F.sum("n").over(upto("part").partitionBy("category")), F.lit(0)).alias("second"))
    third = F.coalesce(F.sum("n").over(upto("conv_id").partitionBy("category", "part")), F.lit(0))
    starts = sizes.withColumn("part", F.floor(F.col("conv_id") / 1000)).withColumn("third", third).drop("n").join(parts, ["category", "part"]).join(whole, "category")
    placed = df.join(starts.select("category", "conv_id", (F.col("first") + F.col("second") + F.col("third")).alias("start")), ["category", "conv_id"])
    at = F.col("start") + F.row_number().over(turns.W.partitionBy("category", "conv_id").orderBy("turn")) - 1
    return placed.select(F.concat_ws("_", "category", at.cast("string")).alias("test_id"), "conv_id", "turn")


@query("rendered_frames", """
select conv_id, turn, 'event: ' || role || chr(10) || 'data: {"turn":' || turn || '}' || chr(10) || chr(10) as frame from conversations
""")
def rendered_frames(spark, sf_dir):
    """S9."""
    from ..sources.text_formats import sse_frame

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sse_frame(F.col("role"), F.to_json(F.struct("turn"))).alias("frame"))


@query("parsed_frames", """
select conv_id, count(*)::bigint as n_frames, count(*) filter (where role = 'user')::bigint as n_user, sum(turn)::bigint as turn_sum from conversations group by conv_id
""")
def parsed_frames(spark, sf_dir):
    """Each conversation written as frames and read back."""
    from ..sources.text_formats import sse_events, sse_frame

    written = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: sse_frame(x["role"], F.concat(F.lit('{"turn":'), x["turn"].cast("string"), F.lit("}")))), "").alias("body"))
    read = sse_events(written, "body").withColumn("turn", F.get_json_object("data", "$.turn").cast("long"))
    return read.groupBy("conv_id").agg(F.count("*").alias("n_frames"), F.count_if(F.col("event") == "user").alias("n_user"), F.sum("turn").alias("turn_sum"))
