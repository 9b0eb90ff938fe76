"""Queries of stored drafts, submissions, vault entries, captures and allocations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import loosely_equal
from ..operators import cases, generation, persistence, progress, sampling
from ..session import table
from .event_queries import _folder
from .registry import query


def _requests(spark, sf_dir):
    """A request per order: the customer's email, the priority as the form; some lack something."""
    o = table(spark, sf_dir, "orders")
    email = F.when(F.col("o_orderkey") % 32 != 7, F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@x.org")))
    form = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).otherwise("")
    return o.select(F.col("o_orderkey").alias("request_id"), email.alias("email"), form.alias("form_id"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("data"), F.col("o_orderdate").cast("timestamp").alias("at"))


_REQUESTS = """r as (select o_orderkey as request_id, case when o_orderkey % 32 <> 7 then 'c' || o_custkey || '@x.org' end as email, case when o_orderstatus <> 'P' then o_orderpriority else '' end as form_id, '{"status":"' || o_orderstatus || '"}' as data, o_orderdate::timestamp as at_ from orders),
g as (select * from r where email is not null and form_id <> '')"""


@query("saved_drafts", f"""
with {_REQUESTS}, old as (select 'c' || c_custkey || '@x.org' as email, 'draft_old' || c_custkey as draft_id, c_mktsegment as form_id, null::varchar as data, null::timestamp as updated_at from customer where c_custkey % 2 = 0),
f as (select email, 'draft_' || substring(md5(email || '|' || request_id), 1, 8) as new_id from (select *, row_number() over (partition by email order by at_, request_id) as rn from g) where rn = 1),
l as (select email, form_id, data, at_ from (select *, row_number() over (partition by email order by at_ desc, request_id desc) as rn from g) where rn = 1)
select coalesce(old.email, l.email) as email, coalesce(old.draft_id, f.new_id) as draft_id, coalesce(l.form_id, old.form_id) as form_id, l.data, l.at_ as updated_at from old full join l on old.email = l.email left join f on f.email = l.email
""")
def saved_drafts(spark, sf_dir):
    """Drafts after all requests; half of the customers had one before."""
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 2 == 0)
    key = F.col("c_custkey").cast("string")
    old = c.select(F.concat(F.lit("c"), key, F.lit("@x.org")).alias("email"), F.concat(F.lit("draft_old"), key).alias("draft_id"), F.col("c_mktsegment").alias("form_id"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("timestamp").alias("updated_at"))
    return persistence.save_drafts(old, _requests(spark, sf_dir))[0]


@query("saved_submissions", f"""
with {_REQUESTS} select r.request_id, case when g.request_id is null then 'email, form_id, and data are required' end as error, case when g.request_id is not null then 'sub_' || substring(md5(g.email || '|' || g.request_id), 1, 8) end as submission_id,
  case when g.request_id is not null then 'APP-2024-' || lpad(((('0x' || substring(md5(g.email || '|' || g.request_id), 9, 6))::bigint) % 100000)::varchar, 5, '0') end as ref_number from r left join g using (request_id)
""")
def saved_submissions(spark, sf_dir):
    """What each request for a submission is answered."""
    return persistence.save_submissions(_requests(spark, sf_dir), 2024)[1]


def _entries(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    doc = F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("priority")).alias("last"), F.create_map(F.col("o_orderstatus"), F.col("o_orderkey")).alias("seen")))
    return o.select(F.concat(F.lit("v_"), F.col("o_orderkey").cast("string")).alias("entry_id"), F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderpriority").alias("label"), doc.alias("data"), F.col("o_orderdate").cast("timestamp").alias("saved_at"), F.lit(False).alias("is_profile"))


@query("vault_saved", """
with e as (select 'v_' || o_orderkey as entry_id, o_custkey::varchar as owner from orders),
n as (select distinct 'v_' || substring(md5(concat_ws('|', c_custkey::varchar, c_mktsegment, '2024-01-01 00:00:00')), 1, 8) as entry_id, c_custkey::varchar as owner from customer)
select owner, count(*)::bigint as n, min(entry_id) as first_id from (select * from e union all select * from n) group by owner
""")
def vault_saved(spark, sf_dir):
    """Entries after each customer saved one, twice."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("owner"), F.col("c_mktsegment").alias("label"), F.lit("{}").alias("data"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("saved_at"))
    once = persistence.vault_save(_entries(spark, sf_dir), c.unionByName(c))
    return persistence.vault_save(once, c).groupBy("owner").agg(F.count("*").alias("n"), F.min("entry_id").alias("first_id"))


@query("vault_merged", """
with o as (select o_custkey, o_orderkey, o_orderstatus, case when o_orderkey % 2 = 0 then o_orderpriority end as pr, row_number() over (partition by o_custkey order by o_orderkey) as k from orders), t as (select * from o where k <= 3),
s as (select o_custkey, string_agg('"' || o_orderstatus || '":' || k2, ',' order by o_orderstatus) as seen from (select o_custkey, o_orderstatus, max(o_orderkey) as k2 from t group by all) group by 1),
l as (select o_custkey, count(*)::bigint as n, arg_max(o_orderstatus, k) as st, arg_max(pr, k) filter (where pr is not null) as pr from t group by 1)
select o_custkey as request_id, case when n >= 2 then o_custkey::varchar end as owner, case when n >= 2 then '{"last":{' || case when pr is not null then '"priority":"' || pr || '",' else '' end || '"status":"' || st || '"},"seen":{' || seen || '}}' end as merged, n as n_entries,
  case when n < 2 then 'at least two entries are needed' end as error from l join s using (o_custkey)
""")
def vault_merged(spark, sf_dir):
    """Each owner's first three entries merged into one document."""
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), F.concat(F.lit("v_"), F.col("o_orderkey").cast("string")).alias("entry_id"), place.alias("place")).where("place <= 3")
    return persistence.vault_merge(_entries(spark, sf_dir), asked)


@query("call_statistics", "select l_orderkey, count(*)::bigint as n, round(avg(l_quantity::double), 4) as mean, round(stddev_samp(l_quantity::double), 4) as sd from lineitem where l_returnflag <> 'R' group by 1")
def call_statistics(spark, sf_dir):
    """Each order as an item, its lines of a flag as the calls of a trial."""
    q = F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("double"))
    trials = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.collect_list(q).alias("scores"))
    return persistence.item_statistics(trials, "l_orderkey", "scores", 4)


@query("captured_output", "select doc_id, md5(text) as expected from documents where doc_id % 2 = 0")
def captured_output(spark, sf_dir):
    """The first capture stays, a second one of other rows is refused, and the expected output is read back."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("expected"))
    folder = _folder(spark, "anchors")
    path = persistence.capture(spark, d.where(F.col("doc_id") % 2 == 0), folder, "a1")
    try:
        persistence.capture(spark, d, folder, "a1")
    except FileExistsError:
        return spark.read.schema("doc_id long, expected string").json(path)
    raise AssertionError("a capture was overwritten")


@query("baseline_scores", """
with u as (select doc_id, lang, md5(concat_ws('|', 'base', doc_id::varchar)) as h, (length(text) % 101)::double / 100 as score from documents),
r as (select *, row_number() over (partition by lang order by h, doc_id) as k from u)
select lang, count(*)::bigint as n, round(avg(score), 6) as baseline from r where k <= 20 group by lang
""")
def baseline_scores(spark, sf_dir):
    """The average score of the same split that every run takes."""
    d = table(spark, sf_dir, "documents").withColumn("score", (F.length("text") % 101).cast("double") / 100)
    split = sampling.ranked(d.select("doc_id", "lang", "score"), ["lang"], "base", "doc_id").where(F.col("rank") <= 20)
    return split.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("baseline"))


_WEIGHTS = {"src00": 0.4, "src01": 0.3, "src03": 0.1, "other": 0.2}


@query("allocated_strata", """
with s as (select source, count(*)::bigint as size from documents group by 1), w as (select source, size, case source when 'src00' then 0.4 when 'src01' then 0.3 when 'src03' then 0.1 else 0.05 end::double as w from s),
c as (select *, least(greatest(1, round_even(w / sum(w) over () * 150, 0)::bigint), size) as cap from w), u as (select *, sum(cap) over (order by source) as upto from c),
o as (select *, (least(upto, 150) - least(upto - cap, 150))::bigint as own from u),
tokens as (select source, size, unnest(generate_series(1, size - own)) as pass from o where size > own),
more as (select source, count(*) as n from (select source, row_number() over (order by pass, size desc, source) as k from tokens) where k <= 150 - (select sum(own) from o) group by 1)
select source, size, (own + coalesce(n, 0))::bigint as given from o left join more using (source)
""")
def allocated_strata(spark, sf_dir):
    """K7: 150 documents from the sources, by weights."""
    return persistence.allocated(table(spark, sf_dir, "documents"), "source", 150, _WEIGHTS)


@query("loose_matches", """
select o_orderkey, lower(trim(o_orderpriority)) = lower(trim(substring(o_clerk_like, 1))) or coalesce(try_cast(o_orderpriority as double) = try_cast(o_clerk_like as double), false) as same from (select *, case o_orderkey % 4 when 0 then upper(o_orderpriority) || ' ' when 1 then 'x' when 2 then o_orderpriority else '5' end as o_clerk_like from orders)
""")
def loose_matches(spark, sf_dir):
    """Priorities against texts that differ in case and spaces only, or more."""
    other = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.upper("o_orderpriority"), F.lit(" "))).when(F.col("o_orderkey") % 4 == 1, "x").when(F.col("o_orderkey") % 4 == 2, F.col("o_orderpriority")).otherwise("5")
    return table(spark, sf_dir, "orders").select("o_orderkey", loosely_equal(F.col("o_orderpriority"), other).alias("same"))


@query("connected_clauses", """
with p as (select o_custkey, list(o_orderpriority order by o_orderkey) as l from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) where k <= 4 group by 1)
select o_custkey, case len(l) when 1 then l[1] when 2 then l[1] || ' and ' || l[2] else array_to_string(l[:-2], ', ') || ', and ' || l[-1] end as message from p
""")
def connected_clauses(spark, sf_dir):
    """A customer's first priorities in one sentence."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).where("k <= 4")
    parts = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("p"))
    return parts.select("o_custkey", generation.connected(F.col("p")).alias("message"))


@query("swapped_options", """
with u as (select c_custkey, c_mktsegment, (('0x' || substring(md5(concat_ws('|', 'g11', c_custkey::varchar)), 1, 13))::bigint)::double / 4503599627370496.0 as u from customer)
select c_custkey, list_filter(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], lambda x: x <> c_mktsegment)[1 + floor(u * len(list_filter(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], lambda x: x <> c_mktsegment)))::int] as swapped from u
""")
def swapped_options(spark, sf_dir):
    """Another segment for each customer."""
    options = F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))
    return table(spark, sf_dir, "customer").select("c_custkey", generation.option_swap(F.col("c_mktsegment"), options, sampling.unit_interval("g11", "c_custkey")).alias("swapped"))


@query("seed_tags", "with t as (select unnest(string_split(c_name, '0')) as tag from customer) select tag, count(*)::bigint as n from t group by 1")
def seed_tags(spark, sf_dir):
    """Counts of the seeds' tags, here the parts of customers' names."""
    return cases.tag_counts(table(spark, sf_dir, "customer").select(F.split("c_name", "0").alias("cannot_targets")))


@query("turn_variations", r"""
with s as (select conv_id, arg_min(role, turn) as source from conversations where role is not null group by 1),
t as (select c.conv_id, turn, role, coalesce(text, '') as t, source from conversations c join s using (conv_id)),
f as (select *, len(regexp_extract_all(t, '[A-Z][a-z]+')) as n_ids, len(regexp_extract_all(t, '[a-z]{9,}')) as n_values from t)
select conv_id, turn, case when t = '' then 'correct_answer must be object' when not contains(t, 'e') then 'missing flag ''has_new_data''' when not contains(t, 'i') then 'missing flag ''wants_review''' when n_ids <> n_values then 'field_ids and field_values length mismatch'
  when role is distinct from source then 'source mismatch' when length(t) % 2 = 1 then 'test_id should start with the seed''s' end as fault from f
""")
def turn_variations(spark, sf_dir):
    """F13 on texts: a conversation's turns as variations of its first, with names as fields and long words as values."""
    c = table(spark, sf_dir, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    seed = c.where(F.col("role").isNotNull()).groupBy("conv_id").agg(F.min_by("role", "turn").alias("seed_role"))
    has = lambda letter: F.when(F.contains("t", F.lit(letter)), True)
    flags = F.struct(has("e").alias("has_new_data"), F.contains("t", F.lit("?")).alias("needs_choice"), has("i").alias("wants_review"), F.contains("t", F.lit("save")).alias("wants_save"), F.contains("t", F.lit("send")).alias("wants_submit"))
    found = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    answer = F.struct(flags.alias("flags"), found("[A-Z][a-z]+").alias("field_ids"), found("[a-z]{9,}").alias("field_values"))
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    own = F.when(F.length("t") % 2 == 0, F.concat(conv, F.lit("-v"), turn)).otherwise(F.concat(F.lit("turn-"), turn))
    v = F.struct(own.alias("test_id"), F.struct(F.col("t").alias("user_message")).alias("input"), F.when(F.col("t") != "", answer).alias("correct_answer"), F.col("role").alias("source"))
    return c.join(seed, "conv_id").select("conv_id", "turn", cases.variation_fault(v, F.struct(conv.alias("test_id"), F.col("seed_role").alias("source"))).alias("fault"))


@query("document_scores", """
select doc_id, case lang when 'en' then case when contains(text, '.') then (length(text) % 100)::double / 100 else 0.0 end when 'fr' then case when contains(text, '.') then 1.0 / (1 + length(source)) else 0.0 end end::double as score from documents
""")
def document_scores(spark, sf_dir):
    """M10 on documents: the score of the language's module, 0 where a text has no full stop."""
    scored = cases.record_score(F.col("lang"), F.contains("text", F.lit(".")), {"en": (F.length("text") % 100).cast("double") / 100, "fr": F.lit(1.0) / (1 + F.length("source"))})
    return table(spark, sf_dir, "documents").select("doc_id", scored.alias("score"))


@query("shown_parts", """
with c as (select p_brand, p_type, min(p_partkey) as pos, max(p_size) as size from part group by 1, 2),
b as (select p_brand, list(p_type order by pos) filter (where size >= 10) as ids, max(size % 7) as most from c group by 1),
a as (select l_orderkey, min(p_brand) as brand, count(*) % 7 as entry, list(distinct p_type order by p_type) filter (where l_quantity > 25) as wanted from lineitem join part on p_partkey = l_partkey group by 1)
select l_orderkey, array_to_string(case when coalesce(len(wanted), 0) = 0 then coalesce(ids, []) else list_filter(wanted, lambda x: list_contains(coalesce(ids, []), x)) end, ',') as shown,
  array_to_string(case when coalesce(len(wanted), 0) = 0 then [] else list_filter(wanted, lambda x: not list_contains(coalesce(ids, []), x)) end, ',') as unknown, entry < most as in_bounds from a join b on brand = p_brand
""")
def shown_parts(spark, sf_dir):
    """V12 on orders: the types of a brand as a group's fields, those of an order's lines as the wanted ones."""
    part = table(spark, sf_dir, "part")
    size = F.max("p_size")
    fields = part.groupBy(F.col("p_brand").alias("parent_group"), F.col("p_type").alias("field_id")).agg(F.min("p_partkey").alias("field_pos"), size.alias("size"))
    catalogue = fields.select(F.lit("f").alias("form_id"), "parent_group", "field_id", "field_pos", F.when(F.col("size") >= 10, "text").otherwise("file").alias("type"), (F.col("size") % 7).alias("max_items"))
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    asked = lines.groupBy("l_orderkey").agg(F.min("p_brand").alias("group_id"), (F.count("*") % 7).alias("entry"), F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("p_type")))).alias("wanted"))
    shown = progress.shown_fields(asked.withColumn("form_id", F.lit("f")), catalogue)
    return shown.select("l_orderkey", F.array_join("shown", ",").alias("shown"), F.array_join("unknown", ",").alias("unknown"), "in_bounds")
