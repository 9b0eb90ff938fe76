"""Queries that write the files which the readers and sinks are for, and read them back, and small rules beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, scores
from ..operators import cases, generation, progress, store, vectors
from ..session import table
from ..sources import logs, text_formats
from ..streaming import live
from .event_queries import _folder
from .registry import query

PAIR = "messages array<struct<role:string,content:string>>"


@query("jsonl_lenient", "select conv_id, turn, role, text from conversations")
def jsonl_lenient(spark, sf_dir):
    """JSON lines among blank, broken and non-object ones; only objects are read."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    broken = F.explode(F.array(F.lit("  "), F.lit("[1]"), F.concat(F.lit('{"conv_id":'), F.col("conv_id").cast("string"))))
    folder = _folder(spark, "jsonl")
    c.select(F.to_json(F.struct(*c.columns)).alias("value")).unionByName(c.where(F.col("turn") == 0).select(broken.alias("value"))).write.text(folder)
    return logs.jsonl(spark, folder, "conv_id long, turn long, role string, text string", glob="part-*").drop("file", "line")


@query("jsonl_strict", "select role, count(*)::bigint as n, sum(length(text))::bigint as chars from conversations group by 1")
def jsonl_strict(spark, sf_dir):
    """The same table from clean files, where a bad line would fail the query."""
    folder = _folder(spark, "jsonl-strict")
    table(spark, sf_dir, "conversations").select("conv_id", "role", "text").write.json(folder)
    rows = logs.jsonl(spark, folder, "conv_id long, role string, text string", strict=True)
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("header_file", "select 'record' as kind, p_partkey::varchar as said from part union all select 'meta', 'm1'")
def header_file(spark, sf_dir):
    """A header object and the records after it."""
    p = table(spark, sf_dir, "part")
    folder = _folder(spark, "header")
    head = p.limit(1).select(F.lit('{"_meta":{"model":"m1"}}').alias("value"))
    head.unionByName(p.select(F.to_json(F.struct(F.col("p_partkey").alias("test_id"))).alias("value"))).write.text(folder)
    meta, records = logs.header_and_records(spark, folder, "test_id long")
    return records.select(F.lit("record").alias("kind"), F.col("test_id").cast("string").alias("said")).unionByName(meta.select(F.lit("meta").alias("kind"), F.get_json_object("meta", "$.model").alias("said")))


@query("document_files", "select (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as pos, n_nationkey::bigint as id, n_name as name from nation")
def document_files(spark, sf_dir):
    """A JSON document per region, whose rows lie under a key."""
    n = table(spark, sf_dir, "nation")
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))))
    folder = _folder(spark, "documents")
    n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.lit("c").alias("config"), rows.alias("rows"))).alias("value")).write.partitionBy("n_regionkey").text(folder)
    return logs.document_rows(spark, folder, "rows", "id long, name string").drop("file")


@query("key_value_file", "select n_name || '@b.c' as email, n_nationkey::varchar as draft_id from nation")
def key_value_file(spark, sf_dir):
    """One JSON map of records; a table of 25 rows."""
    n = table(spark, sf_dir, "nation")
    entry = F.struct(F.concat("n_name", F.lit("@b.c")).alias("key"), F.struct(F.col("n_nationkey").cast("string").alias("draft_id")).alias("value"))
    folder = _folder(spark, "store")
    n.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(folder)
    return logs.key_value_store(spark, folder, "draft_id:string")


@query("step_log", """
select (row_number() over (order by p_partkey, k))::bigint as step, case k when 0 then p_size * 0.5 else 7.0 end::double as loss, case k when 0 then p_size + 0.25 end::double as grad
from part cross join (values (0), (1)) t(k) where k = 0 or p_partkey % 3 = 0
""")
def step_log(spark, sf_dir):
    """A trainer's log with one or two dicts in a line."""
    size = F.col("p_size")
    first = F.concat(F.lit("at {'loss': "), (size * F.lit(0.5)).cast("string"), F.lit(", 'grad': '"), (size + F.lit(0.25)).cast("string"), F.lit("'} end"))
    lines = table(spark, sf_dir, "part").select("p_partkey", F.concat(first, F.when(F.col("p_partkey") % 3 == 0, " {'loss': 7.0}").otherwise("")).alias("value"))
    steps = logs.scraped_steps(lines, "p_partkey")
    return steps.select(F.col("step").cast("long").alias("step"), F.element_at("metrics", F.lit("loss")).alias("loss"), F.element_at("metrics", F.lit("grad")).alias("grad"))


@query("detected_logs", """
select n_regionkey::bigint as region, 'json' as kind, (row_number() over (partition by n_regionkey order by n_nationkey))::bigint as step, n_nationkey * 0.5 as loss from nation
union all select n_regionkey, 'text', (row_number() over (partition by n_regionkey order by n_nationkey))::bigint, n_nationkey * 0.25 from nation
""")
def detected_logs(spark, sf_dir):
    """Each region's trainer log as a JSON document and as text, both read by one reader."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    folder, out = _folder(spark, "trainer"), []
    for region in (r[0] for r in n.select("n_regionkey").distinct().collect()):  # five regions
        own = n.where(F.col("n_regionkey") == region).orderBy("n_nationkey").coalesce(1)
        entry = F.struct(F.col("n_nationkey").alias("at"), F.struct((F.col("n_nationkey") * F.lit(0.5)).alias("loss"), F.lit("x").alias("note")).alias("e"))
        own.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("log_history")).write.json(f"{folder}/{region}.json")
        own.select(F.concat(F.lit("it {'loss': "), (F.col("n_nationkey") * F.lit(0.25)).cast("string"), F.lit("} done"))).write.text(f"{folder}/{region}.log")
        for kind, path in (("json", f"{folder}/{region}.json"), ("text", f"{folder}/{region}.log")):
            m = logs.training_metrics(spark, path)
            out.append(m.select(F.lit(region).cast("long").alias("region"), F.lit(kind).alias("kind"), F.col("step").cast("long").alias("step"), F.element_at("metrics", F.lit("loss")).alias("loss")))
    return reduce(DataFrame.unionByName, out)


@query("event_sink", "select 'u' || user_id % 10 as session_id, event_type, count(*)::bigint as n from events group by 1, 2")
def event_sink(spark, sf_dir):
    """Events appended in two writes, each row stamped with its session."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    folder = _folder(spark, "sink")
    for half in (0, 1):
        logs.write_events(e.where(F.col("event_id") % 2 == half), folder, F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")))
    return spark.read.schema("session_id string, event_type string").json(folder).groupBy("session_id", "event_type").agg(F.count("*").alias("n"))


@query("session_export", "select event_id, event_type, true as bare from events where user_id % 10 = 3")
def session_export(spark, sf_dir):
    """One session's events as JSON text without the surrogate id."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("session_id"), F.col("event_id").alias("row_id"))
    out = logs.export_session(e, "u3", "row_id")
    return out.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.get_json_object("value", "$.event_type").alias("event_type"), F.get_json_object("value", "$.row_id").isNull().alias("bare"))


@query("training_versions", """
with m as (select lang, source, doc_id from documents where lang is not null and source is not null)
select 1::int as version, lang as asked, count(*)::bigint as n, count(distinct source)::bigint as n_sources from m group by 2 union all select 2, lang, count(*)::bigint, count(distinct source)::bigint from m where lang = 'en' group by 2
""")
def training_versions(spark, sf_dir):
    """Messages alone are written, and each version goes beside the one before."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    d = table(spark, sf_dir, "documents").where(F.col("lang").isNotNull() & F.col("source").isNotNull())
    folder, base = _folder(spark, "training"), _folder(spark, "versions")
    logs.training_write(d.select("doc_id", F.array(message("user", "lang"), message("assistant", "source")).alias("messages")), folder)
    rows = spark.read.schema(PAIR).json(folder)
    logs.archived_write(rows, base, "1")
    logs.archived_write(rows.where(F.col("messages")[0]["content"] == "en"), base, "2")
    back = spark.read.schema(f"{PAIR}, version int").json(base)
    return back.groupBy("version", F.col("messages")[0]["content"].alias("asked")).agg(F.count("*").alias("n"), F.countDistinct(F.col("messages")[1]["content"]).alias("n_sources"))


@query("mutations", """
select c_custkey, case c_custkey % 4 when 0 then 'missing' when 1 then 'too_short' when 2 then 'unchanged' end as fault,
  case when c_custkey % 2 = 1 then '- a y: ' || c_name || chr(10) || '- b x: ' || c_mktsegment || chr(10) || '- c: z' end as review, c_custkey % 3 = 0 as listed, case when c_custkey % 2 = 0 then 0.5 else 1.0 end::double as covered,
  case when c_custkey % 5 = 0 then 'late' else c_name end as found, c_mktsegment as applied, '1' as kept, round(100.0 * (c_custkey % 5) / (4 + c_custkey % 4))::int as percent,
  case when c_custkey % 3 = 0 then case when c_custkey % 2 = 0 then 0.0 else 0.75 end when c_custkey % 3 = 1 then case when c_custkey % 2 = 0 then 0.0 else 0.25 end end::double as score
from customer
""")
def mutations(spark, sf_dir):
    """F12, F14, U8, G2, F17, M8, V4, P63, A40, A41, M10."""
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    mutated = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, " ab ").when(k % 4 == 2, F.concat(F.lit(" "), F.upper(name), F.lit(" "))).otherwise(F.concat(name, F.lit(" more")))
    state = F.map_filter(F.create_map(F.lit("b_x"), segment, F.lit("a_y"), name, F.lit("c"), F.lit("z")), lambda key, _: (k % 2 == 1) | (key != "c"))
    catalogue = F.when(k % 3 == 0, F.array(F.lit("grp.*.sub"), F.lit("x"))).otherwise(F.array(F.lit("grp.*.other")))
    said = F.when(k % 2 == 0, "your Home Address").otherwise(F.concat(F.lit("HOME_ADDRESS, "), F.upper(segment)))
    sections = F.array(F.create_map(F.lit("other"), F.lit("q")), F.when(k % 5 != 0, F.create_map(F.lit("n"), name)).otherwise(F.create_map(F.lit("o"), name)), F.create_map(F.lit("n"), F.lit("late")))
    delta = F.array(F.struct(F.lit("grp.0.sub").alias("field_id"), segment.alias("value")))
    after = cases.applied_delta(F.create_map(F.lit("grp-0-sub"), F.lit("old"), F.lit("kept"), F.lit("1")), delta)
    module = F.when(k % 3 == 0, "router").when(k % 3 == 1, "text").otherwise("unknown")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", generation.accepted_mutation(name, mutated).alias("fault"), generation.review_target(state).alias("review"), ids.in_catalogue(F.lit("grp.3.sub"), catalogue).alias("listed"),
        scores.coverage(F.array(F.lit("home_address"), segment), said).alias("covered"), cases.sectioned_value(sections, F.lit("n")).alias("found"), F.element_at(after, F.lit("grp-0-sub")).alias("applied"), F.element_at(after, F.lit("kept")).alias("kept"),
        cases.warning_completeness((k % 5).cast("int"), F.lit(4), (k % 4).cast("int")).alias("percent"), cases.record_score(module, k % 2 == 1, {"router": F.lit(0.75), "text": F.lit(0.25)}).alias("score"),
    )


@query("case_subsets", """
with c as (select p_partkey % 3 as r from part)
select 'all' as which, count(*)::bigint as n from c union all select 'legacy', count(*)::bigint from c where r = 0 union all select 'variations', count(*)::bigint from c where r = 1 union all select 'seeds', count(*)::bigint from c where r = 2
""")
def case_subsets(spark, sf_dir):
    """each subset by the form of its ids; an old case that looks like a variation stays old."""
    k = F.col("p_partkey")
    named = F.when(k % 3 == 0, F.concat(F.lit("legacy-a-v"), k.cast("string"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("-v1"))).otherwise(k.cast("string"))
    c = table(spark, sf_dir, "part").select(named.alias("test_id"))
    out = [cases.subset(c, which).agg(F.count("*").alias("n")).select(F.lit(which).alias("which"), "n") for which in ("all", "legacy", "variations", "seeds")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("module_compare", """
select o_orderkey, case when o_orderkey % 2 = 0 then o_totalprice end as a, case when o_orderkey % 3 = 0 then o_totalprice end as b, case when o_orderkey % 6 = 0 then 'both' when o_orderkey % 2 = 0 then 'left_only' else 'right_only' end as "where" from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0
""")
def module_compare(spark, sf_dir):
    """J13."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return vectors.compare(o.where(F.col("o_orderkey") % 2 == 0), o.where(F.col("o_orderkey") % 3 == 0), ["o_orderkey"], "o_totalprice")


@query("repeat_check", """
select o_orderkey, concat_ws(',', case when o_orderkey % 2 = 0 then 'o_orderstatus' end, case when o_orderkey % 3 = 0 then 'o_totalprice' end) as differing, o_orderkey % 2 <> 0 and o_orderkey % 3 <> 0 as identical from orders
""")
def repeat_check(spark, sf_dir):
    """Stored rows against those of a second run."""
    o, k = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    again = o.withColumns({"o_orderstatus": F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(k % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    found = store.reproducibility(o, again, "o_orderkey", ["o_orderstatus", "o_totalprice"])
    return found.select("o_orderkey", F.array_join("differing", ",").alias("differing"), "identical")


@query("screen_views", """
with l as (select l_orderkey, l_linenumber, 's' || l_linenumber || ' ' || repeat('#', floor((l_quantity::int % 5) * 10 / 4.0)::int) || case when l_quantity::int % 5 >= 4 then ' done' else '' end as line from lineitem)
select l_orderkey as record_id, string_agg(line, chr(10) order by l_linenumber, line) as view from l group by 1
""")
def screen_views(spark, sf_dir):
    """An order's lines as sections with bars."""
    filled = F.col("l_quantity").cast("int") % 5
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("section_pos"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("section_id"),
        filled.alias("filled"), F.lit(4).alias("required"), (filled >= 4).alias("complete"),
    )
    return progress.screen_view(p)


@query("probe_references", """
select p_partkey, case when p_partkey % 2 = 0 then p_name else (select q.p_name from part q where q.p_partkey = p.p_partkey - 1 and q.p_partkey % 2 = 0) end as state from part p
""")
def probe_references(spark, sf_dir):
    """An odd part's empty state is that of the part before it."""
    even = F.col("p_partkey") % 2 == 0
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(~even, F.col("p_partkey") - 1).alias("ref"), F.when(even, F.col("p_name")).otherwise("").alias("state"))
    return text_formats.resolve_references(p, "p_partkey", "ref", "state").select("p_partkey", F.nullif("state", F.lit("")).alias("state"))


@query("call_pairs", "select event_id, ts as started, ts + interval 30 minute as ended from events where event_id % 3 = 0")
def call_pairs(spark, sf_dir):
    """Starts met with ends of the same call within an hour; two in three ends come too late or before their start."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    shift = F.when(F.col("event_id") % 3 == 0, F.expr("interval 30 minutes")).when(F.col("event_id") % 3 == 1, F.expr("interval 61 minutes")).otherwise(F.expr("interval -1 minutes"))
    return live.paired_calls(e, e.withColumn("ts", F.col("ts") + shift), "event_id")


@query("shown_groups", """
select o_orderkey, case when o_orderkey % 4 = 3 then null when o_orderkey % 3 = 0 then 'a' else 'a,b' end as shown, case when o_orderkey % 3 <> 0 then '' when o_orderkey % 4 <> 3 then 'zz' end as unknown, case when o_orderkey % 4 = 3 then true else o_orderkey % 5 < 3 end as in_bounds from orders
""")
def shown_groups(spark, sf_dir):
    """All sub-fields of a group, or the wanted ones, and whether the entry is in bounds; an unknown group shows nothing."""
    k = F.col("o_orderkey")
    subs = [("f", "g", 2, "b", "text", 3), ("f", "g", 1, "a", "text", 3), ("f", "g", 3, "c", "file", 3), ("f", None, 0, "top", "text", None)]
    catalogue = spark.createDataFrame(subs, "form_id string, parent_group string, field_pos int, field_id string, type string, max_items int")
    wanted = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("zz")))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("f").alias("form_id"), F.when(k % 4 == 3, "h").otherwise("g").alias("group_id"), (k % 5).cast("int").alias("entry"), wanted.alias("wanted"))
    found = progress.shown_fields(asked, catalogue)
    return found.select("o_orderkey", F.array_join("shown", ",").alias("shown"), F.array_join("unknown", ",").alias("unknown"), "in_bounds")


@query("variation_faults", """
select p_partkey, case p_partkey % 7 when 0 then 'missing top-level key ''test_id''' when 1 then 'correct_answer must be object' when 2 then 'missing flag ''wants_save''' when 3 then 'field_ids and field_values must be lists'
  when 4 then 'field_ids and field_values length mismatch' when 5 then 'source mismatch' else case when p_partkey % 2 = 0 then 'test_id should start with the seed''s' end end as fault from part
""")
def variation_faults(spark, sf_dir):
    """each kind of variation breaks one rule, the last none or the rule on ids."""
    k = F.col("p_partkey")
    kind, own = k % 7, F.concat(F.lit("s"), k.cast("string"))
    flags = F.struct(*(F.lit(True).alias(n) for n in ("has_new_data", "needs_choice", "wants_review")), F.when(kind != 2, F.lit(False)).alias("wants_save"), F.lit(True).alias("wants_submit"))
    values = F.when(kind == 3, F.lit(None)).when(kind == 4, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y")))
    answer = F.struct(flags.alias("flags"), F.array(F.lit("a"), F.lit("b")).alias("field_ids"), values.alias("field_values"))
    named = F.when(kind == 0, F.lit(None)).when((kind == 6) & (k % 2 == 0), F.concat(F.lit("other-"), own)).otherwise(F.concat(own, F.lit("-v1")))
    v = F.struct(named.alias("test_id"), F.struct(F.lit("m").alias("user_message")).alias("input"), F.when(kind != 1, answer).alias("correct_answer"), F.when(kind == 5, "else").otherwise(F.col("p_brand")).alias("source"))
    both = table(spark, sf_dir, "part").select("p_partkey", v.alias("v"), F.struct(own.alias("test_id"), F.col("p_brand").alias("source")).alias("seed"))
    return both.select("p_partkey", cases.variation_fault(F.col("v"), F.col("seed")).alias("fault"))
