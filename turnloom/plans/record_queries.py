"""Validation, completeness, merging and weighted scores over orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import aggregates, merging, sampling, validation
from ..session import table
from .registry import query

#: A small catalogue over customer columns, as any form's catalogue would be.
FIELDS = [
    ("c_name", "Name", "text", True, 5, 18, None, None, None, None, None, None, None),
    ("c_acctbal", "Balance", "number", True, None, None, -500.0, 9000.0, None, None, None, None, None),
    ("c_mktsegment", "Segment", "select", True, None, None, None, None, None, ["BUILDING", "MACHINERY", "HOUSEHOLD"], None, None, None),
    ("c_nationkey", "Nation", "number", True, None, None, 0.0, 20.0, None, None, "c_mktsegment", "equals", ["BUILDING"]),
]


def _catalogue(spark):
    names = "field_id string, label string, type string, required boolean, min_length int, max_length int, min double, max double, decimal_places int, opts array<string>, cond_field string, cond_op string, cond_values array<string>"
    base = spark.createDataFrame(FIELDS, names)
    return base.select(
        F.lit("customer").alias("form_id"), F.lit(0).alias("section_pos"), F.lit("main").alias("section_id"), F.lit(0).alias("field_pos"), "field_id", F.lit(None).cast("string").alias("parent_group"), F.col("field_id").alias("pattern_id"),
        "label", "type", "required", "min_length", "max_length", "min", "max", "decimal_places", F.lit(None).cast("string").alias("format"),
        F.transform("opts", lambda o: F.struct(o.alias("value"), F.initcap(o).alias("label"))).alias("options"), F.lit(None).cast("int").alias("max_selections"), F.lit(False).alias("require_country_code"),
        F.lit(None).cast("int").alias("min_items"), F.lit(None).cast("int").alias("max_items"), "cond_field", "cond_op", "cond_values",
    )


def _values(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pair = lambda n, kind: F.struct(F.lit(n).alias("field_id"), F.col(n).cast("string").alias("value"), F.lit(kind).alias("type"))
    balance = F.struct(F.lit("c_acctbal").alias("field_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).alias("value"), F.lit("number").alias("type"))
    return c.select(F.col("c_custkey").alias("record_id"), F.lit("customer").alias("form_id"), F.explode(F.array(pair("c_name", "string"), balance, pair("c_mktsegment", "string"), pair("c_nationkey", "number"))).alias("x")).select("record_id", "form_id", "x.*")


@query("validate_rows", """
with v as (
  select c_custkey as record_id, 'c_name' as field_id, case when length(c_name) > 18 then 'Name must be at most 18 characters.' when length(c_name) < 5 then 'Name must be at least 5 characters.' end as error from customer
  union all select c_custkey, 'c_acctbal', case when c_acctbal < 0 then 'Balance is required.' when c_acctbal > 9000 then 'Balance must be at most 9000.0.' end from customer
  union all select c_custkey, 'c_mktsegment', case when c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') then 'Segment is not a valid option.' end from customer
  union all select c_custkey, 'c_nationkey', case when c_mktsegment = 'BUILDING' and c_nationkey > 20 then 'Nation must be at most 20.0.' end from customer)
select record_id, field_id, error, error is null as valid from v
""")
def validate_rows(spark, sf_dir):
    """Every value against the catalogue, conditions included."""
    return validation.validated(_values(spark, sf_dir), _catalogue(spark)).select("record_id", "field_id", "error", "valid")


@query("validation_summary", """
with v as (select c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') as s, c_acctbal < 0 or c_acctbal > 9000 as b, c_mktsegment = 'BUILDING' and c_nationkey > 20 as n, length(c_name) not between 5 and 18 as nm from customer)
select field_id, n_bad::bigint as n_bad, (select count(*) from customer)::bigint as n from (select 'c_name' as field_id, count(*) filter (where nm) as n_bad from v union all select 'c_acctbal', count(*) filter (where b) from v union all select 'c_mktsegment', count(*) filter (where s) from v union all select 'c_nationkey', count(*) filter (where n) from v)
""")
def validation_summary(spark, sf_dir):
    """V11's counts per field."""
    v = validation.validated(_values(spark, sf_dir), _catalogue(spark))
    return v.groupBy("field_id").agg(F.count_if(~F.col("valid")).alias("n_bad"), F.count("*").alias("n"))


@query("required_rows", """
select c_custkey as record_id, f as field_id, case f when 'c_acctbal' then c_acctbal >= 0 else true end as filled from customer, (values ('c_name'), ('c_acctbal'), ('c_mktsegment'), ('c_nationkey')) t(f) where f <> 'c_nationkey' or c_mktsegment = 'BUILDING'
""")
def required_rows(spark, sf_dir):
    """V14."""
    values = _values(spark, sf_dir)
    records = values.select("record_id", "form_id").distinct()
    return validation.required(records, values, _catalogue(spark)).select("record_id", "field_id", "filled")


@query("completeness", """
with r as (select c_custkey as record_id, 3 + (c_mktsegment = 'BUILDING')::int as total, 2 + (c_acctbal >= 0)::int + (c_mktsegment = 'BUILDING')::int as filled from customer)
select record_id, filled::bigint as filled, total::bigint as total, round(100.0 * filled / total)::int as percent from r
""")
def completeness(spark, sf_dir):
    """A39, A42."""
    values = _values(spark, sf_dir)
    r = validation.required(values.select("record_id", "form_id").distinct(), values, _catalogue(spark)).groupBy("record_id").agg(F.count_if("filled").alias("filled"), F.count("*").alias("total"))
    return r.withColumn("percent", aggregates.completeness(F.col("filled"), F.col("total")))


@query("snap_options", """
select c_custkey as record_id, case when c_mktsegment in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') then c_mktsegment end as snapped, case when c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') then 'value_not_in_enum:c_mktsegment=' || lower(c_mktsegment) end as reason from customer
""")
def snap_options(spark, sf_dir):
    """Lower-cased values snap back to the catalogue's spelling."""
    values = _values(spark, sf_dir).where(F.col("field_id") == "c_mktsegment").withColumn("value", F.lower("value"))
    return validation.snapped(values, _catalogue(spark)).select("record_id", "snapped", "reason")


@query("condition_table", """
with o as (select o_orderkey, o_orderstatus as actual, o_totalprice as price from orders)
select o_orderkey, actual = 'F' as eq, actual <> 'F' as ne, actual in ('F', 'O') as among, actual not in ('F', 'O') as not_among, price > 100000 as gt, price < 100000 as lt, false as unequal_types, true as unknown from o
""")
def condition_table(spark, sf_dir):
    """Each operator on typed texts."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice").cast("string")
    s, n = F.lit("string"), F.lit("number")
    met = lambda op, a, at, w, wt=None: validation.condition_met(a, at, F.lit(op), F.array(*map(F.lit, w)), wt if wt is not None else at)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", met("equals", status, s, ["F"]).alias("eq"), met("not_equals", status, s, ["F"]).alias("ne"), met("in", status, s, ["F", "O"]).alias("among"), met("not_in", status, s, ["F", "O"]).alias("not_among"),
        met("greater_than", price, n, ["100000"]).alias("gt"), met("less_than", price, n, ["100000"]).alias("lt"), met("equals", status, s, ["F"], n).alias("unequal_types"), met("near", status, s, ["F"]).alias("unknown"),
    )


@query("composite_renorm", """
with m as (select o_orderkey, case when o_orderkey % 2 = 0 then 0.5 end as r, case when o_orderkey % 3 = 0 then (o_orderkey % 7) / 7 end as d, case when o_orderkey % 5 = 0 then 1.0 end as c, (o_orderkey % 10) / 10 as t from orders)
select o_orderkey, round((coalesce(0.2 * r, 0) + coalesce(0.15 * d, 0) + coalesce(0.05 * c, 0) + 0.55 * t) / ((r is not null)::int * 0.2 + (d is not null)::int * 0.15 + (c is not null)::int * 0.05 + 0.55), 6)::double as score from m
""")
def composite_renorm(spark, sf_dir):
    """M5: weights over active modules only."""
    k = F.col("o_orderkey")
    modules = {"action_router": F.when(k % 2 == 0, 0.5), "data_extractor": F.when(k % 3 == 0, (k % 7) / 7), "choice_builder": F.when(k % 5 == 0, 1.0), "text_responder": (k % 10) / 10}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(scores.composite(modules), 6).alias("score"))


@query("rubric_scores", """
select o_orderkey, round((3.0 * (o_orderkey % 2) + 2.0 * (o_orderkey % 3) / 2 + 1.0 * (o_orderkey % 5) / 4) / 6.0, 6)::double as score from orders
""")
def rubric_scores(spark, sf_dir):
    """M4, M20."""
    k = F.col("o_orderkey")
    items = F.array(*(F.struct(F.lit(w).alias("weight"), s.cast("double").alias("score")) for w, s in ((3.0, k % 2), (2.0, k % 3 / 2), (1.0, k % 5 / 4))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(scores.rubric_score(items), 6).alias("score"))


@query("upsert_latest", """
select o_custkey, o_orderkey as latest_order, kept_id, o_totalprice from (select *, first_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as kept_id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1
""")
def upsert_latest(spark, sf_dir):
    """The latest record under its first id."""
    return merging.upsert(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate").select("o_custkey", F.col("o_orderkey").alias("latest_order"), "kept_id", "o_totalprice")


@query("section_merge", """
with l as (select o_custkey, left(o_orderpriority, 1) as section, o_orderstatus as name, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as v from orders group by 1, 2, 3)
select o_custkey, section, string_agg(name || '=' || v, ',' order by name) as merged from l group by 1, 2
""")
def section_merge(spark, sf_dir):
    """U11."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.left("o_orderpriority", F.lit(1)).alias("section"), F.create_map("o_orderstatus", "o_orderkey").alias("m"))
    merged = merging.section_merge(o, "o_custkey", "at", "section", "m")
    return merged.select("o_custkey", "section", F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("merged"))


@query("group_entries", """
select l_orderkey as record_id, 'items' as group_id, string_agg(distinct (l_linenumber - 1)::varchar, ',' order by (l_linenumber - 1)::varchar) as entries, max(l_linenumber)::int as n_entries from lineitem where l_returnflag <> 'R' group by 1
""")
def group_entries(spark, sf_dir):
    """Filled indices of a repeatable group; gaps count."""
    li = table(spark, sf_dir, "lineitem")
    values = li.select(F.col("l_orderkey").alias("record_id"), F.concat_ws(".", F.lit("items"), (F.col("l_linenumber") - 1).cast("string"), F.lit("quantity")).alias("field_id"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("string")).alias("value"))
    return validation.group_entries(values).select("record_id", "group_id", F.array_join("entries", ",").alias("entries"), "n_entries")


@query("top_up_plan", """
select s.c_mktsegment, n.n_name, coalesce(h.have, 0)::bigint as have, greatest(0, 20 - coalesce(h.have, 0))::bigint as need from (select distinct c_mktsegment from customer) s cross join nation n
left join (select c_mktsegment, n_name, count(*) as have from customer join nation on c_nationkey = n_nationkey group by all) h on h.c_mktsegment = s.c_mktsegment and h.n_name = n.n_name
""")
def top_up_plan(spark, sf_dir):
    """Combinations of segments (a literal list) and nations (25 rows)."""
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    every = table(spark, sf_dir, "nation").select("n_name", F.explode(F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))).alias("c_mktsegment"))
    return sampling.top_up(every, customers, ["c_mktsegment", "n_name"], 20)


@query("majority_by_group", """
select o_orderpriority, count(*)::bigint as n, count(*) filter (where o_orderstatus = 'F') * 2 > count(*) as mostly_done, round(100.0 * count(*) filter (where o_orderstatus = 'F') / count(*), 4)::double as pct_done from orders group by 1
""")
def majority_by_group(spark, sf_dir):
    """A16, A25, A48."""
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), (done * 2 > F.count("*")).alias("mostly_done"), F.round(100.0 * done / F.count("*"), 4).alias("pct_done"))


@query("id_notations", r"""
select l_orderkey, l_linenumber, 'items-' || l_linenumber || '-qty' as dashed, 'items.*.qty' as starred, l_linenumber::int as entry from lineitem
""")
def id_notations(spark, sf_dir):
    """P32-P36."""
    from ..functions import ids

    dotted = F.concat_ws(".", F.lit("items"), F.col("l_linenumber").cast("string"), F.lit("qty"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ids.dotted_to_dashed(dotted).alias("dashed"), ids.starred(dotted).alias("starred"), ids.group_parts(dotted)["entry"].alias("entry"))


@query("deep_merge", """
with o as (select o_custkey as k, o_orderkey as i, o_orderstatus as st, o_orderpriority as pr, o_orderkey // 4 % 3 as kind, 'm' || (o_orderkey % 5) as m from orders),
l as (select k, max(i) filter (where kind = 0) as scalar_at, max(i) filter (where kind = 1) as object_at, arg_max(st, i) as st, arg_max(pr, i) as pr, arg_max(pr, i) filter (where kind = 0) as said from o group by k),
b as (select k, '{' || string_agg('"' || st || '":"' || i || '"', ',' order by st) || '}' as t from (select k, st, max(i) as i from o group by all) group by k),
n as (select k, '{' || string_agg('"' || m || '":' || i, ',' order by m) || '}' as t from (select o.k, m, max(i) as i from o join l using (k) where kind = 1 and i > coalesce(scalar_at, -1) group by all) group by k)
select l.k as o_custkey, '{"by_status":' || b.t || ',"last":{"priority":"' || pr || '","status":"' || st || '"}' || case when coalesce(object_at, -1) > coalesce(scalar_at, -1) then ',"note":' || n.t when scalar_at is not null then ',"note":"' || said || '"' else '' end || '}' as merged
from l join b using (k) left join n using (k)
""")
def deep_merge(spark, sf_dir):
    """Order documents of each customer, merged recursively; a note is a text in some and an object in others."""
    from ..operators import json_merge

    kind, name = F.floor(F.col("o_orderkey") / 4) % 3, F.concat(F.lit("m"), (F.col("o_orderkey") % 5).cast("string"))
    fields = [
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("last"),
        F.create_map("o_orderstatus", F.col("o_orderkey").cast("string")).alias("by_status"),
    ]
    doc = F.when(kind == 0, F.to_json(F.struct(*fields, F.col("o_orderpriority").alias("note")))).when(kind == 1, F.to_json(F.struct(*fields, F.create_map(name, "o_orderkey").alias("note")))).otherwise(F.to_json(F.struct(*fields)))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", doc.alias("doc"))
    return json_merge.deep_merge(o, "o_custkey", "o_orderkey", "doc")


@query("normalised_values", """
select o_orderkey, case when o_totalprice = floor(o_totalprice) then o_totalprice::bigint::varchar else null end as whole, lower(trim(o_orderpriority)) as priority from orders
""")
def normalised_values(spark, sf_dir):
    """Whole numbers without a point, texts trimmed and lower-cased."""
    from ..functions.values import normalised

    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(price == F.floor(price), normalised(price)).alias("whole"), normalised(F.col("o_orderpriority")).alias("priority"))
