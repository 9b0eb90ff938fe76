"""Set and value scores over order baskets: gold against predicted part keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import aggregates
from ..session import table
from .registry import query

GOLD, PRED = "l_returnflag <> 'R'", "l_linenumber <= 4"

_SETS_SQL = f"""
l as (select l_orderkey as k, l_partkey as id, bool_or({GOLD}) as g, bool_or({PRED}) as p, max(case when {GOLD} then l_quantity end) as gv, max(case when {PRED} then l_quantity + (l_suppkey % 4 = 0)::int end) as pv from lineitem group by 1, 2),
c as (select k, count(*) filter (where g and p) as tp, count(*) filter (where p and not g) as fp, count(*) filter (where g and not p) as fn, count(*) filter (where g and p and gv = pv) as ok from l group by k)"""


def _sets(spark, sf_dir):
    """Per order gold and predicted ids with values, as maps."""
    li = table(spark, sf_dir, "lineitem")
    each = li.groupBy("l_orderkey", "l_partkey").agg(
        F.bool_or(F.expr(GOLD)).alias("g"), F.bool_or(F.expr(PRED)).alias("p"), F.max(F.expr(f"case when {GOLD} then l_quantity end")).alias("gv"),
        F.max(F.expr(f"case when {PRED} then l_quantity + cast(l_suppkey % 4 = 0 as int) end")).alias("pv"),
    )
    side = lambda flag, value: F.map_from_entries(F.collect_list(F.when(F.col(flag), F.struct(F.col("l_partkey"), F.col(value)))))
    return each.groupBy(F.col("l_orderkey").alias("order_id")).agg(side("g", "gv").alias("gold"), side("p", "pv").alias("pred"))


def _prf(name, recall_on_empty):
    return f"""
with {_SETS_SQL}, m as (select k, case when tp + fp > 0 then tp / (tp + fp) when tp + fn = 0 then 1.0 else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) {recall_on_empty} end as recall from c)
select k as order_id, round(precision, 6)::double as precision, round(recall, 6)::double as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end, 6)::double as f1 from m"""


def _rounded(df, metrics):
    return df.select("order_id", metrics.alias("m")).select("order_id", *(F.round(f"m.{c}", 6).alias(c) for c in ("precision", "recall", "f1")))


@query("set_f1_router", f"with {_SETS_SQL} select k as order_id, round(case when tp + fp + fn = 0 then 1.0 when tp = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end, 6)::double as f1 from c")
def set_f1_router(spark, sf_dir):
    return _sets(spark, sf_dir).select("order_id", F.round(scores.router_f1(F.map_keys("gold"), F.map_keys("pred")), 6).alias("f1"))


@query("set_f1_compare", _prf("compare", "else 1.0"))
def set_f1_compare(spark, sf_dir):
    """M6."""
    return _rounded(_sets(spark, sf_dir), scores.report_metrics(F.map_keys("gold"), F.map_keys("pred")))


@query("set_f1_rl", _prf("rl", "when tp + fp = 0 then 1.0 else 0.0"))
def set_f1_rl(spark, sf_dir):
    """M13."""
    return _rounded(_sets(spark, sf_dir), scores.reward_metrics(F.map_keys("gold"), F.map_keys("pred")))


@query("extractor_score", f"""
with {_SETS_SQL} select k as order_id, round(0.6 * (case when tp + fp + fn = 0 then 1.0 when tp = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end) + 0.4 * (case when tp > 0 then ok / tp when tp + fn = 0 then 1.0 else 0.0 end), 6)::double as score from c
""")
def extractor_score(spark, sf_dir):
    """M2."""
    return _sets(spark, sf_dir).select("order_id", F.round(scores.extractor_score(F.col("gold"), F.col("pred")), 6).alias("score"))


@query("value_match", f"with {_SETS_SQL} select (k % 10)::bigint as grp, round(sum(ok) / nullif(sum(tp), 0), 6)::double as ratio from c group by 1")
def value_match(spark, sf_dir):
    """Sum of matches over sum of shared ids."""
    s = _sets(spark, sf_dir).select((F.col("order_id") % 10).alias("grp"), scores.matching_values(F.col("gold"), F.col("pred")).alias("ok"), F.size(F.array_intersect(F.map_keys("gold"), F.map_keys("pred"))).alias("tp"))
    return aggregates.ratio_of_sums(s, ["grp"], F.col("ok"), F.col("tp"))


@query("reward_accuracy", f"""
with {_SETS_SQL} select k as order_id, round(case when tp + fn = 0 then case when tp + fp = 0 then 1.5 else 0.0 end when tp + fp = 0 then 0.0 else 1.5 * (2.0 * tp / (2 * tp + fp + fn)) + 1.5 * ok / (tp + fn) end, 6)::double as reward from c
""")
def reward_accuracy(spark, sf_dir):
    """M15."""
    return _sets(spark, sf_dir).select("order_id", F.round(scores.accuracy_reward(F.col("gold"), F.col("pred")), 6).alias("reward"))


@query("reward_hallucination", """
with v as (select l_orderkey as k, list(distinct l_partkey) filter (where l_linenumber <= 2) as valid, list(l_partkey % 300) as pred from lineitem group by 1)
select k as order_id, (case when valid is null or len(pred) = 0 then 0.0 else -least(len(list_filter(pred, lambda x: not list_contains(valid, x))) * 0.5, 2.0) end + 0.0)::double as penalty from v
""")
def reward_hallucination(spark, sf_dir):
    """Predicted ids (with repeats) that are not among the valid ones."""
    li = table(spark, sf_dir, "lineitem")
    v = li.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_partkey"))).alias("valid"), F.collect_list(F.col("l_partkey") % 300).alias("pred"))
    return v.select("order_id", scores.hallucination_penalty(F.col("pred"), F.col("valid")).alias("penalty"))


@query("choice_metrics", """
with s as (select l_orderkey as k, lower(l_returnflag) as o, bool_or(l_linenumber <= 3) as g, bool_or(l_linenumber >= 2) as p from lineitem group by all), c as (select k, count(*) filter (where g and p) as tp, count(*) filter (where p and not g) as fp, count(*) filter (where g and not p) as fn from s group by k)
select k as order_id, round(case when tp + fp > 0 then tp / (tp + fp) when tp + fn = 0 then 1.0 else 0.0 end, 6)::double as precision, fp = 0 and fn = 0 as exact_set_match from c
""")
def choice_metrics(spark, sf_dir):
    """M7, U4."""
    li = table(spark, sf_dir, "lineitem").withColumn("o", F.lower("l_returnflag"))
    s = li.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("o"))).alias("g"), F.collect_set(F.when(F.col("l_linenumber") >= 2, F.col("o"))).alias("p"))
    return s.select("order_id", F.round(scores.report_metrics(F.col("g"), F.col("p"))["precision"], 6).alias("precision"), scores.same_set(F.col("g"), F.col("p")).alias("exact_set_match"))


@query("report_pivot", """
select l_returnflag, round(sum(l_quantity) filter (where l_linestatus = 'F'), 2) as "F", round(sum(l_quantity) filter (where l_linestatus = 'O'), 2) as "O" from lineitem group by 1
""")
def report_pivot(spark, sf_dir):
    """A11."""
    return aggregates.pivoted(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], F.round(F.sum("l_quantity"), 2))


@query("report_aggregate", """
select l_linestatus, count(*)::bigint as n, count(*) filter (where l_discount > 0.05)::bigint as n_discounted, round(avg(l_tax), 6) as avg_tax, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) as net_share, round(avg(case when l_returnflag = 'R' then 1.0 else 0.0 end), 6)::double as return_rate from lineitem group by 1
""")
def report_aggregate(spark, sf_dir):
    """One wide conditional aggregate per group."""
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"), F.round(F.avg("l_tax"), 6).alias("avg_tax"),
        F.round(F.sum(price * (1 - F.col("l_discount"))) / F.sum(price), 6).alias("net_share"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("return_rate"),
    )


@query("field_frequency", """
select 'brand.' || '*' || '.' || p_brand as field_id, count(*)::bigint as n from lineitem join part on l_partkey = p_partkey group by p_brand order by n desc, field_id limit 20
""")
def field_frequency(spark, sf_dir):
    """The twenty most frequent starred ids."""
    from ..functions.ids import starred

    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    named = li.select(starred(F.concat_ws(".", F.lit("brand"), F.col("l_linenumber").cast("string"), "p_brand")).alias("field_id"))
    return named.groupBy("field_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field_id").limit(20)


@query("fields_per_example", "select n_fields, count(*)::bigint as n from (select l_orderkey, count(*)::bigint as n_fields from lineitem group by 1) group by 1")
def fields_per_example(spark, sf_dir):
    """A38."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_fields")).groupBy("n_fields").agg(F.count("*").alias("n"))


@query("turn_level_and", """
select l_orderkey as order_id, coalesce(bool_and(l_quantity >= 5), true) as format_ok, coalesce(bool_and(l_discount < 0.1) filter (where l_returnflag <> 'R'), true) as content_ok from lineitem group by 1
""")
def turn_level_and(spark, sf_dir):
    """All fired modules pass; none fired counts as passed."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.coalesce(F.bool_and(F.col("l_quantity") >= 5), F.lit(True)).alias("format_ok"), F.coalesce(F.bool_and(F.when(F.col("l_returnflag") != "R", F.col("l_discount") < 0.1)), F.lit(True)).alias("content_ok"),
    )
