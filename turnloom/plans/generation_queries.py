"""Drafts, rules, messages, profiles, resumable evaluations and matrix products, each with its statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import block_matrix, drafts, evaluation_runs, grammar, rules, scale
from ..session import table
from . import form_rules
from .event_queries import _folder
from .registry import query

_U = "(('0x' || substring(md5(concat_ws('|', {}))  , 1, 13))::bigint)::double / 4503599627370496.0"


def _u(seed, *parts):
    return _U.format(", ".join([f"'{seed}'", *parts]))


# ---- seeded drafts

_SECTIONS = [("f", 0, "program"), ("f", 1, "personal"), ("f", 2, "contact"), ("f", 3, "history"), ("f", 4, "documents")]
_FIELDS = [
    ("f", "program", 0, "segment", "text", None, None, None), ("f", "personal", 0, "name", "text", None, None, None), ("f", "personal", 1, "balance", "number", None, "segment", "BUILDING"),
    ("f", "contact", 0, "phone", "text", None, None, None), ("f", "contact", 1, "address", "text", None, "name", "nobody"), ("f", "history", 0, "orders", "group", None, None, None),
    ("f", "history", 0, "status", "text", "orders", None, None), ("f", "history", 1, "scan", "file", "orders", None, None), ("f", "documents", 0, "id_card", "file", None, None, None),
]


def _draw_sql(k):
    """Columns a to z of a draw of ``seed``, step by step, as nested selects of one scalar."""
    m, half = 4294967296, "::hugeint"
    product = lambda x, y: f"((({x}){half} * ({y}){half}) % {m})::bigint"
    a = f"((seed + {k}::bigint * 1831565813) % {m})"
    return (
        f"(select xor(t2, t2 >> 14)::double / {m}.0 from (select xor((t + {product('xor(t, t >> 7)', 't | 61')}) % {m}, t) as t2 from "
        f"(select {product('xor(a, a >> 15)', 'a | 1')} as t from (select {a} as a))))"
    )


@query("seeded_drafts", f"""
with c as (select c_custkey, c_name, c_mktsegment, c_acctbal, 'p' || c_nationkey as c_phone, c_custkey::bigint as seed from customer),
d as (select *, {_draw_sql(1)} < 0.5 as personal, {_draw_sql(2)} < 0.5 as contact, {_draw_sql(3)} < 0.5 as history, {_draw_sql(4)} as r4 from c),
n as (select *, personal::int + contact::int + history::int as taken from d),
e as (select *, case when taken = 3 then floor(r4 * 3)::int end as gone, taken = 0 as none from n),
s as (select c_custkey, c_name, c_mktsegment, c_acctbal, c_phone, (personal or none) and coalesce(gone, -1) <> 0 as personal, contact and coalesce(gone, -1) <> 1 as contact, history and coalesce(gone, -1) <> 2 as history from e),
o as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as entry, o_orderstatus from orders)
select c_custkey as record_id, 'segment' as field_id, c_mktsegment as value from s
union all select c_custkey, 'name', c_name from s where personal
union all select c_custkey, 'balance', round(c_acctbal)::bigint::varchar from s where personal and c_mktsegment = 'BUILDING'
union all select c_custkey, 'phone', c_phone from s where contact
union all select c_custkey, 'orders.' || entry || '.status', o_orderstatus from s join o on o_custkey = c_custkey where history and entry < 3
""")
def seeded_drafts(spark, sf_dir):
    """Each customer's draft from a seed of their own; a field that depends on another, a group and files."""
    c = scale.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey")
    sections = spark.createDataFrame(_SECTIONS, "form_id string, section_pos int, section_id string")
    fields = spark.createDataFrame(_FIELDS, "form_id string, section_id string, field_pos int, field_id string, type string, parent_group string, condition_field string, condition_value string")
    own = {"segment": F.col("c_mktsegment"), "name": F.col("c_name"), "balance": F.round("c_acctbal").cast("long").cast("string"), "phone": F.concat(F.lit("p"), F.col("c_nationkey").cast("string")), "address": F.col("c_name"), "id_card": F.lit("x")}
    personas = c.select(F.col("c_custkey").alias("record_id"), F.explode(F.create_map(*(x for k, v in own.items() for x in (F.lit(k), v)))).alias("field_id", "value"))
    from pyspark.sql import Window as W

    entry = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record_id"), F.lit("orders").alias("group_id"), entry.alias("entry"), F.lit("status").alias("field_id"), F.col("o_orderstatus").alias("value")).where("entry < 3")
    asked = c.select(F.col("c_custkey").alias("record_id"), F.lit("f").alias("form_id"), F.col("c_custkey").cast("long").alias("seed"), F.lit(0.5).alias("ratio"))
    return drafts.draft_values(asked, sections, fields, personas, o)


# ---- rules

_PHONE = "lpad(cast(c_custkey as varchar(20)), cast(3 + c_custkey % 12 as int), '5')"
_RECORD = {
    "full_name": "c_name", "signature_name": "case c_custkey % 3 when 0 then '  ' || upper(c_name) || ' ' when 1 then c_name || '?' end", "signature_date": "case when c_custkey % 2 = 0 then '2024-05-01' else '2024-05-02' end",
    "dob": "case c_custkey % 4 when 0 then '1990-05-01' when 1 then '1990-05' when 2 then 'May 1990' else '' end", "address": "c_name", "emergency_contact_name": "c_mktsegment", "emergency_contact_relationship": "c_mktsegment",
    "phone": _PHONE, "emergency_contact_phone": "cast(c_custkey * 100000 as varchar(20))", "email": "lower(c_mktsegment) || case when c_custkey % 5 = 0 then ' ' else '' end || '@x.org'",
    "symptom_severity": "cast(cast(floor(c_acctbal / 500) as bigint) as varchar(20))", "alcohol_frequency": "case when c_nationkey < 20 then cast(c_nationkey as varchar(20)) end", "sleep_hours": "c_mktsegment",
    "has_insurance": "case when c_acctbal > 0 then 'true' else 'false' end", "consent_billing": "case when c_mktsegment = 'BUILDING' then 'true' end", "consent_treatment": "'true'", "self_pay": "case when c_custkey % 2 = 0 then 'true' when c_custkey % 7 = 0 then 'maybe' end",
    "insurance_provider": "c_mktsegment", "visit_reason": "case c_nationkey % 4 when 0 then 'specific_concern' when 1 then 'referral' when 2 then 'other' end", "referring_doctor": "case when c_custkey % 2 = 0 then c_name else '' end",
    "conditions": "case when c_nationkey % 2 = 0 then '[\"asthma\",\"' || lower(c_mktsegment) || '\"]' when c_nationkey % 3 = 0 then '[]' end", "alcohol_use": "case when c_nationkey > 10 then 'heavily' else 'never' end", "tobacco_use": "case when c_nationkey > 15 then 'current' end",
    "takes_medications": "'true'", "medications": "case when c_nationkey > 5 then '[\"a\"]' else '[]' end",
}


def _rule_sql():
    """The faults of a record in the order of the rules, as one statement over columns."""
    f = form_rules
    filled = lambda x: f"coalesce({x}, '') <> ''"
    no = lambda c: f"not coalesce({c}, false)"
    among = lambda x, values: f"coalesce({x} in ({', '.join(repr(v) for v in values)}), false)"
    number = lambda x: f"try_cast({x} as double)"
    out = [(x, "consent", no(f"{x} = 'true'")) for x in ("consent_treatment", "consent_privacy")]
    out += [("consent_billing", "consent", f"has_insurance = 'true' and {no("consent_billing = 'true'")}"), ("signature_name", "mismatch", f"{filled('signature_name')} and lower(trim(signature_name)) <> lower(trim(full_name))")]
    out += [("signature_date", "not_today", no("signature_date = '2024-05-01'"))] + [(x, "required", f"not ({filled(x)})") for x in f.REQUIRED]
    out += [(x, "too_long", f"length({x}) > {n}") for x, n in f.TEXTS.items()] + [(x, "format", rf"{filled(x)} and not regexp_matches({x}, '{f.DATE}')") for x in f.DATES]
    out += [("email", "format", rf"{filled('email')} and not regexp_matches(email, '{f.EMAIL}')")] + [(x, "digits", rf"{filled(x)} and length(regexp_replace({x}, '\D', '', 'g')) not between 10 and 15") for x in f.PHONES]
    out += [(x, "not_a_number", f"{filled(x)} and {number(x)} is null") for x in f.NUMBERS] + [(x, "range", f"{number(x)} not between {a} and {b}") for x, (a, b) in f.NUMBERS.items()]
    out += [(x, "option", f"{filled(x)} and not {among(x, o)}") for x, o in f.OPTIONS.items()]
    out += [(x, "option", f"len(from_json({x}, '[\"VARCHAR\"]')) > 0 and len(list_filter(from_json({x}, '[\"VARCHAR\"]'), lambda y: y not in ({', '.join(repr(v) for v in o)}))) > 0") for x, o in f.LISTS.items()]
    out += [(x, "not_a_boolean", f"{x} not in ('true', 'false')") for x in f.BOOLEANS]
    out += [(x, "due", f"{among(g, v)} and not ({filled(x)})") for g, v, xs in f.DUE for x in xs] + [("self_pay", "due", f"has_insurance = 'false' and {no("self_pay = 'true'")}")]
    out += [(x, "due", f"{among(g, v)} and {x} is null") for g, v, x in f.DUE_NUMBERS] + [(x, "due", f"{g} = 'true' and coalesce(len(from_json({x}, '[\"VARCHAR\"]')), 0) = 0") for g, x in f.DUE_LISTS]
    cases = ", ".join(f"case when {c} then '{x}:{p}' end" for x, p, c in out)
    fields = ", ".join(f"{_RECORD.get(x, 'null')}::varchar as {x}" for x in sorted(f.FIELDS))
    return f"with r as (select c_custkey, {fields} from customer) select c_custkey, concat_ws(',', {cases}) as problems from r"


@query("form_rules", _rule_sql())
def form_rules_(spark, sf_dir):
    """The value rules and the due fields of the visit form, about a hundred rules in one pass."""
    heads, nodes = rules.tree_rows([*form_rules.value_rules(), *form_rules.due_rules()])
    values = F.create_map(*(x for f, sql in _RECORD.items() for x in (F.lit(f), F.expr(sql))))
    c = scale.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey")
    records = c.select("c_custkey", values.alias("values"))
    found = rules.with_problems(records, "values", spark.createDataFrame(heads, rules.RULES), spark.createDataFrame(nodes, rules.NODES), form_rules.FIELDS, F.to_date(F.lit("2024-05-01")))
    return found.select("c_custkey", F.array_join(F.transform("problems", lambda p: F.concat_ws(":", p["field_id"], p["problem"])), ",").alias("problems"))


@query("masters_due", """
select o_orderkey, concat_ws(',', case when o_orderstatus = 'F' then 'gre_verbal' end, case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 'gre_quant' end, case when o_orderstatus = 'F' then 'gre_writing' end, case when o_orderstatus = 'F' then 'gre_date' end,
  case when o_orderstatus = 'O' and o_totalprice < 100000 then 'funding_type' end) as due from orders
""")
def masters_due(spark, sf_dir):
    """What another answer makes due on the masters form."""
    heads, nodes = rules.tree_rows(form_rules.masters_rules())
    o = F.col("o_orderstatus")
    given = {"gre_taken": F.when(o == "F", "true"), "gre_quant": F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")), "funding_interest": F.when(o == "O", "true").otherwise("false"), "funding_type": F.when(F.col("o_totalprice") >= 100000, "loan").otherwise("")}
    records = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(*(x for f, v in given.items() for x in (F.lit(f), v))).alias("values"))
    found = rules.with_problems(records, "values", spark.createDataFrame(heads, rules.RULES), spark.createDataFrame(nodes, rules.NODES), form_rules.MASTERS_FIELDS)
    return found.select("o_orderkey", F.array_join(F.transform("problems", lambda p: p["field_id"]), ",").alias("due"))


# ---- messages and profiles

_GRAMMAR = [
    ("message", 0, 3.0, ["<say>", " ", "{segment}", "."]), ("message", 1, 1.0, ["<open>", " ", "<say>", " ", "{segment}", ", ", "<extra>"]),
    ("open", 0, 1.0, ["hello,"]), ("open", 1, 1.0, ["well,"]), ("say", 0, 2.0, ["my segment is"]), ("say", 1, 1.0, ["I belong to"]), ("say", 2, 1.0, ["please put down"]),
    ("extra", 0, 1.0, ["nation ", "{nation}", "."]), ("extra", 1, 1.0, ["<open>", " balance ", "{balance}", "."]), ("extra", 2, 0.0, ["never"]),
]


def _at(place, *options):
    """SQL of the pick at a place among (upto, text)."""
    u = _u("g3", "c_custkey::varchar", f"'{place}'")
    return "(case " + " ".join(f"when {u} < {upto} then {text}" for upto, text in options) + " end)"


def _say(place):
    return _at(place, (0.5, "'my segment is'"), (0.75, "'I belong to'"), (2, "'please put down'"))


def _open(place):
    return _at(place, (0.5, "'hello,'"), (2, "'well,'"))


_EXTRA = _at("0.006", (0.5, "'nation ' || c_nationkey || '.'"), (2, f"{_open('0.006.000')} || ' balance ' || round(c_acctbal)::bigint || '.'"))


@query("generated_messages", f"""
select c_custkey, {_at("0", (0.75, f"{_say('0.000')} || ' ' || c_mktsegment || '.'"), (2, f"{_open('0.000')} || ' ' || {_say('0.002')} || ' ' || c_mktsegment || ', ' || {_EXTRA}"))} as message from customer
""")
def generated_messages(spark, sf_dir):
    """Messages from a grammar, with each customer's own values."""
    c = table(spark, sf_dir, "customer")
    slots = {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey").cast("string"), "balance": F.round("c_acctbal").cast("long").cast("string")}
    values = c.select("c_custkey", F.explode(F.create_map(*(x for k, v in slots.items() for x in (F.lit(k), v)))).alias("slot", "value"))
    return grammar.messages(c.select("c_custkey", F.lit("message").alias("symbol")), spark.createDataFrame(_GRAMMAR, "symbol string, alternative int, weight double, parts array<string>"), values, "c_custkey", "g3")


_TABLE = [
    ("tier", ["BUILDING"], "gold", 1.0), ("tier", ["BUILDING"], "plain", 1.0), ("tier", ["*"], "gold", 1.0), ("tier", ["*"], "plain", 3.0), ("channel", ["gold"], "call", 3.0), ("channel", ["gold"], "mail", 1.0), ("channel", ["plain"], "mail", 1.0),
    ("limit", ["*", "gold"], "high", 1.0), ("limit", ["BUILDING", "*"], "low", 1.0), ("limit", ["BUILDING", "*"], "none", 1.0),
]


@query("drawn_profiles", f"""
with t as (select c_custkey, c_mktsegment as segment, case when {_u('g10', 'c_custkey::varchar', "'tier'")} < case when c_mktsegment = 'BUILDING' then 0.5 else 0.25 end then 'gold' else 'plain' end as tier from customer)
select c_custkey, segment, tier, case when tier = 'plain' then 'mail' when {_u('g10', 'c_custkey::varchar', "'channel'")} < 0.75 then 'call' else 'mail' end as channel,
  case when segment = 'BUILDING' then case when {_u('g10', 'c_custkey::varchar', "'limit'")} < 0.5 then 'low' else 'none' end when tier = 'gold' then 'high' end as "limit" from t
""")
def drawn_profiles(spark, sf_dir):
    """Profiles whose keys depend on one another and on the customer's segment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    options = spark.createDataFrame(_TABLE, "name string, given array<string>, option string, weight double")
    return grammar.drawn_profiles(c, options, {"segment": [], "tier": ["segment"], "channel": ["tier"], "limit": ["segment", "tier"]}, "c_custkey", "g10")


# ---- evaluations and matrices


@query("resumed_evaluation", "select doc_id as case_id, (length(text) % 101)::double / 100 as score from documents where doc_id % 13 <> 5")
def resumed_evaluation(spark, sf_dir):
    """S24, halt: a run that stops at its first failures, one that is ended early, and one that does the rest."""
    folder = _folder(spark, "evaluation")
    cases = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text")
    score = lambda fails: lambda rows: rows.select("case_id", F.when(~fails, (F.length("text") % 101).cast("double") / 100).alias("score"))
    broken = F.col("case_id") % 13 == 5
    try:
        evaluation_runs.evaluate(cases, score(broken), folder, batches=4)
    except evaluation_runs.Halted:  # the failures of the first batch stay without a score
        cases = cases.where(~broken)
    evaluation_runs.evaluate(cases, score(F.lit(False)), folder, batches=4, stop_after=2)
    evaluation_runs.evaluate(cases, score(F.lit(False)), folder, batches=4)
    return evaluation_runs.scored(spark, folder, 4).select("case_id", "score")


@query("gram_matrix", """
with e as (select vec_id, unnest(embedding) as x, unnest(generate_series(0, len(embedding) - 1)) as c from embeddings), q as (select vec_id, c, round(x::double * 100) as x from e)
select a.c::bigint as "row", b.c::bigint as col, sum(a.x * b.x)::double as value from q a join q b using (vec_id) group by all having sum(a.x * b.x) <> 0
""")
def gram_matrix(spark, sf_dir):
    """2.11: the embeddings' transpose times themselves, in blocks, on whole numbers."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 100)).alias("v"))
    b = block_matrix.blocks(e, "vec_id", "v")
    return block_matrix.product(b, b, transpose=True)


@query("gram_norms", """
with e as (select vec_id, unnest(embedding) as x, unnest(generate_series(0, len(embedding) - 1)) as c from embeddings), q as (select vec_id, c, round(x::double * 100) as x from e),
g as (select a.c, b.c, sum(a.x * b.x) as v from q a join q b using (vec_id) group by all)
select round(sqrt(sum(v * v)), 2) as frobenius, max(abs(v)) as max_abs, round(sum(abs(v)) / ((select count(distinct c) from e) ** 2), 4) as mean_abs from g
""")
def gram_norms(spark, sf_dir):
    """2.11: the norms of that product."""
    wide = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 1
    n = block_matrix.matrix_norms(gram_matrix(spark, sf_dir), wide, wide)
    return n.select(F.round("frobenius", 2).alias("frobenius"), "max_abs", F.round("mean_abs", 4).alias("mean_abs"))
