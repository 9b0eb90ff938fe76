"""Queries over documents, labels, benchmark, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import actions, markers, scores, text
from ..operators import aggregates, sampling, vectors
from ..session import table
from .registry import query

# Fixed values for the alert and grounding queries: keyword, severity; option value, spellings.
ALERTS = (("the", 3), ("tion", 8), ("password", 9), ("ment", 8), ("eau", 9))
LABELS = {"src1": ["the", "de"], "src2": ["ung", "tion"], "src3": ["ment", "ea"]}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("bucket_histogram", """
select case when n_chars < 500 then '<500' when n_chars < 2000 then '500-1999' when n_chars < 8000 then '2000-7999' else '8000+' end as bucket, count(*)::bigint as n from documents group by 1
""")
def bucket_histogram(spark, sf_dir):
    n = F.col("n_chars")
    bucket = F.when(n < 500, "<500").when(n < 2000, "500-1999").when(n < 8000, "2000-7999").otherwise("8000+")
    return _docs(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("combo_topk", """
select source, lang, n, rank from (select source, lang, count(*)::bigint as n, row_number() over (partition by source order by count(*) desc, lang)::int as rank from documents group by source, lang) where rank <= 3
""")
def combo_topk(spark, sf_dir):
    return aggregates.top_within(_docs(spark, sf_dir), "source", "lang", 3)


@query("stats_grouping_sets", """
select source, lang, count(*)::bigint as n, floor(100 * count(*) / (select count(*) from documents))::bigint as pct, sum(n_chars)::bigint as chars from documents group by grouping sets ((source), (lang), ())
""")
def stats_grouping_sets(spark, sf_dir):
    """A4: several groupings over one scan."""
    docs = _docs(spark, sf_dir)
    sets = docs.groupingSets([["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    total = F.max("n").over(W.partitionBy())
    return sets.select("source", "lang", "n", F.floor(100 * F.col("n") / total).alias("pct"), "chars")


@query("size_percentiles", """
select lang, len(l)::bigint as n, l[1] as lowest, l[len(l) // 2 + 1] as p50, l[floor(len(l) * 0.9)::int + 1] as p90, l[len(l)] as highest from (select lang, list_sort(list(n_chars)) as l from documents group by lang)
""")
def size_percentiles(spark, sf_dir):
    return aggregates.index_percentiles(_docs(spark, sf_dir), ["lang"], "n_chars")


@query("dedup_first", """
select doc_id, lang, source from (select *, row_number() over (partition by lower(trim(text)) order by doc_id) as rn from documents) where rn = 1
""")
def dedup_first(spark, sf_dir):
    """U6; the key is the text's digest, so the shuffle carries no texts."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "source", F.sha2(F.lower(F.trim("text")), 256).alias("k"))
    return sampling.first_of(docs, F.col("k"), "doc_id").select("doc_id", "lang", "source")


@query("leak_free_train", """
select d.doc_id, d.lang from documents d anti join (select lower(trim(text)) as k from benchmark) b on lower(trim(d.text)) = b.k
""")
def leak_free_train(spark, sf_dir):
    """J6."""
    key = lambda df: df.withColumn("k", F.sha2(F.lower(F.trim("text")), 256))
    return sampling.without(key(_docs(spark, sf_dir)), key(table(spark, sf_dir, "benchmark")), ["k"]).select("doc_id", "lang")


@query("strat_sample", """
with r as (select doc_id, lang, row_number() over (partition by lang order by md5(concat_ws('|', 's1', doc_id::varchar)), doc_id) as rank from documents)
select doc_id, lang, rank::int as rank from r where rank <= case lang when 'en' then 20 when 'de' then 10 when 'fr' then 10 else 5 end
""")
def strat_sample(spark, sf_dir):
    return sampling.stratified(_docs(spark, sf_dir), "lang", "doc_id", "s1", {"en": 20, "de": 10, "fr": 10, "es": 5}).select("doc_id", "lang", F.col("rank").cast("int").alias("rank"))


@query("round_robin_sample", """
with r as (select doc_id, source, row_number() over (partition by source order by md5(concat_ws('|', 's2', doc_id::varchar)), doc_id) as rank from documents)
select doc_id, source, rank::int as rank from r order by rank, source limit 50
""")
def round_robin_sample(spark, sf_dir):
    return sampling.round_robin(_docs(spark, sf_dir), "source", "doc_id", "s2", 50).select("doc_id", "source", "rank")


@query("disjoint_samples", """
with r as (select doc_id, source, row_number() over (partition by source order by md5(concat_ws('|', 's3', doc_id::varchar)), doc_id) as rank from documents), t as (select *, row_number() over (order by rank, source) as turn from r)
select doc_id, source, case when turn <= 60 then 'train' else 'val' end as split from t where turn <= 90
""")
def disjoint_samples(spark, sf_dir):
    return sampling.two_samples(_docs(spark, sf_dir), "source", "doc_id", "s3", 60, 30).select("doc_id", "source", "split")


@query("ratio_split", """
with r as (select doc_id, lang, count(*) over (partition by lang) as n, row_number() over (partition by lang order by md5(concat_ws('|', 's4', doc_id::varchar)), doc_id) as rank from documents)
select doc_id, lang, case when rank <= greatest(1, floor(n * 0.1)) then 'val' else 'train' end as split from r
""")
def ratio_split(spark, sf_dir):
    return sampling.ratio_split(_docs(spark, sf_dir), "lang", "doc_id", "s4", 0.1).select("doc_id", "lang", "split")


@query("capped_class", """
with r as (select doc_id, lang, row_number() over (partition by lang order by md5(concat_ws('|', 's5', doc_id::varchar)), doc_id) as rank from documents) select doc_id, lang from r where lang <> 'en' or rank <= 100
""")
def capped_class(spark, sf_dir):
    """The cap is the feature."""
    return sampling.capped(_docs(spark, sf_dir), "lang", "en", "doc_id", "s5", 100).select("doc_id", "lang")


@query("limit_across", """
with r as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as rank from documents) select doc_id, lang from r where rank <= 10 order by lang, doc_id limit 40
""")
def limit_across(spark, sf_dir):
    return sampling.limit_across(_docs(spark, sf_dir), "lang", "doc_id", 40, 4).select("doc_id", "lang")


@query("weighted_choice", """
with u as (select doc_id, (('0x' || substring(md5(concat_ws('|', 's6', doc_id::varchar)), 1, 13))::bigint)::double / 4503599627370496.0 as u from documents)
select doc_id, (case when u < 0.4 then 0 when u < 0.75 then 1 else 2 end)::int as choice from u
""")
def weighted_choice(spark, sf_dir):
    """K15, G7."""
    return _docs(spark, sf_dir).select("doc_id", sampling.weighted_choice(sampling.unit_interval("s6", "doc_id"), [40, 35, 25]).alias("choice"))


@query("slugs", """
select doc_id, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 50) as slug from documents
""")
def slugs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("text_sanity", r"""
with t as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents)
select doc_id, length(t)::int as n_chars, length(t) > 0 as nonempty, length(t) between 5 and 2000 as reasonable_length, not regexp_matches(t, '\[\[\s*##|---actions---') as no_format_leak,
  length(t) > 0 and not regexp_matches(t, '\[\[\s*##|---actions---') as ok from t
""")
def text_sanity(spark, sf_dir):
    """M9, F16."""
    return _docs(spark, sf_dir).select("doc_id", scores.text_sanity(F.col("text")).alias("s")).select("doc_id", "s.*")


FAILURES = {"too_short": "n_chars < 300", "too_long": "n_chars > 8000", "has_pipe": "contains(text, ' | ')", "shouting": "text = upper(text)", "repeats_the": "contains(text, 'the the')"}
_LABELS_SQL = ", ".join(f"case when {c} then '{n}' end" for n, c in FAILURES.items())


def _failures():
    return F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in FAILURES.items())))


@query("failure_buckets", f"""
select bucket, count(*)::bigint as n from (select unnest(list_filter([{_LABELS_SQL}], lambda x: x is not null)) as bucket from documents) group by bucket
""")
def failure_buckets(spark, sf_dir):
    """Several labels per record."""
    return _docs(spark, sf_dir).select(F.explode(_failures()).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("failure_examples", f"""
select bucket, count(*)::bigint as n, min(doc_id) as first_doc_id, arg_min(lang, doc_id) as lang from (select doc_id, lang, unnest(list_filter([{_LABELS_SQL}], lambda x: x is not null)) as bucket from documents) group by bucket
""")
def failure_examples(spark, sf_dir):
    """A49."""
    return aggregates.first_examples(_docs(spark, sf_dir).withColumn("b", _failures()), "b", "doc_id", "lang")


@query("tag_means", f"""
select coalesce(tag, '(legacy)') as tag, count(*)::bigint as n, round(avg(n_chars), 6) as mean from (
  select unnest(case when len(l) = 0 then [null] else l end) as tag, n_chars from (select n_chars, list_filter([{_LABELS_SQL}], lambda x: x is not null) as l from documents)) group by 1
""")
def tag_means(spark, sf_dir):
    """A20."""
    return aggregates.mean_by_tag(_docs(spark, sf_dir).select(F.expr("n_chars"), _failures().alias("tags")), "tags", "n_chars")


@query("keyword_alerts", """
select doc_id, keyword, severity from documents, (values {}) k(keyword, severity) where severity >= 8 and contains(lower(text), keyword)
""".format(", ".join(f"('{k}', {s})" for k, s in ALERTS)))
def keyword_alerts(spark, sf_dir):
    """one alert per hit."""
    hit = F.array(*(F.when(F.contains(F.col("low"), F.lit(k)), F.struct(F.lit(k).alias("keyword"), F.lit(s).alias("severity"))) for k, s in ALERTS if s >= 8))
    return _docs(spark, sf_dir).select("doc_id", F.lower("text").alias("low")).select("doc_id", F.explode(F.array_compact(hit)).alias("a")).select("doc_id", "a.*")


@query("leak_check", """
select doc_id, contains(lower(text), lower(left(source, 3))) and not contains(lower(lang || ' ' || doc_id), lower(left(source, 3))) as leaked from documents
""")
def leak_check(spark, sf_dir):
    """F15 with the source's first letters for a name."""
    names = F.array(F.left("source", F.lit(3)))
    return _docs(spark, sf_dir).select("doc_id", text.name_leak(F.col("text"), F.concat_ws(" ", "lang", F.col("doc_id").cast("string")), names).alias("leaked"))


@query("grounding_check", """
with v as (select doc_id, lower(text) as said, source as low from documents)
select doc_id, case low {} else contains(said, low) end as grounded from v
""".format(" ".join(f"when '{k}' then {' or '.join(f'contains(said, {chr(39)}{x}{chr(39)})' for x in v)}" for k, v in LABELS.items())))
def grounding_check(spark, sf_dir):
    """F11 for a short value with known spellings."""
    labels = F.create_map(*(x for k, v in LABELS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("source")]
    return _docs(spark, sf_dir).select("doc_id", scores.grounded(F.col("source"), F.col("text"), labels).alias("grounded"))


@query("actions_roundtrip", r"""
select case when doc_id = 0 then 'greeting' when doc_id % 4 = 0 then 'question_no_actions' when doc_id % 4 = 3 then 'multi_field' when doc_id % 4 = 1 then 'single_field' else 'ask_choice_only' end as category, count(*)::bigint as n, sum(case when doc_id % 4 = 1 then 1 when doc_id % 4 = 3 then 3 else 0 end)::bigint as n_fields
from documents group by 1
""")
def actions_roundtrip(spark, sf_dir):
    """P48, then P1, P10, P11: replies composed, parsed and classified."""
    k = F.col("doc_id") % 4
    field = lambda i: f'{{"field_id":"f{i}","value":"v"}}'
    body = F.when(k == 1, f'[{{"type":"set_fields","fields":[{field(1)}]}}]').when(k == 2, '{"type":"ask_choice","options":["a",{"label":"b"}]}').when(k == 3, f'[{{"type":"set_fields","fields":[{field(1)},{field(2)},{field(3)}]}},7]')
    reply = F.when(k == 0, F.lit("nothing to do")).otherwise(actions.compose(F.lit("done"), body))
    parsed = _docs(spark, sf_dir).select("doc_id", reply.alias("reply")).select("doc_id", actions.parse_actions(F.col("reply")).alias("a"))
    parsed = parsed.select("doc_id", F.size("a").alias("n"), actions.types(F.col("a")).alias("types"), actions.fields_set(F.col("a")).alias("fields"))
    category = actions.category(F.col("doc_id"), F.col("n") > 0, F.lit(""), F.size("fields"), F.col("types"))
    return parsed.select(category.alias("category"), F.size("fields").alias("k")).groupBy("category").agg(F.count("*").alias("n"), F.sum("k").alias("n_fields"))


@query("marker_report", r"""
select doc_id, doc_id % 3 <> 0 as has_completed, (case when doc_id % 2 = 0 then '' else 'field_values' end) as missing, (doc_id % 3 <> 0 and doc_id % 2 = 0) as format_ok, (case when doc_id % 2 = 0 and doc_id % 3 <> 0 then 2.0 else 0.0 end)::double as reward, '["a","' || lang || '"]' as ids from documents
""")
def marker_report(spark, sf_dir):
    """P24-P30, M14 on replies written in marker format."""
    ids = F.concat(F.lit('["a","'), F.col("lang"), F.lit('"]'))
    reply = F.concat(F.lit("[[ ## field_ids ## ]]\n"), ids, F.when(F.col("doc_id") % 2 == 0, '\n\n[[ ## field_values ## ]]\n["1","2"]').otherwise(""), F.when(F.col("doc_id") % 3 != 0, "\n\n[[ ## completed ## ]]").otherwise(""))
    df = _docs(spark, sf_dir).select("doc_id", reply.alias("r"))
    expected = F.array(F.lit("field_ids"), F.lit("field_values"))
    df = df.select("doc_id", markers.report(F.col("r"), expected).alias("m"), markers.format_reward(F.col("r")).alias("reward"), markers.value(F.col("r"), "field_ids").alias("ids"))
    return df.select("doc_id", "m.has_completed", F.array_join("m.missing", ",").alias("missing"), "m.format_ok", "reward", "ids")


@query("tag_extract", r"""
select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::int as n_links from pages
""")
def tag_extract(spark, sf_dir):
    """S14-S16 and P25 on pages."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("n_links"),
    )


@query("flag_confusion", "select quality, toxic, count(*)::bigint as n from labels group by quality, toxic")
def flag_confusion(spark, sf_dir):
    return aggregates.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


_POLARITY_SQL = " union all ".join(f"select '{n}' as flag, ({g}) as gold, ({p}) as pred from labels join documents using (doc_id)" for n, g, p in (("quality", "quality = 1", "n_chars >= 500"), ("toxic", "toxic = 1", "n_chars % 7 = 0")))


@query("polarity_recall", f"""
with f as ({_POLARITY_SQL}), c as (select flag, count(*) filter (where gold and pred) as tp, count(*) filter (where gold and not pred) as fn, count(*) filter (where not gold and not pred) as tn, count(*) filter (where not gold and pred) as fp from f group by flag)
select flag, tp::bigint as tp, fn::bigint as fn, tn::bigint as tn, fp::bigint as fp, round(case when tp + fn > 0 then tp / (tp + fn) end, 6)::double as pos_recall, round(case when tn + fp > 0 then tn / (tn + fp) end, 6)::double as neg_recall from c
""")
def polarity_recall(spark, sf_dir):
    """A10 with rules on the length as predictions."""
    df = table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    return aggregates.polarity(df, {"quality": (F.col("quality") == 1, F.col("n_chars") >= 500), "toxic": (F.col("toxic") == 1, F.col("n_chars") % 7 == 0)})


@query("confusion_pivot", """
select lang, count(*) filter (where quality = 0)::bigint as "0", count(*) filter (where quality = 1)::bigint as "1" from labels join documents using (doc_id) group by lang
""")
def confusion_pivot(spark, sf_dir):
    """A11."""
    df = table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return aggregates.pivoted(df, "lang", "quality", [0, 1], F.count("doc_id")).fillna(0)


@query("flag_combinations", """
select concat_ws('+', case when quality = 1 then 'quality' end, case when toxic = 1 then 'toxic' end) as combo, count(*)::bigint as n from labels group by 1
""")
def flag_combinations(spark, sf_dir):
    """A21."""
    return aggregates.combinations(table(spark, sf_dir, "labels"), {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 1})


@query("case_lookup", """
select d.doc_id, l.quality, l.doc_id is null as missing from documents d left join labels l using (doc_id)
""")
def case_lookup(spark, sf_dir):
    """Cases with what is known of them, and whether nothing is."""
    known = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("known"))
    return _docs(spark, sf_dir).select("doc_id").join(known, "doc_id", "left").select("doc_id", "quality", F.col("known").isNull().alias("missing"))


@query("router_scores", """
with f as (select doc_id, (quality = 1)::int + 2 * (toxic = 1)::int as g, (n_chars >= 500)::int + 2 * (n_chars % 7 = 0)::int as p from labels join documents using (doc_id)),
c as (select doc_id, bit_count(g & p) as tp, bit_count(p & ~g & 3) as fp, bit_count(g & ~p & 3) as fn from f)
select doc_id, round(case when tp + fp + fn = 0 then 1.0 when tp = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end, 6)::double as f1 from c
""")
def router_scores(spark, sf_dir):
    """M1 on two flags."""
    df = table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    true = lambda a, b: F.array_compact(F.array(F.when(a, F.lit("quality")), F.when(b, F.lit("toxic"))))
    return df.select("doc_id", F.round(scores.router_f1(true(F.col("quality") == 1, F.col("toxic") == 1), true(F.col("n_chars") >= 500, F.col("n_chars") % 7 == 0)), 6).alias("f1"))


@query("vector_norms", """
select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm, round(list_max(list_transform(embedding, lambda x: abs(x::double))), 6) as max_abs, round(list_avg(list_transform(embedding, lambda x: abs(x::double))), 6) as mean_abs from embeddings
""")
def vector_norms(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(e), 5).alias("norm"), F.round(vectors.max_abs(e), 6).alias("max_abs"), F.round(vectors.mean_abs(e), 6).alias("mean_abs"))


_CENTRE_SQL = "select label, list(m order by i) as centre from (select label, i, avg(x::double) as m from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i) group by label"


@query("vector_drift", f"""
with c as ({_CENTRE_SQL}), d as (select vec_id, list_transform(list_zip(embedding, centre), lambda z: z[1]::double) as a, centre as b from embeddings join c using (label)),
s as (select vec_id, sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as dist, sqrt(list_sum(list_transform(a, lambda x: x * x))) as na, sqrt(list_sum(list_transform(b, lambda x: x * x))) as nb, list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) as ab from d)
select vec_id, round(dist, 5) as distance, round(dist / na, 5) as relative, round(ab / (na * nb), 5) as cosine from s
""")
def vector_drift(spark, sf_dir):
    """L2, relative change and cosine against the mean vector of the label."""
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))
    a, b = F.col("embedding"), F.col("centre")
    return e.join(centres, "label").select("vec_id", F.round(vectors.l2(a, b), 5).alias("distance"), F.round(vectors.relative_change(a, b), 5).alias("relative"), F.round(vectors.cosine(a, b), 5).alias("cosine"))


@query("component_summary", """
with v as (select label, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings)
select label, count(*)::bigint as n, round(avg(norm), 5) as mean, round(max(norm), 5) as highest, round(min(norm), 5) as lowest, round(sum(norm), 5) as total from v group by label
""")
def component_summary(spark, sf_dir):
    """A35, A36."""
    return vectors.component_summary(table(spark, sf_dir, "embeddings").withColumn("norm", vectors.norm(F.col("embedding"))), "label", "norm")


@query("module_examples", """
with t as (select doc_id, doc_id % 2 = 0 as a, doc_id % 3 = 0 as b, doc_id % 5 = 0 as c from documents)
select module, count(*)::bigint as n from (select unnest(list_filter(['action_router', case when a then 'data_extractor' end, case when b then 'choice_builder' end, case when c then 'review_builder' end, 'text_responder'], lambda x: x is not null)) as module from t) group by module
""")
def module_examples(spark, sf_dir):
    """G1."""
    from ..operators.generation import module_examples as examples

    d = F.col("doc_id")
    turns = _docs(spark, sf_dir).select("doc_id", F.struct((d % 2 == 0).alias("has_new_data"), (d % 3 == 0).alias("needs_choice"), (d % 5 == 0).alias("wants_review")).alias("flags"), F.col("lang").alias("user_message"), F.col("source").alias("output"))
    return examples(turns, "flags", "output").groupBy("module").agg(F.count("*").alias("n"))
