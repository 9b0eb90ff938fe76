"""DuckDB statements for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from .secret_scan import RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
b as (select item_id, w, least(10, len(w)) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
bg as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select *, unnest(generate_series(1, len(w) - n + 1)) as i from b)),
dg as (select rid, i, n, array_to_string(w[i:i + n - 1], ' ') as g from (select rid, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from bg) where len(w) >= n)),
hit as (select rid, i, dg.n, item_id from dg join bg on dg.n = bg.n and dg.g = bg.g),
cov as (select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(i, i + n - 1)) as p from hit) group by rid),
it as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (rid) left join it using (rid)
"""

_RULES = ", ".join(f"({k}, '{r.kind}', {r.at_least})" for k, r in enumerate(RULES))


def _matches() -> str:
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"select rid, {k} as k, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}', 0) as ms, regexp_extract_all(t, '{p}', {r.group}) as gs from d")
    return " union all ".join(parts)


SECRETS = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents), m as ({_matches()}),
e as (select rid, k, unnest(generate_series(1, len(ms))) as i, gaps, ms, gs from m where len(ms) > 0),
x as (select rid, k, i, length(gaps[i]) as gap, length(ms[i]) as n, length(gs[i]) as g from e),
p as (select rid, k, n, g, sum(gap + n) over (partition by rid, k order by i) as stop from x),
s as (select rid, k, kind, stop - n as start, stop from p join (values {_RULES}) r(k, kind, at_least) using (k) where g >= at_least),
a as (select rid, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) filter (where k < 3) as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) as spans from s group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (rid)
"""

WARC = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest, case when page_id <> first_id then 'revisit' else 'response' end as record_type, case when page_id <> first_id then first_id end as refers_to from p left join f using (payload_digest)
"""

DIVERGENCE = f"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, {_LOWER} as t from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as (select lang, term from w group by 1, 2 having count(distinct rid) >= 30),
v as (select lang, (select count(*) from k where k.lang = l.lang)::hugeint as v from (select distinct lang from d) l),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*)::hugeint as n from w join k using (lang, term) group by 1, 2, 3),
full_c as (select g.lang, g.source, k.term, coalesce(n, 0)::hugeint as n from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p from full_c join v using (lang)),
u as (select lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang) + 5 * v) as q from (select lang, term, sum(n)::hugeint as n from full_c group by 1, 2) join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, coalesce((select sum(abs(x.p - y.p)) from p x join p y on x.term = y.term and x.lang = y.lang where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source),
terms as (select lang, source, term as item, (p - q)::bigint as value from p join u using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all select * from (select lang, source, 'term' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms) where rank <= 50
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = f"""
with d as (select row_number() over () as rid, doc_id, {_TERMS} as w from documents),
s as (select count(*)::bigint as n, sum(len(w))::bigint as l from d where len(w) > 0),
p as (select rid, term, count(*)::bigint as tf from (select rid, unnest(w) as term from d) group by 1, 2),
df as (select term, count(*)::bigint as df from p group by 1),
q as (select item_id, term, count(*)::bigint as qtf from (select item_id, unnest({_TERMS}) as term from benchmark) group by 1, 2),
w as (select item_id, term, qtf, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)))::bigint as w from q join df using (term), s),
m as (select rid, doc_id, 100 - 25 + (25 * len(w)::bigint * n) // l as m from d, s where len(w) > 0),
x as (select item_id, rid, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from w join p using (term) join m using (rid) group by 1, 2),
r as (select item_id, doc_id, score, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from x join m using (rid) where score > 0)
select item_id, rank, doc_id, score from r where rank <= 20
"""

MINHASH = f"""
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select distinct rid, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i + 3], ' ') end as s from (select rid, w, unnest(generate_series(1, greatest(len(w) - 3, least(len(w), 1)))) as i from d)),
n as (select rid, count(*)::bigint as n from g group by 1),
i as (select a.rid as a, b.rid as b, count(*)::bigint as shared from g a join g b on a.s = b.s and a.rid < b.rid group by 1, 2),
l as (select a, b from i join n x on x.rid = a join n y on y.rid = b where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
r as (select rid, rid as other from d union select r.rid, e.b from r join e on r.other = e.a),
c as (select r.rid, min(d.doc_id) as component_id from r join d on d.rid = r.other group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from d join c using (rid) left join n using (rid)
"""

ORACLE = {"op11_minhash": MINHASH, "op12_lexical": LEXICAL, "op13_divergence": DIVERGENCE, "op1_decontaminate": DECONTAMINATE, "op7_secrets": SECRETS, "op9_warc": WARC}
