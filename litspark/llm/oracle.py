"""DuckDB SQL of the queries that SQL expresses."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_NOT_BLANK = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p group by h)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 5 * (k // 4), 5))::bigint) >> (15 - 5 * (k % 4))) & 31)::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from p join f using (h)
""",
    "op4_near_duplicates": f"""
with recursive w as (select doc_id, {_NOT_BLANK} as ws from documents),
s as (
  select doc_id, unnest(case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w
),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.b as component_id, m.b = d.doc_id as kept
from documents d join (select a, min(b) as b from r group by a) m on m.a = d.doc_id left join n on n.doc_id = d.doc_id
""",
    "op6_contamination": f"""
with i as (select item_id, {_LETTERS} as ws from benchmark),
g as (
  select distinct item_id, least(13, len(ws)) as n, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2),
    lambda k: array_to_string(ws[k:k + least(13, len(ws)) - 1], ' '))) as g from i where len(ws) > 0
),
d as (select doc_id, {_LETTERS} as ws from documents),
l as (select distinct n from g),
o as (
  select doc_id, n, unnest(range(1, len(ws) - n + 2)) as k, ws from d cross join l where len(ws) >= n
),
h as (select o.doc_id, o.k, o.n, g.item_id from o join g on g.n = o.n and g.g = array_to_string(o.ws[o.k:o.k + o.n - 1], ' ')),
x as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from h) group by doc_id)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join x using (doc_id) left join t using (doc_id)
""",
}
