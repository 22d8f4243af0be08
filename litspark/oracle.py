"""DuckDB SQL for every query of ``queries``, written from the operators' definitions."""

from __future__ import annotations

from litspark import fixtures as fx
from litspark import schema
from litspark.queries import BATCH_QUERIES, TEXT_QUERY

ORACLE: dict[str, str] = {}


def _list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _chars(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


MARKS = " and ".join(f"not contains(upper(title), '{m.upper()}')" for m in schema.REVIEW_MARKS)

PERIOD = (
    "case when year is null then null "
    + " ".join(f"when year < {hi} then '{n}'" for n, _, hi in schema.PERIODS if hi is not None)
    + f" else '{schema.PERIODS[-1][0]}' end"
)

# ---- building blocks: (name, body); a query names the blocks it needs in order

RAW = """papers_raw as (
 select doc_id as ord, doc_id as paper_id,
  split_part(text, '.', 1) || case when n_chars % 97 = 13 then ' pp. 12-34'
   when n_chars % 89 = 7 then chr(10) || '[Working Title]'
   when n_chars % 5 = 1 then chr(10) || source else '' end as title,
  nullif('Author ' || (doc_id % 41), 'Author 3') as authors,
  case when n_chars % 11 <> 4 then text end as abstract,
  case when n_chars % 13 = 5 then null when n_chars % 17 = 6 then 'http://hdl.handle.net/'
   else 'https://papers.example.org/' || (n_chars % 997) end as url,
  source as journal,
  cast(nullif(1985 + n_chars % 43, 2027) as smallint) as year
 from documents)"""

CLEAN = f"""{RAW},
reviewed as (select * from papers_raw where year is not null and title is not null and {MARKS}),
titled as (select * replace (replace(regexp_replace(title, '\\n\\[.*?\\]', '', 'g'), chr(10), ' ') as title) from reviewed),
unique_papers as (select * from titled
 qualify url is null or row_number() over (partition by title, url order by ord) = 1),
cleaned as (select * replace (case when url in ({_list(schema.BROKEN_LINKS)}) then null else url end as url)
 from unique_papers)"""

PAPERS = f"""{CLEAN},
papers as (select *, {PERIOD} as period, title || ' ' || coalesce(abstract, '') as text,
 md5(concat_ws(':', '42', paper_id)) as h from cleaned)"""

CELLS = f"""cells as (select doc_id as ord,
 case when n_chars % 4 = 0 then ([{_list(schema.NA_TOKENS)}])[1 + (n_chars // 4) % {len(schema.NA_TOKENS)}] else source end as journal,
 case n_chars % 5 when 0 then (1985 + n_chars % 43) || '.0' when 1 then (1985 + n_chars % 43) || '.5'
  when 2 then lang when 3 then cast(1985 + n_chars % 43 as varchar) end as year_text
 from documents)"""

VECTORS = f"""{PAPERS},
vecs as (select vec_id as paper_id, embedding, label,
 list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
stored as (select p.paper_id, p.ord, p.year, p.period, v.embedding, v.e, 0 as batch from papers p join vecs v using (paper_id)),
halves as (select *, case when row_number() over (partition by period order by ord)
  <= count(*) over (partition by period) // 2 then 1 else 2 end as part from stored)"""


def _entries(source: str, created: str) -> str:
    return f"""select file_entry, period, num_papers, min_year, max_year,
 cast(coalesce(sum(num_papers) over (partition by period order by file_entry rows between unbounded preceding and 1 preceding), 0) as bigint) as first_index,
 cast(coalesce(sum(num_papers) over (partition by period order by file_entry rows between unbounded preceding and 1 preceding), 0) + num_papers - 1 as bigint) as last_index,
 file_size_mb, {created} as created, cast(0 as bigint) as papers_added
 from (select case when period = 'b2000' then period || '_part' || part else period end as file_entry, period,
  count(*) as num_papers, min(year) as min_year, max(year) as max_year,
  sum(len(embedding) * 2) / 1048576.0 as file_size_mb from {source} group by 1, 2)"""


MANIFEST = f"""{VECTORS},
entries as ({_entries('halves', "timestamp '2026-03-01 00:00:00' + to_minutes(cast(num_papers * 2 as bigint))")}),
expected as (select unnest([{_list(schema.FILE_ENTRIES)}]) as file_entry),
sources as (select period, timestamp '2026-03-01 00:00:00' + to_minutes(count(*)) as mtime from papers group by period),
stale as (select s.period, bool_or(e.created is null or s.mtime > e.created) as stale
 from sources s join expected x on split_part(x.file_entry, '_part', 1) = s.period
 left join entries e on e.file_entry = x.file_entry group by s.period),
counts as (select period, count(*) as n from papers group by period),
versus as (select coalesce(e.period, c.period) as period, cast(coalesce(m, 0) as bigint) as manifest_papers,
 coalesce(n, 0) as actual_papers, coalesce(m, 0) = coalesce(n, 0) as passed
 from (select period, sum(num_papers) as m from entries group by period) e full join counts c on c.period = e.period)"""

CREATED = "strftime(created, '%Y-%m-%d %H:%M:%S') as created"
ENTRY_OUT = (
    "file_entry, period, num_papers, min_year, max_year, first_index, last_index, "
    f"round(file_size_mb, 6) as file_size_mb, {CREATED}, papers_added"
)


def _where(alias: str = "") -> str:
    return f"{alias}journal in ({_list(fx.GROUPS['general'])}) and {alias}year between 1990 and 2022"


INFO = "upper(text)"


def _matches(groups: list[list[str]], info: str = INFO) -> str:
    parts = ["(" + " or ".join(f"contains({info}, upper('{t}'))" for t in g) + ")" for g in groups]
    return " and ".join(parts) if parts else "true"


DOT = "list_dot_product(v.e, q.e)"
REAL_ABSTRACT = f"length(trim(abstract, {_chars(schema.BLANKS)})) > 50"


def _query_vector(paper_id: int = 0) -> str:
    return f"q as (select list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where vec_id = {paper_id})"


SCORED = f"""{VECTORS}, {_query_vector()},
scored as (select v.paper_id, round({DOT}, 9) as similarity from vecs v, q),
found as (select p.*, s.similarity from papers p join scored s using (paper_id)
 where s.similarity >= 0.1 and {_where('p.')} and {REAL_ABSTRACT})"""

HALF = """case when x = 0 then x else
 round_even(x / pow(2.0, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) end"""

ELEMENTS = """elements as (select paper_id, pos - 1 as pos, x from (
 select vec_id as paper_id, unnest(range(1, len(embedding) + 1)) as pos, cast(unnest(embedding) as double) as x from embeddings))"""


def _hashed(name: str, source: str, key: str, body: str) -> str:
    return f"""{name}_words as (select {key}, md5(w) as code from (
  select {key}, unnest(regexp_extract_all(lower({body}), '{schema.TOKEN_PATTERN}')) as w from {source})),
{name}_places as (select {key}, cast(cast('0x' || substr(code, 1, 8) as bigint) % {fx.DIM} as integer) as pos,
  sum(1 - 2 * (cast('0x' || substr(code, 9, 1) as bigint) % 2)) as cnt from {name}_words group by 1, 2),
{name}_weights as (select {key}, pos, cnt / sqrt(sum(cnt * cnt) over (partition by {key})) as weight
  from {name}_places where cnt <> 0)"""


def _number(h: str, digits: int = 15) -> str:
    return f"cast('0x' || substr({h}, 1, {digits}) as bigint)"


def _draw(what: str, draw: str, n: str) -> str:
    return f"({_number(f'''md5(concat_ws(':', '42', '{what}', {draw}))''')} % ({n}))"


VOCAB = f"""{PAPERS},
sampled as (select paper_id, text from papers),
kept_words as (select paper_id, list_filter(regexp_extract_all(lower(text), '{schema.TOKEN_PATTERN}'),
  lambda w: w not in ({_list(schema.STOP_WORDS)})) as ws from sampled),
all_terms as (select paper_id, unnest(list_concat(ws,
  list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as term from kept_words),
tfs as (select paper_id, term, count(*) as tf from all_terms group by 1, 2),
dfs as (select term, count(*) as df, cast(sum(tf) as bigint) as ctf from tfs group by 1),
vocab_kept as (select *, (select count(*) from sampled) as n_docs from dfs
  where df >= 3 and df <= 0.3 * (select count(*) from sampled) order by ctf desc, term limit 3000),
weights as (select paper_id, term, tf * (ln((1 + n_docs) / (1 + df)) + 1) as weight from tfs join vocab_kept using (term)),
units as (select term, weight / sqrt(sum(weight * weight) over (partition by paper_id)) as weight from weights),
vocabulary as (select term, round(sum(weight), 6) as score from units group by term),
ranked as (select *, row_number() over (order by score desc, term) as rank from vocabulary)"""

TERMED = f"""{VOCAB},
top_terms as (select list(term order by rank) as terms from ranked where rank <= 500),
termed as (select * from (select paper_id, h, list_filter(terms, lambda t: contains(lower(title), t)) as terms
  from papers, top_terms) where len(terms) > 0)"""

N = schema.PAIR_TOTAL
CUT = "%s"

TITLE_ABSTRACT = f"""title_abstract as (select 'title_abstract' as kind, 'title_abstract/' || paper_id as pair_key,
  title as text_a, {CUT % 'abstract'} as text_b, 1.0::double as label
  from papers where length(abstract) > 50 order by h, paper_id limit {N * 4 // 10})"""

JOURNAL_YEAR = f"""numbered_jy as (select *, row_number() over (partition by journal, year order by h, paper_id) as place
  from papers where journal is not null),
journal_year as (select 'journal_year' as kind, 'journal_year/' || a.paper_id || '-' || b.paper_id as pair_key,
  {CUT % 'a.text'} as text_a, {CUT % 'b.text'} as text_b, 0.7::double as label
  from numbered_jy a join numbered_jy b on a.journal = b.journal and a.year = b.year and b.place = a.place + 1
  where a.place % 2 = 1 and a.place < 40 order by a.journal, a.year, a.place limit {N // 4})"""


def _template(i: int, template: str) -> str:
    parts = template.split("{}")
    slots = len(parts) - 1
    words = f"list_concat(drawn[1:{slots}], [{_list(schema.TEMPLATE_FILLERS)}])"
    pieces = [f"'{parts[0]}'"]
    for k, tail in enumerate(parts[1:], 1):
        pieces += [f"({words})[{k}]", f"'{tail}'"]
    return f"when {i} then " + " || ".join(pieces)


QUERY_PAIRS = f"""termed_at as (select *, row_number() over (order by h, paper_id) - 1 as pos from termed),
draws as (select tag, {_draw('query', 'tag', '(select count(*) from termed)')} as pos from range({N // 4}) r(tag)),
asked as (select tag, paper_id, {_draw('template', 'tag', str(len(schema.QUERY_TEMPLATES)))} as template,
  list_transform(list_sort(list_transform(terms, lambda t: struct_pack(h := md5(concat_ws(':', '42', 'term', tag, t)), t := t))),
   lambda x: x.t) as drawn from draws join termed_at using (pos)),
query_pairs as (select 'query' as kind, 'query/' || tag as pair_key,
  case template {' '.join(_template(i, t) for i, t in enumerate(schema.QUERY_TEMPLATES))} end as text_a,
  {CUT % 'p.text'} as text_b, 0.9::double as label from asked join papers p using (paper_id))"""

NEGATIVE = f"""old_at as (select paper_id, row_number() over (order by h, paper_id) - 1 as pos from papers where year < 2000),
new_at as (select paper_id, row_number() over (order by h, paper_id) - 1 as pos from papers where year > 2015),
any_at as (select paper_id, row_number() over (order by h, paper_id) - 1 as pos from papers),
sizes as (select (select count(*) from old_at) as n_old, (select count(*) from new_at) as n_new, (select count(*) from any_at) as n_any),
tags as (select tag, s.*, least({N // 10}, n_old, n_new) as crossed from range({N // 10}) r(tag), sizes s),
cross_draws as (select t.tag, a.paper_id as id_a, b.paper_id as id_b, false as must_differ from tags t
  join old_at a on a.pos = {_draw('old', 'tag', 'n_old')} join new_at b on b.pos = {_draw('new', 'tag', 'n_new')}
  where t.tag < crossed),
any_draws as (select t.tag, a.paper_id as id_a, b.paper_id as id_b, true as must_differ from tags t
  join any_at a on a.pos = {_draw('any_a', 'tag', 'n_any')}
  join any_at b on b.pos = ({_draw('any_a', 'tag', 'n_any')} + {_draw('any_b', 'tag', 'n_any - 1')} + 1) % n_any
  where t.tag >= crossed),
negative as (select 'negative' as kind, 'negative/' || d.tag as pair_key, {CUT % 'a.text'} as text_a, {CUT % 'b.text'} as text_b,
  0.1::double as label from (select * from cross_draws union all select * from any_draws) d
  join papers a on a.paper_id = d.id_a join papers b on b.paper_id = d.id_b
  where not must_differ or coalesce(a.journal <> b.journal, true))"""

ALL_PAIRS = f"""{TERMED}, {TITLE_ABSTRACT}, {JOURNAL_YEAR}, {QUERY_PAIRS}, {NEGATIVE},
all_pairs as (select * from (select * from title_abstract union all select * from journal_year
  union all select * from query_pairs union all select * from negative)
  order by md5(concat_ws(':', '42', pair_key)), pair_key limit {N})"""

MERGED = f"""{VECTORS}, new_papers as (select * from papers where paper_id not in (select paper_id from stored)),
{_hashed('new', 'new_papers', 'paper_id', 'text')},
new_vecs as (select p.paper_id, p.ord, p.year, p.period, list_transform(range(0, {fx.DIM}), lambda i:
   cast(coalesce(m[i], 0.0) as float)) as embedding, 1 as batch
  from new_papers p left join (select paper_id, map_from_entries(list(struct_pack(k := pos, v := weight))) as m
   from new_weights group by 1) w using (paper_id)),
merged as (select paper_id, ord, year, period, embedding, batch from stored
  union all select paper_id, ord, year, period, embedding, batch from new_vecs),
merged_halves as (select *, case when row_number() over (partition by period order by batch desc, ord)
  <= count(*) over (partition by period) // 2 then 1 else 2 end as part from merged)"""


def oracle(name: str, blocks: str, body: str) -> None:
    ORACLE[name] = f"with {blocks}\n{body}"


# ---- scans and curation

oracle("scan_papers", RAW, "select * replace (cast(year as varchar) as year) from papers_raw")
oracle("na_normalise", CELLS, f"select ord, case when journal not in ({_list(schema.NA_TOKENS)}) then journal end as journal from cells")
oracle("type_year", f"{CELLS}, numbers as (select *, try_cast(year_text as double) as d from cells)", """
select ord, cast(cast(case when d = floor(d) then d end as smallint) as varchar) as year, year_text,
 year_text is not null and (d is null or d <> floor(d)) as rejected from numbers""")
oracle("rejects", f"""{RAW}, {CELLS}, texts as (select r.ord, case when length(title) >= 12 then title end as title, year_text,
 try_cast(year_text as double) as d from papers_raw r join cells c using (ord)),
judged as (select *, year_text is not null and (d is null or d <> floor(d)) as bad from texts)""", """
select ord, year_text as year, 'year' as reason from judged where bad
union all select ord, cast(cast(d as smallint) as varchar), 'title' from judged where not bad and year_text is not null and title is null""")
ORACLE["scan_embeddings"] = """select vec_id as paper_id, label, cast(len(embedding) as integer) as width,
 round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 6) as norm from embeddings"""
oracle("distinct_ratio", RAW, "select * from (" + " union all ".join(
    f"select '{c}' as \"column\", count(distinct {c}) as distinct_values, count(*) as rows, "
    f"round(count(distinct {c}) / count(*), 6) as ratio, count(distinct {c}) / count(*) < 0.5 as repetitive from papers_raw"
    for c in ["title", "authors", "abstract", "url", "journal"]) + ")")
oracle("book_review_filter", RAW, f"select ord, title from papers_raw where year is not null and title is not null and {MARKS}")
oracle("title_clean", RAW, "select ord, replace(regexp_replace(title, '\\n\\[.*?\\]', '', 'g'), chr(10), ' ') as title from papers_raw")
oracle("dedupe_papers", CLEAN, "select ord, title, url from unique_papers")
oracle("broken_links", CLEAN, "select ord, url from cleaned")
oracle("clean_papers", CLEAN, "select * from cleaned")
oracle("clean_stage_counts", CLEAN, f"""
select 'raw' as step, count(*) as rows from papers_raw
union all select 'missing_years', count(*) from papers_raw where year is null
union all select 'null_titles', count(*) from papers_raw where year is not null and title is null
union all select 'book_reviews', count(*) from papers_raw where year is not null and title is not null and not ({MARKS})
union all select 'duplicates', (select count(*) from titled) - (select count(*) from unique_papers)
union all select 'broken_links', count(*) from unique_papers where url in ({_list(schema.BROKEN_LINKS)})
union all select 'kept', count(*) from cleaned""")
oracle("embedding_text", PAPERS, "select paper_id, text from papers")
oracle("period_counts", PAPERS, "select period, count(*) as n from papers group by period")
oracle("period_range_join", PAPERS, "select paper_id, year, period as found_period from papers")

# ---- search

oracle("prefilter", PAPERS, f"select paper_id, journal, year from papers where {_where()}")
oracle("journal_groups", PAPERS, f"select paper_id, journal from papers where journal in ({_list(fx.GROUPS['top5'] + fx.GROUPS['survey'])})")
oracle("top_journals", PAPERS, "select journal, count(*) as n from papers where journal is not null group by 1 order by n desc, journal limit 5")
oracle("journal_year_groups", PAPERS, "select journal, year, count(*) as n from papers where journal is not null group by 1, 2 having count(*) >= 2")
oracle("query_terms", f"""{PAPERS},
asked as (select paper_id as query_id, case length(title) % 4 when 0 then title
  when 1 then '"' || title || '" ' || journal when 2 then replace(title, ' ', '|') else title || '"' end as query from papers),
parsed as (select *, case when contains(query, '"')
  then list_transform(regexp_extract_all(query, '(?:"[^"]*"|[^\\s"])+'), lambda t: replace(t, '"', ''))
  else string_split(query, ' ') end as terms from asked)""", """
select query_id, array_to_string(terms, chr(10)) as terms, cast(len(terms) as integer) as n_terms,
 array_to_string(list_filter(terms, lambda t: not contains(t, '|')), chr(10)) as plain_terms,
 array_to_string(list_transform(terms, lambda t: cast(len(string_split(t, '|')) as varchar)), ',') as group_sizes from parsed""")
oracle("keyword_and", PAPERS, f"select paper_id from papers where {_matches([['er'], ['wh']])}")
oracle("keyword_or", PAPERS, f"select paper_id from papers where {_matches([['wh', 'eaux'], ['er']])}")
oracle("keyword_phrase", PAPERS, f"select paper_id from papers where {_matches([['the of']])}")
oracle("keyword_blank", PAPERS, "select paper_id from papers")
oracle("keyword_author", PAPERS, f"""select paper_id from papers
 where {_matches([['author 7']], "upper(text || ' ' || coalesce(authors, ''))")}""")
_SEARCH = f"{_where()} and {_matches([['er'], ['wh', 'the']])}"
oracle("keyword_count", PAPERS, f"select count(*) as papers_found from papers where {_SEARCH}")
_SHOWN = "paper_id, title, authors, url, journal, year"
oracle("keyword_search", PAPERS, f"select {_SHOWN} from papers where {_SEARCH} order by year desc, ord limit 100")
oracle("keyword_early", PAPERS, f"select {_SHOWN} from papers where {_SEARCH} order by year, ord limit 50")
# the groups each batch query stands for, written out
_BATCH_GROUPS = {
    1: [["er"], ["wh"]], 2: [["wh", "eaux"], ["er"]], 3: [["the of"]], 4: [], 5: [["the"], ["wh"]], 6: [], 7: [],
    8: [["un"], ["der the"]],
}
_BATCH_GROUPS[8] = [["un"], ["der"], ["the"]]
assert sorted(_BATCH_GROUPS) == [i for i, _ in BATCH_QUERIES]
oracle("keyword_batch", PAPERS, " union all ".join(
    f"select * from (select {i} as query_id, cast(row_number() over (order by year desc, ord) as integer) as rank, paper_id "
    f"from papers where {_matches(g)}) where rank <= 100" for i, g in _BATCH_GROUPS.items()))


def _request(journals: list[str] | None, year_from: int | None, year_to: int | None) -> str:
    parts = [] if journals is None else [f"journal in ({_list(journals)})" if journals else "false"]
    parts += [f"year >= {year_from}"] * (year_from is not None) + [f"year <= {year_to}"] * (year_to is not None)
    return " and ".join(parts) or "true"


_FILTERED_GROUPS = {1: [["er"], ["wh"]], 2: [["wh", "eaux"], ["er"]], 3: [["the of"]], 4: [], 5: [], 6: [["er"]], 7: [["zq"], ["jx"]]}
_FILTERS = {
    1: (fx.GROUPS["top5"], 1990, 2010), 2: (None, None, 2005), 3: (fx.GROUPS["survey"], None, None), 4: (fx.GROUPS["general"], 2000, None),
    5: (None, None, 1995), 6: ([], None, None), 7: (None, None, None),
}
oracle("keyword_batch_filtered", PAPERS, " union all ".join(
    f"select * from (select {i} as query_id, cast(row_number() over (order by year desc, ord) as integer) as rank, paper_id, year "
    f"from papers where {_matches(g)} and {_request(*_FILTERS[i])}) where rank <= 50" for i, g in _FILTERED_GROUPS.items()))
oracle("prefilter_open", PAPERS, "select paper_id, journal, year from papers where year >= 2001")


def _citation(similarity: str = "") -> str:
    return (
        f"rank || '. ' {similarity} || case when coalesce(url, '') <> '' then '[' || title || '](' || url || ')' else title end "
        "|| '. ' || coalesce(authors, '<NA>') || '. ' || year || '. ' || journal || '.'"
    )


oracle("citation_lines", f"""{PAPERS}, shown as (select *, row_number() over (order by year desc, ord) as rank
 from papers where {_SEARCH})""", f"select cast(rank as integer) as rank, {_citation()} as line from shown where rank <= 100")
oracle("random_roll", PAPERS, f"select paper_id, title from papers where {_SEARCH} order by h, paper_id limit 1")
oracle("sample_k", PAPERS, "select paper_id, journal, year from papers order by h, paper_id limit 100")

# ---- vectors

oracle("dot_scores", f"{VECTORS}, {_query_vector()}", f"select v.paper_id, round(round({DOT}, 9), 6) as similarity from vecs v, q")
oracle("half_round", ELEMENTS, f"select paper_id, cast(pos as integer) as pos, {HALF} as value from elements")
oracle("l2_normalise", f"{ELEMENTS}, halved as (select paper_id, pos, {HALF} as x from elements)", """
select paper_id, cast(pos as integer) as pos,
 round(x / sqrt(sum(x * x) over (partition by paper_id)), 6) as value from halved""")
for _name, _order in {
    "semantic_search": "similarity desc, ord", "semantic_recent": "year desc, similarity desc, ord",
    "semantic_early": "year, similarity desc, ord",
}.items():
    oracle(_name, SCORED, f"""select paper_id, title, journal, year, round(similarity, 6) as similarity
 from found order by {_order} limit 100""")
oracle("semantic_citations", f"""{SCORED}, shown as (select *, row_number() over (order by year desc, similarity desc, ord) as rank
 from found)""", f"""select cast(rank as integer) as rank, {_citation("|| printf('%.3f ', similarity)")} as line
 from shown where rank <= 100""")
oracle("semantic_batch", f"""{VECTORS},
q as (select label as query_id, arg_min(e, paper_id) as e from vecs group by label),
scored as (select q.query_id, v.paper_id, round({DOT}, 9) as similarity from vecs v, q
 where v.paper_id in (select paper_id from papers where {REAL_ABSTRACT})),
best as (select *, row_number() over (partition by query_id order by similarity desc, paper_id) as rank
 from scored where similarity >= 0.1)""", """
select cast(query_id as bigint) as query_id, cast(rank as integer) as rank, paper_id, round(similarity, 6) as similarity
 from best where rank <= 20""")
_SEMANTIC_FILTERS = [(fx.GROUPS["top5"], 1990, 2010), (None, None, 2005), (fx.GROUPS["survey"], 2000, None), ([], None, None)]
_ACCEPTED = " or ".join(f"(query_id % 4 = {i} and {_request(*f)})" for i, f in enumerate(_SEMANTIC_FILTERS))
oracle("semantic_batch_filtered", f"""{VECTORS},
q as (select label as query_id, arg_min(e, paper_id) as e from vecs group by label),
scored as (select q.query_id, v.paper_id, round({DOT}, 9) as similarity, journal, year from vecs v join papers p using (paper_id), q
 where {REAL_ABSTRACT}),
best as (select *, row_number() over (partition by query_id order by similarity desc, paper_id) as rank
 from scored where similarity >= 0.1 and ({_ACCEPTED}))""", """
select cast(query_id as bigint) as query_id, cast(rank as integer) as rank, paper_id, round(similarity, 6) as similarity
 from best where rank <= 20""")
oracle("knn_self_match", f"""{VECTORS},
q as (select paper_id as probe_id, e from stored order by md5(concat_ws(':', '42', paper_id)), paper_id limit 8),
scored as (select probe_id, v.paper_id, round({DOT}, 9) as similarity from vecs v, q),
best as (select *, row_number() over (partition by probe_id order by similarity desc, paper_id) as rank from scored)""", """
select probe_id, cast(rank as integer) as rank, paper_id, round(similarity, 6) as similarity, paper_id = probe_id as aligned
 from best where rank <= 5""")
oracle("encode_hashing", f"{PAPERS}, {_hashed('paper', 'papers', 'paper_id', 'text')}",
       "select paper_id, pos, round(weight, 6) as weight from paper_weights")
oracle("semantic_text_query", f"""{PAPERS}, {_hashed('paper', 'papers', 'paper_id', 'text')},
asked as (select 0 as query_id, '{TEXT_QUERY}' as query), {_hashed('asked', 'asked', 'query_id', 'query')},
scored as (select p.paper_id, round(sum(cast(cast(p.weight as float) as double) * cast(a.weight as float)), 9) as similarity
 from paper_weights p join asked_weights a using (pos) group by 1)""", f"""
select paper_id, year, round(similarity, 6) as similarity from papers join scored using (paper_id)
 where similarity >= 0.2 and {_where()} and {REAL_ABSTRACT} order by similarity desc, ord limit 100""")
oracle("papers_with_vectors", VECTORS, """select p.paper_id, title, period, label, cast(len(embedding) as integer) as width
 from papers p join vecs using (paper_id)""")

# ---- maintenance

_LINE = "md5(concat_ws(chr(1), coalesce(title, chr(0)), coalesce(authors, chr(0)), coalesce(url, chr(0))))"
_PRINT = f"""concat_ws('/', journal, year) as name, count(*) || ':' || sum({_number(f'{_LINE}', 12)}) || ':' ||
 sum(cast('0x' || substr({_LINE}, 13, 12) as bigint)) as sha"""
oracle("changed_files", f"""{PAPERS},
old_list as (select {_PRINT} from papers where paper_id in (select vec_id from embeddings) group by 1),
new_list as (select {_PRINT} from papers group by 1)""",
       "select name from new_list n where not exists (select 1 from old_list o where o.name = n.name and o.sha = n.sha)")
oracle("manifest_build", MANIFEST, f"select {ENTRY_OUT} from entries")
oracle("manifest_rollup", MANIFEST, """select file_entry, cast(sum(num_papers) as bigint) as num_papers,
 round(sum(file_size_mb), 6) as file_size_mb from entries group by rollup (file_entry)""")
oracle("manifest_rows", MANIFEST, f"""select file_entry, '{schema.DEFAULT_MODEL}' as model_name, {fx.DIM} as embedding_dim,
 num_papers, round(file_size_mb, 6) as file_size_mb, min_year, max_year,
 case when file_entry <> period then first_index::varchar end as first_index,
 case when file_entry <> period then last_index::varchar end as last_index, period, {CREATED}, papers_added from entries""")
oracle("manifest_vs_actual", MANIFEST, "select * from versus")
oracle("merge_embeddings", MERGED, """select paper_id, period, batch, part,
 round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 6) as total from merged_halves""")
oracle("manifest_upsert", f"""{MERGED},
old_entries as ({_entries('halves', "timestamp '2026-03-01 00:00:00' + to_minutes(cast(num_papers * 2 as bigint))")}),
new_entries as ({_entries("(select * from merged_halves where period in ('2020s', '2025s'))", "timestamp '2026-04-01 00:00:00' + to_minutes(cast(num_papers as bigint))")}),
upserted as (select n.* replace (n.num_papers - coalesce(o.num_papers, 0) as papers_added)
  from new_entries n left join old_entries o using (file_entry)
  union all select * from old_entries where file_entry not in (select file_entry from new_entries))""",
       f"select {ENTRY_OUT} from upserted")
oracle("stale_periods", MANIFEST, "select * from stale")
oracle("delta_by_key", PAPERS, "select paper_id, period from papers where paper_id not in (select vec_id from embeddings)")
oracle("delta_by_count", VECTORS, """select paper_id, period from (select paper_id, period,
  row_number() over (partition by period order by ord) as rn, count(*) over (partition by period) as n from papers)
 left join (select period, count(*) as previous from stored group by period) using (period)
 where rn <= n - coalesce(previous, 0)""")
oracle("half_split", PAPERS, """select paper_id, period, case when row_number() over (partition by period order by ord)
 <= count(*) over (partition by period) // 2 then 1 else 2 end as part from papers""")
oracle("split_boundary", PAPERS, """select rn as idx, paper_id, title, year from (select *, row_number() over (order by ord) - 1 as rn,
 count(*) over () // 2 as split from papers where period = 'b2000') where rn between split - 2 and split + 1""")

# ---- vocabulary and pairs

oracle("vocab_df", VOCAB, "select * from dfs")
oracle("vocab_tfidf", VOCAB, "select term, score, cast(rank as integer) as rank from ranked")
oracle("paper_terms", TERMED, "select paper_id, array_to_string(terms, '|') as terms from termed")
oracle("pairs_title_abstract", f"{PAPERS}, {TITLE_ABSTRACT}", "select * from title_abstract")
oracle("pairs_journal_year", f"{PAPERS}, {JOURNAL_YEAR}", "select * from journal_year")
oracle("pairs_query", f"{TERMED}, {QUERY_PAIRS}", "select * from query_pairs")
oracle("pairs_negative", f"{PAPERS}, {NEGATIVE}", "select * from negative")
oracle("pairs_consecutive", f"""{PAPERS},
leaders as (select * from papers where abstract is not null order by ord limit 100),
busiest as (select journal from papers where journal is not null group by journal order by count(*) desc, journal limit 5),
firsts as (select *, row_number() over (partition by journal order by ord) as rn from papers where journal in (select journal from busiest)),
nexts as (select *, lead(title) over (partition by journal order by ord) as next_title from firsts where rn <= 10)""", f"""
select 'title_abstract' as kind, title as text_a, {CUT % 'abstract'} as text_b, 1.0::double as label from leaders
union all select 'consecutive', title, next_title, 0.7::double from nexts where next_title is not null""")
oracle("pairs_all", ALL_PAIRS, "select * from all_pairs")
oracle("pair_summary", ALL_PAIRS, "select " + ", ".join(
    f"count(*) filter (kind = '{k}') as {k}_pairs" for k in schema.PAIR_LABELS) + """,
 count(*) as training_examples, (select count(*) from vocabulary) as vocabulary_terms,
 (select string_agg(term, '|' order by rank) from ranked where rank <= 50) as top_terms from all_pairs""")

# ---- audits

oracle("missing_periods", MANIFEST, """select file_entry, file_entry in (select file_entry from entries e join sources s
 using (period) where e.created >= s.mtime) as present from expected""")
_MATCH = """matched as (select (select count(*) from papers) as papers, (select count(*) from embeddings) as vectors,
 (select count(*) from papers where paper_id not in (select vec_id from embeddings)) as without_vector,
 (select count(*) from embeddings where vec_id not in (select paper_id from papers)) as without_paper)"""
oracle("count_match", f"{PAPERS}, {_MATCH}", "select *, without_vector = 0 and without_paper = 0 as passed from matched")
_NORMS = f"""norms as (select count(*) as vectors, min(n) as min_norm, max(n) as max_norm, avg(n) as mean_norm,
 count(*) filter (abs(n - 1) > 1e-3 + 1e-5) as not_unit, count(*) filter (w <> {fx.DIM}) as wrong_width
 from (select sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) as n, len(embedding) as w from embeddings))"""
oracle("norm_stats", _NORMS, """select vectors, round(min_norm, 6) as min_norm, round(max_norm, 6) as max_norm,
 round(mean_norm, 6) as mean_norm, not_unit, wrong_width from norms""")
_BOUNDS = " or ".join(
    f"(period = '{n}' and min_year >= {-32768 if lo is None else lo} and max_year < {32768 if hi is None else hi})"
    for n, lo, hi in schema.PERIODS)
_SPLIT = f"split_years as (select *, {_BOUNDS} as passed from (select period, min(year) as min_year, max(year) as max_year from papers group by period))"
oracle("split_check", f"{PAPERS}, {_SPLIT}", "select * from split_years")
oracle("text_consistency", PAPERS, """select count(*) as papers, count(*) filter (abstract is null) as null_abstracts,
 count(*) filter (text <> title || ' ' || coalesce(abstract, '<NA>')) as unequal from papers""")
oracle("reencode_check", f"""{PAPERS}, chosen as (select paper_id, text from papers order by h, paper_id limit 10),
{_hashed('paper', 'chosen', 'paper_id', 'text')},
sims as (select paper_id, sum(cast(x as double) * {HALF}) as s from
 (select paper_id, cast(cast(weight as float) as double) as x from paper_weights) group by 1)""", """
select count(*) as sampled, round(avg(s), 6) as mean_similarity, round(min(s), 6) as min_similarity, min(s) > 0.999 as passed from sims""")
oracle("diagnose", f"""{VECTORS},
parts as (select 'raw' as section, coalesce({PERIOD}, 'none') as period, count(*) as n from papers_raw group by 2
 union all select 'papers', period, count(*) from papers group by 2
 union all select 'vectors', period, count(*) from stored group by 2),
sums as (select cast(sum(n) filter (section = 'raw') as bigint) as r, cast(sum(n) filter (section = 'papers') as bigint) as p,
 cast(sum(n) filter (section = 'vectors') as bigint) as v from parts),
said as (select *, case when v > p then 'more vectors than papers' when v < p then 'fewer vectors than papers' else 'equal' end as verdict from sums)""", """
select section, period, n, '' as verdict from parts
union all select 'raw_total', 'all', r, verdict from said union all select 'papers_total', 'all', p, verdict from said
union all select 'vectors_total', 'all', v, verdict from said union all select 'removed_total', 'all', r - p, verdict from said""")
oracle("audit_report", f"""{MANIFEST}, {_MATCH}, {_NORMS}, {_SPLIT},
checks as (
 select 'file_present' as "check", file_entry as period, 'true' as expected,
  cast(file_entry in (select file_entry from entries) as varchar) as actual, file_entry in (select file_entry from entries) as passed, true as required from expected
 union all select 'count_match', 'all', papers::varchar, vectors::varchar, papers = vectors, true from matched
 union all select 'papers_without_vector', 'all', '0', without_vector::varchar, without_vector = 0, true from matched
 union all select 'vectors_without_paper', 'all', '0', without_paper::varchar, without_paper = 0, true from matched
 union all select 'manifest_total', 'all', sum(actual_papers)::bigint::varchar, sum(manifest_papers)::bigint::varchar,
  sum(actual_papers) = sum(manifest_papers), true from versus
 union all select 'manifest_period', period, actual_papers::varchar, manifest_papers::varchar, passed, true from versus
 union all select 'vector_width', 'all', '0', wrong_width::varchar, wrong_width = 0, false from norms
 union all select 'vector_norm', 'all', '0', not_unit::varchar, not_unit = 0, false from norms
 union all select 'period_years', period, 'true', passed::varchar, passed, true from split_years
 union all select 'fresh', period, 'false', stale::varchar, not stale, false from stale
 union all select 'file_size', file_entry, 'true', (file_size_mb < {schema.MAX_FILE_MB})::varchar, file_size_mb < {schema.MAX_FILE_MB}, false from entries)""", """
select * from checks
union all select 'all', 'all', 'true', bool_and(passed or not required)::varchar, bool_and(passed or not required), true from checks""")
