"""The SQL that gives the same rows as the queries, written for another engine and in another way."""

from __future__ import annotations

from gleaner.functions.text import SPACE_SET
from gleaner.operators import chunk, stylometry
from gleaner.plans.reports import DISCLAIMER

W, T = f"[{SPACE_SET}]", f"[^{SPACE_SET}]+"
_ABBR = "(?i)(^|" + W + ")(" + "|".join([x.replace(".", "[.]") for x in chunk.DOTTED] + chunk.TITLES) + r"|\p{L})\.+$"
_DOCS = "docs as (select cast(doc_id as varchar) as document_id, text from documents)"
_ITEMS = "items as (select cast(item_id as varchar) as document_id, text from benchmark)"
_TRANSCRIPTS = """docs as (select cast(conv_id as varchar) as document_id, string_agg(text, chr(10) || chr(10) order by turn, text) as text
  from conversations group by conv_id)"""
_SHINGLES = """case when len({w}) = 0 then [] when len({w}) < 5 then [array_to_string({w}, ' ')]
  else list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i + 4], ' ')) end"""
_CHUNK_ID = "substr(sha256(document_id || ':' || chunk_index), 1, 16) as chunk_id"
_R4 = "round_even({0} * 10000, 0) / 10000"
_NAMES = [*stylometry.WEIGHTS]
_SCORE = "(" + " + ".join(f"{n} * {w}" for n, w in stylometry.WEIGHTS.items()) + ") / 5.6"
_ROUNDED = ", ".join(f"{_R4.format(n)} as {n}" for n in _NAMES)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


def _words(c: str) -> str:
    return f"regexp_extract_all({c}, '{T}')"


# Chunks


def _chunks(out: str, spans: str) -> str:
    """CTEs from pieces (document_id, pos, start, raw) to chunks."""
    return f"""{spans},
{out}_kept as (select document_id, pos, start + length(raw) - length(regexp_replace(raw, '^{W}+', '')) as start_offset, {_strip('raw')} as text from {out}_raw),
{out} as materialized (select document_id, cast(row_number() over (partition by document_id order by pos) - 1 as int) as chunk_index, text,
  cast(start_offset as int) as start_offset, cast(start_offset + length(text) as int) as end_offset from {out}_kept where text <> '')"""


def _paragraphs(docs: str, out: str) -> str:
    p = rf"\n{W}*\n"
    before = lambda a: f"coalesce(list_sum(list_transform({a}[1:i - 1], lambda x: length(x))), 0)"
    return _chunks(out, f"""{out}_cut as (select document_id, regexp_split_to_array(text, '{p}') as g, regexp_extract_all(text, '{p}') as m from {docs}),
{out}_raw as (select document_id, i as pos, g[i] as raw, {before('g')} + {before('m')} as start from {out}_cut, unnest(range(1, len(g) + 1)) as u(i))""")


def _sentences(docs: str, out: str) -> str:
    return _chunks(out, f"""{out}_parts as (
  select document_id, string_split(regexp_replace(text, '([.!?])({W}+)', '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(1)) as p from {docs}),
{out}_pieces as (select document_id, i, case when i = 1 then '' else split_part(p[i], chr(2), 1) end as gap,
  case when i = 1 then p[i] else split_part(p[i], chr(2), 2) end as piece from {out}_parts, unnest(range(1, len(p) + 1)) as u(i)),
{out}_flags as (select *, sum(length(gap) + length(piece)) over w - length(piece) as start, coalesce(lag(regexp_matches(piece, '{_ABBR}')) over w, false) as goes_on
  from {out}_pieces window w as (partition by document_id order by i)),
{out}_groups as (select *, sum(case when goes_on then 0 else 1 end) over (partition by document_id order by i) as pos from {out}_flags),
{out}_raw as (select document_id, pos, min(start) as start, substr(string_agg(gap || piece, '' order by i), 1 + length(arg_min(gap, i))) as raw
  from {out}_groups group by document_id, pos)""")


def _windows(docs: str, out: str, size: int, step: int) -> str:
    return _chunks(out, f"""{out}_cut as (select document_id, text as t, {_words('text')} as m, regexp_split_to_array(text, '{T}') as g from {docs}),
{out}_toks as (select document_id, len(m) as n, unnest(m) as w, unnest(g[1:len(m)]) as gap, generate_subscripts(m, 1) as i from {out}_cut),
{out}_placed as (select document_id, n, i, w, cast(sum(length(gap) + length(w)) over (partition by document_id order by i) - length(w) as bigint) as at_ from {out}_toks),
{out}_raw as (select s.document_id, s.i as pos, s.at_ as start, substr(t, s.at_ + 1, e.at_ + length(e.w) - s.at_) as raw from {out}_placed s
  join {out}_placed e on s.document_id = e.document_id and e.i = least(s.i + {size - 1}, s.n) join {out}_cut on {out}_cut.document_id = s.document_id where (s.i - 1) % {step} = 0)""")


# Matches


def _sets(of: str, out: str, more: str = "") -> str:
    return f"""{out}_words as (select *, {_words('lower(text)')} as w from {of}),
{out}_sets as (select *, list_distinct({_SHINGLES.format(w='w')}) as s from {out}_words {more}),
{out}_grams as (select document_id, chunk_index, len(s) as n, unnest(s) as g from {out}_sets)"""


def _pairs(docs: str, items: str, out: str = "pairs", remote: bool = False) -> str:
    q, s = f"{out}_q", f"{out}_s"
    return f"""{_sets(docs, q, 'where len(w) >= 8')}, {_sets(items, s, 'where len(w) >= 8' if remote else '')},
{out}_met as (select q.document_id, q.chunk_index, s.document_id as source_id, s.chunk_index as source_chunk_index, count(*) as common, any_value(q.n) as nq, any_value(s.n) as ns
  from {q}_grams q join {s}_grams s using (g) group by all),
{out} as materialized (select document_id, chunk_index, source_id, source_chunk_index, common, common / (nq + ns - common) as jaccard from {out}_met
  where common / (nq + ns - common) >= 0.1)"""


def _scored(docs: str, items: str, pairs: str) -> str:
    """CTEs to <pairs>_scored (the keys, score, and what a match needs): the longest common subsequence of the sorted words
    row by row, each row's running maximum by doubling."""
    letters = 12  # texts of up to 2 ** 12 characters
    row = "(select *, list_transform(range(1, len(ys) + 1), lambda j: case when ys[j] = xs[i] then r[j] + 1 else r[j + 1] end) as m0 from now)"
    for k in range(letters):
        row = f"(select * exclude (m{k}), list_transform(range(1, len(ys) + 1), lambda j: greatest(m{k}[j], case when j > {2**k} then m{k}[j - {2**k}] end)) as m{k + 1} from {row})"
    return f"""{pairs}_texts as materialized (select p.*, q.text as q, s.text as s, q.start_offset, q.end_offset,
    array_to_string(list_sort({_words('q.text')}), ' ') as x, array_to_string(list_sort({_words('s.text')}), ' ') as y
  from {pairs} p join {docs} q on p.document_id = q.document_id and p.chunk_index = q.chunk_index
  join {items} s on p.source_id = s.document_id and p.source_chunk_index = s.chunk_index),
{pairs}_of as (select distinct x, y from {pairs}_texts),
{pairs}_lcs as (
  select x, y, string_split(x, '') as xs, string_split(y, '') as ys, 1 as i, list_transform(range(0, length(y) + 1), lambda j: 0) as r from {pairs}_of
  union all
  select x, y, xs, ys, i + 1, list_concat([0], m{letters}) from {row.replace('from now', f'from {pairs}_lcs where i <= length(x)')}),
{pairs}_common as (select x, y, r[-1] as lcs from {pairs}_lcs where i = length(x) + 1),
{pairs}_scored as materialized (select t.*, 200.0 * cast(lcs as double) / (length(t.x) + length(t.y)) as score from {pairs}_texts t join {pairs}_common c on t.x = c.x and t.y = c.y)"""


def _matches(docs: str, items: str, out: str, remote: bool = False) -> str:
    pairs, raw = f"{out}_pairs", "score / 100"
    judged = _R4.format("(score / 100)") if remote else raw
    return f"""{_pairs(docs, items, pairs, remote)}, {_scored(docs, items, pairs)},
{out} as materialized (select document_id, 'fdg_' || substr(sha256('plag::' || source_id || '::' || source_chunk_index || '::' || chunk_index), 1, 16) as finding_id, source_id, source_chunk_index, chunk_index,
  {_R4.format('(score / 100)')} as similarity_score, case when {judged} >= 0.95 then 'exact' when {judged} >= 0.7 then 'near' else 'paraphrase' end as match_type,
  substr(q, 1, 300) as matched_excerpt, substr(s, 1, 300) as source_excerpt, start_offset, end_offset from {pairs}_scored where score >= 60)"""


def _merged(matches: str, out: str) -> str:
    """The fold over each source chunk's matches by start: k is the place, c the kept one's place, g the number of kept ones."""
    keys = "document_id, source_id, source_chunk_index"
    return f"""{out}_placed as materialized (select *, row_number() over (partition by {keys} order by start_offset, chunk_index, similarity_score, match_type) as k from {matches}),
{out}_fold as (
  select {keys}, k, k as c, 1 as g, end_offset as border, similarity_score as best from {out}_placed where k = 1
  union all
  select f.document_id, f.source_id, f.source_chunk_index, n.k,
    case when n.start_offset < f.border and n.similarity_score <= f.best then f.c else n.k end,
    case when n.start_offset < f.border then f.g else f.g + 1 end,
    case when n.start_offset < f.border and n.similarity_score <= f.best then f.border else n.end_offset end,
    case when n.start_offset < f.border and n.similarity_score <= f.best then f.best else n.similarity_score end
  from {out}_fold f join {out}_placed n on n.document_id = f.document_id and n.source_id = f.source_id and n.source_chunk_index = f.source_chunk_index and n.k = f.k + 1),
{out}_kept as (select {keys}, arg_max(c, k) as k from {out}_fold group by {keys}, g),
{out} as materialized (select p.* exclude (k) from {out}_placed p join {out}_kept using ({keys}, k))"""


_RANK = "row_number() over (partition by document_id order by similarity_score desc, source_id, source_chunk_index, chunk_index)"
_SELECTED = f"""ranked as (select *, row_number() over (partition by document_id order by length(text) desc, chunk_index) as r, {_words('text')} as w from chunks),
asked as (select document_id, chunk_index, cast(r as int) as query_rank, substr(array_to_string(w, ' '), 1, 180) as query from ranked where r <= 5 and len(w) >= 8)"""
_GRAMS3 = "list_distinct(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)"
_SEARCHED = f"""ask_grams as (select document_id, query_rank, unnest({_GRAMS3}) as g from (select *, {_words('lower(query)')} as w from asked)),
item_grams as (select document_id as source_id, unnest({_GRAMS3}) as g from (select *, {_words('lower(text)')} as w from items)),
shared as (select document_id, query_rank, source_id, count(*) as n from ask_grams join item_grams using (g) group by all),
results as (select *, row_number() over (partition by document_id, query_rank order by n desc, source_id) - 1 as result_rank from shared),
found as materialized (select document_id, min(query_rank) as query_rank, cast(arg_min(result_rank, query_rank) as int) as result_rank, 'table' as provider, 'table:' || source_id as source_id
  from results where result_rank < 3 group by document_id, source_id)"""


# Style

_SIGNALS = f"""sents as (select document_id, chunk_index, text,
    list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){W}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') as s from chunks),
w as (select *, list_transform(s, lambda x: {_words('x')}) as w from sents),
v as (select *, list_transform(w, lambda x: cast(len(x) as double)) as n, list_transform(flatten(w), lambda x: lower(x)) as words, list_transform(w, lambda x: lower(x[1])) as firsts,
  list_transform(w, lambda x: list_sum(list_transform(x, lambda y: length(y))) / len(x)) as means from w),
spread as (select *, coalesce(list_aggregate(n, 'stddev_samp') / list_avg(n), 1) as cn, coalesce(list_aggregate(means, 'stddev_samp') / list_avg(means), 1) as cm,
  list_max(map_values(list_histogram(firsts))) as most from v),
signals as (select document_id, chunk_index, len(words) as n_words,
  case when len(s) < 2 then 0.0 else greatest(0.0, least(1.0, 1 - cn)) end as sentence_length_uniformity,
  case when len(s) = 0 then 0.0 else len(list_filter(n, lambda x: x <= 8)) / len(s) end as short_sentence_ratio,
  case when len(s) = 0 then 0.0 else len(list_filter(n, lambda x: x >= 40)) / len(s) end as long_sentence_ratio,
  case when len(words) = 0 then 0.0 else 1 - len(list_distinct(words)) / len(words) end as lexical_diversity,
  case when len(s) < 2 then 0.0 else (most - 1) / len(s) end as sentence_start_repetition,
  case when len(s) < 2 then 0.0 else greatest(0.0, least(1.0, 1 - cm)) end as avg_word_length_uniformity from spread)"""
_HIT = "list_filter([" + ", ".join(f"case when {{0}}{n} >= 0.5 then {n!r} end" for n in _NAMES) + "], lambda x: x is not null)"
_TOLD = "case x " + " ".join(f"when {n!r} then {_quoted(stylometry.TOLD[n][0])}" for n in _NAMES) + " end"
_MEANS = f"""means as (select document_id, sum(n_words) as n_words, {', '.join(f'avg({n}) as raw_{n}' for n in _NAMES)} from signals group by document_id),
rounded as (select document_id, n_words, {_HIT.format('raw_')} as hit, {', '.join(f"{_R4.format(f'raw_{n}')} as {n}" for n in _NAMES)} from means),
scored as (select *, {_R4.format(f'least({_SCORE}, 1.0)')} as ai_likeness_score from rounded),
risks as materialized (select *, case when ai_likeness_score >= 0.6 then 'high' when ai_likeness_score >= 0.3 then 'medium' else 'low' end as automated_writing_risk from scored)"""
_STYLE_CODE, _SHORT_CODE = "stylometric_only/warning/ai_likelihood", "short_document/info/ai_likelihood"

# The corpus

_SNAPSHOT = """files as (select doc_id as i, doc_id % 11 <> 0 as readable, 'new ' || substr(text, 1, 300) as text from documents),
known as (select doc_id as i, substr(text, 1, 300) as text, case when doc_id % 5 = 0 then 'stale' else 'fresh' end as state from documents where doc_id % 3 <> 0),
states as (select i, readable, files.text as now, known.text as had, coalesce(state, 'new') as state from files left join known using (i)),
entries as (select i, case when state = 'fresh' then had else now end as text from states where state = 'fresh' or readable)"""

# Reports

_REPORT = f"""{_TRANSCRIPTS}, {_ITEMS}, {_paragraphs('docs', 'chunks')}, {_paragraphs('items', 's_chunks')}, {_matches('chunks', 's_chunks', 'raw_matches')}, {_merged('raw_matches', 'matches')},
{_SIGNALS}, {_MEANS},
best as (select document_id, count(*) as n, max(similarity_score) as s from matches group by document_id),
summary as (select document_id, text, coalesce(n, 0) as plagiarism_match_count, coalesce(s, 0.0) as plagiarism_overall_score, coalesce(ai_likeness_score, 0.0) as ai_likeness_score,
  coalesce(automated_writing_risk, 'low') as automated_writing_risk, coalesce(automated_writing_risk, 'low') <> 'low' as human_review_recommended, n_words,
  {', '.join(_NAMES)} from docs left join best using (document_id) left join risks using (document_id))"""
_FIXED2 = "printf('%.2f', {0})"
_COPIED = f"{_DOCS}, {_ITEMS}, {_sentences('docs', 'q_chunks')}, {_sentences('items', 's_chunks')}, {_matches('q_chunks', 's_chunks', 'raw_matches')}, {_merged('raw_matches', 'matches')}"
_HEAD = "'Document: ' || document_id || chr(10) || 'Status:   complete' || chr(10) || 'Summary:  analyses={0} plagiarism=' || " + _FIXED2.format("{1}") + " || ' ai=' || " + _FIXED2.format("{2}")
_LISTED = f"""lines as (select document_id, count(*) as n, max(similarity_score) as s, string_agg('    [' || match_type || '] score=' || {_FIXED2.format('similarity_score')} || '  source=' || source_id
  || '  chunk#' || source_chunk_index, chr(10) order by place) filter (place <= 10) as text from (select *, {_RANK} as place from matches) group by document_id)"""
_PLAGIARISM_TEXT = f"""chr(10) || chr(10) || 'Copied passages: overall score ' || {_FIXED2.format('coalesce(s, 0.0)')} || chr(10) || case when n is null then '  No matches found.'
  else '  ' || n || ' match(es):' || chr(10) || lines.text || case when n > 10 then chr(10) || '    ... and ' || (n - 10) || ' more' else '' end end"""


def _parsed(values: str, text: str = "") -> str:
    return f"select cast(item_id as varchar) as document_id, {values} from (select *, cast(item_id as varchar) as i {text} from benchmark)"


def oracle_sql() -> dict[str, str]:
    chunk_columns = f"select {_CHUNK_ID}, document_id, chunk_index, text, start_offset, end_offset from chunks"
    sentences = f"{_DOCS}, {_ITEMS}, {_sentences('docs', 'q_chunks')}, {_sentences('items', 's_chunks')}"
    html = "list_transform(regexp_split_to_array(regexp_replace(html, '<!--.*?-->|<!DOCTYPE[^>]*>', '<>', 'gs'), '<[^>]*>'), lambda x: x)"
    unescape = lambda c: f"replace(replace(replace(replace(replace(replace({c}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    title = "coalesce(nullif(case when item_id % 5 <> 0 then substr(text, 1, 20) end, ''), 'OpenAlex work')"
    land = "case when item_id % 4 <> 3 then 'https://land/x' end"
    path = f"coalesce(case when item_id % 3 = 0 then 'https://doi.org/' || i end, case when item_id % 2 = 0 then 'https://w/' || i end, {land}, {title})"
    placed = f"array_to_string(list_transform({_words('text')}, lambda w, p: w || '~' || (p - 1)), ' ')"
    crossref_title = "case when item_id % 5 <> 0 then substr(text, 1, 9) || ' part two' else 'Crossref work' end"
    crossref_path = f"coalesce(case when item_id % 3 = 0 then 'https://u/x' end, case when item_id % 2 = 0 then 'https://doi.org/10.1/' || i end, {crossref_title})"
    crossref_text = f"array_to_string({_words(unescape('text'))}, ' ') || ' & more'"
    shapes = ["url", "url", "'https://duckduckgo.com/y'", "null", "null", "null", "'https:' || regexp_replace(url, '^https?:', '')", "url", "null", "null", "'x+y+z'"]
    shapes[2], shapes[9], shapes[10] = "null", "null", "null"
    n_shingles = "case when len(w) = 0 then 0 else greatest(1, len(w) - 4) end"
    found = {
        "ingest_document_metadata": f"with {_DOCS} select document_id, length(text) as character_count, sha256(text) as content_hash from docs",
        "chunk_paragraph": f"with {_TRANSCRIPTS}, {_paragraphs('docs', 'chunks')} {chunk_columns}",
        "chunk_sentence": f"with {_DOCS}, {_sentences('docs', 'chunks')} {chunk_columns}",
        "chunk_fixed_window": f"with {_DOCS}, {_windows('docs', 'chunks', 50, 40)} {chunk_columns}",
        "remote_rechunk": f"""with {_TRANSCRIPTS}, long as (select * from docs where len({_words('text')}) >= 8), {_paragraphs('long', 'chunks')}
select document_id as source_id, chunk_index, text, start_offset, end_offset from chunks where len({_words('text')}) >= 8""",
        "shingle_counts": f"""with {_DOCS}, w as (select document_id, {_words('lower(text)')} as w from docs), s as (select document_id, {_SHINGLES.format(w='w')} as s from w)
select document_id, len(s) as n_shingles, len(list_distinct(s)) as n_distinct from s""",
        "normalized_text": f"with {_DOCS} select document_id, array_to_string({_words('lower(text)')}, ' ') as normalized_text from docs",
        "inverted_index": f"""with {_ITEMS}, w as (select document_id, {_words('lower(text)')} as w from items), s as (select document_id, unnest({_SHINGLES.format(w='w')}) as shingle from w)
select shingle, count(*) as n_refs, count(distinct document_id) as n_sources, string_agg(document_id || ':0', ',' order by document_id || ':0') as refs from s group by shingle""",
        "candidate_pairs": f"with {sentences}, {_pairs('q_chunks', 's_chunks')} select document_id, chunk_index, source_id, source_chunk_index from pairs",
        "jaccard_pairs": f"with {sentences}, {_pairs('q_chunks', 's_chunks')} select * from pairs",
        "jaccard_all_pairs": f"""with {_ITEMS}, {_paragraphs('items', 'chunks')}, {_sets('chunks', 'c')}
select a.document_id, a.chunk_index, b.document_id as source_id, b.chunk_index as source_chunk_index, len(list_intersect(a.s, b.s)) as common,
  len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) as jaccard from c_sets a, c_sets b where len(a.w) >= 8""",
        "token_sort_similarity": f"""with recursive {sentences}, {_pairs('q_chunks', 's_chunks')}, {_scored('q_chunks', 's_chunks', 'pairs')}
select document_id, chunk_index, source_id, source_chunk_index, round(score, 6) as score from pairs_scored""",
        "local_matches": f"with recursive {sentences}, {_matches('q_chunks', 's_chunks', 'matches')} select * from matches",
        "remote_matches": f"with recursive {_DOCS}, {_ITEMS}, {_sentences('docs', 'q_chunks')}, {_paragraphs('items', 's_chunks')}, {_matches('q_chunks', 's_chunks', 'matches', True)} select * from matches",
        "merged_matches": f"""with recursive {_DOCS}, {_ITEMS}, {_windows('docs', 'q_chunks', 50, 25)}, {_paragraphs('items', 's_chunks')}, {_matches('q_chunks', 's_chunks', 'raw_matches')},
{_merged('raw_matches', 'matches')} select * from matches""",
        "hybrid_matches": f"""with recursive {sentences}, {_paragraphs('items', 'p_chunks')}, {_matches('q_chunks', 'p_chunks', 'far_raw', True)}, {_merged('far_raw', 'far')},
{_matches('q_chunks', 's_chunks', 'near_raw')}, {_merged('near_raw', 'near')}, both_of as (select * from far union all select * from near), {_merged('both_of', 'matches')} select * from matches""",
        "ranked_matches": f"with recursive {_COPIED} select document_id, cast({_RANK} as int) as rank, finding_id, similarity_score from matches",
        "document_plagiarism_summary": f"""with recursive {_COPIED}, best as (select document_id, count(*) as n, max(similarity_score) as s from matches group by document_id)
select document_id, coalesce(n, 0) as match_count, coalesce(s, 0.0) as overall_score from docs left join best using (document_id)""",
        "query_selection": f"with {_DOCS}, {_sentences('docs', 'chunks')}, {_SELECTED} select * from asked",
        "candidate_dedupe": """select document_id, source_id, query_rank, provider_rank, result_rank from (
  select *, row_number() over (partition by document_id, source_id order by query_rank, provider_rank, result_rank) as n from (
    select cast(page_id % 7 as varchar) as document_id, cast(page_id % 40 as varchar) as source_id, cast(page_id * 13 % 5 as int) as query_rank, cast(page_id * 7 % 3 as int) as provider_rank,
      cast(page_id as int) as result_rank from pages)) where n = 1""",
        "provider_search": f"with {_DOCS}, {_ITEMS}, {_sentences('docs', 'chunks')}, {_SELECTED}, {_SEARCHED} select * from found",
        "provider_matches": f"""with recursive {_DOCS}, {_ITEMS}, {_sentences('docs', 'chunks')}, {_SELECTED}, {_SEARCHED},
named as (select 'table:' || document_id as document_id, text from items where len({_words('text')}) >= 8), {_paragraphs('named', 's_chunks')}, {_matches('chunks', 's_chunks', 'all_matches', True)},
own as (select m.* from all_matches m join (select distinct document_id, source_id from found) using (document_id, source_id)), {_merged('own', 'matches')} select * from matches""",
        "openalex_parsed": _parsed(f"""0 as result_rank, 'openalex' as provider, 'openalex:' || coalesce(case when item_id % 2 = 0 then 'https://w/' || i end, {path}) as source_id,
  {title} as source_label, {path} as source_path, {title} || case when item_id % 7 <> 0 and text <> '' then chr(10) || chr(10) || {placed} else '' end as metadata_text,
  case item_id % 4 when 1 then 'https://oa/x' when 2 then 'https://p/x.pdf' when 0 then 'https://land/x' end as full_text_url"""),
        "crossref_parsed": _parsed(f"""0 as result_rank, 'crossref' as provider, 'crossref:' || case when item_id % 2 = 0 then '10.1/' || i else {crossref_path} end as source_id,
  {crossref_title} as source_label, {crossref_path} as source_path, {crossref_title} || case when item_id % 7 <> 0 then chr(10) || chr(10) || {crossref_text} else '' end as metadata_text"""),
        "arxiv_parsed": f"""select * from ({_parsed(f'''0 as result_rank, 'arxiv' as provider, 'arxiv:' || case when item_id % 2 = 0 then 'http://a/' || i else 'A title ' || i end as source_id, 'A title ' || i as source_label,
  case when item_id % 2 = 0 then 'http://a/' || i else 'A title ' || i end as source_path,
  'A title ' || i || chr(10) || chr(10) || array_to_string({_words("regexp_replace(text, '[<>&]', ' ', 'g')")}, ' ') as metadata_text,
  case when item_id % 3 = 0 then 'http://a/pdf' end as full_text_url''')}) where cast(document_id as bigint) % 5 <> 0""",
        "duckduckgo_parsed": """select document_id, result_rank, 'duckduckgo' as provider, 'duckduckgo:' || u as source_id, title as source_label, u as source_path, title as metadata_text, u as full_text_url
from (select cast(item_id as varchar) as document_id, unnest([0, 2]) as result_rank, unnest(['one two', 'a & b']) as title,
  unnest(['https://s/' || item_id || '?a=1&b=x y', 'https://s/' || item_id || '?a=1&b=x%20y']) as u from benchmark)""",
        "strip_markup": f"""select page_id, array_to_string({_words(unescape("regexp_replace(html, '<[^>]+>', ' ', 'g')"))}, ' ') as text from pages""",
        "abstract_reconstruction": f"with {_ITEMS} select document_id, array_to_string({_words('text')}, ' ') as abstract from items",
        "result_url_resolution": f"select page_id, case page_id % 11 {' '.join(f'when {k} then {x}' for k, x in enumerate(shapes))} end as target from pages",
        "style_signals": f"with {_DOCS}, chunks as (select document_id, 0 as chunk_index, text from docs), {_SIGNALS} select document_id, {', '.join(f'round({n}, 6) as {n}' for n in _NAMES)} from signals",
        "chunk_ai_findings": f"""with {_TRANSCRIPTS}, {_paragraphs('docs', 'chunks')}, {_SIGNALS}, hits as (select *, {_HIT.format('')} as hit from signals)
select document_id, 'fdg_' || substr(sha256('ai::' || document_id || '::' || chunk_index), 1, 16) as finding_id, chunk_index, {_R4.format(f'least({_SCORE}, 1.0)')} as ai_likeness_score, {_ROUNDED},
  array_to_string(hit, ',') as signals_triggered,
  case when len(hit) = 0 then {_quoted(stylometry.NOTHING_FOUND)} else array_to_string(list_transform(hit[1:3], lambda x: {_TOLD}), ' ') end as explanation from hits""",
        "document_indicators": f"""with {_TRANSCRIPTS}, {_paragraphs('docs', 'chunks')}, {_SIGNALS}, {_MEANS} {' union all '.join(
  f"select document_id, {n!r} as signal_name, {n} as value, case when list_contains(hit, {n!r}) then {_quoted(stylometry.TOLD[n][0])} else {_quoted(stylometry.TOLD[n][1])} end as description, list_contains(hit, {n!r}) as triggered from risks"
  for n in _NAMES)}""",
        "document_ai_risk": f"""with {_TRANSCRIPTS}, {_paragraphs('docs', 'chunks')}, {_SIGNALS}, {_MEANS}
select document_id, {', '.join(_NAMES)}, array_to_string(hit, ',') as signals_triggered, ai_likeness_score, automated_writing_risk, automated_writing_risk <> 'low' as human_review_recommended,
  n_words < 80 as short_document, {_STYLE_CODE!r} || case when n_words < 80 then {',' + _SHORT_CODE!r} else '' end as caveats from risks""",
        "corpus_refresh_states": f"with {_SNAPSHOT} select cast(i as varchar) as source_path, state from states",
        "corpus_sources": f"with {_DOCS} select document_id as source_id, document_id as label, sha256(text) as content_hash from docs",
        "corpus_refreshed": f"""with {_SNAPSHOT}, docs as (select cast(i as varchar) as document_id, text from entries), {_paragraphs('docs', 'chunks')},
counted as (select document_id, count(*) as n, sum({n_shingles}) as g from (select document_id, {_words('lower(text)')} as w from chunks) group by document_id)
select document_id as source_id, sha256(text) as content_hash, coalesce(n, 0) as n_chunks, coalesce(cast(g as bigint), 0) as n_shingles from docs left join counted using (document_id)""",
        "corpus_refresh_stats": f"""with {_SNAPSHOT} select count(*) filter (state <> 'fresh' and readable) as indexed, count(*) filter (state <> 'fresh' and not readable) as skipped,
  count(*) filter (state = 'fresh') as up_to_date, count(*) as total_files from states""",
        "report_summary": f"with recursive {_REPORT} select document_id, plagiarism_match_count, plagiarism_overall_score, ai_likeness_score, automated_writing_risk, human_review_recommended from summary",
        "report_matches": f"""with recursive {_COPIED} select document_id, cast({_RANK} - 1 as int) as place, finding_id, source_id, source_chunk_index, similarity_score, match_type, start_offset as start,
  end_offset as "end" from matches""",
        "report_json": f"""with recursive {_REPORT}, n_chunks as (select document_id, count(*) as n from chunks group by document_id)
select document_id, '1.0' as schema_version, 'complete' as status, document_id as document_filename, automated_writing_risk as summary_automated_writing_risk,
  automated_writing_risk as ai_likelihood_automated_writing_risk, document_id as plagiarism_document_id, cast(length(text) as int) as character_count, ai_likeness_score,
  '["plagiarism","ai_check"]' as analyses_run, cast(plagiarism_match_count as int) as n_matches, cast(coalesce(n, 0) as int) as n_findings, case when n is null then 0 else 6 end as n_indicators,
  case when n is null then 0 when n_words < 80 then 2 else 1 end as n_caveats from summary left join n_chunks using (document_id)""",
        "report_text": f"""with recursive {_REPORT}, {_LISTED} select summary.document_id, {_HEAD.format('plagiarism, ai_check', 'plagiarism_overall_score', 'ai_likeness_score').replace('document_id', 'summary.document_id')} || {_PLAGIARISM_TEXT}
  || chr(10) || chr(10) || 'AI-likeness: score ' || {_FIXED2.format('ai_likeness_score')} || ', risk ' || automated_writing_risk
  || case when n_words is null then '' else {" || ".join(f"chr(10) || '  {x}: ' || {_FIXED2.format(x)}" for x in _NAMES)} || chr(10) || '  Caveats:' || chr(10) || '    - [stylometric_only] ' || {_quoted(stylometry.STYLE_ONLY)}
  || case when n_words < 80 then chr(10) || '    - [short_document] ' || {_quoted(stylometry.SHORT_TEXT)} else '' end end || chr(10) || '  Disclaimer: ' || {_quoted(DISCLAIMER)} as report
  from summary left join lines on lines.document_id = summary.document_id""",
        "report_text_matches": f"""with recursive {_COPIED}, {_LISTED} select docs.document_id, {_HEAD.format('plagiarism', 'coalesce(s, 0.0)', '0.0').replace('document_id', 'docs.document_id')} || {_PLAGIARISM_TEXT} as report
  from docs left join lines on lines.document_id = docs.document_id""",
    }
    return found
