"""The SQL of the personal data query: the plain patterns of the contract, and the same counts for disclosing terms."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PATTERNS = (
    ("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", 2, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    ("card", 3, r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", 4, r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_PART = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _located(table: str, pattern: str) -> str:
    """Rows (everything of ``table``, start, stop, value): the matches of ``pattern`` in its column t."""
    return f"""
select * exclude (m, g, i), list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start,
  start + length(m[i]) as stop, m[i] as value
from (select *, regexp_extract_all(t, '{pattern}') as m, regexp_split_to_array(t, '{pattern}') as g from {table}), unnest(range(1, len(m) + 1)) as u(i)"""


_BASE = " union all ".join(f"select r, '{kind}' as kind, {k} as k, cast(start as int) as start, cast(stop as int) as stop, value from ({_located('docs', p)})" for kind, k, p in _PATTERNS)

SQL = rf"""
with docs as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
found as materialized ({_BASE}),
numbered as (select *, regexp_replace(value, '[^0-9]', '', 'g') as d from found),
base as materialized (select r, kind, k, start, stop,
    kind || ':' || case kind when 'email' then {_LOWER.format('value')} when 'ip' then value else d end as entity
  from numbered where case kind when 'email' then true when 'ip' then regexp_matches(value, '^{_PART}(\.{_PART}){{3}}$')
    when 'phone' then length(d) between 8 and 15
    else length(d) between 16 and 19 and list_sum(list_transform(range(0, length(d)), lambda i:
      case when i % 2 = 1 then (2 * cast(substr(d, cast(length(d) - i as int), 1) as int)) // 10 + (2 * cast(substr(d, cast(length(d) - i as int), 1) as int)) % 10
        else cast(substr(d, cast(length(d) - i as int), 1) as int) end)) % 10 = 0 end),
cut as (select r, regexp_extract_all({_LOWER.format('t')}, '{_TERM}') as m, regexp_split_to_array({_LOWER.format('t')}, '{_TERM}') as g from docs),
tokens as (select r, unnest(m) as term, unnest(g[1:len(m)]) as gap, generate_subscripts(m, 1) as i from cut),
placed as (select r, term, cast(sum(length(gap) + length(term)) over (partition by r order by i) as int) as stop from tokens),
words as materialized (select r, term, stop - cast(length(term) as int) as start, stop from placed where length(term) >= 3 and not contains(term, chr(64976))),
outside as materialized (select * from words w where not exists (select 1 from base b where b.r = w.r and w.start <= b.stop and b.start <= w.stop)),
mentions as (select distinct r, entity from base),
n_e as (select entity, count(*) as n_e from mentions group by entity),
n_et as (select entity, term, count(*) as n_et from mentions join (select distinct r, term from outside) using (r) group by all having count(*) >= 2),
n_t as (select term, count(distinct r) as n_t from words group by term),
told as (select distinct term from n_et join n_e using (entity) join n_t using (term)
  where (n_et / n_t) * (n_et / n_t) * (n_et / n_t) * (n_et / n_t) * (select cast(count(*) as double) from docs) >= n_e),
terms as (select r, 'term' as kind, 5 as k, start, stop from outside join told using (term)),
spans as (select r, k, kind, start, stop from base union all select r, k, kind, start, stop from terms),
lists as (select r, string_agg(kind || ':' || start || ':' || stop, ',' order by k, start) as spans,
  string_agg(kind || ':' || start || ':' || stop, ',' order by k, start) filter (k < 5) as base,
  count(*) filter (k = 1) as n_email, count(*) filter (k = 2) as n_ip, count(*) filter (k = 3) as n_card, count(*) filter (k = 4) as n_phone
  from spans group by r)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join lists using (r)
"""
