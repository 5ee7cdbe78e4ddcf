"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from touchline.llm import risk_rules

URL_RULES = """
with u as (
  select page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(rhost, rpath, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
  select page_id, rhost || rpath as rule, verdict,
    row_number() over (partition by page_id order by length(rhost || rpath) desc) as k
  from u join rules on (host = rhost or suffix(host, '.' || rhost)) and prefix(path, rpath))
select u.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') as verdict
from u left join (select * from fits where k = 1) f on u.page_id = f.page_id
"""

WARC = """
with p as (select page_id, url, coalesce(html, '') as body, strlen(coalesce(html, '')) as n from pages),
f as (select *, case when n >= 100 then min(page_id) over (partition by body) end as first from p),
k as (select *, case when url is null or not contains(url, '://') then coalesce(url, '')
    else array_to_string(list_reverse(string_split(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.')), ',')
      || ')' || regexp_extract(url, '://[^/?#]*([^#]*)', 1) end as url_key from f)
select page_id, n as payload_bytes, sha256(body) as payload_digest,
  case when first is not null and first <> page_id then 'revisit' else 'response' end as record_type,
  case when first <> page_id then first end as refers_to, url_key,
  row_number() over (order by url_key, page_id) - 1 as position
from k
"""

_VALUES = ", ".join(
    f"('{r}', case when {b} > 0 then cast(floor(1000 * {a} / {b}) as bigint) else -1 end)" for r, (a, b) in risk_rules.RULES.items()
)
_RISK = risk_rules.RISK / len(risk_rules.RULES)

RISK_RULES = rf"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select doc_id, unnest(range(1, len(words) - 3)) as p, words from w where len(words) >= 5),
h as (select doc_id, p, words[p:p+4] as gram from g),
r as (select doc_id, p from h qualify count(*) over (partition by doc_id, gram) > 1),
c as (select doc_id, sum(least(5, coalesce(nxt - p, 5))) as n from (select doc_id, p, lead(p) over (partition by doc_id order by p) as nxt from r) group by doc_id),
m as (select w.doc_id, stratum, len(words)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint as n_capitals,
    len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words
  from w left join c on w.doc_id = c.doc_id),
good as (select doc_id from labels group by doc_id having min(quality) = 1 and max(quality) = 1),
v as (select m.stratum, x.rule, x.value from m join good using (doc_id), lateral (values {_VALUES}) x(rule, value)),
k as (select stratum, rule, cutoff, count(*) as n, count(*) filter (where value >= cutoff) as k
  from v, (select unnest([{', '.join(map(str, risk_rules.CUTOFFS))}]) as cutoff) group by all),
p as (select *, case when k >= n * {_RISK} then 1.0 else (
    select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK}) + (n - i) * ln(1 - {_RISK})))
    from (select unnest(range(0, k + 1)) as i)) end as p from k),
cut as (select stratum, rule, min(cutoff) as cutoff from p where p <= {risk_rules.ERROR} / (select count(*) from k) group by all),
hit as (select m.doc_id from m, lateral (values {_VALUES}) x(rule, value) join cut on cut.stratum = m.stratum and cut.rule = x.rule
  where x.value >= cut.cutoff group by m.doc_id)
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and m.doc_id not in (select doc_id from hit) as kept
from m
"""
