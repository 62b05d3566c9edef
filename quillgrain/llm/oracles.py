"""DuckDB SQL for the operators that SQL expresses on small tables."""

from __future__ import annotations

from quillgrain.llm import quality_rules as Q

_WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
x as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as i, len(w) as n from d),
v as (select *, case when i <= n - 49 then string_agg(t, ' ') over (partition by doc_id order by i rows between current row and 49 following) end as s from x),
m as (select *, s is not null and min(doc_id) over (partition by s) < doc_id as hit from v),
g as (select *, max(hit::int) over (partition by doc_id order by i rows between 49 preceding and current row) = 1 as gone from m),
k as (select doc_id, count_if(gone) as r, string_agg(t, ' ' order by i) filter (where not gone) as kept from g group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(r, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""

QUALITY_RULES = rf"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
l as (select doc_id, host, t, unnest(string_split(t, chr(10))) as l from d),
lw as (select doc_id, host, t, l, regexp_extract_all(l, '{_WORD}') as lw from l where regexp_matches(l, '{_WORD}')),
ln as (select doc_id, host, t, l, len(lw) as n, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from lw),
dup as (select doc_id, count(*) - count(distinct l) as n_dup_lines from ln group by 1),
x as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d),
y as (select doc_id, i, x || ' ' || lead(x, 1) over o || ' ' || lead(x, 2) over o as g from x window o as (partition by doc_id order by i)),
z as (select doc_id, i, g is not null and count(*) over (partition by doc_id, g) > 1 as twice from y),
r as (select doc_id, count_if(c) as n_repeat_words from (select doc_id, max(twice::int) over (partition by doc_id order by i rows between 2 preceding and current row) = 1 as c from z) group by 1),
hosts as (select host, count(distinct t) as host_docs from d group by 1),
often as (select host, norm from ln join hosts using (host) group by host, norm, host_docs having count(distinct t) > {Q.FLOOR} and count(distinct t) > {Q.SHARE} * host_docs),
gone as (select doc_id, sum(n) as n_frequent_words from ln join often using (host, norm) group by 1),
a as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_frequent_words, 0)::bigint as n_frequent_words
  from d left join dup using (doc_id) left join r using (doc_id) left join gone using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from a)
select *, not base_failed and n_words - n_frequent_words >= greatest(1, {Q.KEEP} * n_words) as kept from b
"""
