"""DuckDB SQL of the adapters and of some text functions, for the oracles."""

from __future__ import annotations

from quillgrain.functions import text as T



def banks(table: str, rows: int = 250) -> str:
    """How many banks the rows of a table are dealt to; four at least."""
    return f"(select greatest(4, count(*) // {rows}) from {table})"


CONV = f"""conv as (
  select bank_id, conv_id * 1000 + turn as id, conv_id as session_id, turn,
    row_number() over (partition by bank_id order by conv_id, turn) as turn_idx,
    case role when 'user' then 'dialogue' when 'assistant' then 'episodic' else 'semantic' end as kind,
    case role when 'user' then 'told' when 'assistant' then 'witnessed' else 'remembered' end as provenance,
    text as content, 'turn:' || conv_id || ':' || turn as event_key
  from (select *, conv_id % {banks("conversations")} as bank_id from conversations))"""


def squeeze(t: str) -> str:
    return f"trim(regexp_replace(coalesce({t}, ''), '\\s+', ' ', 'g'))"


def salience(t: str) -> str:
    hits = " + ".join(f"contains(lower({t}), '{m}')::int" for m in T.SALIENCE_MARKERS)
    return f"round(least(0.95::double, 0.45::double + least(length({t}), 400) / 1600.0::double + 0.08::double * ({hits})), 3)"


def tokens(t: str, cls: str = "[a-z0-9'']{3,}") -> str:
    return f"regexp_extract_all(lower(coalesce({t}, '')), '{cls}')"


def distinct(expr: str) -> str:
    """Distinct elements of a list in the order of first sight."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


ENT = distinct("regexp_extract_all(regexp_replace(t, '[^\\x00-\\x7F]', '_', 'g'), '\\b(?:[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,2})\\b')")
GIST = """case when length(sq) <= 240 then sq else coalesce(nullif(array_to_string(list_slice(parts, 1,
    len(list_filter(range(1, len(parts) + 1), lambda i: length(array_to_string(list_slice(parts, 1, i), ' ')) <= 240))), ' '), ''),
    regexp_replace(substr(sq, 1, 240), ' [^ ]*$', '')) end"""
PARTS = "string_split(regexp_replace(substr(sq, 1, 242), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) as parts"


def names(limit: int = 12) -> str:
    """The names in a text `t`."""
    return f"list_filter({ENT}, lambda x: x not in {tuple(T.BLOCKED_ENTITIES)})[1:{limit}]"


def key_phrases(source: str, key: str, text: str, ents: str) -> str:
    """Tables up to kf(k, phrases) over the rows of `source`: quotes, names and ranked words, each once."""
    tok, stop = tokens(text, "[a-z0-9''-]{3,}"), words(T.STOPWORDS)
    return f"""kt as (select {key} as k, unnest({tok}) as w, generate_subscripts({tok}, 1) as i from {source}), kb as (select k, w, lead(w) over (partition by k order by i) as n from kt),
kp as (select k, w as phrase, 1.0::double as weight from kb where not list_contains({stop}, w) union all select k, w || ' ' || n, 1.5 from kb where n is not null and not list_contains({stop}, w) and not list_contains({stop}, n)),
kg as (select k, phrase, sum(weight) as weight from kp group by 1, 2),
kr as (select k, list(phrase order by weight desc, len(string_split(phrase, ' ')) desc, phrase)[1:24] as ranked from kg group by 1),
ka as (select {key} as k, list_filter(list_transform(regexp_extract_all({text}, '["“](.{{3,100}}?)[”"]', 1), lambda q: {squeeze("q")}), lambda x: x <> '') || {ents} || coalesce(ranked, []) as every from {source} left join kr on k = {key}),
kl as (select k, every, list_transform(every, lambda x: lower(x)) as low from ka), kf as (select k, list_filter(every, lambda x, i: list_position(low, lower(x)) = i)[1:12] as phrases from kl)"""


def words(names: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in names) + "]"


DOCM = f"""docm as (
  select doc_id % {banks("documents")} as bank_id, doc_id as id, case when doc_id % 11 <> 0 then doc_id end as turn_idx,
    case when doc_id % 7 = 0 then 'inference' when doc_id % 19 = 0 then 'commitment' else 'semantic' end as kind,
    case when doc_id % 7 = 0 then 'inferred' else 'read' end as provenance, text as content, source,
    case when doc_id % 7 = 0 then (doc_id % 10) / 10.0::double else 0.8::double end as confidence, {salience("text")} as salience,
    doc_id % 13 = 0 as archived, case when doc_id % 17 = 0 then 'b' || (doc_id % 3) end as retired_batch,
    'doc:' || doc_id as event_key from documents)"""

QUERIES = f"""qs as (
  select item_id as query_id, item_id % {banks("documents")} as bank_id, text as query_text,
    500 + item_id * 7 as cutoff_turn from benchmark)"""

OBS = """obs as (
  select doc_id // 20 as hypothesis_id, doc_id as seq,
    'https://source.example/' || (doc_id // 20) || '/' || (doc_id % 5) as url,
    case when toxic = 1 then 'contradicts' when quality = 1 then 'supports' else 'context' end as stance, text as body
  from labels join documents using (doc_id))"""

BELIEFS = f"""ups as (
  select user_id % {banks("events", 2500)} as bank_id, 'user-' || user_id as about,
    case event_type when 'click' then 'observation' when 'view' then 'stated_fact' when 'signup' then 'preference'
      when 'purchase' then 'goal' when 'error' then 'trait' else 'identity' end as kind,
    case when k % 2 = 1 then 'not ' else '' end || event_type || ' bucket' || (k % 5) as claim,
    least(1.0::double, abs(value) / 50) as confidence,
    row_number() over (partition by user_id order by ts, event_id) as turn, event_id as seq
  from (select *, (props::json->>'k')::int as k from events))"""

EXPERIMENTS = """ex as (
  select event_id as id, user_id as hypothesis_id, event_type || ':' || k as digest,
    case when k % 50 = 1 then 'fix-marker' when event_type = 'error' then 'refuted' when k % 10 = 0 then 'inconclusive' else 'confirmed' end as outcome,
    'exit ' || case when event_type = 'error' then '1' else '0' end || ' in 1s' as observation, k % 25 = 3 as reproduces, ts, event_type, k
  from (select *, (props::json->>'k')::int as k from events))"""


#: Documents with their names and key phrases, and the exact cue score of the pairs of a bank that `qs` asks.
CUES = f"""cd as (select doc_id, doc_id % {banks("documents")} as bank_id, text as t from documents), ce as (select *, {names()} as ents from cd), {key_phrases("ce", "doc_id", "t", "ents")},
cu as (select doc_id as id, bank_id, ents, phrases from ce join kf on k = doc_id)"""

_CUE = """list_max([0.0::double] || list_transform(phrases, lambda p: case when trim(p) <> '' and contains(lower(query_text), lower(trim(p))) then 1.0 when trim(p) <> '' and contains(lower(trim(p)), lower(query_text)) and length(query_text) >= 4 then 0.8 else 0 end::double)
  || list_transform(ents, lambda e: case when contains(lower(query_text), lower(e)) then 0.7 else 0 end::double))"""
EXACT = f"ex as (select query_id, id, {_CUE} as score from qs join cu using (bank_id))"
