"""Queries of evidence, beliefs, lifecycle and telemetry, with SQL where it expresses them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrain.functions import belief as B
from quillgrain.functions import text as T
from quillgrain.operators import bank as K
from quillgrain.operators import beliefs as H
from quillgrain.operators import evidence as E
from quillgrain.operators import lifecycle as L
from quillgrain.operators import telemetry as M
from quillgrain.plans import sql as S
from quillgrain.plans.catalog import Catalog
from quillgrain.sources import adapters as A

C = Catalog()
query = C.query
_EBANKS = S.banks("events", 2500)

# ---- evidence

_READ = f"with {S.OBS}, rd as (select *, lag(stance) over (partition by hypothesis_id, url order by seq) as before, row_number() over (partition by hypothesis_id, url order by seq)::int as reading from obs)"
_FLIP = "coalesce(before in ('supports', 'contradicts') and stance in ('supports', 'contradicts') and before <> stance, false)"


@query("w11_fresh_or_flipped", f"{_READ} select seq, reading, before is null as fresh, {_FLIP} as flipped from rd")
def w11(spark, d):
    return E.readings(A.observations(spark, d)).select("seq", "reading", "fresh", "flipped")


_FOLD = f"""with recursive {S.OBS}, rd as (select *, lag(stance) over (partition by hypothesis_id, url order by seq) as before, row_number() over (partition by hypothesis_id order by seq) as n from obs),
x as (select hypothesis_id, n, before is null as fresh, {_FLIP} as flipped, stance,
  (stance = 'supports')::int - coalesce((before = 'supports')::int, 0) as ds, (stance = 'contradicts')::int - coalesce((before = 'contradicts')::int, 0) as dk from rd),
f as (select hypothesis_id, 0::bigint as n, 0.3::double as c, 0 as s, 0 as k, false as d, 0 as fl from (select distinct hypothesis_id from x)
  union all select hypothesis_id, n, case when fresh then case when s1 > 0 and k1 > 0 then round(greatest(0.35, least(0.65, c2)), 4) else c2 end when flipped then round(greatest(0.35, least(0.65, c)), 4) else c end, s1, k1,
    d or (fresh and s1 > 0 and k1 > 0) or flipped, fl + flipped::int
  from (select *, round(case when d then greatest(0.35, least(0.65, m)) else m end, 4) as c2
    from (select x.hypothesis_id, x.n, x.fresh, x.flipped, f.c, f.d, f.fl, f.s + x.ds as s1, f.k + x.dk as k1,
      case x.stance when 'supports' then f.c + least(0.4, 0.35 * (1 - f.c)) when 'contradicts' then f.c - least(0.4, 0.45 * f.c) else f.c end as m
      from f join x on x.hypothesis_id = f.hypothesis_id and x.n = f.n + 1)))
select hypothesis_id, c as confidence, case when d then 'disputed' else 'open' end as status, s as n_supports, k as n_contradicts, fl as n_flips from f qualify row_number() over (partition by hypothesis_id order by n desc) = 1"""


@query("f01_evidence_confidence", _FOLD)
def f01(spark, d):
    return E.confidence(A.observations(spark, d))


_CUR = f"with {S.OBS}, cur as (select *, min(seq) over (partition by hypothesis_id, url) as first_seq from obs qualify row_number() over (partition by hypothesis_id, url order by seq desc) = 1)"


@query("a01_stance_tally", f"{_CUR} select hypothesis_id, count_if(stance = 'supports') as supports, count_if(stance = 'contradicts') as contradicts, count_if(stance = 'context') as context from cur group by 1")
def a01(spark, d):
    return E.tally(A.observations(spark, d))


@query("f02_dispute_sides", f"{_CUR} select hypothesis_id, string_agg('ev:' || first_seq, ' ' order by first_seq) filter (where stance = 'supports') as supporting, string_agg('ev:' || first_seq, ' ' order by first_seq) filter (where stance = 'contradicts') as contradicting from cur group by 1 having supporting is not null and contradicting is not null")
def f02(spark, d):
    cur = E.current(A.observations(spark, d))
    side = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("stance") == s, F.col("first_seq")))), lambda x: F.concat(F.lit("ev:"), x.cast("string"))), " ")
    return cur.groupBy("hypothesis_id").agg(side("supports").alias("supporting"), side("contradicts").alias("contradicting")).where("supporting <> '' and contradicting <> ''")


@query("f03_dispute_notes", f"{_READ} select hypothesis_id, count(*) as n_notes, min(seq) as first_note from rd where {_FLIP} group by 1")
def f03(spark, d):
    return E.readings(A.observations(spark, d)).where("flipped").groupBy("hypothesis_id").agg(F.count("*").alias("n_notes"), F.min("seq").alias("first_note"))


@query("f04_record_evidence", f"""{_READ}, e as (select *, {S.squeeze('body')} as t from rd), m as (select *, ' …[cut: ' || length(t) || ' chars total]' as mk from e)
select seq, 'evidence:' || substr(sha1(hypothesis_id || '|' || url), 1, 16) as event_key, case when length(t) > 600 then substr(t, 1, 600 - length(mk)) || mk else t end as excerpt, case when stance = 'context' then 0.6 else 0.7 end::double as salience, before is null as fresh from m""")
def f04(spark, d):
    r = E.readings(A.observations(spark, d))
    k = F.concat(F.lit("evidence:"), F.substring(F.sha1(F.concat_ws("|", F.col("hypothesis_id").cast("string"), "url")), 1, 16))
    return r.select("seq", k.alias("event_key"), T.excerpt("body").alias("excerpt"), F.when(F.col("stance") == "context", 0.6).otherwise(0.7).alias("salience"), "fresh")


@query("j14_citation_grounding", f"""with {S.CONV}, a as (select session_id as answer_id, 'turn:' || session_id || ':' || unnest([0, 1, 1, 90]) as ref, unnest([1, 2, 3, 4]) as p from (select distinct session_id from conv)),
u as (select answer_id, ref, min(p) as p from a group by 1, 2) select answer_id, ref, ref in (select event_key from conv where turn < 6) as delivered from u""")
def j14(spark, d):
    conv = A.conversation_rows(spark, d)
    key = lambda n: F.concat(F.lit("turn:"), F.col("answer_id").cast("string"), F.lit(f":{n}"))
    cites = conv.select(F.col("session_id").alias("answer_id")).distinct().withColumn("refs", F.array(key(0), key(1), key(1), key(90)))
    return E.grounded(cites, conv.where("turn < 6").select(F.col("session_id").alias("answer_id"), F.col("event_key").alias("ref"))).select("answer_id", "ref", "delivered")


@query("j15_three_way_grounding", f"""with {S.CONV}, a as (select session_id as answer_id, unnest(['turn:' || session_id || ':0', 'turn:' || session_id || ':5', 'turn:x:' || session_id, 'current']) as ref from (select distinct session_id from conv))
select answer_id, ref, case when ref = 'current' or exists (select 1 from conv c where c.session_id = answer_id and c.turn < 3 and c.event_key = ref) then 'delivered' when ref in (select event_key from conv) then 'in_bank' else 'invented' end as status from a""")
def j15(spark, d):
    conv = A.conversation_rows(spark, d)
    i = F.col("answer_id").cast("string")
    refs = conv.select(F.col("session_id").alias("answer_id")).distinct().select("answer_id", F.explode(F.array(F.concat(F.lit("event:turn:"), i, F.lit(":0")), F.concat(F.lit("turn:"), i, F.lit(":5")), F.concat(F.lit("turn:x:"), i), F.lit("current"))).alias("ref"))
    return E.grounding_status(refs, conv.where("turn < 3").select(F.col("session_id").alias("answer_id"), F.col("event_key").alias("ref")), conv.select(F.col("event_key").alias("ref"))).select("answer_id", "ref", "status")


@query("j16_ref_in_bank", f"with {S.CONV}, {S.DOCM}, k as (select event_key from conv union select event_key from docm) select doc_id from labels where 'doc:' || (doc_id * 2) in (select event_key from k)")
def j16(spark, d):
    keys = A.conversation_rows(spark, d).select("event_key").unionByName(A.document_rows(spark, d).select("event_key")).distinct()
    lab = A.table(spark, d, "labels").select("doc_id", F.concat(F.lit("doc:"), (F.col("doc_id") * 2).cast("string")).alias("event_key"))
    return lab.join(keys, "event_key", "left_semi").select("doc_id")


_WORDSET = S.distinct(S.tokens("t"))


J17 = f"""with {S.DOCM}, sm as (select doc_id as summary_id, (doc_id // 20) || case when doc_id % 7 = 0 then ':surmise' else ':received' end as scope, {S.squeeze('text')} as sq from documents),
c as (select summary_id, scope, unnest(list_filter(list_transform(string_split(regexp_replace(sq, '([.!?]) +([A-Z"''“‘])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) as claim, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(sq, '([.!?]) +([A-Z"''“‘])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 as pos from sm),
cw as (select distinct summary_id, scope, pos, unnest(list_distinct({S.tokens('claim')})) as word from c), mw as (select distinct (id // 20) || case when kind = 'inference' then ':surmise' else ':received' end as scope, event_key as ref, unnest(list_distinct({S.tokens('content')})) as word from docm),
sh as (select summary_id, pos, ref, count(*) as n from cw join mw using (scope, word) where not list_contains({S.words(T.SUPPORT_STOPWORDS)}, word) group by 1, 2, 3 having count(*) >= 3),
b as (select summary_id, pos, string_agg(ref, ' ' order by n desc, ref) as refs from (select * from sh qualify row_number() over (partition by summary_id, pos order by n desc, ref) <= 3) group by 1, 2)
select summary_id, pos::int as pos, claim, coalesce(refs, '') as refs from c left join b using (summary_id, pos)"""


def _window(doc, inferred=None):
    """A summary's support lies in its own window of twenty documents, and in its own scope."""
    scope = F.lit(":received") if inferred is None else F.when(inferred, ":surmise").otherwise(":received")
    return F.concat(F.floor(F.col(doc) / 20).cast("string"), scope).alias("scope")


@query("j17_support_sets", J17)
def j17(spark, d):
    rows = A.document_rows(spark, d).select(_window("id", F.col("kind") == "inference"), F.col("event_key").alias("ref"), "content")
    sm = A.table(spark, d, "documents").select(F.col("doc_id").alias("summary_id"), _window("doc_id", F.col("doc_id") % 7 == 0), F.col("text").alias("summary"))
    return E.support_sets(sm, rows).select("summary_id", "pos", "claim", F.array_join("support_refs", " ").alias("refs"))


A14 = J17.replace("case when doc_id % 7 = 0 then ':surmise' else ':received' end as scope", "':received' as scope").replace("case when kind = 'inference' then ':surmise' else ':received' end as scope", "':received' as scope")
A14 = A14[: A14.index("b as (select summary_id, pos, string_agg")].rstrip().rstrip(",") + " select distinct ref from (select * from sh qualify row_number() over (partition by summary_id, pos order by n desc, ref) <= 3)"


@query("a14_supported_refs", A14)
def a14(spark, d):
    rows = A.document_rows(spark, d).select(_window("id"), F.col("event_key").alias("ref"), "content")
    sm = A.table(spark, d, "documents").select(F.col("doc_id").alias("summary_id"), _window("doc_id"), F.col("text").alias("summary"))
    return E.support_sets(sm, rows).select(F.explode("support_refs").alias("ref")).distinct()


@query("a17_open_questions", _FOLD.replace("select hypothesis_id, c as confidence, case when d then 'disputed' else 'open' end as status, s as n_supports, k as n_contradicts, fl as n_flips from f qualify", "select hypothesis_id, c as confidence, s as n_supports, k as n_contradicts from f where not d or d qualify") + " order by hypothesis_id desc limit 5")
def a17(spark, d):
    return E.confidence(A.observations(spark, d)).orderBy(F.desc("hypothesis_id")).limit(5).select("hypothesis_id", "confidence", "n_supports", "n_contradicts")


_HEDGE = f"""with h as ({_FOLD}), cur as (select * from ({_CUR} select * from cur) where stance in ('supports', 'contradicts')),
top as (select *, row_number() over (partition by hypothesis_id, stance order by first_seq) as r from cur qualify r <= 3),
l as (select hypothesis_id, count_if(stance = 'supports') as n_s, string_agg('- ' || stance || ' [ev:' || first_seq || '] (' || url || ')', chr(10) order by (stance <> 'supports')::int, r) as lines from top group by 1)
select hypothesis_id, case when status = 'disputed' then 'Sources disagree on this.' when coalesce(n_s, 0) > 0 then 'Best supported reading so far.' else 'No well-supported answer was established.' end || coalesce(chr(10) || lines, '') as answer, confidence from h left join l using (hypothesis_id)"""


@query("r13_hedged_answer", _HEDGE)
def r13(spark, d):
    obs = A.observations(spark, d)
    return E.hedge(E.confidence(obs), obs)


@query("r14_accepted_conclusion", f"""with h as ({_FOLD}), g as (select hypothesis_id, count_if(seq % 3 = 0) as n_refs, bool_and(stance = 'context') as told from ({S.OBS.removeprefix('obs as ')[1:-1]}) group by 1)
select hypothesis_id, confidence, status, coalesce(n_refs > 0 and (confidence >= 0.6 or status = 'disputed' or (n_supports + n_contradicts = 0 and told)), false) as accepted from h left join g using (hypothesis_id)""")
def r14(spark, d):
    obs = A.observations(spark, d)
    g = obs.select("hypothesis_id", (F.col("seq") % 3 == 0).alias("delivered"), (F.col("stance") == "context").alias("testimony"))
    return E.accepted(E.confidence(obs), g).select("hypothesis_id", "confidence", "status", "accepted")


# ---- beliefs

@query("f05_belief_merge")
def f05(spark, d):
    return H.merge(A.belief_updates(spark, d))


_LIVE = "confidence * pow(0.5, greatest(0, 100 - turn) / case kind when 'observation' then 5 when 'stated_fact' then 18 when 'preference' then 300 when 'goal' then 45 else 400 end::double)"
_STORE = f"with {S.BELIEFS}, st as (select bank_id, about, kind, claim, arg_max(confidence, turn) as confidence, max(turn) as turn from ups group by 1, 2, 3, 4), lv as (select *, round({_LIVE}, 9) as live from st)"


def _store(spark, d):
    """One row of each claim of a subject: its latest update."""
    u = A.belief_updates(spark, d).groupBy("bank_id", "about", "kind", "claim")
    return u.agg(F.max_by("confidence", "turn").alias("confidence"), F.max("turn").alias("last_updated_turn"))


@query("f06_belief_sweep", f"{_STORE} select bank_id, about, kind, claim, live from lv where live >= 0.05 qualify row_number() over (partition by bank_id, about order by live desc, kind, claim) <= 30")
def f06(spark, d):
    return H.sweep(_store(spark, d), F.lit(100)).select("bank_id", "about", "kind", "claim", "live")


@query("o05_active_sheet", f"{_STORE}, k as (select bank_id, about || '|' || kind || '|' || claim as key, max(live) as live from lv group by 1, 2), s as (select *, row_number() over (partition by bank_id order by round(live + case when key like '%goal%' then 0.08 else 0 end, 9) desc, key)::int as rank from k) select bank_id, rank, key, live from s where rank <= 5")
def o05(spark, d):
    key = B.hypothesis_key(F.col("about"), F.col("kind"), F.col("claim"))
    st = _store(spark, d).withColumn("_v", F.round(H.live(F.lit(100)), 9))
    top = st.groupBy("bank_id", "about", "kind", "claim").agg(F.max_by(F.struct("confidence", "last_updated_turn"), "_v").alias("x")).select("bank_id", "about", "kind", "claim", "x.confidence", "x.last_updated_turn")
    held = top.where("kind = 'goal'").select("bank_id", key.alias("key"))
    return H.active_sheet(top, held, F.lit(100))


@query("o06_leading_beliefs", f"{_STORE}, r as (select bank_id, about, kind, claim, round(live, 3) as confidence, row_number() over (partition by bank_id, about, kind order by round(live, 3) desc, claim, turn)::int as rank from lv) select bank_id, about, kind, rank, claim, confidence from r where rank <= 3")
def o06(spark, d):
    return H.leading(_store(spark, d), F.lit(100))


@query("a18_latest_belief_view", f"with {S.BELIEFS} select bank_id, max(turn) as latest_turn, count(distinct about) as n_subjects from ups group by 1")
def a18(spark, d):
    return A.belief_updates(spark, d).groupBy("bank_id").agg(F.max("turn").alias("latest_turn"), F.countDistinct("about").alias("n_subjects"))


def _asked(spark, d):
    return A.belief_updates(spark, d).select(F.col("seq").alias("asked_id"), "bank_id", "about", "claim")


_CRED = f"""{_STORE}, ask as (select seq as asked_id, bank_id, about, claim from ups), sl as (select bank_id, about, claim as held, {_LIVE} as live from st),
p as (select asked_id, claim, held, live, list_filter(list_distinct(regexp_extract_all(lower(claim), '[a-z0-9'']+')), lambda x: x <> 'not' and not contains('|user|' || substr(about, 6) || '|', '|' || x || '|')) as fa, list_filter(list_distinct(regexp_extract_all(lower(held), '[a-z0-9'']+')), lambda x: x <> 'not' and not contains('|user|' || substr(about, 6) || '|', '|' || x || '|')) as fb from ask left join sl using (bank_id, about)),
q as (select asked_id, held, live, case when held is null then null when claim.starts_with('not') <> held.starts_with('not') then 0 else len(list_intersect(fa, fb)) / least(len(fa), len(fb))::double end as sim from p)
select asked_id, case when sim >= 0.4 then live end as credence from q qualify row_number() over (partition by asked_id order by sim desc nulls last, held, live desc) = 1"""


@query("f07_credence", f"select asked_id, round(credence, 9) as credence from ({_CRED})")
def f07(spark, d):
    return H.credence(_asked(spark, d), _store(spark, d), F.lit(100)).select("asked_id", F.round("credence", 9).alias("credence"))


@query("f08_reconcile", f"select asked_id as id, round(greatest(coalesce(credence, 0.275), 0.275), 4) as revised, abs(round(greatest(coalesce(credence, 0.275), 0.275), 4) - 0.5) > 1e-6 as changed from ({_CRED})")
def f08(spark, d):
    asked = _asked(spark, d)
    cred = H.credence(asked, _store(spark, d), F.lit(100))
    inf = asked.select(F.col("asked_id").alias("id"), F.lit(0.6).alias("salience"), F.lit(0.5).alias("confidence"))
    return H.reconcile(inf, cred).select("id", "revised", "changed")


# ---- lifecycle

@query("f09_raise_importance", f"with {S.DOCM}, h as (select 'doc:' || (doc_id // 2) as event_key, count(*) as n from labels group by 1) select id, case when n is null then null else greatest(greatest(0, least(1, salience)), least(0.97, 1 - (1 - greatest(0, least(1, salience))) * pow(0.88, n))) end as importance from docm left join h using (event_key)")
def f09(spark, d):
    rows = A.document_rows(spark, d).withColumn("importance", F.lit(None).cast("double"))
    hits = A.table(spark, d, "labels").select(F.concat(F.lit("doc:"), F.floor(F.col("doc_id") / 2).cast("string")).alias("event_key"))
    return L.raise_importance(rows, hits, only_unrevised=True).select("id", "importance")


_DISPUTES = f"""dp as (select item_id as dispute_id, item_id as turn_idx, case when item_id % 6 <> 5 then 'reading ' || item_id else ' ' end as reading, case when item_id % 4 = 0 then 'doc:' || item_id else '' end as memory_ref, lower({S.squeeze("text")}) as needle from benchmark),
gq as (select *, {S.squeeze('content')} as sq from docm), gp as (select *, {S.PARTS} from gq), a as (select *, lower({S.GIST}) as g, lower(sq) as c, greatest(0, least(1, salience)) as base from gp),
m1 as (select dispute_id, bank_id, id, 1 as tier from dp join a on memory_ref = event_key where memory_ref <> ''), m2 as (select dispute_id, bank_id, id, 2 as tier from dp join a on needle = g where needle <> '' and dispute_id not in (select dispute_id from m1)),
m3 as (select dispute_id, bank_id, id, 3 as tier from dp join a on contains(g, needle) or contains(c, needle) where needle <> '' and dispute_id not in (select dispute_id from m1 union select dispute_id from m2)), m as (select * from m1 union all select * from m2 union all select * from m3)"""


def _disputes(spark, d):
    rows = A.document_rows(spark, d).withColumns({"importance": F.lit(None).cast("double"), "gist": T.gist("content")})
    rows = rows.withColumn("disputed", F.when(F.col("id") % 5 == 0, F.struct(F.lit(1).cast("long").alias("turn_idx"), F.lit("before").alias("reading"), F.lit(2).cast("long").alias("count"))))
    i = F.col("item_id")
    said = F.when(i % 6 != 5, F.concat(F.lit("reading "), i.cast("string"))).otherwise(" ")
    return rows, A.table(spark, d, "benchmark").select(i.alias("dispute_id"), i.alias("turn_idx"), said.alias("reading"), F.when(i % 4 == 0, F.concat(F.lit("doc:"), i.cast("string"))).alias("memory_ref"), F.col("text").alias("gist"))


@query("f10_dispute", f"with {S.DOCM}, {_DISPUTES} select dispute_id, bank_id, id, tier from m")
def f10(spark, d):
    return L.dispute(*_disputes(spark, d))


@query("f10_disputed_rows", f"""with {S.DOCM}, {_DISPUTES}, h as (select bank_id, id, count(*) as n, max(dispute_id) as turn_idx from m join dp using (dispute_id) where trim(reading) <> '' group by 1, 2)
select bank_id, id, n + case when id % 5 = 0 then 2 else 0 end as n_disputes, h.turn_idx, 'reading ' || h.turn_idx as reading, round(least(0.97, base + 0.2 * n), 6)::double as importance from h join a using (bank_id, id)""")
def f10_rows(spark, d):
    out = L.apply_disputes(*_disputes(spark, d))
    return out.where("disputed.reading <> 'before'").select("bank_id", "id", F.col("disputed.count").alias("n_disputes"), "disputed.turn_idx", "disputed.reading", F.round("importance", 6).alias("importance"))


_RETIRE = "case when k.event_key not in (select event_key from docm) then 'no such memory' when retired_batch is not null then 'already retired' when kind = 'commitment' then 'a commitment' when id % 23 = 0 then 'carries a dispute' else 'retired' end"


@query("l01_retire", f"with {S.DOCM}, k as (select 'doc:' || (doc_id * 3) as event_key from labels) select k.event_key, {_RETIRE} as outcome from k left join docm using (event_key)")
def l01(spark, d):
    keys = A.table(spark, d, "labels").select(F.concat(F.lit("doc:"), (F.col("doc_id") * 3).cast("string")).alias("event_key"))
    return L.retire(keys, A.document_rows(spark, d).withColumn("disputed", F.col("id") % 23 == 0))


@query("l02_restore_batch", f"with {S.DOCM} select id, case when retired_batch <> 'b1' then retired_batch end as retired_batch from docm")
def l02(spark, d):
    return L.restore(A.document_rows(spark, d), "b1").select("id", "retired_batch")


@query("l03_purge_retired", f"with {S.DOCM} select event_key, case when id % 2 = 0 then 'kept' else 'purged' end as outcome from docm where retired_batch = 'b2'")
def l03(spark, d):
    rows = A.document_rows(spark, d)
    return L.purge(rows, rows.where("id % 2 = 0").select(F.col("event_key").alias("ref")), "b2")


@query("l04_archive_sweep", f"with {S.DOCM} select id, coalesce(not archived and turn_idx < 488 and kind <> 'commitment' and salience < 0.72, false) as to_archive from docm")
def l04(spark, d):
    rows = A.document_rows(spark, d).withColumn("importance", F.lit(None).cast("double"))
    return rows.select("id", L.archivable(F.lit(500)).alias("to_archive"))


_L5 = f"""{S.CONV}, g as (select *, {S.squeeze('content')} as sq, {S.salience('content')} as salience from conv), gp as (select *, {S.PARTS} from g), w as (select *, case provenance when 'told' then 'received' else 'autobiographical' end as scope, {S.GIST} as gist from gp where turn_idx > bank_id * 5 and trim(content) <> ''),
sp as (select bank_id, min(turn_idx) as start_turn, max(turn_idx) as end_turn, count_if(scope = 'autobiographical')::bigint as n_first_hand, bank_id % 4 = 1 and count_if(scope = 'autobiographical') > 0 as refused from w group by 1),
t as (select bank_id, scope, case when bank_id % 4 = 1 and scope = 'autobiographical' then '' else string_agg(gist, ' ' order by turn_idx, id) end as summary from w group by 1, 2),
sm as (select bank_id, scope, start_turn, end_turn, coalesce(summary, '') as summary from (select *, unnest(['autobiographical', 'received', 'surmise']) as scope from sp where not refused) left join t using (bank_id, scope) where summary is not null or scope = 'autobiographical')"""


def _consolidated(spark, d):
    """Windows of conversations; the summarizer loses the first-hand text of every fourth bank."""
    rows = A.conversation_rows(spark, d).withColumns({"archived": F.lit(False), "gist": T.gist("content"), "salience": T.salience("content"), "importance": F.lit(None).cast("double")})
    now = rows.groupBy("bank_id").agg(F.max("turn_idx").alias("now"))
    lost = (F.col("bank_id") % 4 == 1) & (F.col("scope") == L.FIRST_HAND)
    return L.consolidate(rows, now.select("bank_id", (F.col("bank_id") * 5).alias("cursor")), now, lambda w: L.joined_gists(w).withColumn("summary", F.when(~lost, F.col("summary"))))


@query("l05_consolidation", f"with {_L5} select * from sm")
def l05(spark, d):
    return _consolidated(spark, d).summaries


@query("l05_refused", f"with {_L5} select bank_id, start_turn, end_turn, n_first_hand from sp where refused")
def l05_refused(spark, d):
    return _consolidated(spark, d).refused


@query("l05_archived", f"with {_L5} select bank_id, id from g join sp using (bank_id) where not refused and turn_idx < end_turn - 12 and end_turn > 12 and salience < 0.72")
def l05_archived(spark, d):
    return _consolidated(spark, d).archived


@query("l05_cursors", f"with {_L5}, b as (select distinct bank_id from conv) select bank_id, coalesce(case when not refused then end_turn end, bank_id * 5) as cursor from b left join sp using (bank_id)")
def l05_cursors(spark, d):
    return _consolidated(spark, d).cursors


@query("l05_support", f"""with {_L5}, k as (select *, bank_id || ':' || scope as place, regexp_replace(trim(regexp_replace(summary, '\\s+', ' ', 'g')), '([.!?]) +([A-Z"''“‘])', '\\1' || chr(1) || '\\2', 'g') as cut from sm),
c as (select place, unnest(l) as claim, generate_subscripts(l, 1) - 1 as pos from (select place, list_filter(list_transform(string_split(cut, chr(1)), lambda x: trim(x)), lambda x: x <> '') as l from k)),
cw as (select distinct place, pos, unnest(list_distinct({S.tokens('claim')})) as word from c), mw as (select distinct bank_id || ':' || scope as place, event_key as ref, unnest(list_distinct({S.tokens('content')})) as word from w),
sh as (select place, pos, ref, count(*) as n from cw join mw using (place, word) where not list_contains({S.words(T.SUPPORT_STOPWORDS)}, word) group by 1, 2, 3 having count(*) >= 3),
b as (select place, pos, string_agg(ref, ' ' order by n desc, ref) as refs from (select * from sh qualify row_number() over (partition by place, pos order by n desc, ref) <= 3) group by 1, 2)
select place, pos::int as pos, claim, coalesce(refs, '') as refs from c left join b using (place, pos)""")
def l05_support(spark, d):
    return _consolidated(spark, d).support.select(F.col("summary_id").alias("place"), "pos", "claim", F.array_join("support_refs", " ").alias("refs"))


_L6 = f"""with recursive r as (select user_id % {_EBANKS} as bank_id, event_id from events), m as (select bank_id, row_number() over (partition by bank_id order by event_id) // (1 + bank_id % 13) as turn_idx from r),
n as (select *, row_number() over (partition by bank_id order by turn_idx) as i from (select bank_id, turn_idx, count(*) as n from m group by 1, 2)),
f as (select distinct bank_id, 0::bigint as i, 0::bigint as turn_idx, 0::bigint as since, 0::bigint as held, false as due from n union all
  select n.bank_id, n.i, n.turn_idx, case when x then n.turn_idx else since end, case when x then 0 else f.held + n.n end, x from f join n on n.bank_id = f.bank_id and n.i = f.i + 1, lateral (select n.turn_idx - f.since >= 10 or f.held + n.n >= 40 as x))
select bank_id, turn_idx as end_turn from f where due"""


def _bank_turns(spark, d):
    """Banks with one to thirteen rows a turn: some windows close by turns, others by rows."""
    bank = F.col("user_id") % A.banks(spark, d, "events", A.EVENTS_PER_BANK)
    n = F.row_number().over(Window.partitionBy(bank).orderBy("event_id"))
    return A.table(spark, d, "events").select(bank.alias("bank_id"), F.floor(n / (1 + bank % 13)).alias("turn_idx"))


@query("l06_consolidation_windows", _L6)
def l06(spark, d):
    return L.windows(_bank_turns(spark, d))


def _threads(spark, d):
    e = A.experiments(spark, d)
    return e.select((F.col("hypothesis_id") % A.banks(spark, d, "events", A.EVENTS_PER_BANK)).alias("bank_id"), F.floor(F.col("id") / 500).alias("window_no"), F.concat(F.lit("thread "), F.col("digest")).alias("thread")).distinct()


@query("w13_thread_openings", f"with {S.EXPERIMENTS}, t as (select distinct hypothesis_id % {_EBANKS} as bank_id, id // 500 as window_no, 'thread ' || digest as thread from ex), g as (select *, window_no - row_number() over (partition by bank_id, thread order by window_no) as i from t) select bank_id, window_no, thread, min(window_no) over (partition by bank_id, thread, i) as since from g")
def w13(spark, d):
    return L.fold_threads(_threads(spark, d))


@query("l07_close_threads", f"""with {S.EXPERIMENTS}, t as (select distinct hypothesis_id % {_EBANKS} as bank_id, 'thread ' || digest as thread from ex where outcome <> 'refuted'), o as (select *, row_number() over (partition by bank_id order by thread) - 1 as pos, count(*) over (partition by bank_id) as n from t),
a as (select distinct hypothesis_id % {_EBANKS} as bank_id, 'thread ' || digest as thread from ex) select bank_id, thread, pos, n as of, case when pos is null then 'unknown' else 'closed' end as outcome from a left join o using (bank_id, thread)""")
def l07(spark, d):
    from pyspark.sql import Window

    e = A.experiments(spark, d).withColumn("thread", F.concat(F.lit("thread "), "digest")).withColumn("bank_id", F.col("hypothesis_id") % A.banks(spark, d, "events", A.EVENTS_PER_BANK))
    o = e.where("outcome <> 'refuted'").select("bank_id", "thread").distinct()
    o = o.withColumns({"pos": F.row_number().over(Window.partitionBy("bank_id").orderBy("thread")) - 1, "since": F.lit(0)})
    return L.close_threads(o, e).select("bank_id", "thread", F.col("pos").cast("long").alias("pos"), "of", "outcome")


@query("l10_rebuild_texts", f"with {S.DOCM} select id, 'kind: ' || kind || chr(10) || 'turn: ' || turn_idx || chr(10) || 'details: ' || source || chr(10) || 'source: ' || provenance as document from docm where turn_idx is not null")
def l10(spark, d):
    none = F.array().cast("array<string>")
    r = A.document_rows(spark, d).where("turn_idx is not null")
    return r.select("id", T.memory_document(F.col("kind"), F.col("turn_idx"), none, none, F.lit(""), F.col("source"), F.col("provenance"), F.lit("")).alias("document"))


@query("l11_turn_minting", f"with {S.CONV} select 'turn:' || id || ':' || p as event_key, {S.salience('content')} as salience from (select *, unnest(case when {S.salience('content')} >= 0.6 then ['episode', 'fact'] else ['episode'] end) as p from conv)")
def l11(spark, d):
    s = T.salience("content")
    parts = F.when(s >= 0.6, F.array(F.lit("episode"), F.lit("fact"))).otherwise(F.array(F.lit("episode")))
    return A.conversation_rows(spark, d).select("id", s.alias("salience"), F.explode(parts).alias("p")).select(F.concat(F.lit("turn:"), F.col("id").cast("string"), F.lit(":"), "p").alias("event_key"), "salience")


@query("t45_thread_text", "select event_id, trim(regexp_replace(coalesce(props::json->>'k', props), '\\s+', ' ', 'g')) as thread from events")
def t45(spark, d):
    e = A.table(spark, d, "events")
    return e.select("event_id", T.squeeze(F.coalesce(F.get_json_object("props", "$.k"), "props")).alias("thread"))


# ---- telemetry

_FAIL = "(outcome = 'refuted' and observation not like 'exit 0%') or (outcome = 'confirmed' and reproduces)"


@query("t44_failure_signal", f"with {S.EXPERIMENTS} select id, observation not like 'exit 0%' as failed from ex")
def t44(spark, d):
    return A.experiments(spark, d).select("id", M.observation_failed(F.col("observation")).alias("failed"))


@query("t47_observation_text", "select event_id, case when event_id % 17 = 0 then 'TIMED OUT after 3s' when event_id % 19 = 0 then 'DID NOT RUN' when event_type = 'error' then 'exit 1 in 3s' else 'exit 0 in 3s' end || ' — ' || case when event_type = 'error' or event_id % 17 = 0 or event_id % 19 = 0 then 'stderr: ' || event_type || ' | stdout: ' || props else 'stdout: ' || props || ' | stderr: ' || event_type end as observation from events")
def t47(spark, d):
    i = F.col("event_id")
    code = F.when(i % 17 == 0, None).when(i % 19 == 0, None).when(F.col("event_type") == "error", 1).otherwise(0)
    return A.table(spark, d, "events").select("event_id", M.observation_text(code, F.lit(3), i % 17 == 0, F.col("props"), F.col("event_type")).alias("observation"))


@query("t42_grading", """with a as (select event_id, event_type, (props::json->>'k')::int as k, props from events)
select event_id, case when k % 10 = 9 then 'inconclusive' when event_type = 'view' then 'inconclusive' when (event_type = 'error') <> (k % 2 = 0) or (event_type <> 'click' and contains(props, '7')) then 'refuted' else 'confirmed' end as outcome from a""")
def t42(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    nothing = lambda t: F.lit(None).cast(t)
    viewed = F.col("event_type") == "view"
    expect = F.struct(
        F.when(~viewed, k % 2 == 1).alias("exit_zero"), nothing("int").alias("exit_code"), nothing("string").alias("stdout_has"),
        F.when(~viewed & (F.col("event_type") != "click"), "7").alias("stdout_lacks"), nothing("string").alias("stderr_has"), nothing("string").alias("stderr_lacks"),
        nothing("string").alias("stdout_matches"), nothing("string").alias("output_equals"), nothing("map<string,string>").alias("precondition"), nothing("map<string,string>").alias("file_contains"),
    )
    runs = A.table(spark, d, "events").select(
        "event_id", F.when(k % 10 == 9, None).when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"), F.lit(False).alias("timed_out"), F.col("props").alias("stdout"),
        F.lit("").alias("stderr"), F.lit("").alias("harness"), expect.alias("expect"), nothing("map<string,string>").alias("files"),
    )
    return M.judge(runs).select("event_id", "outcome")


@query("j13_failing_hypotheses", f"with {S.EXPERIMENTS} select hypothesis_id, max(id) as last_failure from ex where {_FAIL} group by 1 order by 2 desc limit 6")
def j13(spark, d):
    return M.failing(A.experiments(spark, d))


@query("w12_failing_since_fix", f"with {S.EXPERIMENTS}, m as (select *, coalesce(max(case when outcome = 'fix-marker' then id end) over (partition by hypothesis_id), -1) as m from ex) select hypothesis_id, bool_or({_FAIL}) as ever, bool_or(({_FAIL}) and id > m) as since_fix from m group by 1")
def w12(spark, d):
    return M.failing_since_fix(A.experiments(spark, d))


def _arriving(spark, d):
    """A log of runs, others that arrive, some of which saw an older version, and the versions of hypotheses; some runs have none."""
    e = A.experiments(spark, d).where("outcome <> 'fix-marker'").withColumns({"precondition": F.create_map("event_type", F.expr("sha1(cast(k % 2 as string))")), "digest": F.concat_ws(":", F.col("hypothesis_id").cast("string"), "event_type", (F.col("k") % 4).cast("string"))})
    cols = ["id", "hypothesis_id", "digest", "outcome", "precondition"]
    h = e.where("hypothesis_id % 11 <> 0").select("hypothesis_id").distinct().withColumn("version", F.col("hypothesis_id") % 3)
    new = e.where("id % 5 = 4").withColumn("seen_version", (F.col("hypothesis_id") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)) % 3)
    seen = e.where("id % 5 = 3").select("hypothesis_id", (F.col("id") - 10**9).alias("seq"), F.concat(F.lit("https://source.example/"), (F.col("id") % 4).cast("string")).alias("url"), F.when(F.col("k") % 3 == 0, "supports").otherwise("context").alias("stance"))
    return M.append_experiments(e.where("id % 5 < 3").select(*cols), new.select(*cols, "seen_version"), h, seen)


_L12 = f"""{S.EXPERIMENTS}, e as (select id, hypothesis_id, event_type as path, sha1((k % 2)::varchar) as sha, hypothesis_id || ':' || event_type || ':' || (k % 4) as digest, outcome, k from ex where outcome <> 'fix-marker'),
rf as (select id, hypothesis_id, case when hypothesis_id % 11 = 0 then 'no such hypothesis' else 'stale version' end as why from e where id % 5 = 4 and (hypothesis_id % 11 = 0 or id % 7 = 0)),
nw as (select * from e where id % 5 = 4 and id not in (select id from rf)), wh as (select * from e where id % 5 < 3 union all select * from nw),
fr as (select digest, min(id) as first_id, arg_min(outcome, id) as earlier from wh group by 1), pf as (select hypothesis_id, path, sha, min(id) as pin_id from wh group by all),
st as (select nw.*, exists (select 1 from pf where pf.hypothesis_id = nw.hypothesis_id and pf.path = nw.path and pin_id < nw.id and pf.sha <> nw.sha) as moved from nw),
ev as (select id, hypothesis_id, digest, case when moved then 'context' when outcome = 'confirmed' then 'supports' when outcome = 'refuted' then 'contradicts' else 'context' end as stance from st)"""


@query("l12_append_refused", f"with {_L12} select * from rf")
def l12_refused(spark, d):
    return _arriving(spark, d).refused


@query("l12_append_evidence", f"with {_L12} select hypothesis_id, id as seq, 'experiment:' || digest as url, stance from ev")
def l12_evidence(spark, d):
    return _arriving(spark, d).evidence


@query("l12_append_notes", f"with {_L12} select id, hypothesis_id, digest, earlier, outcome from nw join fr using (digest) where id > first_id and outcome <> earlier")
def l12_notes(spark, d):
    return _arriving(spark, d).notes


_L12_OBS = f"""{_L12}, obs as (select hypothesis_id, id as seq, 'experiment:' || digest as url, stance from ev union all select hypothesis_id, id - 1000000000, 'https://source.example/' || (id % 4), case when k % 3 = 0 then 'supports' else 'context' end from e where id % 5 = 3)"""
_L12_FOLD = _FOLD.replace(S.OBS, _L12_OBS)
_L12_FOLD = _L12_FOLD[: _L12_FOLD.index("select hypothesis_id, c as confidence")]


@query("l12_append_hypotheses", f"""{_L12_FOLD.rstrip()}, la as (select hypothesis_id, c, d from f qualify row_number() over (partition by hypothesis_id order by n desc) = 1), hy as (select distinct hypothesis_id from e where hypothesis_id % 11 <> 0)
select hypothesis_id, hypothesis_id % 3 + (hypothesis_id in (select hypothesis_id from nw))::int as version, coalesce(c, 0.3)::double as confidence, case when d then 'disputed' else 'open' end as status from hy left join la using (hypothesis_id)""")
def l12_hypotheses(spark, d):
    return _arriving(spark, d).hypotheses


@query("l08_thread_merge", f"with {S.EXPERIMENTS}, t as (select distinct hypothesis_id % {_EBANKS} as bank_id, id // 500 as window_no, 'thread ' || digest as thread from ex), g as (select *, window_no - row_number() over (partition by bank_id, thread order by window_no) as i from t), o as (select *, min(window_no) over (partition by bank_id, thread, i) as since from g) select bank_id, window_no, thread, since from o qualify window_no = max(window_no) over (partition by bank_id)")
def l08(spark, d):
    """The threads that each bank's latest window carries, with the window that opened them."""
    t = _threads(spark, d)
    latest = t.groupBy("bank_id").agg(F.max("window_no").alias("window_no"))
    return L.fold_threads(t).join(latest, ["bank_id", "window_no"]).select("bank_id", "window_no", "thread", "since")


@query("t43_stale_anchor", f"with {S.EXPERIMENTS} select id, case k % 5 when 0 then true else k % 3 = 1 end as stale from ex")
def t43(spark, d):
    """Runs report the digest of the file they rest on: a longer one that begins alike, another one, or none."""
    sha = F.sha1(F.col("event_type").cast("binary"))
    said = F.when(F.col("k") % 5 == 0, "nothing").otherwise(F.concat(F.lit("line\nPRECONDITION src/a.py "), F.when(F.col("k") % 3 == 1, F.reverse(sha)).otherwise(F.upper(sha)), F.lit("\ndone")))
    return A.experiments(spark, d).select("id", M.stale_anchor(said, F.create_map(F.lit("src/a.py"), F.substring(sha, 1, 12))).alias("stale"))


@query("l12_unstable_experiments", f"with {S.EXPERIMENTS} select digest, count(distinct outcome) as n_outcomes, count(*) as n_runs from (select id, event_type || ':' || (k % 3) as digest, outcome from ex where outcome <> 'fix-marker') group by 1 having count(distinct outcome) > 1")
def l12(spark, d):
    e = A.experiments(spark, d).withColumns({"hypothesis_id": F.lit(0), "digest": F.concat_ws(":", "event_type", (F.col("k") % 3).cast("string"))})
    return M.unstable(e).select("digest", "n_outcomes", "n_runs")


@query("l13_row_shows_failure", f"with {S.EXPERIMENTS} select id, coalesce({_FAIL}, false) as shows from ex")
def l13(spark, d):
    return A.experiments(spark, d).select("id", M.shows_failure().alias("shows"))


@query("l14_fix_gate", f"with {S.EXPERIMENTS} select hypothesis_id, bool_or({_FAIL}) as may_fix from ex group by 1")
def l14(spark, d):
    return A.experiments(spark, d).groupBy("hypothesis_id").agg(F.bool_or(M.shows_failure()).alias("may_fix"))


@query("j18_moved_anchor", f"with {S.EXPERIMENTS}, p as (select hypothesis_id, id, event_type as path, substr(sha1((k % 3)::varchar), 1, 8 + k % 2) as sha from ex), f as (select hypothesis_id, path, sha, min(id) as first_id from p group by all) select a.hypothesis_id, a.path, min(f.first_id) as earlier_id, a.id from p a join f on a.hypothesis_id = f.hypothesis_id and a.path = f.path and f.first_id < a.id where substr(a.sha, 1, least(length(a.sha), length(f.sha))) <> substr(f.sha, 1, least(length(a.sha), length(f.sha))) group by a.hypothesis_id, a.path, a.id")
def j18(spark, d):
    sha = F.expr("substr(sha1(cast(k % 3 as string)), 1, 8 + k % 2)")
    rows = A.experiments(spark, d).select("hypothesis_id", "id", F.create_map("event_type", sha).alias("precondition"))
    return M.moved_anchor(rows).select("hypothesis_id", "path", "earlier_id", "id")


@query("st1_event_log_replay", f"with {S.EXPERIMENTS}, l as (select hypothesis_id, id, row_number() over (partition by hypothesis_id order by ts, id) - 1 as i from ex) select hypothesis_id, id, i from l where i >= case when hypothesis_id % 3 = 0 then 0 when hypothesis_id % 3 = 1 then 11 else 0 end")
def st1(spark, d):
    log = M.event_log(A.experiments(spark, d), "hypothesis_id", ["ts", "id"])
    h = A.experiments(spark, d).select("hypothesis_id").distinct()
    cur = h.where("hypothesis_id % 3 > 0").withColumn("cursor", F.when(F.col("hypothesis_id") % 3 == 1, "10").otherwise("junk"))
    return M.replay(log, cur, "hypothesis_id").select("hypothesis_id", "id", F.col("i").cast("long").alias("i"))


QUERIES, ORACLES = C.queries, C.oracles
