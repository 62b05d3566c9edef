"""Queries of the bank, of text functions and of belief arithmetic, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrain.functions import belief as B
from quillgrain.functions import text as T
from quillgrain.operators import bank as K
from quillgrain.plans import sql as S
from quillgrain.plans.catalog import Catalog
from quillgrain.sources import adapters as A

C = Catalog()
query = C.query


# ---- scans, sinks and the read seam

@query("s01_pushdown_scan", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 200000")
def s01(spark, d):
    return A.table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("s02_keyed_upsert", f"""with {S.CONV}, both_ as (select *, 0 as n from conv union all
  select bank_id, id, session_id, turn, turn_idx, kind, provenance, 'again: ' || content, event_key, 1 from conv where id % 3 = 0)
select bank_id, id, event_key, content from (select *, row_number() over (partition by bank_id, event_key order by n desc, id desc) r from both_) where r = 1""")
def s02(spark, d):
    old = A.conversation_rows(spark, d)
    new = old.where("id % 3 = 0").withColumn("content", F.concat(F.lit("again: "), "content"))
    return K.upsert(old, new, ["bank_id", "event_key"], "id").select("bank_id", "id", "event_key", "content")


@query("s03_batch_mint_counts", f"with {S.CONV} select bank_id, kind, count(*) as n_rows, count(*) * 2 as n_vectors from conv group by all")
def s03(spark, d):
    pairs = K.embedding_texts(K.prepare(A.conversation_rows(spark, d)).withColumn("turn_idx", F.col("turn_idx")))
    kinds = K.prepare(A.conversation_rows(spark, d)).select("id", "kind")
    n = pairs.join(kinds, "id").select("bank_id", "kind", F.explode(F.array("document", "cue")).alias("t"))
    return n.groupBy("bank_id", "kind").agg((F.count("*") / 2).cast("long").alias("n_rows"), F.count("*").alias("n_vectors"))


@query("s04_prepare_rows", f"""with {S.CONV}, a as (select *, {S.squeeze('content')} as sq from conv), b as (select *, {S.PARTS} from a)
select bank_id, id, kind, provenance, {S.salience('content')} as salience, sq as content, {S.GIST} as gist from b""")
def s04(spark, d):
    return K.prepare(A.conversation_rows(spark, d)).select("bank_id", "id", "kind", "provenance", "salience", "content", "gist")


ORACLE_S05 = f"""with {S.CONV}, a as (select *, {S.squeeze('content')} as sq from conv), b as (select *, {S.PARTS} from a),
  c as (select *, {S.GIST} as gist, sq as t from b), d as (select *, {S.names()} as ents from c), {S.key_phrases("d", "id", "sq", "ents")}, e as (select d.*, phrases from d join kf on k = id)
select bank_id, id, array_to_string(list_filter(['kind: ' || kind, 'turn: ' || turn_idx, 'people: ' || array_to_string(ents, ', '),
   'key phrases: ' || array_to_string(phrases, ', '), 'gist: ' || gist, 'details: ' || sq, 'source: ' || provenance], lambda x: not x.ends_with(': ')), chr(10)) as document,
  array_to_string(list_filter([gist, array_to_string(phrases, ', '), array_to_string(ents, ', '), kind], lambda x: x <> ''), chr(10)) as cue from e"""


@query("s05_embedding_texts", ORACLE_S05)
def s05(spark, d):
    return K.embedding_texts(K.prepare(A.conversation_rows(spark, d)))


@query("t05_memory_document", f"select id, document from ({ORACLE_S05})")
def t05(spark, d):
    return s05(spark, d).select("id", "document")


@query("t06_memory_cues", f"select id, cue from ({ORACLE_S05})")
def t06(spark, d):
    return s05(spark, d).select("id", "cue")


@query("p06_scope_labels", f"with {S.CONV} select id, case provenance when 'told' then 'what_i_was_told_or_read' else 'what_happened_between_us' end as label from conv")
def p06(spark, d):
    return A.conversation_rows(spark, d).select("id", K.scope_label(K.provenance_scope(F.col("provenance"))).alias("label"))


@query("s06_replace_by_source", """with old as (select doc_id, source, 'old' as version from documents), new as (select doc_id, source, 'new' as version from documents where source in ('src1', 'src2') and doc_id % 2 = 0)
select * from old where source not in (select source from new) union all select * from new""")
def s06(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "source")
    new = docs.where("source in ('src1', 'src2') and doc_id % 2 = 0").withColumn("version", F.lit("new"))
    return K.replace_by_source(docs.withColumn("version", F.lit("old")), new, "source").select("doc_id", "source", "version")


@query("s07_delete_turn", f"with {S.CONV} select bank_id, id from conv where session_id % 5 <> 0")
def s07(spark, d):
    rows = A.conversation_rows(spark, d)
    return rows.join(rows.where("session_id % 5 = 0").select("bank_id", "id"), ["bank_id", "id"], "left_anti").select("bank_id", "id")


@query("s08_window_upsert", f"""with {S.CONV}, w as (select bank_id, provenance as scope, turn_idx // 10 * 10 as end_turn, id, content from conv)
select bank_id, scope, end_turn, id from (select *, row_number() over (partition by bank_id, scope, end_turn order by id desc) r from w) where r = 1""")
def s08(spark, d):
    w = A.conversation_rows(spark, d).select("bank_id", F.col("provenance").alias("scope"), (F.floor(F.col("turn_idx") / 10) * 10).alias("end_turn"), "id")
    return K.upsert(w.where("id % 2 = 0").limit(0), w, ["bank_id", "scope", "end_turn"], "id").select("bank_id", "scope", "end_turn", "id")


@query("s09_reserve_turns", f"""with {S.CONV}, top as (select bank_id, max(turn_idx) as t from conv where session_id < 50 group by 1)
select bank_id, id, coalesce(t, 0) + row_number() over (partition by bank_id order by id) as turn_idx from conv left join top using (bank_id) where session_id >= 50""")
def s09(spark, d):
    rows = A.conversation_rows(spark, d)
    return K.reserve_turns(rows.where("session_id < 50"), rows.where("session_id >= 50").drop("turn_idx"), ["id"]).select("bank_id", "id", "turn_idx")


@query("s15_integrity_audit", """with k as (select source, lang, count(*) as n_rows from documents group by 1, 2 having count(*) > 1)
select 'duplicate' as problem, source || '/' || lang as k, n_rows from k
union all select 'orphan', 'label:' || doc_id, 1 from labels where doc_id not in (select doc_id from documents where doc_id % 10 <> 0)""")
def s15(spark, d):
    docs, labels = A.table(spark, d, "documents"), A.table(spark, d, "labels")
    twice = K.violations(docs, ["source", "lang"]).select(F.lit("duplicate").alias("problem"), F.concat_ws("/", "source", "lang").alias("k"), "n_rows")
    lost = K.orphans(labels, docs.where("doc_id % 10 <> 0"), "doc_id")
    return twice.unionByName(lost.select(F.lit("orphan").alias("problem"), F.concat(F.lit("label:"), F.col("doc_id").cast("string")).alias("k"), F.lit(1).cast("long").alias("n_rows")))


_REFS = """refs as (select 'turns' as tab, conv_id * 1000 + turn as id, 'session_id' as col, 'sessions' as parent, conv_id as parent_id, 'cascade' as action from conversations
union all select 'steps', (conv_id * 1000 + turn) * 10 + s, 'turn_id', 'turns', conv_id * 1000 + turn, 'cascade' from conversations, (select unnest([1, 2]) as s)
union all select 'memories', conv_id * 1000 + turn, 'session_id', 'sessions', conv_id, 'set null' from conversations union all select 'memories', conv_id * 1000 + turn, 'turn_id', 'turns', conv_id * 1000 + turn, 'set null' from conversations
union all select distinct 'hypotheses', doc_id // 20, 'session_id', 'sessions', doc_id // 20, 'set null' from labels union all select 'evidence', doc_id, 'hypothesis_id', 'hypotheses', doc_id // 20, 'cascade' from labels)"""


@query("s15_cascades", f"""with recursive {_REFS}, gone as (select 'sessions' as tab, conv_id as id from (select distinct conv_id from conversations) where conv_id % 3 = 0 union select 'hypotheses', h from (select distinct doc_id // 20 as h from labels) where h % 5 = 0
union select r.tab, r.id from gone join refs r on r.parent = gone.tab and r.parent_id = gone.id where action = 'cascade')
select tab, id, 'deleted' as outcome, '' as col from gone union all select tab, id, 'set null', col from refs r where action = 'set null' and exists (select 1 from gone g where g.tab = r.parent and g.id = r.parent_id) and not exists (select 1 from gone g where g.tab = r.tab and g.id = r.id)""")
def s15_cascades(spark, d):
    """Sessions and hypotheses are deleted: their turns and evidence go, the steps of those turns, too; memories and hypotheses lose their references."""
    c = A.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"))
    h = A.table(spark, d, "labels").select("doc_id", F.floor(F.col("doc_id") / 20).alias("hypothesis_id"))
    hyp = h.select("hypothesis_id", F.col("hypothesis_id").alias("session_id")).distinct()
    steps = c.select("turn_id", F.explode(F.array(F.col("turn_id") * 10 + 1, F.col("turn_id") * 10 + 2)).alias("step_id"))
    refs = K.references(c, "turns", "turn_id", "session_id", "sessions", "cascade")
    for rows, *how in (
        (steps, "steps", "step_id", "turn_id", "turns", "cascade"), (c.withColumn("id", F.col("turn_id")), "memories", "id", "session_id", "sessions", "set null"), (c.withColumn("id", F.col("turn_id")), "memories", "id", "turn_id", "turns", "set null"),
        (hyp, "hypotheses", "hypothesis_id", "session_id", "sessions", "set null"), (h, "evidence", "doc_id", "hypothesis_id", "hypotheses", "cascade"),
    ):
        refs = refs.unionByName(K.references(rows, *how))
    deleted = c.select(F.lit("sessions").alias("tab"), F.col("session_id").alias("id")).distinct().where("id % 3 = 0").unionByName(hyp.select(F.lit("hypotheses").alias("tab"), F.col("hypothesis_id").alias("id")).where("id % 5 = 0"))
    return K.carried(deleted, refs)


@query("p01_read_seam", f"""with {S.DOCM}, {S.QUERIES} select query_id, count(*) as n_visible, min(id) as first_id, max(turn_idx) as last_turn
from qs join docm using (bank_id) where not archived and retired_batch is null and (turn_idx is null or turn_idx < cutoff_turn) group by 1""")
def p01(spark, d):
    q = A.recall_queries(spark, d)
    rows = A.document_rows(spark, d).select("bank_id", "id", "turn_idx", "archived", "retired_batch").join(q, "bank_id")
    seen = K.visible(rows, before=F.col("cutoff_turn"), include_archived=False)
    return seen.groupBy("query_id").agg(F.count("*").alias("n_visible"), F.min("id").alias("first_id"), F.max("turn_idx").alias("last_turn"))


@query("p02_projection", f"""with {S.DOCM}, a as (select *, {S.squeeze('content')} as sq from docm), b as (select *, {S.PARTS} from a)
select bank_id, event_key as memory_ref, case when turn_idx is null then 'at some earlier point' when 500 - turn_idx <= 1 then 'last turn' when 500 - turn_idx <= 4 then 'a few turns ago'
  when 500 - turn_idx <= 12 then 'about ' || (500 - turn_idx) || ' turns ago' else 'about ' || (500 - turn_idx) || ' turns ago, some while back' end as when_seen, kind,
  case provenance when 'inferred' then 'what_i_concluded' else 'what_i_read' end as epistemic_origin, {S.GIST} as gist, round(confidence, 3) as confidence from b""")
def p02(spark, d):
    rows = A.document_rows(spark, d).withColumn("gist", T.gist("content"))
    return K.project(rows, F.lit(500))


@query("p03_relative_age", """select o_orderkey, case when g <= 1 then 'last turn' when g <= 4 then 'a few turns ago' when g <= 12 then 'about ' || g || ' turns ago' else 'about ' || g || ' turns ago, some while back' end as age
from (select o_orderkey, greatest(0, 20 - o_orderkey % 30) as g from orders)""")
def p03(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", K.beats_ago(F.lit(20).cast("long"), F.col("o_orderkey") % 30).alias("age"))


@query("p04_effective_importance", "select event_id, greatest(0, least(1, coalesce(case when event_id % 3 = 0 then value / 10 end, value / 100))) as importance from events")
def p04(spark, d):
    e = A.table(spark, d, "events")
    return e.select("event_id", K.effective_importance(F.when(F.col("event_id") % 3 == 0, F.col("value") / 10), F.col("value") / 100).alias("importance"))


@query("p05_scope_census", f"""with {S.CONV}, {S.DOCM}, a as (select provenance from conv union all select provenance from docm),
b as (select case provenance when 'witnessed' then 'autobiographical' when 'remembered' then 'autobiographical' when 'inferred' then 'surmise' else 'received' end as scope from a)
select scope, case scope when 'autobiographical' then 'what_happened_between_us' when 'received' then 'what_i_was_told_or_read' else 'what_i_concluded' end as label, count(*) as n_rows from b group by all""")
def p05(spark, d):
    rows = A.conversation_rows(spark, d).select("provenance").unionByName(A.document_rows(spark, d).select("provenance"))
    s = rows.select(K.provenance_scope(F.col("provenance")).alias("scope"))
    return s.groupBy("scope", K.scope_label(F.col("scope")).alias("label")).agg(F.count("*").alias("n_rows"))


@query("p07_tolerant_decode", "select event_id, coalesce((props::json->>'k')::int, -1) as k from events")
def p07(spark, d):
    e = A.table(spark, d, "events")
    return e.select("event_id", F.coalesce(F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"], F.lit(-1)).alias("k"))


@query("p08_stranded_vectors", "select vec_id, (label <> 0) as is_stranded from embeddings")
def p08(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("label") == 0, "api:m0").otherwise("api:m1").alias("embedding_model"), F.size("embedding").alias("embedding_dim"))
    return e.select("vec_id", K.stranded(e, "api:m0", 64).alias("is_stranded"))


@query("p11_filtered_listing", "select o_orderkey, o_orderdate from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey desc limit 50")
def p11(spark, d):
    return A.table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderdate")


@query("p14_blank_fields", "select doc_id, 'text' as field from documents where trim(coalesce(text, '')) = '' union all select doc_id, 'lang' from documents where trim(coalesce(case when doc_id % 50 <> 0 then lang end, '')) = ''")
def p14(spark, d):
    docs = A.table(spark, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 50 != 0, F.col("lang")))
    return K.blank_fields(docs, "doc_id", ["text", "lang"])


# ---- text

@query("t01_clamp", "select doc_id, coalesce(greatest(0, least(1, try_cast(regexp_extract(text, '[0-9]+') as double) / 100)), 0) as v from documents")
def t01(spark, d):
    n = F.regexp_extract("text", "[0-9]+", 0).try_cast("double") / 100
    return A.table(spark, d, "documents").select("doc_id", T.clamp(n).alias("v"))


@query("t02_gist", f"with a as (select doc_id, {S.squeeze('text')} as sq from documents), b as (select *, {S.PARTS} from a) select doc_id, {S.GIST} as gist from b")
def t02(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.gist("text").alias("gist"))


@query("t03_entities", f"with a as (select doc_id, text as t from documents) select doc_id, array_to_string({S.names()}, '|') as names from a")
def t03(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.array_join(T.entities("text"), "|").alias("names"))


def phrase_weights(rows, limit: int = 12):
    """Per row the best words (weight 1) and word pairs (1.5) without stop words: (id, rank, phrase, weight)."""
    best = rows.select("id", F.posexplode(T.weighted_phrases("content", limit)).alias("pos", "x"))
    return best.select("id", (F.col("pos") + 1).alias("rank"), "x.phrase", "x.weight")


_STOP = S.words(T.STOPWORDS)


@query("a09_phrase_weights", f"""with a as (select doc_id as id, unnest({S.tokens('text', "[a-z0-9''-]{3,}")}) as w, generate_subscripts({S.tokens('text', "[a-z0-9''-]{3,}")}, 1) as i from documents),
b as (select id, w, lead(w) over (partition by id order by i) as n from a), p as (
  select id, w as phrase, 1.0::double as weight from b where not list_contains({_STOP}, w)
  union all select id, w || ' ' || n, 1.5 from b where n is not null and not list_contains({_STOP}, w) and not list_contains({_STOP}, n)),
g as (select id, phrase, sum(weight) as weight from p group by 1, 2)
select id, rank, phrase, weight from (select *, row_number() over (partition by id order by weight desc, len(string_split(phrase, ' ')) desc, phrase)::int as rank from g) where rank <= 12""")
def a09(spark, d):
    return phrase_weights(A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))).select("id", "rank", "phrase", "weight")


@query("t04_key_phrases", f"with a as (select doc_id, text as t from documents), b as (select *, {S.names()} as ents from a), {S.key_phrases('b', 'doc_id', 't', 'ents')} select k as doc_id, array_to_string(phrases, '|') as phrases from kf")
def t04(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.array_join(T.key_phrases("text", T.entities("text")), "|").alias("phrases"))


@query("t07_query_terms", f"with {S.QUERIES}, a as (select query_id, list_filter({S.tokens('query_text', chr(91) + 'a-z0-9' + chr(39) * 2 + '-' + chr(93) + '{3,}')}, lambda x: not list_contains({_STOP}, x)) as l from qs) select query_id, array_to_string(({S.distinct('l')})[1:16], ' OR ') as terms from a")
def t07(spark, d):
    return A.recall_queries(spark, d).select("query_id", F.array_join(T.query_terms("query_text"), " OR ").alias("terms"))


@query("t08_temporal_mode", """with a as (select doc_id, lower(case doc_id % 3 when 0 then text || ' long ago' when 1 then text || ' just now.' else text end) as t from documents)
select doc_id, case when regexp_matches(t, '\\b(?:long ago|weeks? ago|months? ago|back then|earliest|first time|originally)\\b') then 'old' when regexp_matches(t, '\\b(?:recently|just now|a moment ago|last time|just happened)\\b') then 'recent' else 'neutral' end as mode from a""")
def t08(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" long ago"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" just now."))).otherwise(F.col("text"))
    return A.table(spark, d, "documents").select("doc_id", T.temporal_mode(t).alias("mode"))


@query("t09_exact_cue", f"with {S.QUERIES}, {S.CUES}, {S.EXACT} select query_id, id, score from ex where score > 0")
def t09(spark, d):
    m = A.document_rows(spark, d).select("bank_id", "id", T.entities("content").alias("entities"), "content").withColumn("phrases", T.key_phrases("content", F.col("entities")))
    s = T.exact_cue_score(F.col("phrases"), F.col("entities"), F.col("query_text"))
    return A.recall_queries(spark, d).join(m, "bank_id").select("query_id", "id", s.alias("score")).where("score > 0")


_SET = f"list_distinct({S.tokens('text')})"


@query("t10_jaccard", f"""with a as (select doc_id, {_SET} as s from documents) select x.doc_id, y.doc_id as other_id, round(len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s))::double, 9) as similarity
from a x join a y on y.doc_id = x.doc_id + 1 where len(x.s) > 0 and len(y.s) > 0""")
def t10(spark, d):
    a = A.table(spark, d, "documents").select("doc_id", T.token_set("text").alias("s")).where("size(s) > 0")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other_id"), F.col("s").alias("o"))
    return a.join(b, "doc_id").select("doc_id", "other_id", F.round(T.jaccard(F.col("s"), F.col("o")), 9).alias("similarity"))


@query("t12_dot_product", "select x.vec_id, y.vec_id as other_id, round(list_dot_product(x.embedding::double[], y.embedding::double[]), 6) as cosine from embeddings x join embeddings y on y.vec_id = x.vec_id + 1")
def t12(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("o"))
    return e.join(o, "vec_id").select("vec_id", "other_id", F.round(T.dot(F.col("embedding"), F.col("o")), 6).alias("cosine"))


@query("t13_content_words", f"with a as (select doc_id, {_SET} as s from documents) select doc_id, array_to_string(list_sort(list_filter(s, lambda x: not list_contains({S.words(T.SUPPORT_STOPWORDS)}, x))), ' ') as words from a")
def t13(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.content_words("text")), " ").alias("words"))


@query("t14_clauses", f"""with a as (select doc_id, {S.squeeze('text')} as t from documents) select doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(t, '([.!?]) +([A-Z"''“‘])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), ' | ') as clauses from a""")
def t14(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.array_join(T.clauses("text"), " | ").alias("clauses"))


@query("t15_first_sentence", f"""with a as (select doc_id, string_split(regexp_replace({S.squeeze('text')}, '([.!?]) +', '\\1' || chr(1)), chr(1))[1] as s from documents) select doc_id, case when length(s) > 240 then rtrim(substr(s, 1, 239)) || '…' else s end as first_sentence from a""")
def t15(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.first_sentence("text").alias("first_sentence"))


@query("t21_normal_question", f"with {S.CONV} select id, trim(regexp_replace(lower({S.squeeze('content')}), '[^a-z0-9 ]', '', 'g')) as question from conv")
def t21(spark, d):
    return A.conversation_rows(spark, d).select("id", T.normal_question("content").alias("question"))


@query("t22_excerpt", f"with a as (select doc_id, {S.squeeze('text')} as t from documents), b as (select *, ' …[cut: ' || length(t) || ' chars total]' as m from a) select doc_id, length(t) as n, case when length(t) > 600 then substr(t, 1, 600 - length(m)) || m else t end as excerpt from b")
def t22(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.length(T.squeeze("text")).alias("n"), T.excerpt("text").alias("excerpt"))


@query("t23_fit_both_ends", """with a as (select doc_id, text as t, chr(10) || '… [' || format('{:,}', length(text) - 4000) || ' chars elided from the middle] …' || chr(10) as m from documents), b as (select *, least(1200, (4000 - length(m)) // 3) as h from a)
select doc_id, case when length(t) <= 4000 then t else substr(t, 1, h) || m || substr(t, length(t) - (4000 - h - length(m)) + 1) end as fitted from b""")
def t23(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.fit_both_ends("text").alias("fitted"))


@query("t24_episode_half", "with a as (select doc_id, text as t, ' …[cut: ' || length(text) || ' chars total]' as m from documents) select doc_id, case when length(t) <= 1200 then t else rtrim(substr(t, 1, 1200 - length(m)), ' ') || m end as half from a")
def t24(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.episode_half("text").alias("half"))


@query("t25_salience", f"with {S.CONV} select id, {S.salience('content')} as salience from conv")
def t25(spark, d):
    return A.conversation_rows(spark, d).select("id", T.salience("content").alias("salience"))


@query("t34_hypothesis_key", f"with {S.BELIEFS} select seq, trim(about) || '|' || kind || '|' || trim(claim) as k from ups")
def t34(spark, d):
    return A.belief_updates(spark, d).select("seq", B.hypothesis_key(F.col("about"), F.col("kind"), F.col("claim")).alias("k"))


@query("t35_evidence_key", f"with {S.OBS} select seq, 'evidence:' || substr(sha1(hypothesis_id || '|' || url), 1, 16) as event_key from obs")
def t35(spark, d):
    return A.observations(spark, d).select("seq", F.concat(F.lit("evidence:"), F.substring(F.sha1(F.concat_ws("|", F.col("hypothesis_id").cast("string"), "url")), 1, 16)).alias("event_key"))


@query("t36_chunk_handle", "select doc_id, substr(sha256('workspace|' || source || '|' || doc_id), 1, 16) as handle from documents")
def t36(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat_ws("|", F.lit("workspace"), "source", F.col("doc_id").cast("string")), 256), 1, 16).alias("handle"))


@query("t37_experiment_digest", f"with {S.EXPERIMENTS} select id, substr(sha1(hypothesis_id || '|' || event_type || '|' || observation), 1, 16) as identity from ex")
def t37(spark, d):
    return A.experiments(spark, d).select("id", F.substring(F.sha1(F.concat_ws("|", F.col("hypothesis_id").cast("string"), "event_type", "observation")), 1, 16).alias("identity"))


@query("t41_cell_render", "select doc_id, case when length(text) > 2000 then substr(text, 1, 2000) || '… [cell truncated, ' || length(text) || ' chars total]' else text end as shown from documents")
def t41(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.cell(F.col("text")).alias("shown"))


@query("t48_sql_functions", """select o_custkey, string_agg(o_orderkey::varchar, ' ' order by o_orderkey) as orders_, sum(length(trim(o_orderpriority))) as n_chars, sum((o_orderpriority ilike '%urg%')::int) as n_urgent,
  max(epoch(o_orderdate)::bigint) as last_epoch from orders group by 1""")
def t48(spark, d):
    o = A.table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(
        F.expr("listagg(cast(o_orderkey as string), ' ') within group (order by o_orderkey)").alias("orders_"), F.sum(F.length(F.trim("o_orderpriority"))).alias("n_chars"),
        F.sum(F.col("o_orderpriority").ilike("%urg%").cast("int")).alias("n_urgent"), F.max(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("last_epoch"))


# ---- belief arithmetic

@query("t26_mint_salience", f"with {S.BELIEFS} select seq, round(0.45::double + 0.3::double * confidence, 4) as s, greatest(0, least(1, (round(0.45::double + 0.3::double * confidence, 4) - 0.45) / 0.3)) as back from ups")
def t26(spark, d):
    return A.belief_updates(spark, d).select("seq", B.mint_salience(F.col("confidence")).alias("s")).withColumn("back", B.mint_confidence(F.col("s")))


@query("t27_abandoned", f"with {S.BELIEFS}, a as (select seq, greatest(0, least(1, (0.45::double + 0.3::double * confidence - 0.45) / 0.3)) as m from ups) select seq, least(m, greatest(0.08, m * 0.55)) as resting from a")
def t27(spark, d):
    return A.belief_updates(spark, d).select("seq", B.abandoned_confidence(0.45 + 0.3 * F.col("confidence")).alias("resting"))


@query("t28_decay", f"with {S.BELIEFS} select seq, round(confidence * pow(0.5, turn / case kind when 'observation' then 5 when 'stated_fact' then 18 when 'preference' then 300 when 'goal' then 45 else 400 end::double), 9) as live from ups")
def t28(spark, d):
    return A.belief_updates(spark, d).select("seq", F.round(B.decayed(F.col("confidence"), F.col("kind"), F.col("turn")), 9).alias("live"))


_CLAIM_TOK = S.distinct("regexp_extract_all(lower(content), '[a-z0-9'']+')")


@query("t29_claim_tokens", f"with {S.CONV}, a as (select id, {_CLAIM_TOK} as w from conv), b as (select *, list_filter(w, lambda x: not list_contains({S.words(B.STOPWORDS)}, x)) as f from a) select id, array_to_string(case when len(f) > 0 then f else w end, ' ') as toks from b")
def t29(spark, d):
    return A.conversation_rows(spark, d).select("id", F.array_join(B.claim_tokens(F.col("content")), " ").alias("toks"))


_CLEAN = "regexp_replace(lower(content), '[^\\x00-\\x7F]', '_', 'g')"
_NEG = " + ".join("regexp_matches(t, '{}')::int".format(c.replace("'", "''")) for c in B.NEGATIONS)


@query("t30_polarity", f"with {S.CONV}, a as (select id, {_CLEAN} || case id % 4 when 0 then ' not' when 1 then ' never without' else '' end as t from conv) select id, case when ({_NEG}) % 2 = 1 then -1 else 1 end as polarity from a")
def t30(spark, d):
    tail = F.when(F.col("id") % 4 == 0, " not").when(F.col("id") % 4 == 1, " never without").otherwise("")
    return A.conversation_rows(spark, d).select("id", B.polarity(F.concat("content", tail)).alias("polarity"))


@query("t31_claim_similarity", f"""with {S.BELIEFS}, p as (select about, claim, turn from ups), t as (select x.about, x.turn, y.turn as other, x.claim as a, y.claim as b from p x join p y on x.about = y.about and y.turn = x.turn + 1),
w as (select *, list_distinct(regexp_extract_all(lower(a), '[a-z0-9'']+')) as wa, list_distinct(regexp_extract_all(lower(b), '[a-z0-9'']+')) as wb, list_distinct(regexp_extract_all(lower(about), '[a-z0-9'']+')) as ws from t),
f as (select about, turn, other, a, b, list_filter(wa, lambda x: x <> 'not' and not list_contains(ws, x)) as fa, list_filter(wb, lambda x: x <> 'not' and not list_contains(ws, x)) as fb from w)
select about, turn, other, case when a.starts_with('not') <> b.starts_with('not') then 0 else len(list_intersect(fa, fb)) / least(len(fa), len(fb))::double end as similarity from f""")
def t31(spark, d):
    # the parts of a claim are read before it meets the next one
    p = A.belief_updates(spark, d).select("about", "turn", B.claim_parts(F.col("claim"), F.col("about")).alias("own"))
    o = p.select("about", F.col("own").alias("next"), F.col("turn").alias("other"), (F.col("turn") - 1).alias("turn"))
    return p.join(o, ["about", "turn"]).select("about", "turn", "other", B.parts_similarity(F.col("own"), F.col("next")).alias("similarity"))


_KIND = "case " + " ".join("when regexp_matches(t, '{}') then '{}'".format(v, k) for k, v in B.KIND_CUES.items()) + " end"
_CUED = "|| case id % 6 when 0 then ' told' when 1 then ' is really' when 2 then ' always' when 3 then ' prefers' when 4 then ' wants to' else '' end"


@query("t32_inferred_kind", f"with {S.CONV}, a as (select id, {_CLEAN} {_CUED} as t from conv) select id, {_KIND} as kind from a")
def t32(spark, d):
    return A.conversation_rows(spark, d).select("id", B.inferred_kind(F.concat("content", _cue())).alias("kind"))


def _cue():
    i = F.col("id") % 6
    return F.when(i == 0, " told").when(i == 1, " is really").when(i == 2, " always").when(i == 3, " prefers").when(i == 4, " wants to").otherwise("")


_CAP = lambda k: f"case {k} when 'observation' then 1.0 when 'stated_fact' then 0.9 when 'preference' then 0.8 when 'goal' then 0.65 when 'trait' then 0.45 when 'identity' then 0.35 end"


@query("t33_effective_kind", f"with {S.CONV}, a as (select id, 'stated_fact' as own, {_CLEAN} {_CUED} as t from conv), b as (select *, {_KIND} as seen from a) select id, case when seen is not null and {_CAP('seen')} < {_CAP('own')} then seen else own end as kind from b")
def t33(spark, d):
    return A.conversation_rows(spark, d).select("id", B.effective_kind(F.lit("stated_fact"), F.concat("content", _cue())).alias("kind"))


QUERIES, ORACLES = C.queries, C.oracles
