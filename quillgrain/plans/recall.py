"""Queries of recall: lanes, fusion, gate, hybrid search and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrain.functions import text as T
from quillgrain.operators import bank as K
from quillgrain.operators import retrieval as R
from quillgrain.operators import vectors as X
from quillgrain.plans import sql as S
from quillgrain.plans.catalog import Catalog
from quillgrain.sources import adapters as A
from quillgrain.sources.scratch import stored

C = Catalog()
query = C.query


def bare_rows(spark, d):
    """Documents as memories with, where there is one, a vector; what is read out of their texts is left to the operators."""
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("label") == 0, "m0").otherwise("m1").alias("stamp"))
    return A.document_rows(spark, d).drop("salience").join(e, "id", "left").withColumn("cue_vector", F.transform("vector", lambda x: x * x))


def rows(spark, d):
    """Documents as memories with cues and, where there is one, a vector."""
    return R.cued(bare_rows(spark, d))


def queries(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.when(F.col("label") == 0, "m0").otherwise("m1").alias("query_stamp"))
    return A.recall_queries(spark, d).join(e, "query_id")


_TOK = f"regexp_extract_all(translate(lower(content), '{R.ACCENTED}', '{R.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"
_STOP = S.words(T.STOPWORDS)
_LEX = f"""{S.DOCM}, {S.QUERIES}, tl as materialized (select bank_id, id, {_TOK} as toks from docm), tk as (select bank_id, id, len(toks) as doc_len, unnest(toks) as token from tl), po as materialized (select bank_id, id, doc_len, token, count(*) as tf from tk group by all),
df as materialized (select token, count(*) as df from po group by 1), sz as (select count(*)::double as n, avg(len(toks)) as avg_len from tl),
t1 as materialized (select query_id, bank_id, {S.distinct("list_filter(regexp_extract_all(lower(query_text), '[a-z0-9''-]{3,}'), lambda x: not list_contains(" + _STOP + ", x))")}[1:16] as l from qs),
tq as materialized (select distinct query_id, bank_id, unnest(regexp_extract_all(array_to_string(l, ' '), '[\\p{{L}}\\p{{N}}]+')) as token from t1),
lex as (select query_id, id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) as score from tq join po using (bank_id, token) join df using (token), sz group by 1, 2)"""


@query("a10_document_frequency", f"with {S.DOCM}, tk as (select distinct id, unnest({_TOK}) as token from docm) select token, count(*) as df from tk group by 1")
def a10(spark, d):
    return R.corpus_stats(A.document_rows(spark, d))[0]


@query("r01_lexical_ranking", f"with {_LEX}, v as (select query_id, id from qs join docm using (bank_id) where retired_batch is null and (turn_idx is null or turn_idx < cutoff_turn)), r as (select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id)::int as rank, round(score, 6) as score from lex join v using (query_id, id) where score > 0) select * from r where rank <= 60")
def r01(spark, d):
    q, m = A.recall_queries(spark, d), A.document_rows(spark, d)
    seen = R.visible_pairs(q, m).select("query_id", "id")
    return R.top(R.lexical_scores(q, m, R.seen_rows(q, m)).join(seen, ["query_id", "id"], "left_semi")).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("o02_lexical_top", f"with {_LEX} select query_id, id from lex where score > 0 qualify row_number() over (partition by query_id order by round(score, 9) desc, id) <= 10")
def o02(spark, d):
    return R.top(R.lexical_scores(A.recall_queries(spark, d), A.document_rows(spark, d)), 10).select("query_id", "id")


_VIS = "vis as (select q.*, m.* exclude (bank_id) from qs q join docm m using (bank_id) where retired_batch is null and (turn_idx is null or turn_idx < cutoff_turn))"
_EXACT = f"{S.CUES}, {S.EXACT.replace('from qs join cu using (bank_id)', 'from vis join cu using (id)')}"


@query("o03_exact_lane", f"with {S.DOCM}, {S.QUERIES}, {_VIS}, {_EXACT} select query_id, id, row_number() over (partition by query_id order by score desc, id)::int as rank from ex where score > 0")
def o03(spark, d):
    q = A.recall_queries(spark, d)
    return R.top(R.exact_lane(R.visible_pairs(q, R.cued(R.seen_rows(q, A.document_rows(spark, d).drop("salience"))))), None).select("query_id", "id", "rank")


_FUSE = f"""{_LEX}, {_VIS}, {_EXACT}, l1 as (select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from lex join (select query_id, id from vis) using (query_id, id) where score > 0 qualify rank <= 60),
l2 as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from ex where score > 0),
al as (select *, 'lexical' as lane, 1.1 * 12 / (60 + rank) as s from l1 union all select *, 'exact', 1.25 * 12 / (60 + rank) from l2),
fu as (select query_id, id, round(sum(s::double), 9) as fused, list_sort(list(distinct lane) filter (where rank <= 12)) as reasons from al group by 1, 2)"""


def _fused(spark, d, rows=A.document_rows):
    m = rows(spark, d).drop("salience")
    q = A.recall_queries(spark, d)
    pairs = R.scored_pairs(q, m)
    lex = R.lexical_scores(q, m, R.seen_rows(q, m)).join(pairs.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return pairs, R.fuse({"lexical": R.top(lex), "exact": R.top(R.exact_lane(pairs), None)})


@query("r02_rank_fusion", f"with {_FUSE} select query_id, id, round(fused, 6) as fused, coalesce(array_to_string(reasons, ' '), '') as reasons from fu")
def r02(spark, d):
    return _fused(spark, d)[1].select("query_id", "id", F.round("fused", 6).alias("fused"), F.array_join("reasons", " ").alias("reasons"))


@query("r06_relevance_gate", f"with {_FUSE}, g as (select query_id, count(*) as n, count_if(fused >= 0.45 * mx) as worth from (select *, max(fused) over (partition by query_id) as mx from fu) group by 1) select query_id, n, worth, greatest(least(6, n, 16), least(16, worth))::int as take from g")
def r06(spark, d):
    g = R.gate(_fused(spark, d)[1].withColumnRenamed("fused", "score"), 16)
    return g.groupBy("query_id").agg(F.first("n").alias("n"), F.first("worth").alias("worth"), F.first("take").alias("take"))


@query("r05_scalar_priors")
def r05(spark, d):
    pairs, fused = _fused(spark, d)
    return R.priors(pairs, fused).select("query_id", "id", F.round("score", 6).alias("score"))


@query("r03_vector_lanes", f"with {S.DOCM}, {S.QUERIES}, e as (select vec_id, embedding::double[] as v, case when label = 0 then 'm0' else 'm1' end as st from embeddings), {_VIS}, s as (select query_id, id, list_dot_product(a.v, b.v) as score from vis join e a on a.vec_id = id join e b on b.vec_id = query_id where a.st = b.st) select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id desc)::int as rank from s where score > 0 qualify rank <= 60")
def r03(spark, d):
    return R.top(R.vector_lane(R.visible_pairs(queries(spark, d), bare_rows(spark, d)), "vector"), ties="desc").select("query_id", "id", "rank")


@query("r04_facet_lanes", f"with {S.DOCM}, {S.QUERIES}, e as (select vec_id, embedding::double[] as v, case when label = 0 then 'm0' else 'm1' end as st from embeddings), {_VIS}, s as (select query_id, label, id, list_dot_product(a.v, b.v) as score from vis join e a on a.vec_id = id join (select vec_id - 100 as query_id, 'f1' as label, v, st from e union all select vec_id - 200, 'f2', v, st from e) b using (query_id) where a.st = b.st) select query_id, label, id from s where score > 0 qualify row_number() over (partition by query_id, label order by round(score, 9) desc, id desc) <= 60")
def r04(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("fv"), F.when(F.col("label") == 0, "m0").otherwise("m1").alias("fs"))
    f = e.select((F.col("vec_id") - 100).alias("query_id"), F.lit("f1").alias("label"), "fv", "fs").unionByName(e.select((F.col("vec_id") - 200).alias("query_id"), F.lit("f2").alias("label"), "fv", "fs"))
    pairs = R.visible_pairs(queries(spark, d), bare_rows(spark, d)).select("query_id", "id", "vector", "stamp").join(f, "query_id").where("stamp = fs")
    w = Window.partitionBy("query_id", "label").orderBy(F.desc(F.round("score", 9)), F.desc("id"))
    return pairs.select("query_id", "label", "id", T.dot(F.col("vector"), F.col("fv")).alias("score")).where("score > 0").withColumn("r", F.row_number().over(w)).where("r <= 60").select("query_id", "label", "id")


@query("r07_diverse_choice")
def r07(spark, d):
    pairs, fused = _fused(spark, d)
    g = stored(R.gate(R.priors(pairs, fused), 16).select("query_id", "bank_id", "id", "rank", "score", "take"))
    return R.diversify(R.pool_of(g, A.document_rows(spark, d)))


@query("r08_neighbour_padding")
def r08(spark, d):
    """Rows of a bank are episodes here, and each four turns are one, so that those next to each other in a bank are one apart."""
    pairs, fused = _fused(spark, d, A.paced_rows)
    g = R.gate(R.priors(pairs, fused), 16).withColumns({"kind": F.lit("episodic"), "turn_idx": F.floor(F.col("turn_idx") / A.LEAST_BANKS)})
    g = stored(g.select("query_id", "id", "kind", "turn_idx", "rank", "take"))
    picked = g.where("rank <= take").select("query_id", "id", F.col("rank").alias("pick"))
    return R.pad_neighbours(picked, g)


@query("r09_hybrid_search")
def r09(spark, d):
    return R.hybrid_search(queries(spark, d), bare_rows(spark, d), 16)


@query("r10_recall_context")
def r10(spark, d):
    q, m = queries(spark, d), bare_rows(spark, d)
    recent = K.recent(A.document_rows(spark, d), A.recall_queries(spark, d), turns=40).select("query_id", "id")
    return R.context(R.hybrid_search(q, m, 16), recent, m)


@query("o07_summary_top", "with e as (select vec_id, embedding::double[] as v from embeddings), s as (select vec_id % " + S.banks("documents") + " as bank_id, vec_id as end_turn, v from e), o as (select * from s qualify row_number() over (partition by bank_id order by end_turn desc) > 1), p as (select item_id as query_id, end_turn, list_dot_product(e.v, o.v) as score from benchmark join e on vec_id = item_id join o on bank_id = item_id % " + S.banks("documents") + ") select query_id, end_turn, row_number() over (partition by query_id order by round(score, 9) desc, end_turn desc)::int as rank from p qualify rank <= 2")
def o07(spark, d):
    e = A.table(spark, d, "embeddings")
    s = e.select((F.col("vec_id") % A.banks(spark, d, "documents")).alias("bank_id"), F.col("vec_id").alias("end_turn"), F.lit("s").alias("summary"), F.col("embedding").alias("vector"))
    return R.summary_top(queries(spark, d), s).select("query_id", "end_turn", "rank")


@query("v01_hashed_embedding")
def v01(spark, d):
    return X.embed(A.table(spark, d, "documents"), "text", "doc_id")


@query("v02_embedding_stamp", f"select doc_id as id, '{X.STAMP}' as embedding_model, {X.DIM} as embedding_dim from documents")
def v02(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(X.STAMP).alias("embedding_model"), F.lit(X.DIM).alias("embedding_dim"))


@query("v03_exact_neighbours", "with r as (select q.vec_id as query_id, c.vec_id as id, round(list_dot_product(q.embedding::double[], c.embedding::double[]), 6) as score, row_number() over (partition by q.vec_id order by round(list_dot_product(q.embedding::double[], c.embedding::double[]), 9) desc, c.vec_id desc)::int as rank from embeddings q join embeddings c on q.vec_id % 100 = 0 where list_dot_product(q.embedding::double[], c.embedding::double[]) > 0) select * from r where rank <= 10")
def v03(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("one").alias("stamp"), F.col("embedding").alias("vector"))
    return X.nearest(e, e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "stamp", "vector"), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("t11_similarity", f"with t as (select doc_id, list_distinct({S.tokens('text')}) as s, embedding::double[] as v from documents left join embeddings on vec_id = doc_id) select a.doc_id, b.doc_id as other_id, round(case when a.v is not null and b.v is not null then greatest(0, list_dot_product(a.v, b.v)) when len(a.s) = 0 or len(b.s) = 0 then 0 else len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s))::double end, 6) as similarity from t a join t b on b.doc_id = a.doc_id + 1")
def t11(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    a = A.table(spark, d, "documents").select("doc_id", T.token_set("text").alias("s")).join(e, "doc_id", "left")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other_id"), F.col("s").alias("s2"), F.col("v").alias("v2"))
    sim = F.when(F.col("v").isNotNull() & F.col("v2").isNotNull() & (F.size("v") == F.size("v2")), F.greatest(F.lit(0.0), T.dot(F.col("v"), F.col("v2")))).otherwise(T.jaccard(F.col("s"), F.col("s2")))
    return a.join(b, "doc_id").select("doc_id", "other_id", F.round(sim, 6).alias("similarity"))


def _stranded_tables(spark, d):
    """Memories and summaries of which some have another model's vector, or none; and an embedder that stands in for a provider."""
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("label") == 0, _TARGET).otherwise("old").alias("embedding_model"), F.when(F.col("label") == 0, X.DIM).otherwise(F.size("embedding")).alias("embedding_dim"))
    m = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).join(e, "id", "left")
    c = A.table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"), F.when(F.col("conv_id") % 3 == 0, _TARGET).alias("embedding_model"), F.lit(X.DIM).alias("embedding_dim"))
    return m, c.withColumn("embedding", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0).cast("float"))))


_TARGET = "provider:hashed-256"
_L9 = f"""m as (select doc_id as id, not coalesce(label = 0, false) as stale, trim(text) <> '' as whole from documents left join embeddings on vec_id = doc_id), c as (select conv_id as id, conv_id % 3 <> 0 as stale, trim(text) <> '' as whole from conversations where turn = 0),
a as (select 'memories' as tab, id from m where stale union all select 'summaries', id from c where stale and whole), r as (select *, row_number() over (order by tab, id) as rank from a)"""


def _limit(spark, d):
    return A.table(spark, d, "documents").count()


@query("l09_embedding_migration", f"with {_L9} select tab, id, '{_TARGET}' as embedding_model, {X.DIM} as embedding_dim from r where rank <= (select count(*) from documents)")
def l09(spark, d):
    """A run under one limit over both tables: memories first, then summaries."""
    out = X.migrate(*_stranded_tables(spark, d), _TARGET, X.DIM, lambda rows: X.embed(rows).select("id", "embedding"), limit=_limit(spark, d))
    return out.rebuilt.select("tab", "id", "embedding_model", "embedding_dim")


@query("l09_remaining", f"with {_L9}, k as (select unnest(['memories', 'summaries']) as tab) select tab, count(rank) as needed, count_if(rank > (select count(*) from documents))::bigint as remaining from k left join r using (tab) group by tab")
def l09_remaining(spark, d):
    return X.migrate(*_stranded_tables(spark, d), _TARGET, X.DIM, lambda rows: X.embed(rows).select("id", "embedding"), limit=_limit(spark, d)).remaining


QUERIES, ORACLES = C.queries, C.oracles
