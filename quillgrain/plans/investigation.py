"""Queries of investigation: joins, aggregates, windows, orders, limits and sets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrain.operators import bank as K
from quillgrain.operators import investigate as V
from quillgrain.operators import retrieval as R
from quillgrain.plans import sql as S
from quillgrain.plans.catalog import Catalog
from quillgrain.sources import adapters as A

C = Catalog()
query = C.query

_TURNS = "turns as (select o_custkey as c_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as idx from orders)"


def turns(spark, d):
    o = A.table(spark, d, "orders")
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", idx.cast("long").alias("idx"))


def steps(spark, d):
    li = A.table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("ord"), F.col("l_linestatus").alias("key"), (F.col("l_returnflag") == "R").alias("stale"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("j01_find_by_name", f"""with {_TURNS}, asked as (select unnest(['00001', '0002', 'nobody']) as asked), n as (select c_custkey, count(*) as n_children, min(idx) as first_at, max(idx) as last_at from turns group by 1)
select asked, c_custkey, c_name, coalesce(n_children, 0) as n_children, first_at, last_at, count(*) over (partition by asked) > 1 as ambiguous
from customer join asked on contains(lower(c_name), lower(asked)) left join n using (c_custkey)""")
def j01(spark, d):
    asked = spark.createDataFrame([("00001",), ("0002",), ("nobody",)], "asked string")
    return V.find_by_name(A.table(spark, d, "customer").select("c_custkey", "c_name"), turns(spark, d), asked, "c_custkey", "c_name", "idx")


@query("j02_step_details", """with v as (select l_orderkey, l_linenumber, l_quantity > 5 as active, 'part ' || l_partkey as content from lineitem)
select o_orderkey, l.l_linenumber as ord, a.content, coalesce(n.c, 0) as n_variants from orders join lineitem l on l.l_orderkey = o_orderkey
left join v a on a.l_orderkey = l.l_orderkey and a.l_linenumber = l.l_linenumber and a.active
left join (select l_orderkey, l_linenumber, count(*) c from v group by 1, 2) n on n.l_orderkey = l.l_orderkey and n.l_linenumber = l.l_linenumber""")
def j02(spark, d):
    s = steps(spark, d)
    v = s.select("o_orderkey", "ord", (F.col("l_quantity") > 5).alias("active"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("content"))
    return V.step_details(turns(spark, d).select("o_orderkey"), s.select("o_orderkey", "ord"), v, "o_orderkey", ["o_orderkey", "ord"])


@query("j03_lookup_in_range", "select l_orderkey, l_linenumber, p_name from lineitem left join part on p_partkey = l_partkey and p_size > 10 where l_shipdate between timestamp '1994-01-01' and timestamp '1996-12-31'")
def j03(spark, d):
    p = A.table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return A.table(spark, d, "lineitem").where("l_shipdate between timestamp'1994-01-01' and timestamp'1996-12-31'").join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", "p_name")


@query("j04_cast_of_story", "select distinct o_custkey, s_name from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey")
def j04(spark, d):
    o = A.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    li = A.table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
    return o.join(li, "l_orderkey").join(A.table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("o_custkey", "s_name").distinct()


@query("j05_entry_with_book", "select p_partkey, p_name, n_name from part left join nation on n_nationkey = p_partkey % 25")
def j05(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 25).alias("n_nationkey"))
    return p.join(A.table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "left").select("p_partkey", "p_name", "n_name")


@query("j06_per_turn_counts", f"""with {_TURNS}, s as (select l_orderkey, count(*) as n_steps, count_if(l_returnflag = 'R') as n_stale, string_agg(l_linestatus, ' ' order by l_linenumber, l_linestatus) as labels from lineitem group by 1)
select c_custkey, idx, o_orderkey, coalesce(n_steps, 0) as n_steps, coalesce(n_stale, 0) as n_stale, labels from turns left join s on l_orderkey = o_orderkey""")
def j06(spark, d):
    return V.per_turn(turns(spark, d), steps(spark, d), "o_orderkey", "ord, key", "key", "stale")


@query("j07_reached_commit", "select o_custkey, count(*) as n_turns from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F') group by 1")
def j07(spark, d):
    done = A.table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return A.table(spark, d, "orders").join(done, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n_turns"))


_CHATS = "chats as (select c_custkey, case when c_custkey % 3 = 0 then [c_custkey - 1, c_custkey - 2] else [] end as branched_from from customer)"


@query("j08_descendants", f"with {_CHATS}, u as (select unnest(branched_from) as c_custkey from chats), n as (select c_custkey, count(*) c from u group by 1) select c_custkey, coalesce(c, 0) as n_descendants from chats left join n using (c_custkey)")
def j08(spark, d):
    k = F.col("c_custkey")
    chats = A.table(spark, d, "customer").select(k, F.when(k % 3 == 0, F.array(k - 1, k - 2)).otherwise(F.array().cast("array<bigint>")).alias("branched_from"))
    return V.descendants(chats, "c_custkey", "branched_from")


_ROUTES = """direct as (select distinct c_custkey, c_nationkey as book from customer),
linked as (select distinct o_custkey as c_custkey, s_nationkey as book from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey)"""


def book_routes(spark, d):
    direct = A.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("book"))
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"))
    li = A.table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
    linked = o.join(li, "l_orderkey").join(A.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("book")), "s_suppkey").select("c_custkey", "book")
    return direct, linked


@query("u01_route_union", f"with {_ROUTES} select *, 'column' as route from direct union all select *, 'link' from linked")
def u01(spark, d):
    direct, linked = book_routes(spark, d)
    return V.routes({"column": direct, "link": linked})


@query("j09_entries_of_routes", f"with {_ROUTES} select c_custkey, count(*) as n_entries, min(p_partkey) as first_entry, sum(p_partkey)::bigint as entry_sum from (select c_custkey, book from direct union select c_custkey, book from linked) join part on p_partkey % 25 = book group by 1")
def j09(spark, d):
    direct, linked = book_routes(spark, d)
    books = direct.unionByName(linked).select("c_custkey", "book").distinct()
    # entries are summed up by book before they meet the stories that hold it
    entries = A.table(spark, d, "part").groupBy((F.col("p_partkey") % 25).alias("book")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("a"), F.sum("p_partkey").alias("s"))
    return books.join(entries, "book").groupBy("c_custkey").agg(F.sum("n").alias("n_entries"), F.min("a").alias("first_entry"), F.sum("s").alias("entry_sum"))


@query("u02_union_in_filter", f"with {_ROUTES}, b as (select book from direct union select book from linked) select n_nationkey, n_name from nation where n_nationkey in (select book from b)")
def u02(spark, d):
    direct, linked = book_routes(spark, d)
    books = direct.select("book").union(linked.select("book")).distinct().withColumnRenamed("book", "n_nationkey")
    return A.table(spark, d, "nation").join(books, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query("u03_set_difference", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority like '1%')")
def u03(spark, d):
    seen = A.table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return A.table(spark, d, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey")


@query("u04_ordered_distinct", f"with a as (select doc_id, string_split(text, ' ') as l from documents) select doc_id, array_to_string({S.distinct('l')}, ' ') as w from a")
def u04(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("w"))


@query("j10_never_indexed", "select doc_id, source from documents where doc_id not in (select doc_id from labels) and source <> 'src0'")
def j10(spark, d):
    return A.table(spark, d, "documents").where("source <> 'src0'").join(A.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("j11_orphan_chunks", "select doc_id from labels where doc_id not in (select doc_id from documents where source <> 'src3')")
def j11(spark, d):
    return K.orphans(A.table(spark, d, "labels"), A.table(spark, d, "documents").where("source <> 'src3'"), "doc_id").select("doc_id")


@query("j12_stale_sources", "select source, max(doc_id) as modified, m as indexed_at from documents join (select source, max(doc_id) - 30 as m from documents where doc_id % 3 = 0 group by 1) using (source) where doc_id > m + 1 group by source, m")
def j12(spark, d):
    docs = A.table(spark, d, "documents").select("source", "doc_id")
    at = docs.where("doc_id % 3 = 0").groupBy("source").agg((F.max("doc_id") - 30).alias("indexed_at"))
    return docs.join(at, "source").where("doc_id > indexed_at + 1").groupBy("source", "indexed_at").agg(F.max("doc_id").alias("modified"))


@query("p09_name_search", "select c_custkey, c_name from customer where c_name ilike '%#00001%' or contains(lower(c_name), '0077')")
def p09(spark, d):
    return A.table(spark, d, "customer").where(F.col("c_name").ilike("%#00001%") | F.contains(F.lower("c_name"), F.lit("0077"))).select("c_custkey", "c_name")


@query("p10_text_search", "select p_partkey from part where p_name ilike '%a%e%' or p_type ilike '%std%' or p_brand ilike '%13%'")
def p10(spark, d):
    return A.table(spark, d, "part").where(F.col("p_name").ilike("%a%e%") | F.col("p_type").ilike("%std%") | F.col("p_brand").ilike("%13%")).select("p_partkey")


@query("p12_archive_folder", "select doc_id from documents where list_has_any(list_slice(string_split(source || '/' || lang || '/' || doc_id || '.md', '/'), 1, 2), ['src1', 'de'])")
def p12(spark, d):
    parts = F.split(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))), "/")
    return A.table(spark, d, "documents").where(F.arrays_overlap(F.slice(parts, 1, 2), F.array(F.lit("src1"), F.lit("de")))).select("doc_id")


@query("p13_language_by_suffix", "select doc_id, case regexp_extract(lower(p), '\\.[^./]+$') when '.md' then 'markdown' when '.py' then 'python' else '' end as language from (select doc_id, source || '/' || doc_id || case doc_id % 3 when 0 then '.MD' when 1 then '.py' else '' end as p from documents)")
def p13(spark, d):
    tail = F.when(F.col("doc_id") % 3 == 0, ".MD").when(F.col("doc_id") % 3 == 1, ".py").otherwise("")
    ext = F.lower(F.regexp_extract(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), tail), r"\.[^./]+$", 0))
    return A.table(spark, d, "documents").select("doc_id", F.when(ext == ".md", "markdown").when(ext == ".py", "python").otherwise("").alias("language"))


# ---- aggregates

@query("a02_retrieval_health", "select 'api:m' || q as stamp, count(*) as n_rows, count_if(label % 2 = q) as n_comparable, count_if(label % 2 <> q) as n_incomparable, count_if(label % 2 = q) > 0 as lanes_live from embeddings, (select unnest([0, 1]) as q) group by q")
def a02(spark, d):
    n = A.table(spark, d, "embeddings").groupBy((F.col("label") % 2).alias("m")).agg(F.count("*").alias("n"))
    q = spark.range(2).select(F.col("id").cast("int").alias("q"))
    pairs = n.join(F.broadcast(q))  # two stamps against the few stamps that rows have
    same = F.sum(F.when(F.col("m") == F.col("q"), F.col("n")).otherwise(0))
    out = pairs.groupBy("q").agg(F.sum("n").alias("n_rows"), same.alias("n_comparable"))
    return out.select(F.concat(F.lit("api:m"), F.col("q").cast("string")).alias("stamp"), "n_rows", "n_comparable", (F.col("n_rows") - F.col("n_comparable")).alias("n_incomparable"), (F.col("n_comparable") > 0).alias("lanes_live"))


@query("a03_stranded_counts", "select label, count(*) as n_rows, count_if(label <> 0 or embedding is null or len(embedding) <> 64) as n_stranded from embeddings group by 1")
def a03(spark, d):
    e = A.table(spark, d, "embeddings").select("label", "embedding", F.when(F.col("label") == 0, "m0").otherwise("m1").alias("embedding_model"), F.size("embedding").alias("embedding_dim"))
    return e.groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if(K.stranded(e, "m0", 64)).alias("n_stranded"))


@query("a04_session_list", "select conv_id, count_if(role = 'user') as n_turns, substr(arg_min(text, turn) filter (where role = 'user' and text <> ''), 1, 120) as opening from conversations group by 1")
def a04(spark, d):
    user = F.col("role") == "user"
    c = A.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count_if(user).alias("n_turns"), F.substring(F.min_by("text", F.when(user & (F.col("text") != ""), F.col("turn"))), 1, 120).alias("opening"))


@query("a05_story_overview", f"with {_TURNS}, s as (select l_orderkey, count(*) as n, count_if(l_returnflag = 'R') as r from lineitem group by 1) select c_custkey, count(*) as n_turns, min(idx) as first_idx, max(idx) as last_idx, coalesce(sum(n), 0)::bigint as n_steps, coalesce(sum(r), 0)::bigint as n_stale from turns left join s on l_orderkey = o_orderkey group by 1")
def a05(spark, d):
    s = steps(spark, d).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.count_if("stale").alias("r"))
    t = turns(spark, d).join(s, "o_orderkey", "left")
    return t.groupBy("c_custkey").agg(F.count("*").alias("n_turns"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_steps"), F.coalesce(F.sum("r"), F.lit(0)).alias("n_stale"))


@query("a06_consolidation_pressure", f"with {S.CONV} select bank_id, count(*) as n_rows, max(turn_idx) - 20 as n_turns, (max(turn_idx) - 20 >= 10 or count(*) >= 40) as due from conv where turn_idx > 20 group by 1")
def a06(spark, d):
    r = A.conversation_rows(spark, d).where("turn_idx > 20").groupBy("bank_id").agg(F.count("*").alias("n_rows"), (F.max("turn_idx") - 20).alias("n_turns"))
    return r.withColumn("due", (F.col("n_turns") >= 10) | (F.col("n_rows") >= 40))


@query("a07_index_totals", "select lang, count(distinct source) as n_sources, count(*) as n_chunks, sum(length(text))::bigint as n_chars from documents group by 1")
def a07(spark, d):
    return A.table(spark, d, "documents").groupBy("lang").agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


@query("a08_conditional_counts", "select p_partkey % 25 as book, count(*) as n_entries, count_if(p_size > 25) as n_locked, count_if(p_size % 2 = 1) as n_in_play from part group by 1")
def a08(spark, d):
    return A.table(spark, d, "part").groupBy((F.col("p_partkey") % 25).alias("book")).agg(F.count("*").alias("n_entries"), F.count_if(F.col("p_size") > 25).alias("n_locked"), F.count_if(F.col("p_size") % 2 == 1).alias("n_in_play"))


@query("a11_index_quantiles", "with a as (select o_custkey % 50 as g, o_totalprice as v, row_number() over (partition by o_custkey % 50 order by o_totalprice) - 1 as i, count(*) over (partition by o_custkey % 50) as n from orders) select g, max(v) filter (where i = floor(n * 0.1)) as p10, max(v) filter (where i = floor(n * 0.9)) as p90 from a group by 1")
def a11(spark, d):
    g = (F.col("o_custkey") % 50).alias("g")
    w = Window.partitionBy("g")
    o = A.table(spark, d, "orders").select(g, F.col("o_totalprice").alias("v"))
    o = o.withColumns({"i": F.row_number().over(w.orderBy("v")) - 1, "n": F.count("*").over(w)})
    pick = lambda q: F.max(F.when(F.col("i") == F.floor(F.col("n") * q), F.col("v")))
    return o.groupBy("g").agg(pick(0.1).alias("p10"), pick(0.9).alias("p90"))


@query("a12_largest_entries", "select source, sum(length(text))::bigint as n_chars from documents group by 1 order by n_chars desc, source limit 3")
def a12(spark, d):
    return A.table(spark, d, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("n_chars")).orderBy(F.desc("n_chars"), "source").limit(3)


@query("a13_corpus_description", "select source, count(distinct lang) as n_children, count(*) as n_files, sum(octet_length(encode(text)))::bigint as n_bytes from documents group by 1")
def a13(spark, d):
    return A.table(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("n_children"), F.count("*").alias("n_files"), F.sum(F.octet_length("text")).alias("n_bytes"))


@query("a16_payload_cost", "select conv_id, count(*) as n_rounds, max(length(text)) as system_chars, sum(length(text))::bigint as round_chars, (max(length(text)) * count(*) + sum(length(text)))::bigint as total_chars from conversations group by 1")
def a16(spark, d):
    g = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_rounds"), F.max(F.length("text")).alias("system_chars"), F.sum(F.length("text")).alias("round_chars"))
    return g.withColumn("total_chars", F.col("system_chars") * F.col("n_rounds") + F.col("round_chars"))


# ---- windows, orders and limits

@query("w01_ranked_importance", f"""with {S.CONV}, v as (select bank_id, id, {S.salience('content')} as v from conv), r as (select *, rank() over (partition by bank_id order by v) - 1 as k, count(*) over (partition by bank_id, v) as c, count(*) over (partition by bank_id) as n, row_number() over (partition by bank_id order by v, id) - 1 as i from v),
q as (select *, max(case when i = floor(n * 0.1) then v end) over (partition by bank_id) as lo, max(case when i = floor(n * 0.9) then v end) over (partition by bank_id) as hi from r)
select bank_id, id, round(case when n < 2 or hi - lo <= 1e-9 then v else lo + (k + k + c - 1) / 2.0::double / (n - 1) * (hi - lo) end, 9) as importance from q""")
def w01(spark, d):
    from quillgrain.functions import text as T

    v = A.conversation_rows(spark, d).select("bank_id", "id", T.salience("content").alias("importance"))
    return R.ranked_importance(v, "bank_id").select("bank_id", "id", F.round("importance", 9).alias("importance"))


@query("w02_recent_buffer", f"with {S.DOCM}, {S.QUERIES}, r as (select query_id, id, turn_idx, row_number() over (partition by query_id order by turn_idx desc, id desc) as back from qs join docm using (bank_id) where turn_idx < cutoff_turn and turn_idx >= cutoff_turn - 40) select * from r where back <= 12")
def w02(spark, d):
    rows = A.document_rows(spark, d).select("bank_id", "id", "turn_idx")
    return K.recent(rows, A.recall_queries(spark, d), turns=40).select("query_id", "id", "turn_idx", F.col("back").cast("long").alias("back"))


@query("w03_latest_per_key", f"with {S.CONV} select bank_id, provenance, max(id) as id from conv group by 1, 2")
def w03(spark, d):
    rows = A.conversation_rows(spark, d)
    return V.latest(rows, ["bank_id", "provenance"], [F.desc("turn_idx"), F.desc("id")]).select("bank_id", "provenance", "id")


@query("w04_latest_evidence", f"with {S.OBS} select hypothesis_id, seq, r as rank from (select *, row_number() over (partition by hypothesis_id order by seq desc)::int r from obs) where r <= 2")
def w04(spark, d):
    return V.latest(A.observations(spark, d), ["hypothesis_id"], [F.desc("seq")], 2).select("hypothesis_id", "seq", "rank")


@query("w05_chronological_neighbours", f"with {S.CONV}, a as (select bank_id, id, turn_idx, lag(id) over w as p, lag(turn_idx) over w as pt, lead(id) over w as n, lead(turn_idx) over w as nt from conv where provenance <> 'remembered' window w as (partition by bank_id order by turn_idx, id)) select id, case when turn_idx - pt <= 1 then p end as before_id, case when nt - turn_idx <= 1 then n end as after_id from a")
def w05(spark, d):
    w = Window.partitionBy("bank_id").orderBy("turn_idx", "id")
    t = F.col("turn_idx")
    r = A.conversation_rows(spark, d).where("provenance <> 'remembered'")
    return r.select("id", F.when(t - F.lag("turn_idx").over(w) <= 1, F.lag("id").over(w)).alias("before_id"), F.when(F.lead("turn_idx").over(w) - t <= 1, F.lead("id").over(w)).alias("after_id"))


@query("w06_prefix_budget", "with a as (select source, doc_id, sum(length(text)) over (partition by source order by doc_id rows unbounded preceding)::bigint as spent, row_number() over (partition by source order by doc_id) as r from documents) select source, doc_id, spent from a where spent <= 12000 or r = 1")
def w06(spark, d):
    docs = A.table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("n"))
    return V.prefix_budget(docs, ["source"], [F.asc("doc_id")], "n", 12000).select("source", "doc_id", "spent")


@query("w07_first_fit_budget", """with recursive a as (select source || ':' || (doc_id // 2000) as source, length(text) as n, row_number() over (partition by source, doc_id // 2000 order by doc_id) as rank from documents),
f as (select source, rank, n as spent, true as kept from a where rank = 1 union all
  select a.source, a.rank, case when f.spent + a.n <= 24000 then f.spent + a.n else f.spent end, f.spent + a.n <= 24000 from f join a on a.source = f.source and a.rank = f.rank + 1)
select source, max(spent) over (partition by source)::bigint as spent, rank::int as rank from f qualify kept""")
def w07(spark, d):
    part = F.concat_ws(":", "source", F.floor(F.col("doc_id") / 2000).cast("string"))  # keys grow with the table
    docs = A.table(spark, d, "documents").select(part.alias("source"), "doc_id", F.length("text").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return V.first_fit_budget(docs.withColumn("rank", rank), "source", "rank", "n", 24000)


@query("w08_streaks", f"with {S.EXPERIMENTS}, a as (select *, coalesce(lag(event_type) over (partition by hypothesis_id order by ts, id) <> event_type, true)::int as t from ex), b as (select *, sum(t) over (partition by hypothesis_id order by ts, id) as i from a) select id, row_number() over (partition by hypothesis_id, i order by ts, id) as held_for from b")
def w08(spark, d):
    return V.streaks(A.experiments(spark, d), "hypothesis_id", ["ts", "id"], "event_type").select("id", F.col("held_for").cast("long").alias("held_for"))


_STALL = f"with {S.EXPERIMENTS}, a as (select *, coalesce(not (id % 3 > 1) and lag(event_type) over w = event_type, false) as s from ex window w as (partition by hypothesis_id order by ts, id)), b as (select *, sum((not s)::int) over (partition by hypothesis_id order by ts, id) as i from a), c as (select id, sum(s::int) over (partition by hypothesis_id, i order by ts, id)::bigint as stalls from b) select *, stalls >= 2 as stalled from c"


@query("w09_stalls", _STALL)
def w09(spark, d):
    e = A.experiments(spark, d).withColumn("progress", F.col("id") % 3 > 1)
    return V.stalls(e, "hypothesis_id", ["ts", "id"], "event_type", "progress").select("id", "stalls", "stalled")


@query("w10_progress_flag", f"with {S.EXPERIMENTS} select id, (outcome = 'confirmed' or id % 3 > 1) as made_progress from ex")
def w10(spark, d):
    return A.experiments(spark, d).select("id", ((F.col("outcome") == "confirmed") | (F.col("id") % 3 > 1)).alias("made_progress"))


@query("o01_vector_top", "with p as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.embedding::double[], c.embedding::double[]) as s from embeddings q join embeddings c on q.vec_id % 50 = 0 and q.label = c.label), r as (select query_id, vec_id, row_number() over (partition by query_id order by round(s, 9) desc, vec_id desc)::int as rank from p where s > 0) select * from r where rank <= 60")
def o01(spark, d):
    from quillgrain.operators import vectors as X

    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("stamp"), F.col("embedding").alias("vector"))
    q = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "stamp", "vector")
    return X.nearest(e, q, 60).select("query_id", F.col("id").alias("vec_id"), "rank")


@query("o04_chronological_order", f"with {S.DOCM} select id, row_number() over (partition by bank_id order by turn_idx nulls last, id) as place from docm")
def o04(spark, d):
    w = Window.partitionBy("bank_id").orderBy(F.asc_nulls_last("turn_idx"), "id")
    return A.document_rows(spark, d).select("id", F.row_number().over(w).cast("long").alias("place"))


@query("o08_capped_outline", "select source, doc_id, row_number() over (partition by source order by doc_id)::int as rank from documents qualify rank <= 20")
def o08(spark, d):
    return V.latest(A.table(spark, d, "documents"), ["source"], [F.asc("doc_id")], 20).select("source", "doc_id", "rank")


@query("o09_retired_listing", f"with {S.DOCM} select id, retired_batch from docm where retired_batch is not null order by id desc limit 200")
def o09(spark, d):
    return A.document_rows(spark, d).where("retired_batch is not null").orderBy(F.desc("id")).limit(200).select("id", "retired_batch")


@query("o10_question_dedup", f"with {S.CONV}, a as (select id, trim(regexp_replace(lower({S.squeeze('content')}), '[^a-z0-9 ]', '', 'g')) as k from conv) select id, min(id) over (partition by k) as kept_id from a")
def o10(spark, d):
    from quillgrain.functions import text as T

    return A.conversation_rows(spark, d).select("id", F.min("id").over(Window.partitionBy(T.normal_question("content"))).alias("kept_id"))


@query("o11_panel_listing", f"with {S.CONV} select bank_id, id from (select *, row_number() over (partition by bank_id order by turn_idx desc, id desc) r from conv) where r <= 40")
def o11(spark, d):
    return V.latest(A.conversation_rows(spark, d), ["bank_id"], [F.desc("turn_idx"), F.desc("id")], max(1, min(60, 40))).select("bank_id", "id")


@query("o12_transcript", "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as transcript from conversations group by 1")
def o12(spark, d):
    c = A.table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("transcript"))


@query("o13_evidence_in_order", f"with {S.OBS} select hypothesis_id, 'ev:' || seq as ref, row_number() over (partition by hypothesis_id order by seq) as place from obs")
def o13(spark, d):
    w = Window.partitionBy("hypothesis_id").orderBy("seq")
    return A.observations(spark, d).select("hypothesis_id", F.concat(F.lit("ev:"), F.col("seq").cast("string")).alias("ref"), F.row_number().over(w).cast("long").alias("place"))


@query("o14_experiment_history", f"with {S.EXPERIMENTS} select hypothesis_id, id from ex qualify row_number() over (partition by hypothesis_id order by id desc) <= 20")
def o14(spark, d):
    return V.latest(A.experiments(spark, d), ["hypothesis_id"], [F.desc("id")], 20).select("hypothesis_id", "id")


@query("o15_retention", "with a as (select source, doc_id, row_number() over w as r, sum(length(text)) over (partition by source order by doc_id desc rows unbounded preceding) as s from documents window w as (partition by source order by doc_id desc)) select source, doc_id from a where r <= 40 and s <= 80000")
def o15(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    docs = A.table(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).alias("r"), F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    return docs.where("r <= 40 and s <= 80000").select("source", "doc_id")


QUERIES, ORACLES = C.queries, C.oracles
