"""Queries of pages, redaction, chunks and the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrain.functions import redact, web
from quillgrain.functions import text as T
from quillgrain.operators import chunks as N
from quillgrain.operators import pages as P
from quillgrain.plans import sql as S
from quillgrain.plans.catalog import Catalog
from quillgrain.sources import adapters as A

C = Catalog()
query = C.query

_BODY = "src as (select doc_id, source || '/' || lang || '/' || doc_id || '.md' as path, case when doc_id % 2 = 0 then '# ' else '' end || replace(text, chr(10), chr(10) || chr(10)) as body from documents)"


@query("s14_readable_pages")
def s14(spark, d):
    return P.readable(A.table(spark, d, "pages"))


@query("t17_html_text", f"""with a as (select page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') as h from pages), b as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
 '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?is)<svg[^>]*>.*?</svg>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav>', ' ', 'g'), '(?is)<footer[^>]*>.*?</footer>', ' ', 'g'), '(?is)<header[^>]*>.*?</header>', ' ', 'g') as h from a),
c as (select page_id, regexp_replace(regexp_replace(h, '(?is)<br\\s*/?>|</p>|</div>|</li>|</h[1-6]>', chr(10), 'g'), '(?s)<[^>"'']*(?:"[^"]*"|''[^'']*''[^>"'']*)*[^>]*>', ' ', 'g') as h from b)
select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(h, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;?', '&', 'g'), '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g'), '^\\s+', ''), '\\s+$', '') as text from c""")
def t17(spark, d):
    return A.table(spark, d, "pages").select("page_id", web.html_text(F.col("html")).alias("text"))


@query("t18_canonical_url")
def t18(spark, d):
    return A.table(spark, d, "pages").select("page_id", web.canonical_url("url").alias("url"))


@query("t20_same_source")
def t20(spark, d):
    p = A.table(spark, d, "pages").select("page_id", "url")
    variant = F.concat(F.regexp_replace("url", "^https?", "http"), F.when(F.col("page_id") % 2 == 0, "#part").otherwise(F.when(F.contains("url", F.lit("?")), "&utm_source=x").otherwise("?utm_source=x")))
    return p.select("page_id", web.same_source(web.canonical_url("url"), web.canonical_url(variant)).alias("same"))


@query("t16_identifier_tokens", "select event_id, array_to_string(list_sort([event_type, event_type || '_by_username' || user_id, 'name' || user_id, 'user']), ' ') as toks from events")
def t16(spark, d):
    return A.table(spark, d, "events").select("event_id", F.array_join(F.sort_array(T.identifier_tokens(F.concat(F.col("event_type"), F.lit("_by_userName"), F.col("user_id").cast("string")), N.STOP)), " ").alias("toks"))


@query("t38_reply_json", "select event_id, json_extract_string(props, '$.k')::int as k from events")
def t38(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.regexp_replace("props", r"\}$", ",}")).otherwise(F.col("props"))
    return A.table(spark, d, "events").select("event_id", F.get_json_object(P.reply_json(raw), "$.k").cast("int").alias("k"))


@query("t39_json_failure", "select event_id, (event_id % 4 = 0)::int as brace_balance, case when event_id % 4 = 1 then 0 else 2 end as quote_count, event_id % 4 in (0, 1) as failed from events")
def t39(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, F.regexp_replace("props", r"\}$", "")).when(F.col("event_id") % 4 == 1, F.lit("no object")).otherwise(F.col("props"))
    f = A.table(spark, d, "events").select("event_id", P.json_failure(raw).alias("f"))
    return f.select("event_id", "f.brace_balance", "f.quote_count", F.col("f.error").isNotNull().alias("failed"))


_KV = "kv as (select doc_id, unnest(regexp_extract_all(text, '(\\w+) = \"([^\"]+)\"', 1)) as key, unnest(regexp_extract_all(text, '(\\w+) = \"([^\"]+)\"', 2)) as value from documents)"


def key_values(spark, d):
    pairs = F.regexp_extract_all("text", F.lit(r'(\w+) = "([^"]+)"'), F.lit(0))
    kv = A.table(spark, d, "documents").select("doc_id", F.explode(pairs).alias("p"))
    return kv.select("doc_id", F.regexp_extract("p", r"(\w+) = ", 1).alias("key"), F.regexp_extract("p", r'"([^"]+)"', 1).alias("value"))


@query("t40_redaction", f"with {_KV} select doc_id, key, case when regexp_matches(key, '(?i)(^|_)(api_?key|apikey|secret|password|passwd|token|credential)(_|$)|_key$|_hash$|_salt$') then '<redacted: ' || key || ', ' || length(value) || ' chars>' else value end as value, case when regexp_matches(key, '(?i)(^|_)(api_?key|apikey|secret|password|passwd|token|credential)(_|$)|_key$|_hash$|_salt$') then 'value' else '' end as redacted from kv")
def t40(spark, d):
    return redact.redact(key_values(spark, d), keep=("doc_id",)).withColumn("redacted", F.array_join("redacted", ","))


@query("q01_safe_export", "select * exclude (s) from (select row_number() over (order by o_orderkey)::int as place, o_orderkey::varchar as o_orderkey, o_orderpriority, 'rows' as cut_by, 1 as s from orders order by orders.o_orderkey limit 200)")
def q01(spark, d):
    return P.safe_export(A.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"]).drop("redacted")


@query("h01_page_findings")
def h01(spark, d):
    return P.findings(A.table(spark, d, "pages"))


@query("h02_findings_roll_up")
def h02(spark, d):
    return P.roll_up(P.findings(A.table(spark, d, "pages")))


@query("c01_prose_blocks")
def c01(spark, d):
    return N.split_prose(A.chunk_sources(spark, d)).select("path", "ordinal", "title", F.length("body").alias("chars"))


@query("c02_chunks")
def c02(spark, d):
    return N.chunk(A.chunk_sources(spark, d)).select("path", "ordinal", "chunk_key", "title", "gist", "chars")


@query("s16_symbol_index")
def s16(spark, d):
    src = A.table(spark, d, "events").select(F.concat(F.lit("gen/"), F.col("event_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def "), "event_type", F.lit("_"), F.col("user_id").cast("string"), F.lit("():\n    return 1\n")).alias("body"))
    return N.symbol_index(src)


@query("a15_symbol_counts", "select event_type as name, 'function' as kind, count(*) as n from events group by 1")
def a15(spark, d):
    return s16(spark, d).groupBy(F.regexp_replace("name", "_[0-9]+$", "").alias("name"), "kind").agg(F.count("*").alias("n"))


def _mapped(spark, d):
    """Documents as files of several languages; in those of scripts a line that starts with a word names a function."""
    i = F.col("doc_id")
    name = F.when(i % 25 == 0, "main.py").when(i % 5 == 0, "notes.txt").when(i % 5 == 1, "index.js").when(i % 5 == 2, "part.ts").when(i % 5 == 3, "part.go").otherwise("read.md")
    word = F.when(i % 5 == 3, "$1func $2 ").otherwise("$1function $2 ")
    src = A.table(spark, d, "documents").withColumn("word", word)
    return src.select((i % A.banks(spark, d, "documents")).alias("bank_id"), F.concat_ws("/", F.lit("src"), i.cast("string"), name).alias("path"), F.when((i % 5).isin(1, 2, 3), F.expr(r"regexp_replace(text, '(^|\\n)([A-Za-z]+) ', word)")).otherwise(F.col("text")).alias("body"))


_MAP = rf"""src as (select doc_id, doc_id % {S.banks('documents')} as bank_id, 'src/' || doc_id || '/' || case when doc_id % 25 = 0 then 'main.py' when doc_id % 5 = 0 then 'notes.txt' when doc_id % 5 = 1 then 'index.js' when doc_id % 5 = 2 then 'part.ts' when doc_id % 5 = 3 then 'part.go' else 'read.md' end as path,
case when doc_id % 25 = 0 then 'python' when doc_id % 5 = 0 then '' when doc_id % 5 = 1 then 'javascript' when doc_id % 5 = 2 then 'typescript' when doc_id % 5 = 3 then 'go' else 'markdown' end as language,
coalesce(case when doc_id % 5 in (1, 2, 3) then regexp_replace(text, '(^|\n)([A-Za-z]+) ', case when doc_id % 5 = 3 then '\1func \2 ' else '\1function \2 ' end, 'g') else text end, '') as body from documents),
f as (select bank_id, path, language, strlen(body) as bytes, case when language <> '' and strlen(body) < 400000 and body <> '' then length(body) - length(replace(body, chr(10), '')) + 1 end as lines,
case when language in ('javascript', 'typescript', 'go') and strlen(body) < 400000 then len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^(func|function) [A-Za-z]+ '))) else 0 end as n_symbols, regexp_matches(path, '/(main.py|index.js)$') as entry_point from src)"""


@query("s16_file_map", f"with {_MAP} select path, language, bytes, lines, n_symbols, least(n_symbols, 40) as shown, language in ('javascript', 'typescript', 'go') and lines is not null as by_pattern, entry_point from f")
def s16_files(spark, d):
    f = N.file_map(_mapped(spark, d))
    return f.select("path", "language", "bytes", "lines", "n_symbols", F.coalesce(F.size("symbols"), F.lit(0)).cast("long").alias("shown"), (F.col("caveat") == N.BY_PATTERN).alias("by_pattern"), "entry_point")


@query("s16_map_totals", f"with {_MAP} select grouping_id(bank_id, language)::int as level, bank_id, language, count(*) as files, sum(bytes)::bigint as bytes, coalesce(sum(lines), 0)::bigint as lines, sum(n_symbols)::bigint as symbols, count(*) filter (entry_point) as entry_points from f where language <> '' group by rollup (bank_id, language)")
def s16_totals(spark, d):
    return N.map_totals(N.file_map(_mapped(spark, d)))


@query("s16_compact_map", f"with {_MAP}, p as (select bank_id, case when n_symbols > 0 then 'files' else 'other' end as part, path, case when n_symbols > 0 then -lines else 0 end as o from f union all select bank_id, 'entry', path, 0 from f where entry_point), r as (select bank_id, part, path, row_number() over (partition by bank_id, part order by o, path) as rank from p) select bank_id, part, rank::int as rank, path from r where rank <= case part when 'entry' then 12 else 120 end")
def s16_compact(spark, d):
    return N.compact_map(N.file_map(_mapped(spark, d)))


def _files(spark, d):
    i = F.col("doc_id")
    return A.table(spark, d, "documents").select((i % A.banks(spark, d, "documents")).alias("bank_id"), F.concat_ws("/", F.when(i % 9 == 0, "output").when(i % 10 == 0, "archive").otherwise("src"), F.concat(i.cast("string"), F.when(i % 5 == 0, ".bin").when(i % 2 == 0, ".py").otherwise(".md"))).alias("path"), i.alias("modified"), F.length("text").cast("long").alias("bytes"))


_FILES = f"files as (select doc_id % {S.banks('documents')} as bank_id, case when doc_id % 9 = 0 then 'output' when doc_id % 10 = 0 then 'archive' else 'src' end || '/' || doc_id || case when doc_id % 5 = 0 then '.bin' when doc_id % 2 = 0 then '.py' else '.md' end as path, doc_id as modified, length(text) as bytes from documents)"


@query("s11_ingest_reasons", f"""with {_FILES}, t as (select *, case when path like 'output/%' or path like '%.bin' or (path like 'archive/%' and path not like '%.md') or bytes > 500000 then 0 else bytes end as n from files),
s as (select *, coalesce(sum(n) over (partition by bank_id order by modified desc, path rows between unbounded preceding and 1 preceding), 0) as spent from t)
select path, case when path like 'output/%' then 'run output' when path like '%.bin' then 'no recognised language' when spent >= 200000 then 'index budget spent' when path like 'archive/%' and path not like '%.md' then 'recorded run' when bytes > 500000 then 'data, not source' end as why from s""")
def s11(spark, d):
    return N.skip_reasons(_files(spark, d), budget=200_000).select("path", "why")


def _relisted(spark, d):
    """A listing of the documents as sources, and a later one: some rewritten, some longer, some gone, some new."""
    i = F.col("doc_id")
    src = A.chunk_sources(spark, d).withColumn("bytes", F.octet_length("body").cast("long"))
    later = src.where(i % 7 != 0).withColumns({"body": F.when(i % 10 == 0, F.concat(F.lit("# Anew\n\n"), "body")).otherwise(F.col("body")), "modified": F.when(i % 10 == 0, i + 1).otherwise(i)})
    later = later.withColumn("bytes", F.octet_length("body").cast("long"))
    return src.where(i % 9 != 1), later


_LIST = f"""{_BODY}, o as (select path, doc_id as modified, strlen(body) as bytes from src where doc_id % 9 <> 1),
n as (select path, doc_id + (doc_id % 10 = 0)::int as modified, strlen(body) + 8 * (doc_id % 10 = 0)::int as bytes from src where doc_id % 7 <> 0)"""


@query("s12_listing_difference", f"with {_LIST} select path, case when o.path is null then 'new' when n.path is null then 'vanished' when o.bytes = n.bytes and o.modified = n.modified then 'same' else 'changed' end as change from o full join n using (path)")
def s12_difference(spark, d):
    return N.listing_difference(*_relisted(spark, d)).select("path", "change")


@query("s12_reindex_changed")
def s12(spark, d):
    old, now = _relisted(spark, d)
    return N.reindex(N.chunk(old), N.listing_difference(old, now), now).select("path", "ordinal", "chunk_key", "title", "chars")


@query("o16_bounded_sample")
def o16(spark, d):
    return N.sample_within(_files(spark, d), "bank_id", 100_000, 60, 20_000)


def _index(spark, d):
    i = F.col("doc_id")
    return A.table(spark, d, "documents").select(
        i, (i % A.banks(spark, d, "documents")).alias("bank_id"), F.concat_ws("/", "source", i.cast("string")).alias("path"), F.lit(0).alias("ordinal"),
        F.concat(F.lit("c"), i.cast("string")).alias("chunk_key"), T.first_sentence("text", N.GIST).alias("gist"), F.col("lang").alias("title"), F.length("text").cast("long").alias("chars"),
    )


def _sql_tokens(t):
    """The tokens of `identifier_tokens` without the stop words, each once."""
    cut = "regexp_replace(x, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')"
    names = f"regexp_extract_all({t}, '[A-Za-z_][A-Za-z0-9_]{{2,}}')"
    parts = f"list_filter(flatten(list_transform({names}, lambda x: string_split_regex({cut}, '_+'))), lambda x: length(x) > 2)"
    return f"list_filter(list_distinct(list_transform({names} || {parts}, lambda x: lower(x))), lambda x: not list_contains({S.words(N.STOP)}, x))"


def _sql_index(of="documents"):
    """Chunks, queries and their matches; `m` has all pairs of a bank with relevance."""
    gist = f"string_split(regexp_replace({S.squeeze('text')}, '([.!?]) +', '\\1' || chr(1)), chr(1))[1]"
    return f"""raw as (select doc_id % {S.banks('documents')} as bank_id, source || '/' || doc_id as path, 'c' || doc_id as id, {gist} as s, lang as title, length(text) as chars from {of}),
 ch as (select *, case when length(s) > {N.GIST} then rtrim(substr(s, 1, {N.GIST - 1})) || '…' else s end as gist from raw),
 tk as (select *, {_sql_tokens("concat_ws(' ', gist, title)")} as own, {_sql_tokens("replace(path, '/', ' ')")} as wh from ch),
 qs as (select item_id as query_id, item_id % {S.banks('documents')} as bank_id, {_sql_tokens("text")} as terms from benchmark),
 m as (select query_id, bank_id, path, id, gist, title, chars, (len(list_intersect(terms, own)) + 2 * len(list_intersect(terms, wh))) / (len(terms) + 2.0) as rel from qs join tk using (bank_id)),
 e as (select *, length(to_json({{'id': id, 'source': path, 'gist': coalesce(nullif(gist, ''), title), 'chars': chars}})::varchar) + 7 as cost from m),
 w as (select *, row_number() over o as rank, sum(cost) over (o rows unbounded preceding) as spent from e window o as (partition by query_id order by round(rel, 9) desc, path))"""


@query("r11_chunk_relevance", f"with {_sql_index()} select query_id, path, round(rel, 6) as relevance from m where rel > 0")
def r11(spark, d):
    return N.matches(A.recall_queries(spark, d), _index(spark, d)).select("query_id", "path", F.round("relevance", 6).alias("relevance"))


@query("r12_digest", f"with {_sql_index()} select query_id, rank, round(rel, 6) as relevance, spent::bigint as spent, id, path as source, coalesce(nullif(gist, ''), title) as gist, chars from w where spent <= 9000")
def r12(spark, d):
    return N.digest(A.recall_queries(spark, d), _index(spark, d)).withColumn("relevance", F.round("relevance", 6))


#: Labelled documents are the indexed ones here, the rest is listed only.
_MISSED = f"""mi as (select doc_id % {S.banks('documents')} as bank_id, source || '/' || doc_id as path from documents where doc_id not in (select doc_id from labels)),
 mw as (select *, row_number() over o as r, sum(length(path) + 32) over (o rows unbounded preceding) as spent from mi window o as (partition by bank_id order by path)),
 mb as (select bank_id, count(*) as n_not_indexed, string_agg(path, ' ' order by path) filter (r = 1 or spent <= 1125) as not_indexed from mw group by 1),
 tb as (select bank_id, count(*) as total, count(distinct path) as n_sources from ch group by 1),
 qb as (select query_id, count(*) filter (rel > 0) as n_matched, count(*) filter (spent <= 9000) as showing from w group by 1)"""


@query("r12_digest_totals", f"with {_sql_index('documents semi join labels using (doc_id)')}, {_MISSED} select query_id, coalesce(n_matched, 0) as n_matched, coalesce(showing, 0) as showing, coalesce(total, 0) as total, coalesce(n_sources, 0) as n_sources, coalesce(n_not_indexed, 0) as n_not_indexed, not_indexed from qs left join qb using (query_id) left join tb using (bank_id) left join mb using (bank_id)")
def r12_totals(spark, d):
    rows = _index(spark, d)
    known = rows.join(A.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    listing = rows.select("bank_id", "path", F.lit("no labels").alias("why"))
    return N.digest_totals(A.recall_queries(spark, d), known, listing).withColumn("not_indexed", F.array_join("not_indexed.path", " "))


@query("j19_expand", "with a as (select doc_id as answer_id, unnest([doc_id + 1, doc_id, 10000000 + doc_id]) as k, unnest([0, 1, 2]) as pos from labels) select answer_id, pos, k::varchar as chunk_key, source as path, source is not null as known from a left join documents on doc_id = k")
def j19(spark, d):
    i = F.col("doc_id")
    asked = A.table(spark, d, "labels").select(i.alias("answer_id"), F.transform(F.array(i + 1, i, i + 10000000), lambda x: x.cast("string")).alias("keys"))
    ch = A.table(spark, d, "documents").select(i.cast("string").alias("chunk_key"), F.col("source").alias("path"), F.lit("").alias("body"))
    return N.expand(asked, ch).select("answer_id", "pos", "chunk_key", "path", "known")


@query("j20_suffix_paths", f"with {_BODY}, a as (select distinct regexp_extract(path, '[^/]+$') as asked from src where doc_id % 3 = 0) select asked, path, count(*) over (partition by asked) as n_found, count(*) over (partition by asked) > 1 as ambiguous from a join src on path = asked or path.ends_with('/' || asked)")
def j20(spark, d):
    src = A.chunk_sources(spark, d)
    asked = src.where("doc_id % 3 = 0").select(F.element_at(F.split("path", "/"), -1).alias("asked")).distinct()
    return N.find_paths(asked, src.select("path"))


@query("s10_corpus_listing")
def s10(spark, d):
    return N.listing(spark, d, "*.parquet").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "bytes", "archived")


def _code(spark, d):
    name = F.concat_ws("_", "event_type", F.col("user_id").cast("string"))
    doc = F.concat(F.lit('    """Handles '), "event_type", F.lit('. More text."""'))
    # a few narrow files hold many sources: each core gets its share before they are parsed
    rows = A.table(spark, d, "events").select("event_id", "event_type", "user_id").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
    return rows.select("event_id", F.concat(F.lit("gen/"), F.col("event_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def "), name, F.lit("(value):\n"), doc, F.lit("\n    return value * 2\n\n\nclass Second:\n    size = 1\n    colour = 'a longer line of code'\n")).alias("body"))


@query("c03_code_pieces")
def c03(spark, d):
    return N.chunk(_code(spark, d)).select("path", "ordinal", "title", "start_line", "end_line")


@query("t46_code_gist", "select event_id, 'def ' || event_type || '_' || user_id || '(value): — Handles ' || event_type || '.' as gist from events")
def t46(spark, d):
    return _code(spark, d).select("event_id", N.code_gist(F.col("body")).alias("gist"))


@query("c04_bounded_pieces")
def c04(spark, d):
    src = A.table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.repeat("text", F.lit(4)).alias("body"))
    return N.chunk(src).select("path", "ordinal", "title", "chars")


@query("c05_symbols", "select event_id, 'function' as kind, event_type || '_' || user_id as name, 1 as line from events union all select event_id, 'class', 'Second', 6 from events")
def c05(spark, d):
    return N.symbol_index(_code(spark, d)).select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("event_id"), "kind", "name", "line")


@query("s13_embedding_producer")
def s13(spark, d):
    from quillgrain.operators import vectors as X

    return X.embed(A.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))).select("id", "embedding_model", "embedding_dim", F.size("embedding").alias("n"))


QUERIES, ORACLES = C.queries, C.oracles
