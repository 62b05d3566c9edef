"""Registered queries against their SQL on the smallest tables, and the rest against properties."""

import math

import pytest
from pyspark.sql import functions as F

from quillgrain.functions import web
from quillgrain.operators import evidence as E
from quillgrain.operators import retrieval as R
from quillgrain.operators import telemetry as M
from quillgrain.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if math.isfinite(v) else str(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


#: A query of each kind; the driver compares them all.
SOME = [
    "s02_keyed_upsert", "s04_prepare_rows", "p01_read_seam", "t02_gist", "t03_entities", "t04_key_phrases", "t31_claim_similarity", "j06_per_turn_counts", "w01_ranked_importance",
    "w07_first_fit_budget", "w09_stalls", "r01_lexical_ranking", "r02_rank_fusion", "f01_evidence_confidence", "l05_consolidation", "j17_support_sets", "t42_grading", "t40_redaction",
    "s16_file_map", "s16_map_totals", "s16_compact_map",
    "r11_chunk_relevance", "r12_digest", "r12_digest_totals",
]


@pytest.mark.parametrize("name", SOME)
def test_query_is_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_every_query_has_columns(spark):
    for name, q in registry.QUERIES.items():
        if name not in SOME and name in registry.ORACLES:
            assert q(spark, SF).columns, name


def observe(spark, rows):
    df = spark.createDataFrame([(1, i, u, s) for i, (u, s) in enumerate(rows)], "hypothesis_id long, seq long, url string, stance string")
    return E.confidence(df).first()


def test_confidence_moves_by_bounded_steps(spark):
    assert observe(spark, [("a", "supports")]).confidence == 0.545
    assert observe(spark, [("a", "supports"), ("b", "supports")]).confidence == 0.7043
    assert observe(spark, [("a", "supports"), ("a", "supports")]).confidence == 0.545
    both = observe(spark, [("a", "supports"), ("b", "supports"), ("c", "contradicts")])
    assert both.status == "disputed" and 0.35 <= both.confidence <= 0.65
    assert observe(spark, [("a", "supports"), ("a", "contradicts")]).n_flips == 1


ADDRESSES = [
    ("HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"), ("example.com./%7euser", "https://example.com/~user"),
    ("http://bücher.example/x%2fy", "https://xn--bcher-kva.example/x%2Fy"), ("experiment:abc", "experiment:abc"), ("", ""), (None, ""), ("https://e.com:8443", "https://e.com:8443/"),
    ("https://me:pw@e.com/a//", "https://e.com/a"), ("http://e.com:x/a", "http://e.com:x/a"), ("http://e.com:70000/", "http://e.com:70000/"), ("https://e.com?q=a+b%20c&q=*~&flag", "https://e.com/?flag=&q=%2A~&q=a+b+c"),
    ("https://e.com/a%zz?x=100%", "https://e.com/a%zz?x=100%25"), ("https://e.com/?b=%C3%BC&Ref=1", "https://e.com/?b=%C3%BC"), ("  https://e.com/\n", "https://e.com/"),
]


def test_canonical_url(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(ADDRESSES)], "i int, u string").withColumn("c", web.canonical_url("u"))
    rows = df.withColumn("again", web.canonical_url("c")).orderBy("i").collect()
    assert [r.c for r in rows] == [want for _, want in ADDRESSES] == [r.again for r in rows]


def test_html_text(spark):
    page = "<!-- a > b --><p title='x > y'>One&amp;two</p><script>no</script><div>three</div>"
    got = spark.createDataFrame([(page,)], "h string").select(web.html_text(F.col("h"))).first()[0]
    assert got == "One&two\n three"


def test_search_respects_the_cutoff(spark):
    from quillgrain.plans import recall

    rows = recall.rows(spark, SF)
    q = recall.queries(spark, SF).withColumn("cutoff_turn", F.lit(100).cast("long"))
    got = R.hybrid_search(q, rows, 8).join(rows.select("id", "turn_idx"), "id")
    assert got.count() and got.where("turn_idx >= 100").count() == 0
    per = got.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert per <= 10


def test_stale_anchor_is_inconclusive(spark):
    df = spark.createDataFrame([("PRECONDITION a.py abcdef12", {"a.py": "abcd"}), ("PRECONDITION a.py ffff", {"a.py": "abcd"}), ("", {"a.py": "abcd"}), ("", None)], "out string, pre map<string,string>")
    assert [r[0] for r in df.select(M.stale_anchor(F.col("out"), F.col("pre"))).collect()] == [False, True, True, False]
