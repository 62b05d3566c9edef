"""Exact nearest neighbours between blocks of near vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrain.operators import vectors as X


def brute(rows, queries, k):
    out = []
    for qid, qs, qv in queries:
        found = [(-round(float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(qv)))), 9), -i) for i, s, v in rows if s == qs and v is not None and len(v) == len(qv)]
        out += [(qid, -i, r + 1) for r, (s, i) in enumerate(sorted(found)[:k]) if s < 0]
    return sorted(out)


def frames(spark, rows, queries):
    return spark.createDataFrame(rows, "id long, stamp string, vector array<float>"), spark.createDataFrame(queries, "query_id long, stamp string, vector array<float>")


def clustered(n, dim=16, groups=25, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    v = centres[r.integers(0, groups, n)] + 0.05 * r.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).tolist()


@pytest.mark.parametrize(("size", "task_rows"), [(2000, 50_000), (7, 60)])
def test_neighbours_are_those_of_all_pairs(spark, monkeypatch, size, task_rows):
    monkeypatch.setattr(X.blocks_of, "__defaults__", (size, X.PIVOTS, task_rows))
    v = clustered(900)
    rows = [(i, "ab"[i % 2], x) for i, x in enumerate(v)] + [(2000 + i, "a", v[0]) for i in range(60)]
    rows += [(5000, "a", None), (5001, "a", []), (5002, "a", v[3][:5]), (5003, "a", [0.0] * 16)]
    queries = [(i, "ab"[i % 2], v[i]) for i in range(0, 900, 30)] + [(7000, "a", [-x for x in v[0]]), (7001, "c", v[0]), (7002, "a", [3.0] * 5), (7003, "a", None), (7004, "b", [0.0] * 16)]
    got = X.nearest(*frames(spark, rows, queries), 12, size)
    want = brute(rows, [q for q in queries if q[2]], 12)
    assert sorted((r.query_id, r.id, r["rank"]) for r in got.collect()) == want


def test_bounds_save_block_pairs(spark):
    v = clustered(4000)
    rows, queries = frames(spark, [(i, "a", x) for i, x in enumerate(v)], [(i, "a", v[i]) for i in range(0, 4000, 100)])
    blocks = X.blocks_of(rows, 50)
    total, most = blocks.agg(F.sum("n"), F.max("n")).first()
    assert total == 4000 and most <= 50
    asked = queries.select("query_id", "stamp", F.size("vector").alias("dim"), "vector").withColumn("qb", F.lit(0).cast("long"))
    floors = X.nearest(rows, queries, 10, 50).where("rank = 10").select("query_id", F.col("score").alias("floor"))
    early, late = X.block_pairs(blocks, asked, enough=10).count(), X.block_pairs(blocks, asked, floors).count()
    assert early <= 4 * 40 and late < 0.2 * 40 * blocks.count()


def test_empty_sides(spark):
    rows, queries = frames(spark, [(1, "a", [1.0, 0.0])], [(1, "a", [1.0, 0.0])])
    assert X.nearest(rows.limit(0), queries).count() == X.nearest(rows, queries.limit(0)).count() == 0
    assert [tuple(r) for r in X.nearest(rows, queries).collect()] == [(1, 1, 1.0, 1)]


def test_a_migration_goes_on_where_it_stopped(spark):
    from quillgrain.operators.vectors import migrate

    row = "id long, content string, embedding array<float>, embedding_model string, embedding_dim int"
    m = spark.createDataFrame([(i, f"text {i}", [0.5] if i % 3 else None, "new" if i % 5 == 0 else "old", 1) for i in range(40)], row)
    s = spark.createDataFrame([(i, "summary" if i % 4 else " ", [0.5], "old" if i % 2 else None, 1) for i in range(20)], row)
    need = [("memories", i) for i in range(40) if i % 5 or i % 3 == 0] + [("summaries", i) for i in range(20) if i % 4]
    embed = lambda rows: rows.select("id", F.array(F.lit(0.1).cast("float")).alias("embedding"))

    def after(df, tab, rebuilt):
        new = rebuilt.where(F.col("tab") == tab).drop("tab")
        out = df.drop("embedding", "embedding_model", "embedding_dim").join(new, "id").unionByName(df.join(new, "id", "left_anti"))
        return spark.createDataFrame(out.select(df.columns).collect(), row)

    seen = []
    for limit, left in ((25, len(need) - 25), (40, 0), (20, 0)):
        out = migrate(m, s, "new", 1, embed, limit, parts=3)
        done = sorted((r.tab, r.id) for r in out.rebuilt.collect())
        assert done == need[len(seen) : len(seen) + limit]
        assert sum(r.remaining for r in out.remaining.collect()) == left
        seen += done
        m, s = after(m, "memories", out.rebuilt), after(s, "summaries", out.rebuilt)
    assert seen == need
    with pytest.raises(ValueError):
        migrate(m, s, "cheap:x", 1, embed)
