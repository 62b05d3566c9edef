"""Disputes, consolidation, cascades and the experiment log against plain Python."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillgrain.operators import bank as K
from quillgrain.operators import lifecycle as L
from quillgrain.operators import telemetry as M


def test_parts_of_texts_are_found_without_a_nested_loop(spark):
    r = random.Random(3)
    texts = [(i, "".join(r.choice("abé 你") for _ in range(r.choice([0, 3, 40, 400])))) for i in range(120)] + [(500, "abc " * 5000), (501, None)]
    needles = [(i, t[a : a + r.choice([1, 2, 5, 9, 60])]) for i, (_, t) in enumerate(texts) if t for a in [r.randrange(len(t))]] + [(900, "absent part of it"), (901, ""), (902, "zz"), (903, "b")]
    want = sorted((n, i) for n, x in needles for i, t in texts if x and t and x in t)
    out = L.containing(spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(texts, "id long, text string"), ["id"])
    assert sorted(map(tuple, out.collect())) == want and len(want) > 500
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


ROW = "bank_id long, id long, event_key string, gist string, content string, salience double, importance double, disputed struct<turn_idx:long,reading:string,count:long>"


def test_disputes_match_by_tier_and_count(spark):
    rows = spark.createDataFrame([
        (1, 1, "k1", "The Gist", "Long content here", 0.5, None, None), (1, 2, "k2", "the  gist", "more", 0.9, None, (1, "old", 2)),
        (1, 3, "k3", "other", "it says: THE GIST of it", 0.4, 0.2, None), (2, 4, None, None, None, None, None, None),
    ], ROW)
    d = spark.createDataFrame([(1, 10, "read anew", "k3", "the gist"), (2, 11, "again  so", "", "THE gist"), (3, 12, "part", "nobody", "gist of"), (4, 13, " ", "k1", ""), (5, 14, "x", "", ""), (6, 15, "y", "", "absent")], "dispute_id long, turn_idx long, reading string, memory_ref string, gist string")
    assert sorted(map(tuple, L.dispute(rows, d).collect())) == [(1, 1, 3, 1), (2, 1, 1, 2), (2, 1, 2, 2), (3, 1, 3, 3), (4, 1, 1, 1)]
    out = {r.id: (r.disputed and tuple(r.disputed), r.importance and round(r.importance, 6)) for r in L.apply_disputes(rows, d).collect()}
    assert out == {1: ((11, "again so", 1), 0.7), 2: ((11, "again so", 3), 0.97), 3: ((12, "part", 2), 0.6), 4: (None, None)}


def window(spark):
    rows = [(b, 10 * b + t, t, kind, p, f"Text {t} of bank {b} about rivers and bridges.", f"gist {t}", f"k{b}:{t}", 0.5, None, False) for b in (1, 2, 3) for t, kind, p in ((1, "episodic", "witnessed"), (2, "dialogue", "told"), (20, "episodic", "witnessed"), (21, "commitment", "remembered"))]
    rows = [r for r in rows if not (r[0] == 3 and r[4] != "told")] + [(4, 99, 5, "episodic", "witnessed", "   ", "", "k4", 0.5, None, False)]
    df = spark.createDataFrame(rows, "bank_id long, id long, turn_idx long, kind string, provenance string, content string, gist string, event_key string, salience double, importance double, archived boolean")
    return df, spark.createDataFrame([(1, 1), (2, 0)], "bank_id long, cursor long"), df.select("bank_id").distinct().withColumn("now", F.lit(30).cast("long"))


def test_a_refused_bank_keeps_its_cursor(spark):
    rows, cursor, now = window(spark)
    seen = Observation("consolidation")
    lose = lambda w: L.joined_gists(w).withColumn("summary", F.when((F.col("bank_id") != 2) | (F.col("scope") != L.FIRST_HAND), F.col("summary")).otherwise(" "))
    out = L.consolidate(rows, cursor, now, lose, seen)
    assert {tuple(r) for r in out.cursors.collect()} == {(1, 21), (2, 0), (3, 2), (4, 0)}
    assert seen.get == {"windows": 3, "refused": 1}
    assert [tuple(r) for r in out.refused.collect()] == [(2, 1, 21, 3)]
    assert {(r.bank_id, r.scope, r.start_turn, r.summary) for r in out.summaries.collect()} == {(1, "autobiographical", 2, "gist 20 gist 21"), (1, "received", 2, "gist 2"), (3, "autobiographical", 2, ""), (3, "received", 2, "gist 2")}
    assert {r.id for r in out.archived.collect()} == {11, 12}  # what is older than twelve turns, before the cursor, too
    again = L.consolidate(rows.where("bank_id = 1"), out.cursors, now.where("bank_id = 1"))
    assert again.summaries.count() == again.archived.count() == 0 and again.cursors.first().cursor == 21


def test_cascades_reach_their_end(spark):
    r = random.Random(5)
    refs, kids = [], {}
    for depth, (child, parent) in enumerate((("b", "a"), ("c", "b"), ("d", "c"))):
        for i in range(60):
            p = r.randrange(60)
            action = "cascade" if r.random() < 0.7 else "set null"
            refs.append((child, i, "up", parent, p, action))
    start = [("a", i) for i in range(0, 60, 4)] + [("c", 3)]
    gone = set(start)
    while True:
        more = {(t, i) for t, i, _, p, q, act in refs if act == "cascade" and (p, q) in gone} - gone
        if not more:
            break
        gone |= more
    want = {(*g, "deleted", "") for g in gone} | {(t, i, "set null", c) for t, i, c, p, q, act in refs if act == "set null" and (p, q) in gone and (t, i) not in gone}
    out = K.carried(spark.createDataFrame(start, "tab string, id long"), spark.createDataFrame(refs, "tab string, id long, col string, parent string, parent_id long, action string"))
    assert {tuple(x) for x in out.collect()} == want
    rows = spark.createDataFrame([(i, i * 2, "x") for i in range(60)], "id long, up long, note string")
    left = {x.id: x.up for x in K.after_delete(rows, "d", "id", out).collect()}
    assert left == {i: None if ("d", i, "set null", "up") in want else i * 2 for i in range(60) if ("d", i) not in gone}


def test_references_in_a_circle_are_an_error(spark):
    refs = spark.createDataFrame([("a", 1, "up", "a", 2, "cascade"), ("a", 2, "up", "a", 1, "cascade")], "tab string, id long, col string, parent string, parent_id long, action string")
    with pytest.raises(Exception, match="RECURSION"):
        K.carried(spark.createDataFrame([("a", 1)], "tab string, id long"), refs).count()


def test_stale_versions_are_refused_and_the_rest_is_evidence(spark):
    run = "id long, hypothesis_id long, digest string, outcome string, precondition map<string,string>"
    log = spark.createDataFrame([(1, 1, "d1", "confirmed", {"f": "aa"}), (2, 2, "d2", "refuted", None)], run)
    new = spark.createDataFrame([(10, 1, "d1", "refuted", {"f": "aa"}, 4), (11, 1, "d3", "confirmed", {"f": "bb"}, 4), (12, 2, "d2", "confirmed", None, 6), (13, 9, "d2", "confirmed", None, 0), (14, 2, "d4", "odd", None, 7)], run + ", seen_version long")
    hyp = spark.createDataFrame([(1, 4), (2, 7), (3, 0)], "hypothesis_id long, version long")
    old = spark.createDataFrame([(1, 0, "u", "supports")], "hypothesis_id long, seq long, url string, stance string")
    out = M.append_experiments(log, new, hyp, old)
    assert {tuple(r) for r in out.refused.collect()} == {(12, 2, "stale version"), (13, 9, "no such hypothesis")}
    assert {(r.seq, r.stance) for r in out.evidence.collect()} == {(10, "contradicts"), (11, "context"), (14, "context")}
    assert [tuple(r) for r in out.notes.collect()] == [(10, 1, "d1", "confirmed", "refuted")]
    assert {(r.hypothesis_id, r.version, r.status) for r in out.hypotheses.collect()} == {(1, 5, "disputed"), (2, 8, "open"), (3, 0, "open")}
    assert out.log.count() == 5
