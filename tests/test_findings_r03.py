"""What the third round's findings found, and that statistics stay those of all banks."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgrain.functions import belief as B
from quillgrain.functions import text as T
from quillgrain.llm import line_dedup
from quillgrain.operators import beliefs as H
from quillgrain.operators import chunks as N
from quillgrain.operators import evidence as E
from quillgrain.operators import lifecycle as L
from quillgrain.operators import retrieval as R
from quillgrain.plans import basics
from quillgrain.streaming import stateful


def test_files_too_deep_for_the_parser_are_listed(spark):
    deep = ["-" * 100_000 + "1", "x" + ".a" * 100_000, "{" * 5_000, "not " * 20_000 + "x"]
    src = spark.createDataFrame([(1, f"src/{i}/main.py", body) for i, body in enumerate(deep)], "bank_id long, path string, body string")
    rows = N.file_map(src).collect()
    assert len(rows) == len(deep) and all(r.n_symbols == 0 and r.lines == 1 for r in rows)
    assert {r.caveat for r in rows} == {N.UNPARSEABLE}


def test_clauses_keep_the_digits_at_their_ends(spark):
    text = "1 was 10. 2 is 101. 0 stays 490. Next 3. Ends in 44"
    df = spark.createDataFrame([(text,)], "t string").select(T.clauses("t"))
    assert df.first()[0] == ["1 was 10. 2 is 101. 0 stays 490.", "Next 3.", "Ends in 44"]
    first = spark.createDataFrame([("Call 4072374829490",)], "t string").select(T.clauses("t"))
    assert first.first()[0] == ["Call 4072374829490"]


def test_leading_claims_round_halves_of_the_stored_value_up(spark):
    # the first one is 0.0485 but for the last bits
    rows = [(1, "user-1", "goal", "b", 0.048499999999999995, 100), (1, "user-1", "goal", "a", 0.0485, 100), (1, "user-1", "goal", "a", 0.0485, 101)]
    store = spark.createDataFrame(rows, "bank_id long, about string, kind string, claim string, confidence double, last_updated_turn long")
    got = [(r["rank"], r["claim"], r["confidence"]) for r in H.leading(store, F.lit(100)).orderBy("rank").collect()]
    assert got == [(1, "a", 0.049), (2, "a", 0.049), (3, "b", 0.049)]


def test_support_counts_the_digits_of_a_clause(spark):
    sm = spark.createDataFrame([(1, "a", "Ontion reing 12300")], "summary_id long, scope string, summary string")
    rows = spark.createDataFrame([("a", "doc:1", "ontion 12300 reing"), ("a", "doc:2", "ontion reing 123")], "scope string, ref string, content string")
    assert [r.support_refs for r in E.support_sets(sm, rows).collect()] == [["doc:1"]]


def test_statistics_are_of_all_banks(spark):
    q = spark.createDataFrame([(1, 1, "silver lantern")], "query_id long, bank_id long, query_text string")
    rows = spark.createDataFrame([(1, 1, "a silver coin"), (1, 2, "the lantern"), (2, 3, "silver silver"), (2, 4, None), (3, 5, "words")], "bank_id long, id long, content string")
    once, stored = ({r.id: round(r.score, 9) for r in f.collect()} for f in (R.lexical_scores(q, rows), R.lexical_lookup(q, R.lexicon(rows))))
    assert once == stored and set(once) == {1, 2} and once[1] < once[2]


def grouped(n, links):
    """The least member of each group of 0 to n-1."""
    low = list(range(n))
    for _ in range(n):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


@pytest.mark.parametrize(("reps", "rest"), [(1, 512), (0, 10)])
def test_no_link_of_a_bucket_is_lost_behind_nearer_lines(spark, monkeypatch, reps, rest):
    monkeypatch.setattr(line_dedup, "REPS", reps)
    monkeypatch.setattr(line_dedup, "REST", rest, raising=False)
    monkeypatch.setattr(line_dedup.offers, "__defaults__", (reps, *line_dedup.offers.__defaults__[1:]))  # however few are offered first
    r = random.Random(3)
    sign = lambda: r.choice("abcdefghijklmnopqrstuvwxyz")
    lines = []
    for _ in range(8):
        base = [sign() for _ in range(400)]
        for _ in range(20):  # nearer to the first in bits: a run of signs is their own, and they fail the edit test
            at = r.randrange(290)
            lines.append("".join(base[:at] + [sign() for _ in range(110)] + base[at + 110 :]))
        lines.append("".join(base))
        at = r.randrange(240)
        base[at : at + 160 : 2] = [sign() for _ in range(80)]  # farther, as every other sign of a longer run is another one, and it passes
        lines.append("".join(base))
    bands = [{(k, x) for k, x in enumerate(y) if x is not None} for y in line_dedup.bands_of([x.encode() for x in lines]).to_pylist()]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if bands[a] & bands[b] and line_dedup.similar([(lines[a], lines[b])])[0]]
    low = grouped(len(lines), links)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {x.doc_id for x in line_dedup.drop_lines(df).where("n_lines_removed > 0").collect()}
    assert gone == {i for i in range(len(lines)) if low[i] != i} and len(gone) > 2


def test_phrases_are_weighed_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "Red fox red fox about blue"), (2, None), (3, "about")], "id long, content string")
    out = basics.phrase_weights(rows, 4)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x) for x in out.collect()] == [(1, 1, "red fox", 3.0), (1, 2, "fox", 2.0), (1, 3, "red", 2.0), (1, 4, "fox red", 1.5)]


def test_runs_are_the_same_in_small_slices(spark, monkeypatch):
    rows = spark.range(300).select("id", F.concat_ws(" ", "id", F.lit("a text of some words")).alias("text")).coalesce(1)
    asked = np.full(1 << (L.BITS - 6), -1, np.int64).view(np.uint64)
    got = []
    for n in (7, 1000):
        monkeypatch.setattr(L, "SLICE", n)
        got.append({tuple(r) for r in L._with_grams(rows, "text", [4, 8], asked).collect()})
    assert got[0] == got[1] and {r[0] for r in got[0]} == set(range(300))


def test_claims_are_folded_as_they_stream_in(spark):
    kinds = ["observation", "stated_fact", "goal"]
    rows = [(i % 2, f"user-{i % 3}", kinds[i % 5 % 3], f"{'not ' * (i % 4 == 1)}red door {i % 7}" if i % 11 else "didn't say", i % 10 / 10, i // 6 // 2, i) for i in range(300)]
    df = spark.createDataFrame(rows, "bank_id long, about string, kind string, claim string, confidence double, turn long, seq long")
    out = H.merge(df)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # no subject is collected
    read = sorted(H.read_claims(df).collect(), key=lambda u: (u.turn, u.seq))
    want = set()
    for key in {(u.bank_id, u.about) for u in read}:
        s = H.Subject([])
        s.run([u.asDict() | {"words": set(u.words)} for u in read if (u.bank_id, u.about) == key])
        want |= {key + tuple(h[c] for c in H.COLUMNS[2:]) for h in s.held}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert {tuple(r) for r in H.merge(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cues_are_found_wherever_a_claim_has_them(spark):
    claims = ["not", "Nothing", "he can't", "he cant", "won’t", "doesnt", "isn't, wasn't", "no longer not", "unlike him", "un-like", "knot", "É not", "énot", "rather than", "n't", "", None]
    low = F.lower(F.coalesce("c", F.lit("")))
    hits = sum((low.rlike(f"(?U){c}").cast("int") for c in B.NEGATIONS), F.lit(0))
    df = spark.createDataFrame([(c,) for c in claims], "c string").select(B.polarity(F.col("c")).alias("got"), F.when(hits % 2 == 1, -1).otherwise(1).alias("want"))
    assert all(r.got == r.want for r in df.collect())
    kinds = spark.createDataFrame([("he said so",), ("by nature kind",), ("wants it so",), ("aims to go",), ("a door",), ("unsaid",), ("is really it",), (None,)], "c string")
    assert [r[0] for r in kinds.select(B.inferred_kind(F.col("c"))).collect()] == ["stated_fact", "trait", "preference", "goal", None, None, "identity", None]


def test_first_sentences_and_ends_are_those_of_the_whole_text(spark):
    r = random.Random(5)
    texts = ["", None, " ", "a", " A b.  C", "x" * 300 + ". y", "one. two", ". . .", " \n" * 200 + "Late. More", "no end " * 100, "a b! " * 90, "w. " + "z" * 500, "end. Next", "a ", "\x0bb \t"]
    texts += ["".join(r.choice("ab.! \n\t ") for _ in range(r.randrange(700))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in (3, 60, 240):
        s = F.element_at(F.split(T.squeeze("t"), r"(?<=[.!?])\s+", 2), 1)
        want = F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…"))).otherwise(s)
        assert all(x[0] == x[1] for x in df.select(T.first_sentence("t", limit), want).collect())
    assert all(x[0] == x[1] for x in df.select(T.stripped(F.col("t")), F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).collect())


def test_a_text_without_headings_is_not_cut_into_lines(spark, monkeypatch):
    monkeypatch.setattr(N, "lines_of", lambda text: F.raise_error(F.lit("cut into lines")).cast("array<string>"))
    df = spark.createDataFrame([("First. More\n\n" + "b" * 200,)], "t string")
    assert [p.body for p in df.select(N.markdown_pieces(F.col("t"))).first()[0]] == ["First. More", "b" * 200]


def test_sources_of_one_file_are_parsed_by_all_cores(spark):
    from quillgrain.plans import corpus

    out = corpus.QUERIES["c03_code_pieces"](spark, "/root/testdata/sf0.001")
    parts = {(r.p, r.path) for r in out.select(F.spark_partition_id().alias("p"), "path").collect()}
    assert len({p for p, _ in parts}) >= spark.sparkContext.defaultParallelism


def test_a_subject_state_is_read_and_written_once():
    class Held:  # has no other calls
        rows = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    state = stateful.BeliefState()
    state.held = Held()
    for turn, seen in ((1, 0.5), (2, 0.7)):
        rows = pd.DataFrame([(turn, turn, "goal", "red door", seen, 1, "door red")], columns=stateful._GIVEN)
        out = next(state.handleInputRows((1, "user-1"), iter([rows]), None))
    assert out[["bank_id", "about", "claim", "last_updated_turn"]].values.tolist() == [[1, "user-1", "red door", 2]] and state.held.rows[0][5] == ["door", "red"]


def test_supported_refs_are_their_sql_where_clauses_end_in_digits(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from quillgrain.plans import folds

    texts = ["0reing ontion 4070", "Ontion reing 123000", "ontion reing 123", "One two three. Four five 111", "one two Four five 111", "", "Copies alike here", "Copies alike here", "Copies alike here", "Copies alike here", "two ended. Five four 11"]
    docs = pd.DataFrame({"doc_id": range(7, 7 + len(texts)), "text": texts, "source": "s"})
    spark.createDataFrame(docs).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r for (r,) in con.execute(folds.ORACLES["a14_supported_refs"]).fetchall()}
    got = [r.ref for r in folds.QUERIES["a14_supported_refs"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and "doc:7" in want and "doc:16" not in want


def test_recall_reads_names_and_phrases_of_visible_rows_alone(spark, tmp_path, monkeypatch):
    from quillgrain.plans import recall

    @F.pandas_udf("array<string>")
    def strict(texts: pd.Series, stop: pd.Series) -> pd.Series:
        assert not texts.str.contains("unseen").any()
        return texts.map(lambda t: t.split())

    # 6 banks; the query asks bank 0 at turn 500, and rows without a turn are seen at any
    seen = lambda i: i % 6 == 0 and i % 17 and (i < 500 or i % 11 == 0)
    docs = pd.DataFrame([(i, f"silver lantern {i}" if seen(i) else "an unseen lantern", "s") for i in range(1500)], columns=["doc_id", "text", "source"])
    spark.createDataFrame(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a silver lantern")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(T, "ranked_phrases", strict)
    picked = recall.QUERIES["r07_diverse_choice"](spark, str(tmp_path)).collect()
    assert picked and all(seen(r.id) for r in picked)
    assert {r.id for r in recall.QUERIES["o03_exact_lane"](spark, str(tmp_path)).collect()} == {i for i in range(1500) if seen(i)}
    assert recall.QUERIES["r08_neighbour_padding"](spark, str(tmp_path)).columns == ["query_id", "id"]


def test_postings_do_not_tokenise_rows_that_a_join_drops(spark):
    rows = spark.createDataFrame([(1, 1, "Silver ..."), (1, 2, "..."), (2, 3, None)], "bank_id long, id long, content string")
    asked = spark.createDataFrame([(1,)], "bank_id long")
    out = R.postings(rows.join(asked, "bank_id"))
    below = out._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "regexp_extract_all" not in below and [tuple(r) for r in out.collect()] == [(1, 1, 1, "silver", 1)]
