"""Operators on small literal rows: what must hold whatever the data."""

import itertools
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrain.functions import belief as B
from quillgrain.functions import redact
from quillgrain.functions import text as T
from quillgrain.operators import vectors as X
from quillgrain.operators import bank as K
from quillgrain.operators import beliefs as H
from quillgrain.operators import chunks as N
from quillgrain.operators import investigate as V
from quillgrain.operators import lifecycle as L
from quillgrain.operators import pages as P


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_gist_takes_whole_sentences(spark):
    text = "First one. " + "word " * 60
    assert one(spark, T.gist("t"), t=text) == "First one."
    assert one(spark, T.gist("t"), t="word " * 100).endswith("word") and len(one(spark, T.gist("t"), t="word " * 100)) <= 240
    assert one(spark, T.gist("t"), t=" a   b ") == "a b"


def test_cuts_tell_the_true_length(spark):
    assert one(spark, T.excerpt("t"), t="x" * 900).endswith("…[cut: 900 chars total]") and len(one(spark, T.excerpt("t"), t="x" * 900)) == 600
    fitted = one(spark, T.fit_both_ends("t"), t="a" * 3000 + "z" * 3000)
    assert len(fitted) == 4000 and fitted.startswith("a") and fitted.endswith("z") and "2,000 chars elided" in fitted


def test_identifiers_split(spark):
    assert set(one(spark, T.identifier_tokens("t"), t="rebuild_embeddings myName")) == {"rebuild_embeddings", "rebuild", "embeddings", "myname", "name"}


@pytest.mark.parametrize(("claim", "want"), [("likes tea", 1), ("does not like tea", -1), ("never not late", 1), ("stopped", -1), ("dislikes tea", -1)])
def test_polarity(spark, claim, want):
    assert one(spark, B.polarity(F.col("c")), c=claim) == want


def test_opposite_claims_are_not_alike(spark):
    sim = lambda a, b: one(spark, B.claim_similarity(F.col("a"), F.col("b"), F.lit("ann")), a=a, b=b)
    assert sim("ann prefers short answers", "ann does not prefer short answers") == 0 and sim("prefers tea", "ann prefers tea in the evening") == 1


def test_the_stricter_kind_counts(spark):
    assert one(spark, B.effective_kind(F.lit("observation"), F.col("c")), c="always late") == "trait"
    assert one(spark, B.effective_kind(F.lit("identity"), F.col("c")), c="said so") == "identity"


def updates(spark, rows):
    return spark.createDataFrame([(0, "ann", k, c, p, t, i) for i, (k, c, p, t) in enumerate(rows)], "bank_id long, about string, kind string, claim string, confidence double, turn long, seq long")


def test_beliefs_blend_and_compete(spark):
    got = H.merge(updates(spark, [("goal", "finish the report", 0.5, 1), ("goal", "finish the report soon", 0.9, 1)])).collect()
    assert len(got) == 1 and got[0].confidence == pytest.approx(0.65)  # capped
    got = {r.claim: r.confidence for r in H.merge(updates(spark, [("goal", "finish report", 0.6, 1), ("goal", "learn piano", 0.6, 1)])).collect()}
    assert got["finish report"] == pytest.approx(0.6 * 0.7) and got["learn piano"] == pytest.approx(0.6)
    assert H.merge(updates(spark, [("observation", "door open", 0.3, 1), ("goal", "eat", 0.5, 61)])).count() == 1


def test_read_seam_is_strict_and_keeps_rows_without_turn(spark):
    rows = spark.createDataFrame([(1, 5, False, None), (2, 6, False, None), (3, None, False, None), (4, 1, True, None), (5, 1, False, "b0")], "id long, turn_idx long, archived boolean, retired_batch string")
    ids = lambda **o: {r.id for r in K.visible(rows, **o).collect()}
    assert ids(before=F.lit(6), include_archived=True) == {1, 3, 4} and ids(before=F.lit(6), include_archived=False) == {1, 3}
    assert ids(before=None, include_archived=True, include_retired=True) == {1, 2, 3, 4, 5}


def test_upsert_keeps_keyless_rows(spark):
    old = spark.createDataFrame([(0, "k", 1), (0, "", 2)], "bank_id long, event_key string, id long")
    new = spark.createDataFrame([(0, "k", 3), (0, "", 4)], "bank_id long, event_key string, id long")
    assert {r.id for r in K.upsert(old, new, ["bank_id", "event_key"], "id").collect()} == {2, 3, 4}


def test_first_fit_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 30), (2, 1, 500)], "q long, rank int, n long")
    assert {(r.q, r["rank"]) for r in V.first_fit_budget(rows, "q", "rank", "n", 100).collect()} == {(1, 1), (1, 3), (2, 1)}


def test_streaks_break_at_blanks(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", "", "a", "a", "a", "b"])], "run long, i long, v string")
    assert [r.held_for for r in V.streaks(rows, "run", ["i"], "v").orderBy("i").collect()] == [1, 2, 0, 1, 2, 3, 1]


def test_importance_is_asymptotic_and_lifted_once(spark):
    rows = spark.createDataFrame([("a", 0.5, None), ("b", 0.5, 0.96), ("c", 0.5, None)], "event_key string, salience double, importance double")
    hits = spark.createDataFrame([("a",), ("a",), ("b",)], "event_key string")
    got = {r.event_key: r.importance for r in L.raise_importance(rows, hits).collect()}
    assert got["a"] == pytest.approx(1 - 0.5 * 0.88**2) and got["b"] == pytest.approx(0.9648) and got["c"] is None
    assert {r.event_key: r.importance for r in L.raise_importance(rows, hits, only_unrevised=True).collect()}["b"] == 0.96


def test_redaction_names_what_it_ate(spark):
    df = spark.createDataFrame([("task", "do it", "x"), ("api_key", "abc", ""), ("note", "sk-12345678901", "y"), ("text", "uses sk- on its own", "z")], "key string, value string, password string")
    got = {r.key: (r.value, r.password, r.redacted) for r in redact.redact(df).collect()}
    assert got["task"] == ("do it", "<redacted: password, 1 chars>", ["password"]) and got["api_key"][0] == "<redacted: api_key, 3 chars>" and got["api_key"][1] == ""
    assert got["note"][0].startswith("<redacted: credential-shaped") and got["text"][0] == "uses sk- on its own"


def pieces(spark, path, body):
    rows = N.chunk(spark.createDataFrame([(path, body)], "path string, body string")).orderBy("ordinal").collect()
    return [(r.title, r.start_line, r.end_line, r.body) for r in rows]


LONG = "a block of prose that is long enough to stand on its own, as it has more than one hundred and sixty characters, which is the least that a block needs to stay where it was found in its text"


def test_markdown_is_cut_at_headings(spark):
    md = pieces(spark, "a.md", "intro text that is long enough to stay alone here\n\n# One\n" + "body " * 20 + "\n## Two\n" + "more " * 20 + "\n### Tiny\n\n#### no heading\n")
    assert [p[:3] for p in md[:2]] == [("(preamble)", 1, 2), ("One", 3, 4)]
    assert md[2] == ("Two", 5, 6, "## Two\n" + ("more " * 20).strip() + "\n\n### Tiny\n\n#### no heading")
    assert pieces(spark, "a.md", "# x\n" + LONG)[0][:3] == ("x", 1, 2)
    assert [p[0] for p in pieces(spark, "a.md", "# Big one\n\n" + "\n\n".join([LONG] * 130))][:2] == ["Big one (1)", "Big one (2)"]


def test_prose_is_cut_at_blank_lines(spark):
    got = pieces(spark, "notes", f"{LONG}\n \nshort\n\n\n{LONG}\n")
    assert [p[3] for p in got] == [LONG + "\n\nshort", LONG] and got[0][1] is None
    assert pieces(spark, "notes", "") == pieces(spark, "notes", None) == [] and [p[3] for p in pieces(spark, "n.md", "tiny")] == ["tiny"]


def test_code_is_cut_at_symbols(spark):
    head = "import os\nimport sys\n# a preamble that is long enough to be kept"
    f, c = "def f(a):\n    return a + 1 + 2 + 3 + 4 + 5 + 6 + 7", "class C:\n    size = 'a long enough body of a class'"
    got = pieces(spark, "m.py", f"{head}\n{f}\nX = 1\n{c}\n")
    assert got == [("(module preamble)", 1, 3, head), ("function f", 4, 6, f + "\nX = 1"), ("class C", 7, 8, c)]
    assert pieces(spark, "m.py", "x = (")[0][:3] == ("(whole file)", 1, 1)
    assert [p[0] for p in pieces(spark, "m.go", "package a\n\nfunc Run(x int) int {\n\treturn x * 2 + 1 + 1 + 1 + 1\n}\n")] == ["function Run"]


def test_long_pieces_are_cut_at_lines_or_hard(spark):
    got = pieces(spark, "a.py", "x" * 45_000)
    assert [len(p[3]) for p in got] == [20_000, 20_000, 5_000] and got[0][0] == "(whole file) [part 1/3]"
    lines = "".join(f"{'y' * 8_999}\n" for _ in range(5))
    assert [len(p[3]) for p in pieces(spark, "a.sh", lines)] == [18_000, 18_000, 9_000]
    mixed = "a\n" + "z" * 25_000 + "\nb\n"
    parts = [p[3] for p in pieces(spark, "a.sh", mixed)]
    assert "".join(parts) == mixed and max(map(len, parts)) <= 20_000


def test_key_phrases_are_quotes_names_and_words(spark):
    text = 'Alice Smith said "the  blue door" and “The Blue Door” again; blue door, blue door, river bank. Alice Smith left.'
    got = spark.createDataFrame([(text,), (None,)], "t string").select(T.key_phrases("t", T.entities("t"))).collect()
    assert got[0][0][:5] == ["the blue door", "Alice Smith", "The Blue Door", "blue door", "blue"][:2] + got[0][0][2:5]
    assert got[0][0][2:4] == ["blue door", "blue"] and "alice smith" not in got[0][0] and len(got[0][0]) <= 12 and got[1][0] == []


def plain_embedding(text, dim=256):
    t, v = f" {text.lower()} ", np.zeros(dim)
    for n in (3, 4):
        for i in range(max(0, len(t) - n)):
            h = zlib.crc32(t[i : i + n].encode())
            v[h % dim] += 1 if h >> 16 & 1 else -1
    return v / (np.linalg.norm(v) or 1)


def test_hashed_embeddings_match_plain_ones():
    texts = ["Some words to embed", "", "a", "ab", "ünï ©ødé 你好世界 🙂🙂🙂🙂", "x" * 500]
    assert np.allclose(X.hashed_embeddings(texts), [plain_embedding(t) for t in texts], atol=1e-6)


def test_replies_are_read_with_patience():
    assert P.read_reply('Sure:\n```json\n{"a": [1, 2,],}\n```') == {"a": [1, 2]} and P.read_reply('{"a": "line\nbreak"} tail') == {"a": "line\nbreak"}
    assert P.read_reply("no object") is None and P.read_reply(None) is None and P.read_reply("[1]") is None


def test_page_findings():
    kinds = [f[0] for f in P.findings_of('<div id="a"><p id="a">x</div></section><button>×</button><button aria-label="Close">×</button><div onclick="f()">')]
    assert kinds.count("duplicate-id") == 1 and "stray-close" in kinds and kinds.count("unnamed-control") == 1 and "keyboard-unreachable" in kinds


def test_safe_export_is_cut_and_redacted(spark):
    df = spark.range(500).select(F.col("id"), F.concat(F.lit("ghp_"), F.lpad(F.col("id").cast("string"), 12, "x")).alias("note"))
    got = P.safe_export(df, ["id"], rows=20).collect()
    assert len(got) == 20 and {r.cut_by for r in got} == {"rows"} and all(r.note.startswith("<redacted") for r in got)


def test_page_findings():
    from quillgrain.operators.pages import findings_of

    kinds = lambda m: sorted((k, d) for k, d, _ in findings_of(m))
    assert kinds("<div><p>hi</div><p>open") == [("unclosed", "<p> never closed")]
    assert kinds("<div><span>x</div></b>") == [("stray-close", "</b> with nothing open"), ("unclosed", "<span> never closed")]
    named = "<button>ok</button><button aria-label='Save'>x</button><button>保存</button><button><img alt='Save'></button><button>&times;</button>"
    assert kinds(named) == []
    unnamed = "<button>×</button><button aria-label=' '>1</button><button><img alt=''></button><button></button>"
    assert kinds(unnamed) == [("unnamed-control", "a button without a name")] * 4
    assert kinds("<a id=x></a><b id=x></b><div onclick=f()></div>") == [("duplicate-id", "id 'x' appears 2 times"), ("keyboard-unreachable", "<div> carries onclick")]


def test_symbols_of_python():
    from quillgrain.operators.chunks import symbols

    text = "A = b = 1\nx = 2\nasync def f():\n    def g(): pass\nclass C:\n    D = 1\n    def m(self): pass\n    class E:\n        def n(self): pass\n"
    assert symbols(text, "python") == [("constant", "A", 1), ("function", "f", 3), ("class", "C", 5), ("method", "C.m", 7)]
    assert symbols("def broken(:", "python") == []


def test_digest_is_the_prefix_of_all_pairs(spark):
    words = ["cache", "parser", "write_ahead", "loadConfig", "queue", "the"]
    chunks = [(b, f"c{b}.{i}", f"src/{words[i % 5]}/{i // 2:03d}.py", i % 2, None if i % 7 == 0 else f'"{words[i % 6]}"\n{words[i * i % 5]} ü', f"title {i % 3}", i) for b in (0, 1) for i in range(400)]
    asked = [(1, 0, "parser cache"), (2, 0, "the of"), (3, 1, "config of loadConfig and queue"), (4, 0, "nothing alike"), (5, 2, "cache")]
    index = spark.createDataFrame(chunks, "bank_id int, chunk_key string, path string, ordinal int, gist string, title string, chars int")
    queries = spark.createDataFrame(asked, "query_id int, bank_id int, query_text string")

    def tokens(text):
        names = re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", text)
        parts = [p for n in names for p in re.split(r"_+|(?<=[a-z0-9])(?=[A-Z])", n) if len(p) > 2]
        return {x.lower() for x in names + parts} - set(N.STOP)

    for budget in (0, 5_000, 12_000):
        room, want, totals = max(1000, budget - 3000), [], {}
        for q, bank, text in asked:
            rows, terms = sorted((c for c in chunks if c[0] == bank), key=lambda c: (c[2], c[3])), tokens(text)
            rel = [(len(terms & tokens(f"{c[4] or ''} {c[5]}")) + 2 * len(terms & tokens(c[2].replace("/", " ")))) / (len(terms) + 2) if terms else 0.0 for c in rows]
            spent, shown = 0, 0
            for i in sorted(range(len(rows)), key=lambda i: -rel[i]):
                c = rows[i]
                spent += len(json.dumps({"id": c[1], "source": c[2], "gist": c[4] or c[5], "chars": c[6]}, ensure_ascii=False))
                if spent > room:
                    break
                shown += 1
                want.append((q, shown, round(rel[i], 9), spent, c[1], c[2], c[4] or c[5], c[6]))
            totals[q] = (sum(r > 0 for r in rel), shown, len(rows), len({c[2] for c in rows}))
        got = N.digest(queries, index, budget)
        assert sorted(map(tuple, got.collect())) == want
        listing = spark.createDataFrame([(b, p, "too large") for b in (0, 1, 2) for p in ["src/cache/000.py", *(f"lost/{i:03d}" for i in range(90 * b))]], "bank_id int, path string, why string")
        for r in N.digest_totals(queries, index, listing, budget).collect():
            lost = [p for p in ([] if r.query_id != 5 else ["src/cache/000.py"])] + [f"lost/{i:03d}" for i in range({5: 180, 3: 90}.get(r.query_id, 0))]
            cost = list(itertools.accumulate(len(json.dumps({"path": p, "why": "too large"})) for p in sorted(lost)))
            named = [p for i, (p, n) in enumerate(zip(sorted(lost), cost)) if i == 0 or n <= room // 8]
            assert tuple(r)[1:5] == totals[r.query_id] and r.n_not_indexed == len(lost)
            assert [e.path for e in r.not_indexed or []] == named
