"""Fill-in-middle against plain Python on code points."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrain.llm import fim


def plain_fim(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    pre, mid, suf = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return len(t), "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def mixed(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ab é ñ你好🙂\n<>PSḾ") for _ in range(n))


TEXTS = [None, "", "a", "🙂", "é", "<P>", "x<S>y", "<P", "a<", *(mixed(n, n) for n in range(1, 160)), mixed(300_000, 5), "ends with <", "S>M>P>" * 9]


def test_output_matches_plain_python_and_comes_back(spark, docs):
    d = docs([*TEXTS, (None, "no id é"), (7, "one id, two texts"), (7, "one id, two texts")])
    got = fim.fill_in_middle(d).withColumn("back", fim.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        assert tuple(r.fim) == plain_fim(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.fim.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("most", [1, 100, 4 << 20])
def test_cuts_at_any_part_size(monkeypatch, most):
    texts = [t or "" for t in TEXTS]
    r = np.random.default_rng(1)
    h1, h2 = r.integers(0, 2**32, (2, len(texts)))
    monkeypatch.setattr(fim, "parts", lambda b, f=fim.parts: f(b, most))
    sliced = pa.array(["skipped", *(t.encode() for t in texts)], pa.binary())[1:]
    out = fim.reorder(sliced, h1, h2, ["psm"] * len(texts)).to_pylist()
    for t, a, b, x in zip(texts, h1, h2, out, strict=True):
        one, two = sorted((int(a) % (len(t) + 1), int(b) % (len(t) + 1)))
        assert (x["n"], x["prefix_chars"], x["middle_chars"]) == (len(t), one, two - one)
        assert x["output"].decode() == f"<P>{t[:one]}<S>{t[two:]}<M>{t[one:two]}"


def test_rank_and_select_undo_each_other():
    data = np.frombuffer(mixed(5000, 9).encode(), np.uint8)
    units = fim.Units(data, np.array([0, len(data)]))
    n = int(units.before(np.array([len(data)]))[0])
    k = np.arange(n + 1)
    assert n == 5000 and (units.before(units.end(k)) == k).all() and units.end(k)[-1] == len(data)


def test_clashing_columns_stay_and_empty_tables_stay_empty(spark, docs):
    d = docs(["some words here"]).withColumns({c: F.lit("own") for c in ("n", "form", "output", "a-b", "x`y")})
    row = fim.fill_in_middle(d).first()
    assert row.n == row.form == row.output == row["a-b"] == row["x`y"] == "own" and row.fim.n == 15
    assert fim.fill_in_middle(d, into="cut").columns == [*d.columns, "cut"]
    assert fim.fill_in_middle(docs([])).count() == 0


def test_one_python_step_and_no_shuffle(spark, docs):
    d = fim.fill_in_middle(docs(["a b c"])).select("doc_id", "fim.n", "fim.output")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
