"""Ranked search against scoring every document."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrain.llm import ranked_search as R

TERM = re.compile(R.TERM)
LOW = {i: i + 32 for i in range(65, 91)}


def plain_search(documents, items, k):
    """[(item, rank, doc, score)] by scoring everything."""
    split = [(i, TERM.findall((t or "").translate(LOW))) for i, t in documents]
    used = [w for _, w in split if w]
    big_n, big_l = len(used), sum(map(len, used))
    df = Counter(t for w in used for t in set(w))
    weight = {t: floor(1000 * log((2 * big_n + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked, found = set(TERM.findall((text or "").translate(LOW))), []
        for i, w in split:
            tf, m = Counter(w), w and 50 + 50 * len(w) * big_n // big_l
            s = sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in asked if tf[t])
            if s > 0:
                found.append((-s, 2**63 if i is None else i))
        out += [(item, r + 1, None if i == 2**63 else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


def words(n, r):
    return " ".join(r.choice(["the", "Common", f"w{int(r.paretovariate(0.6)) % 500}", f"É{r.randrange(30)}", "x-y", "naïve 你好"]) for _ in range(n))


def frame(spark, rows, id_col):
    return spark.createDataFrame([(i, t, "own", "own") for i, t in rows], f"{id_col} long, text string, score string, `a-b` string")


@pytest.mark.parametrize(("shard_bytes", "shard_docs", "items_of_a_block"), [(1 << 24, 1 << 16, 256), (3000, 1 << 16, 3), (700, 5, 2)])
def test_every_item_as_if_every_document_were_scored(spark, monkeypatch, shard_bytes, shard_docs, items_of_a_block):
    r = random.Random(4)
    documents = [(i, words(r.choice([1, 5, 40, 200]), r)) for i in range(150)]
    documents += [(None, "the common w1"), (None, None), (7, ""), (8, "...  --"), (9, "the w1"), (9, "the w1"), (400, words(30_000, r)), *((1000 + i, "copies of w1 w2 w3") for i in range(80))]
    items = [(i, words(r.choice([1, 3, 25]), r)) for i in range(9)] + [(20, None), (21, ""), (22, "the"), (23, "absent"), (24, "W1 w1 w2"), (25, "copies"), (None, "the"), (26, "b"), (26, "a w1")]
    monkeypatch.setattr(R, "ITEMS", items_of_a_block)
    monkeypatch.setattr(R, "FIRST", 3)
    index = R.build(frame(spark, documents, "doc_id"), shard_bytes=shard_bytes, shard_docs=shard_docs)
    got = sorted(tuple(x) for x in R.search(index, frame(spark, items, "item_id"), 10).collect())
    answered = [x for x in items if x[0] is not None and x != (26, "b")]
    assert got == sorted(plain_search(documents, answered, 10))


@pytest.mark.parametrize(("block", "window"), [(64, 8192), (4, 16), (1, 7)])
def test_bounds_skip_blocks_and_lose_nothing(monkeypatch, block, window):
    monkeypatch.setattr(R, "BLOCK", block)
    r = np.random.default_rng(2)
    n = 3000
    m = 50 + r.integers(0, 300, n)
    ids = r.permutation(n).astype(np.int64)
    lists, plain = [], np.zeros(n, np.int64)
    for w, share in ((9, 0.9), (300, 0.3), (2500, 0.02), (6000, 0.004), (7000, 0.002)):
        doc = np.flatnonzero(r.random(n) < share)
        tf = r.choice([1, 2, 300, 70_000], len(doc), p=[0.7, 0.28, 0.01, 0.01])
        worth = R.impact(tf, m[doc])
        cols = R.packed(np.zeros(len(doc), np.int64), doc, tf, worth, 1)
        x = R.List(len(doc), int(worth.max()), *(cols[c][0].tobytes() for c in R._NAMES))
        back = x.between(0, n)
        assert (back[0] == doc).all() and (back[1] == tf).all()
        x.known.clear()
        x.opened = 0
        lists.append((w, x))
        plain[doc] += w * worth
    best = np.lexsort((ids, -plain))[:20]
    docs, scores = R.best_of(lists, ids, m, 20, 0, window)
    assert sorted(zip(-scores, ids[docs])) == sorted(zip(-plain[best], ids[best]))
    opened = sum(x.opened for _, x in lists)
    again = R.best_of(lists, ids, m, 20, int(plain[best[-1]]), window)
    assert sorted(zip(-again[1], ids[again[0]])) == sorted(zip(-plain[best], ids[best]))
    assert R.best_of(lists, ids, m, 20, int(plain.max()) + 1, window)[0].size == 0
    if block < 64:
        assert opened < 0.7 * sum(-(-x.df // block) for _, x in lists)


def test_terms_are_those_of_the_pattern():
    texts = ["Ab-c  é你\x00x", "", "ABC", "Ünï 9a_b", "tail"]
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    names, term, doc, tf, n = R.postings(np.frombuffer(b"".join(data), np.uint8), bounds)
    got = Counter({(int(d), names[int(t)].as_py().decode()): int(c) for t, d, c in zip(term, doc, tf)})
    assert got == Counter((i, w) for i, t in enumerate(texts) for w in TERM.findall(t.translate(LOW)))
    assert n.tolist() == [len(TERM.findall(t)) for t in texts]


def test_empty_tables(spark):
    none, one = frame(spark, [], "doc_id"), frame(spark, [(1, "a b")], "doc_id")
    item = frame(spark, [(1, "a")], "item_id")
    assert R.search(R.build(none), item).count() == 0
    assert R.search(R.build(one.withColumn("text", F.lit("..."))), item).count() == 0
    assert R.search(R.build(one), item.limit(0)).count() == 0
    assert R.search(R.build(one), item).count() == 1
