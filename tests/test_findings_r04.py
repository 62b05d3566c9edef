"""What the fourth round's findings found."""

import random

from collections import Counter

import pandas as pd

from quillgrain.llm import line_dedup
from quillgrain.operators import evidence as E
from quillgrain.plans import recall


def edited(line, n, rng):
    """The line after n changes of a letter, each inserted, taken out or replaced."""
    for _ in range(n):
        i = rng.randrange(len(line) + 1)
        line = line[:i] + rng.choice(["", "x", rng.choice("éab 漢")]) + line[i + rng.randrange(2) :]
    return line


def test_the_bound_by_pieces_drops_no_similar_pair():
    rng = random.Random(4)
    for alphabet in ("ab", "abcdefgh ", "éè漢字😀ab "):
        lines = ["".join(rng.choices(alphabet, k=rng.choice([1, 5, 63, 64, 65, 129, 300]))) for _ in range(200)]
        pairs = [(x, edited(x, rng.randrange(2 + len(x) // 4), rng) or "x") for x in lines] + list(zip(lines, lines[1:], strict=False))
        far = [line_dedup.edits(a, b) for a, b in pairs]
        for least in (0.5, 0.8, 0.95):
            most = [(1 - least) * max(len(a), len(b)) + 1e-9 for a, b in pairs]
            assert all(held or f > m for held, f, m in zip(line_dedup.pieced(pairs, most), far, most, strict=True))
            for alike in (True, False):
                assert line_dedup.similar(pairs, least, alike=alike) == [f <= m for f, m in zip(far, most, strict=True)]


def test_the_upper_bound_ends_once_it_passes_what_is_allowed():
    rng = random.Random(8)
    lines = [" ".join(rng.choices(["red", "lamp", "door", "river", "stone"], k=30)) for _ in range(60)]
    pairs = [(x, edited(x, rng.randrange(60), rng)) for x in lines] + list(zip(lines, lines[1:], strict=False))
    full = [line_dedup.most_edits(a, b) for a, b in pairs]
    for most in (0.0, 5.0, 20.5, 60.0):
        cut = [line_dedup.most_edits(a, b, most) for a, b in pairs]
        assert [c <= most for c in cut] == [f <= most for f in full] and all(c == f for c, f in zip(cut, full, strict=True) if f <= most)
    assert sum(cut) < sum(full)


def cell_of(n, rng):
    """Lines of one length and the same letters that share a passage and are not similar, and one pair that is."""
    lines = []
    for _ in range(n):
        rest = list("the quick brown foxes jump over lazy dogs and sit " * 6)
        rng.shuffle(rest)
        lines.append("a passage that all of them share, whatever comes " + "".join(rest))
    return [*lines, edited(lines[0], 20, rng)]


def test_pairs_of_a_cell_that_share_a_passage_alone_are_not_edited_through(monkeypatch):
    rng, tested = random.Random(5), []
    lines = cell_of(40, rng) + cell_of(40, rng)
    rows = pd.DataFrame({"key": [1] * 41 + [2] * 41, "side": [None] * 82, "root": range(82), "line": [x.encode() for x in lines]})
    real = line_dedup.side_by_side
    monkeypatch.setattr(line_dedup, "side_by_side", lambda pairs: tested.extend(pairs) or real(pairs))
    links = pd.concat(line_dedup.unlinked()(iter([rows])))
    assert sorted(map(tuple, links.to_numpy().tolist())) == [(40, 0), (81, 41)]
    assert len(tested) < 20  # of 1,640 pairs


def test_cells_of_pairs_are_dealt_to_all_partitions(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([*enumerate(cell_of(30, rng))], "doc_id long, text string")
    nodes = line_dedup.lines_of(df, "doc_id", "text").selectExpr("xxhash64(key) as id", "struct(_d, _t, pos) as at")
    texts = line_dedup.stored(line_dedup.line_texts(nodes, df, "doc_id", "text"))
    dealt = line_dedup.stored(texts.selectExpr("id % 8 as key", "id"))
    groups = spark.createDataFrame([], "node long, root long")
    found = line_dedup.rest_links(dealt, groups, texts, 0.8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and found.rdd.getNumPartitions() == 4


def test_support_sets_shuffle_texts_once_and_neither_words_nor_pairs(spark):
    rng = random.Random(7)
    words = ["red", "blue", "green", "door", "lamp", "river", "stone", "table"]
    said = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 8))) + "."
    # ids and rows repeat, some are null, and so are texts
    told = [(i % 25, "abc"[i % 25 % 3], said()) for i in range(40)] + [(None, "a", said()), (50, None, said()), (51, "a", None), (52, "none", said())]
    known = [(rng.choice(["a", "b", "c", None]), f"doc:{i % 50}", said()) for i in range(70)] + [("a", None, "red blue green door"), ("b", "doc:99", None)]
    out = E.support_sets(spark.createDataFrame(told, "summary_id long, scope string, summary string"), spark.createDataFrame(known, "scope string, ref string, content string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan

    want = Counter()
    for i, _, text in told:
        if text:
            shared = Counter()
            for j, scope, other in told:
                for s, ref, content in known:
                    if i is not None and i == j and scope is not None and scope == s:
                        shared[ref] += len(set(other[:-1].split()) & set((content or "").rstrip(".").split()))
            best = sorted((r for r in shared if shared[r] >= 3), key=lambda r: (-shared[r], r is not None, r or ""))
            want[i, text, tuple(best[:3])] += 1
    assert Counter((r.summary_id, r.claim, tuple(r.support_refs)) for r in out.collect()) == want
    assert sum(len(k[2]) for k in want) > 20


def test_neighbours_are_padded_however_many_banks_there_are(spark, tmp_path):
    # 12 banks of 250 rows: bank 5 holds 5, 17, 29 and so on, and the query sees the rows of its first 125 turns of four
    texts = [f"silver lantern {i}" if i % 60 == 5 else f"row {i}" for i in range(3000)]
    docs = pd.DataFrame({"doc_id": range(3000), "text": texts, "source": "s"})
    spark.createDataFrame(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "a silver lantern")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.id for r in recall.QUERIES["r08_neighbour_padding"](spark, str(tmp_path)).collect()]
    assert len(got) == 2 and all(i % 12 == 5 and i % 60 != 5 for i in got)
    # each is next in its bank to a row that speaks of lanterns
    assert all({(i - 12) % 60, (i + 12) % 60} & {5} for i in got)
