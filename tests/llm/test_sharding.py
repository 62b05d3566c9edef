"""Packing of groups into shards against packing one by one."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillgrain.llm import sharding
from quillgrain.llm.common import table

SF = "/root/testdata/sf0.01"


def one_by_one(sizes, capacity):
    """Best fit of falling sizes: the shard of each."""
    spaces, out, n = [], [], 0
    for s in sizes:
        at = bisect_left(spaces, (s, -1))
        if at < len(spaces):
            space, shard = spaces.pop(at)
        else:
            space, shard, n = capacity, n, n + 1
        insort(spaces, (max(0, space - s), shard))
        out.append(shard)
    return out


def spread(counts, runs):
    """The shard of each group, as the runs say."""
    out = []
    for n, own in zip(counts, runs, strict=True):
        for i in range(n):
            at, shard, each = [r for r in own if r[0] <= i][-1]
            out.append(shard + (i - at) // each)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_best_fit_one_by_one(seed):
    r = random.Random(seed)
    sizes = sorted((r.choice([r.randrange(1, 40), r.randrange(1, 400), 7, 0]) for _ in range(600)), reverse=True)
    counts = Counter(sizes)
    distinct = sorted(counts, reverse=True)
    for capacity in (50, 399, 1000):
        runs, n = sharding.best_fit_decreasing(distinct, [counts[s] for s in distinct], capacity)
        got, want = spread([counts[s] for s in distinct], runs), one_by_one(sizes, capacity)
        assert Counter(zip(sizes, got)) == Counter(zip(sizes, want)) and n == max(want) + 1
        held = Counter()
        for s, shard in zip(sizes, got):
            held[shard] += s
        assert all(x <= capacity or x in sizes for x in held.values())


def test_tree_stays_balanced_and_sorted():
    r, tree, plain = random.Random(2), sharding.Tree(), []
    for i in range(4000):
        if plain and r.random() < 0.4:
            low = (r.randrange(1000), -1)
            at = bisect_left(plain, low)
            assert tree.take_least(low) == (plain.pop(at) if at < len(plain) else None)
        else:
            key = (r.randrange(1000) if i % 2 else i, i)
            tree.add(key)
            insort(plain, key)

    def depth(node):
        return 1 + max(depth(node[1]), depth(node[2])) if node else 0

    assert sharding._size(tree.root) == len(plain) and depth(tree.root) <= 2.5 * len(plain).bit_length()


@pytest.mark.parametrize(("sizes", "shards"), [([5] * 100, 10), ([1000, *[1] * 90], 10), ([9, 8, 7], 5), ([300, 200, *range(1, 60)], 7), ([3], 1)])
def test_shards_are_near_equal(sizes, shards):
    counts = Counter(sizes)
    distinct = sorted(counts, reverse=True)
    got = spread([counts[s] for s in distinct], sharding.near_equal(distinct, [counts[s] for s in distinct], shards))
    held = Counter()
    for s, shard in zip(sorted(sizes, reverse=True), got, strict=True):
        held[shard] += s
    assert set(held) <= set(range(shards)) and sum(held.values()) == sum(sizes)
    large = [s for s in sizes if s * shards >= sum(sizes)]
    rest = sorted(x for x in held.values() if x not in large)
    assert not rest or rest[-1] - rest[0] <= max([s for s in sizes if s not in large], default=0) + 1


def checked(rows, texts, shards):
    slots, homes, held = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        held[r.shard] += r["size"]
    by_text = defaultdict(list)
    for r in rows:
        homes[r.text_crc32].add(r.shard)
        by_text[r.text_crc32].append(r)
    assert Counter((r.id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in homes.values()) and set(held) <= set(range(shards))
    return held


def test_documents_in_near_equal_shards(spark):
    d = table(spark, SF, "documents")
    texts = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    held = checked(sharding.assign(d).collect(), texts, 40)
    assert len(held) == 40 and max(held.values()) <= 1.001 * min(held.values())


@pytest.mark.parametrize("bucket", [1, 1024])
def test_hard_rows_and_hot_groups(spark, docs, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET", bucket)
    texts = [(i, "hot text " * 20) for i in range(300)] + [(None, None), (None, ""), (None, "x"), (5, "same"), (5, "same"), (6, "é" * 200_000)] + [(1000 + i, f"text {i % 450}") for i in range(600)]
    d = docs(texts).withColumns({"shard": F.lit("own"), "size": F.lit("own"), "k": F.lit(1), "a-b": F.lit(2)})
    held = checked(sharding.assign(d, 8).collect(), texts, 8)
    assert max(held.values()) == 400_016 and sorted(held.values())[-2] == 300 * 196  # each alone
    rest = sorted(held.values())[:-2]
    assert len(rest) == 6 and rest[-1] - rest[0] <= 60


def test_fixed_capacity(spark, docs):
    texts = [(i, "x" * (i % 60)) for i in range(200)]
    rows = sharding.assign(docs(texts), None, 600).collect()
    held = checked(rows, texts, 200)
    groups = Counter()
    for i, t in texts:
        groups[len(t)] += len(t) + 16
    want = one_by_one(sorted(groups.values(), reverse=True), 600)
    assert max(held) == max(want) and max(held.values()) <= 600


def test_written_shards_hold_whole_rows(spark, docs, tmp_path):
    d = docs(["a b c", "a b c", None, "", *(f"text number {i}" for i in range(50))]).withColumn("x`y", F.lit("own"))
    sharding.write_shards(d, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.drop("shard").exceptAll(d).count() == 0 and back.count() == d.count()
    assert back.groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_empty_tables_and_arguments(spark, docs):
    assert sharding.assign(docs([])).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(docs(["a"]), 4, 4)
