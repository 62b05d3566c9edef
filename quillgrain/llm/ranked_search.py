"""Ranked lexical search by Block-Max MaxScore over compressed posting lists in document shards.

The index is two Parquet tables. A task of the scan takes its texts in shards of a bounded number of
bytes and rows, and writes for each shard one row per term: document frequency, greatest impact and
blocks of 64 postings, each with its last document, its greatest impact and two byte runs (gaps and
occurrences, in 1, 2 or 4 bytes as the block needs). Texts are not shuffled. Impacts are integers that
depend on the lengths of all documents, so these are counted first.

A search fetches the lists of the asked terms only and lays them out by shard and block of items. A
task takes an item's lists in rising order of weight times greatest impact. The lists whose bounds
add up to less than the score to beat are not essential: a document in none but these can't be an
answer. Essential lists are read in windows of documents; the others are asked from the strongest
down for the documents still in reach, first by the impact bound of the block that would hold them,
and only blocks with a document left are decompressed. A sixteenth of the shards is searched first:
its k-th score is a bound for all others, so these send few rows to the merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrain.llm.common import cut, raw, stored

#: A term is a run of ASCII letters, digits and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text and documents of a shard, postings of a block, documents of a window, items of a block.
SHARD_BYTES, SHARD_DOCS, BLOCK, WINDOW, ITEMS = 16 << 20, 1 << 16, 64, 8192, 256
#: One of so many shards is searched first.
FIRST = 16
NO_ID = 2**63 - 1
_FIRST_BOUND = np.zeros(1, np.int64)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_IS_TERM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | _UPPER | ((_BYTES >= 97) & (_BYTES <= 122))
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a document's `tf` occurrences of a term count, by its length `m` in hundredths of the mean and more."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def terms_of(text: Column) -> Column:
    """The terms of a text in their order, only A to Z in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


# ---- lists of a shard

def _starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a term of one of the joined texts starts at a byte."""
    held = _IS_TERM[data]
    before = np.r_[False, held[:-1]][: len(held)]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    return held & ~before


def postings(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: different terms, and by term and document: term, document, occurrences; terms of each document."""
    held = _IS_TERM[data]
    first = np.flatnonzero(_starts(data, bounds))
    starts = np.cumsum(held, dtype=np.int64)[first] - 1
    kept = _LOWER[data[held]]
    owner = np.searchsorted(bounds, first, "right") - 1
    ends = np.r_[starts, len(kept)]
    tokens = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    coded = tokens.dictionary_encode()
    n = max(1, len(bounds) - 1)
    key = np.sort(coded.indices.to_numpy().astype(np.int64) * n + owner)
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    tf = np.diff(np.r_[new, len(key)])
    return coded.dictionary, key[new] // n, key[new] % n, tf, np.bincount(owner, minlength=len(bounds) - 1)


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 256, 1, np.where(most < 65536, 2, 4))


def _put(out: np.ndarray, at: np.ndarray, width: np.ndarray, value: np.ndarray) -> None:
    """Writes values as little-endian numbers of 1, 2 or 4 bytes."""
    for i in range(int(width.max(initial=0))):
        some = width > i
        out[at[some] + i] = value[some] >> (8 * i) & 255


def packed(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, worth: np.ndarray, n_terms: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The lists' columns, each as bytes of all lists and where a list's bytes begin; sorted by term and document."""
    df = np.bincount(term, minlength=n_terms)
    start = np.r_[0, np.cumsum(df)]
    rank = np.arange(len(term)) - np.repeat(start[:-1], df)
    first = np.flatnonzero(rank % BLOCK == 0)
    size = np.diff(np.r_[first, len(term)])
    of = np.repeat(np.arange(len(first)), size)
    before = np.where(rank > 0, np.r_[0, doc[:-1]], 0)
    gap = doc - before
    top = lambda x: np.maximum.reduceat(x, first) if len(first) else x[:0]
    wide_gap, wide_tf = _width(top(gap)), _width(top(tf))
    length = size * (wide_gap + wide_tf)
    place = np.r_[0, np.cumsum(length)]
    out = np.zeros(place[-1], np.uint8)
    inner = np.arange(len(term)) - first[of] if len(first) else rank
    _put(out, place[of] + inner * wide_gap[of], wide_gap[of], gap)
    _put(out, place[of] + size[of] * wide_gap[of] + inner * wide_tf[of], wide_tf[of], tf)
    blocks = -(-df // BLOCK)
    block = np.r_[0, np.cumsum(blocks)]
    inside = place[:-1] - np.repeat(place[block[:-1]], blocks)
    last = doc[first + size - 1] if len(first) else doc
    as_bytes = lambda x, kind: (x.astype(kind).view(np.uint8), block * np.dtype(kind).itemsize)
    return {
        "last": as_bytes(last, "<i4"), "peak": as_bytes(top(worth), "<i4"), "place": as_bytes(inside, "<i4"),
        "wide": as_bytes(wide_gap * 16 + wide_tf, "u1"), "data": (out, place[block]),
    }


class List:
    """A term's list in a shard; blocks are decompressed when a document in them is asked for."""

    def __init__(self, df: int, top: int, last: bytes, peak: bytes, place: bytes, wide: bytes, data: bytes):
        self.df, self.top, self.data = df, top, data
        self.last, self.peak, self.place = (np.frombuffer(x, "<i4") for x in (last, peak, place))
        self.wide = np.frombuffer(wide, np.uint8)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.opened = 0

    def block(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and occurrences of block j."""
        if j not in self.known:
            n, at, wide = min(BLOCK, self.df - BLOCK * j), int(self.place[j]), int(self.wide[j])
            gaps = np.frombuffer(self.data, f"<u{wide >> 4}", n, at).astype(np.int64)
            tf = np.frombuffer(self.data, f"<u{wide & 15}", n, at + n * (wide >> 4)).astype(np.int64)
            self.known[j] = np.cumsum(gaps) + (int(self.last[j - 1]) if j else 0), tf
            self.opened += 1
        return self.known[j]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from `low` to before `high`, and their occurrences."""
        a, b = np.searchsorted(self.last, [low, high])
        got = [self.block(j) for j in range(a, min(b + 1, len(self.last)))]
        if not got:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        doc, tf = (np.concatenate(x) for x in zip(*got, strict=True))
        some = (doc >= low) & (doc < high)
        return doc[some], tf[some]


def best_of(lists: list[tuple[int, List]], ids: np.ndarray, m: np.ndarray, k: int, floor: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Documents (numbers in the shard) and scores of the k best that reach `floor`, ties to the smaller id."""
    lists = sorted(((w * x.top, w, x) for w, x in lists if w > 0), key=lambda x: x[0])
    sums = np.cumsum([0, *(b for b, _, _ in lists)])  # what the first lists can add at most
    docs, scores, floor = np.empty(0, np.int64), np.empty(0, np.int64), max(1, floor)
    for low in range(0, len(ids), window):
        needed = int(np.searchsorted(sums[1:], floor))  # the first list that is essential
        parts = [(*x.between(low, low + window), w) for _, w, x in lists[needed:]]
        total, seen = np.zeros(window, np.int64), np.zeros(window, bool)
        for doc, tf, w in parts:
            total[doc - low] += w * impact(tf, m[doc])
            seen[doc - low] = True
        found = np.flatnonzero(seen)
        sum_ = total[found]
        found = found + low
        for i in range(needed - 1, -1, -1):
            near = sum_ + sums[i + 1] >= floor
            found, sum_ = found[near], sum_[near]
            if not len(found):
                break
            _, w, x = lists[i]
            j = np.searchsorted(x.last, found)
            inside = j < len(x.last)
            j = np.minimum(j, len(x.last) - 1)
            near = sum_ + sums[i] + np.where(inside, w * x.peak[j].astype(np.int64), 0) >= floor
            found, sum_, j, inside = found[near], sum_[near], j[near], inside[near]
            for b in np.unique(j[inside]).tolist():
                doc, tf = x.block(b)
                rows = np.flatnonzero((j == b) & inside)
                at = np.minimum(np.searchsorted(doc, found[rows]), len(doc) - 1)
                hit = doc[at] == found[rows]
                sum_[rows[hit]] += w * impact(tf[at[hit]], m[found[rows[hit]]])
        near = sum_ >= floor
        if near.any():
            docs, scores = np.r_[docs, found[near]], np.r_[scores, sum_[near]]
            if len(docs) > k:
                order = np.lexsort((ids[docs], -scores))[:k]
                docs, scores = docs[order], scores[order]
            if len(docs) == k:
                floor = max(floor, int(scores.min()))
    return docs, scores


# ---- the index

@dataclass
class Index:
    """Lists by shard and term, ids and lengths by shard, the number of documents with terms and of their terms."""

    lists: DataFrame
    texts: DataFrame
    n_docs: int
    n_terms: int


_LIST = "df int, top int, last binary, peak binary, place binary, wide binary, data binary"
_NAMES = ["last", "peak", "place", "wide", "data"]


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> Index:
    """The index of whole texts.

    A null text has no term, a null id is kept; repeated rows are documents of their own. An empty
    table gives an empty index. No other column is read.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), raw(text_col).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([_starts(np.frombuffer(x.as_buffer(), np.uint8), _FIRST_BOUND).sum() for x in b.column("t")], np.int64)
            yield pa.record_batch([pa.array([(n > 0).sum()]), pa.array([n.sum()])], ["d", "n"])

    counts = rows.select("t").mapInArrow(count, "d long, n long").agg(F.sum("d"), F.sum("n")).first()
    n_docs, n_terms = counts[0] or 0, counts[1] or 0

    def shard(number: int, ids: list[np.ndarray], texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        sizes = np.concatenate([np.diff(np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]) for t in texts])
        bounds = np.r_[0, np.cumsum(sizes)]
        data = np.frombuffer(b"".join(x.as_buffer() for t in texts for x in t), np.uint8)
        names, term, doc, tf, n = postings(data, bounds)
        m = 50 + (50 * n * n_docs) // max(1, n_terms)
        worth = impact(tf, m[doc])
        cols = packed(term, doc, tf, worth, len(names))
        df = np.bincount(term, minlength=len(names))
        first = np.r_[0, np.cumsum(df)[:-1]] if len(names) else df
        top = np.maximum.reduceat(worth, first) if len(names) else worth
        head = pa.record_batch([pa.array([number]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([0], pa.int32()),
                                *(pa.array([x], pa.binary()) for x in (np.concatenate(ids).astype("<i8").tobytes(), m.astype("<i8").tobytes(), None, None, None))], ["shard", "term", "df", "top", *_NAMES])
        yield head
        ends = {c: at.astype(np.int64) for c, (_, at) in cols.items()}
        for a in range(0, len(names), 20_000):
            b = min(len(names), a + 20_000)
            made = []
            for c in _NAMES:
                e = ends[c][a : b + 1]
                made.append(pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((e - e[0]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(cols[c][0][e[0] : e[-1]]))]))
            own = names[a:b].cast(pa.large_string()).cast(pa.string())
            yield pa.record_batch([pa.array(np.full(b - a, number)), own, pa.array(df[a:b].astype(np.int32)), pa.array(top[a:b].astype(np.int32)), *made], ["shard", "term", "df", "top", *_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, held, count = [], [], 0, 0
        for b in batches:
            i, t = b.column("id").to_numpy(), b.column("t").cast(pa.large_binary())
            ends = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
            at = 0
            while at < len(b):
                to = int(np.searchsorted(ends, ends[at] + shard_bytes - held, "right")) - 1
                to = min(len(b), at + shard_docs - count, max(to, at + (count == 0)))
                if to > at:
                    ids.append(i[at:to])
                    texts.append(t[at:to])
                    held, count = held + int(ends[to] - ends[at]), count + to - at
                if to < len(b):
                    yield from shard((part << 32) + made, ids, texts)
                    ids, texts, held, count, made = [], [], 0, 0, made + 1
                at = to
        if ids:
            yield from shard((part << 32) + made, ids, texts)

    table = stored(rows.mapInArrow(run, f"shard long, term string, {_LIST}"))
    return Index(table.where("term is not null"), table.where("term is null").select("shard", F.col("last").alias("ids"), F.col("peak").alias("m")), n_docs, n_terms)


# ---- the search

def search(index: Index, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k best documents with a score above 0, ties to the smaller id.

    Items without a term or an id get no row; an item that comes repeatedly is answered once, for its
    least text. Null document ids come last among equals. Only the item's id and text are read.
    """
    asked = items.where(F.col(item_col).isNotNull()).groupBy(F.col(item_col).cast("long").alias("item")).agg(F.min(text_col).alias("t"))
    blocks = max(1, -(-asked.count() // ITEMS))
    asked = stored(asked.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.array_distinct(terms_of(F.col("t")))).alias("term")))
    # the lists of the asked terms, once; their counts over all shards give the weights
    lists = stored(index.lists.join(asked.select("term").distinct(), "term"))
    ratio = F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1)
    weight = lists.groupBy("term").agg(F.sum("df").alias("df")).select("term", F.floor(1000 * F.ln(ratio)).alias("w"))
    asked = stored(asked.join(weight, "term"))
    first = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    early = _searched(lists.where(first), index.texts.where(first), asked.withColumn("floor", F.lit(0).cast("long")), k, blocks)
    early = cut(_best(early, k))
    floors = early.where(F.col("rank") == k).select("item", F.col("score").alias("floor"))
    late = _searched(lists.where(~first), index.texts.where(~first), asked.join(floors, "item", "left").fillna(0, ["floor"]), k, blocks)
    best = _best(early.select("item", "id", "score").unionByName(late), k)
    return best.select(F.col("item").alias(item_col), "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item; each task of the shuffle keeps k of its own first."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _searched(lists: DataFrame, texts: DataFrame, asked: DataFrame, k: int, blocks: int) -> DataFrame:
    """(item, id, score): the best of each shard and item."""
    who = asked.groupBy("block", "term", "w").agg(F.collect_list(F.struct("item", "floor")).alias("who"))  # at most ITEMS
    lists = lists.join(who, "term").select("shard", "block", "w", "who", "df", "top", *_NAMES)
    texts = texts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(own: pa.Table, docs: pa.Table) -> pa.Table:
        out = [(), (), ()]
        if len(own) and len(docs):
            ids, m = (np.frombuffer(docs[c][0].as_buffer(), "<i8") for c in ("ids", "m"))
            by_item: dict[int, list[tuple[int, List]]] = {}
            floors: dict[int, int] = {}
            for r in own.select(["w", "who", "df", "top", *_NAMES]).to_pylist():
                x = List(r["df"], r["top"], *(r[c] for c in _NAMES))
                for one in r["who"]:
                    by_item.setdefault(one["item"], []).append((r["w"], x))
                    floors[one["item"]] = one["floor"]
            got = [(item, *best_of(x, ids, m, k, floors[item])) for item, x in by_item.items()]
            if got:
                out = np.repeat([g[0] for g in got], [len(g[1]) for g in got]), ids[np.concatenate([g[1] for g in got])], np.concatenate([g[2] for g in got])
        return pa.table([pa.array(c, pa.int64()) for c in out], ["item", "id", "score"])

    return lists.groupBy("shard", "block").cogroup(texts.groupBy("shard", "block")).applyInArrow(run, "item long, id long, score long")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the 50 best documents of every benchmark item."""
    from quillgrain.llm.common import table

    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, {_SQL_TERMS} as w from documents), c as (select count(*) as n_docs, sum(len(w))::bigint as n_terms from d where len(w) > 0),
p as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by 1, 2),
i as (select distinct item_id, unnest({_SQL_TERMS}) as term from benchmark where item_id is not null),
f as (select term, count(*) as df from p group by 1),
g as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as weight from f, c),
s as (select item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * n_docs) // n_terms))))::bigint as score
  from i join g using (term) join p using (term) join d using (r), c group by 1, 2),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank from s join d using (r) where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50
"""
