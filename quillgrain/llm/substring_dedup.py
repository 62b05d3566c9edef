"""Removal of passages that an earlier document holds, by suffix automata over reference shards.

The corpus is its own reference, so shards can't be broadcast to all documents: that would cost
documents times shards. Instead each 50-word window is led by an anchor, the least hashed 16-word
gram in it, so equal windows have equal anchors. Runs of windows with one anchor that several
documents hold are gathered by anchor; a shard of anchors holds all contents that can match there
and nothing else. Equal contents are merged first (with the smallest document that has them). Over
a shard's contents a generalised suffix automaton is built whose states know the smallest document
of their occurrences; the contents are then streamed through it for matching statistics, cut to
the window length. Anchors with very many different contents (what surrounds a common passage) are
too large for a shard; their windows are compared by 128-bit hashes instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrain.llm.common import doc_key, raw, stored

WINDOW, GRAM = 50, 16
#: Contents of a shard, and the contents of one anchor beyond which its windows are hashed.
SHARD_CONTENTS, HOT_CONTENTS = 500, 500
_RUN = "array<struct<h:bigint,p:int,c:int,content:binary>>"


def runs(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each run of windows with one anchor."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    mult, width, out, reach = np.uint64(0x9E3779B97F4A7C15), 1, None, 0
    with np.errstate(over="ignore"):
        power, block, left = mult, h, gram
        while left:  # the hash of a gram from those of its power-of-two blocks
            if left & 1:
                out = block if out is None else out[: len(h) - reach - width + 1] * power + block[reach:]
                reach += width
            left >>= 1
            if left:
                block = block[:-width] * power + block[width:]
                power, width = power * power, width * 2
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    view = np.lib.stride_tricks.sliding_window_view(out, window - gram + 1)
    at = np.concatenate([view[i : i + 4096].argmin(axis=1) for i in range(0, len(view), 4096)]) + np.arange(len(view))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return out[at[first]].view(np.int64), first, np.diff(np.r_[first, len(at)])


class Automaton:
    """A generalised suffix automaton over words; a state knows its smallest document."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [2**63 - 1]
        self.number: dict[bytes, int] = {}

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.low.append(2**63 - 1)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the string of p and c, cut out of q where q stands for longer ones too."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], doc: int) -> None:
        """Takes in one reference text."""
        last = 0
        for w in words:
            c = self.number.setdefault(w, len(self.number))
            known = self.next[last].get(c)
            if known is not None:
                last = self._split(last, c, known)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c, self.next[p][c])
                last = new
            if doc < self.low[last]:
                self.low[last] = doc

    def close(self) -> None:
        """Hands the smallest documents on to the suffixes; call it once, after the last text."""
        for v in np.argsort(self.length, kind="stable")[::-1].tolist():
            if (p := self.link[v]) >= 0 and self.low[v] < self.low[p]:
                self.low[p] = self.low[v]

    def lows(self, words: list[bytes], window: int) -> list[int]:
        """For each window of a streamed text the smallest document that holds it (none: 2**63 - 1)."""
        state, size, out = 0, 0, []
        for i, w in enumerate(words):
            c = self.number.get(w, -1)
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state = self.next[state].get(c, 0)
            size = size + 1 if state else 0
            while size > window and self.length[self.link[state]] >= window:
                state = self.link[state]
                size = self.length[state]
            if i + 1 >= window:
                out.append(self.low[state] if size >= window else 2**63 - 1)
        return out


def _contents(window: int, gram: int):
    """Maps (_d, _t, text, shared anchors) to the runs of the text that have a shared anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32()), ("c", pa.int32()), ("content", pa.binary())]))
        for b in batches:
            found = []
            for text, shared in zip(b.column("t"), b.column("hs"), strict=True):
                words = text.as_py().split()
                h, p, c = runs(words, window, gram)
                keep = np.isin(h, shared.values.to_numpy(zero_copy_only=False))
                found.append([{"h": x, "p": y, "c": z, "content": b" ".join(words[y : y + z + window - 1])} for x, y, z in zip(h[keep].tolist(), p[keep].tolist(), c[keep].tolist(), strict=True)])
            yield pa.record_batch([b.column("_d"), b.column("_t"), pa.array(found, kind)], ["_d", "_t", "runs"])

    return run


def earlier_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_d, _t, spans): the word spans [start, end) that windows held by a smaller id cover."""
    rows = doc_key(docs.select(id_col, text_col), id_col, text_col).select("_d", "_t", raw(text_col).alias("t"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [np.unique(runs(t.as_py().split(), window, gram)[0]) for t in b.column("t")]
            sizes = [len(x) for x in hs]
            at = pa.array(np.repeat(np.arange(len(hs)), sizes))
            yield pa.record_batch([b.column("_d").take(at), b.column("_t").take(at), pa.array(np.concatenate([np.empty(0, np.int64), *hs]))], ["_d", "_t", "h"])

    anchored = stored(rows.mapInArrow(anchors, "_d long, _t long, h long"))
    shared = anchored.groupBy("h").agg(F.min("_d").alias("lo"), F.max("_d").alias("hi")).where("lo < hi").select("h")
    wanted = anchored.join(shared, "h").groupBy("_d", "_t").agg(F.collect_set("h").alias("hs"))
    held = rows.join(wanted, ["_d", "_t"]).select("_d", "_t", "t", "hs").mapInArrow(_contents(window, gram), f"_d long, _t long, runs {_RUN}")
    members = stored(held.select("_d", "_t", F.inline("runs")).withColumn("k", F.md5("content")))

    classes = stored(members.groupBy("h", "k").agg(F.min("_d").alias("low"), F.first("content").alias("content")))
    hot = classes.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT_CONTENTS).select("h", F.lit(True).alias("hot"))
    marked = classes.join(hot, "h", "left")
    shards = max(1, classes.count() // SHARD_CONTENTS)

    def match(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        texts = [c.as_py().split() for c in part["content"]]
        lows = part["low"].to_pylist()
        automaton = Automaton()
        for t, low in zip(texts, lows, strict=True):
            automaton.add(t, low)
        automaton.close()
        earlier = [[i for i, m in enumerate(automaton.lows(t, window)) if m < low] for t, low in zip(texts, lows, strict=True)]
        return pa.table([part["h"], part["k"], part["low"], pa.array(earlier, pa.list_(pa.int32()))], ["h", "k", "low", "earlier"])

    schema = "h long, k string, low long, earlier array<int>"
    matched = (
        marked.where("hot is null").withColumn("shard", F.pmod("h", F.lit(shards)))
        .groupBy("shard").applyInArrow(match, schema)
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [c.as_py().split() for c in b.column("content")]
            ids = [[xxhash.xxh3_128_digest(b" ".join(w[i : i + window])) for i in range(len(w) - window + 1)] for w in words]
            yield pa.record_batch([b.column("h"), b.column("k"), b.column("low"), pa.array(ids, pa.list_(pa.binary()))], ["h", "k", "low", "ws"])

    windows = marked.where("hot").select("h", "k", "low", "content").mapInArrow(hashed, "h long, k string, low long, ws array<binary>")
    single = windows.select("h", "k", "low", F.posexplode("ws").alias("i", "w"))
    least = single.groupBy("w").agg(F.min("low").alias("m"), F.max("low").alias("x")).where("m < x").select("w", "m")
    late = single.join(least, "w").where("m < low").groupBy("h", "k").agg(F.collect_list("i").alias("earlier"))
    compared = marked.where("hot").select("h", "k", "low").join(late, ["h", "k"], "left").withColumn("earlier", F.coalesce("earlier", F.array().cast("array<int>")))

    results = stored(matched.unionByName(compared))
    one = F.transform("earlier", lambda i: F.struct((F.col("p") + i).alias("s"), (F.col("p") + i + window).alias("e")))
    all_ = F.array(F.struct(F.col("p").alias("s"), (F.col("p") + F.col("c") - 1 + window).alias("e")))
    spans = members.select("h", "k", "_d", "_t", "p", "c").join(results, ["h", "k"]).select("_d", "_t", F.when(F.col("_d") > F.col("low"), all_).otherwise(one).alias("s"))
    return stored(spans.where(F.size("s") > 0).groupBy("_d", "_t").agg(F.flatten(F.collect_set("s")).alias("spans")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row; `kept` has the words left, joined by one space.

    Windows are judged on the input. Null and empty texts have no words. Rows with equal ids
    don't remove each other's words; a null id counts as larger than all others. An empty table
    gives no row. No other column is looked at.
    """
    spans = earlier_passages(docs, id_col, text_col, window, gram)
    rows = doc_key(docs.select(id_col, text_col), id_col, text_col).select(F.col(id_col).cast("long").alias("id"), "_d", "_t", raw(text_col).alias("t"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(b.column("t"), b.column("spans"), strict=True):
                words = text.as_py().split()
                gone = np.zeros(len(words), bool)
                for s in spans.as_py() or ():
                    gone[s["s"] : s["e"]] = True
                total.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(words if not removed[-1] else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.record_batch([b.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return rows.join(spans, ["_d", "_t"], "left").select("id", "t", "spans").mapInArrow(keep, "id long, n_words long, n_removed long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: words, removed words and the digest of the kept words of every document."""
    from quillgrain.llm.common import table

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
