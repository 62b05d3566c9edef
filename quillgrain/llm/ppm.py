"""Language-model scoring by prediction by partial matching, pretrained on the corpus itself.

The model is a byte-context trie of order 5, kept as tables of byte n-grams (one table a level).
A symbol that a context hasn't shown is reached by an escape to the next shorter context; escapes
are estimated by method D (half of the distinct symbols against all), shorter contexts count the
distinct longer ones that they end (single counting), and symbols that the longer context has
shown are excluded below it. As the trained counts stay fixed while scoring, the code length of a
byte is a function of its 6-gram, so it is worked out once for every distinct 6-gram, by a join and
a window for each level.

Documents are dealt into chunks of bounded size by a hash. A chunk reports the words and 6-grams it
holds with their training counts. The most frequent ones, a bounded number, are broadcast with their
totals and code lengths; of the rest a chunk gets back just its own, and then scores its documents.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrain.llm.common import cut, id_crc, raw, stored

ORDER = 5
CHUNK_BYTES = 16 << 20
#: Bounds of what is broadcast: the most frequent words and n-grams.
HEAD_WORDS, HEAD_GRAMS = 1 << 17, 1 << 19
#: Bytes that UTF-8 never holds: before a text's start, and the symbol for its end.
START, STOP = b"\xff", b"\xfe"
#: The end token among words, which hold no space.
END = b" "


def grams(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """The (order + 1)-grams that end at each byte and at the end of each text, packed in integers."""
    s = np.frombuffer(b"".join([START * order + t + STOP for t in texts]), np.uint8)
    packed = np.zeros(max(0, len(s) - order), np.int64)
    for i in range(order + 1):
        packed = (packed << 8) | s[i : len(s) - order + i]
    return packed[s[order:] != 0xFF]


class Table:
    """An open-addressing table of integers with values; looks up whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.slots, self.values, self.probes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits), 0
        left = np.arange(len(keys))
        while len(left):
            at = self._place(keys[left], self.probes)
            free = np.flatnonzero(self.slots[at] == -1)
            slot, first = np.unique(at[free], return_index=True)
            chosen = free[first]
            self.slots[slot], self.values[slot] = keys[left[chosen]], values[left[chosen]]
            left = np.delete(left, chosen)
            self.probes += 1

    def _place(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (h.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def total(self, keys: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the values of known keys, and the keys that aren't known."""
        out, unknown = 0.0, []
        for probe in range(self.probes):
            if not len(keys):
                break
            at = self._place(keys, probe)
            held = self.slots[at]
            hit = held == keys
            out += float(self.values[at[hit]].sum())
            unknown.append(keys[held == -1])
            keys = keys[~hit & (held != -1)]
        return out, np.concatenate([keys, *unknown])


def packed(df: DataFrame) -> bytes:
    """The rows of a bounded table as one Arrow stream: the driver passes bytes on and holds no row."""
    rows, out = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


#: The lookups of a worker; they are built once from what was broadcast.
_LOOKUPS: dict[str, tuple[dict[bytes, int], Table]] = {}


def lookups(few: tuple) -> tuple[dict[bytes, int], Table]:
    """Counts of the frequent words and code lengths of the frequent grams."""
    name, words, grams_ = few
    if name not in _LOOKUPS:
        _LOOKUPS.clear()
        w, g = (pa.ipc.open_stream(x).read_all() for x in (words, grams_))
        _LOOKUPS[name] = dict(zip(w["w"].to_pylist(), w["n"].to_pylist(), strict=True)), Table(g["g"].to_numpy(), g["logp"].to_numpy())
    return _LOOKUPS[name]


def _tally(texts: list[bytes], order: int, block: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of many texts with their counts, in blocks of bounded size."""
    keys, counts, part, size = [], [], [], 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= block or i + 1 == len(texts):
            k, n = np.unique(grams(part, order), return_counts=True)
            keys.append(k)
            counts.append(n)
            part, size = [], 0
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts).astype(float), len(k)).astype(np.int64)


def report(texts: list[bytes], held: list[bool], order: int = ORDER) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    """Words and grams of a chunk with their counts in its training documents (0: only held out)."""
    words: Counter = Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            words.update(t.split())
            words[END] += 1
    for t, h in zip(texts, held, strict=True):
        if h:
            for w in (*t.split(), END):
                if w not in words:
                    words[w] = 0
    learnt, n = _tally([t for t, h in zip(texts, held, strict=True) if not h], order)
    other, _ = _tally([t for t, h in zip(texts, held, strict=True) if h], order)
    other = np.setdiff1d(other, learnt, assume_unique=True)
    return list(words), list(words.values()), np.r_[learnt, other], np.r_[n, np.zeros(len(other), np.int64)]


def code_lengths(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, n) of all 6-grams, n their training counts -> (g, n, logp): log10 of their last symbol's probability."""
    levels = [counted]
    for k in range(order, 0, -1):  # a shorter gram counts the distinct longer ones that end in it
        suffix = F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))
        levels.append(levels[-1].groupBy(suffix.alias("g")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n")))
    first = levels.pop()
    total, kinds = (x or 0 for x in first.agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long"))).first())
    q = 1.0 / max(1, 256 - kinds)
    unseen = kinds / 2 / total * q if total else 1 / 256
    level = first.withColumns({"t": F.lit(float(total)), "d": F.lit(float(kinds)), "q": F.lit(q), "p": F.when((F.col("n") > 0) & F.lit(total > 0), (F.col("n") - 0.5) / F.lit(float(max(total, 1)))).otherwise(F.lit(unseen))})
    for k in range(1, order + 1):
        suffix = F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))
        low = level.select(F.col("g").alias("s"), F.col("n").alias("n0"), F.col("t").alias("t0"), F.col("d").alias("d0"), F.col("q").alias("q0"), F.col("p").alias("p0"))
        context = Window.partitionBy("c")  # 256 rows at most
        shown = F.col("n") > 0
        x = levels.pop().withColumn("s", suffix).join(low.hint("shuffle_hash"), "s").withColumn("c", F.shiftright("g", 8)).withColumns({
            "t": F.sum("n").over(context).cast("double"),
            "d": F.sum(shown.cast("double")).over(context),
            "x": F.sum(F.when(shown, F.col("n0")).otherwise(0)).over(context).cast("double"),
        })
        t1, d1 = F.col("t0") - F.col("x"), F.col("d0") - F.col("d")
        q = F.when(d1 <= 0, F.col("q0")).when(F.col("n0") > 0, (F.col("n0") - 0.5) / t1).otherwise(d1 / 2 / t1 * F.col("q0"))
        p = F.when(F.col("t") == 0, F.col("p0")).when(shown, (F.col("n") - 0.5) / F.col("t")).otherwise(F.col("d") / 2 / F.col("t") * F.col("q"))
        level = x.withColumn("q", q).withColumn("p", p).select("g", "n", "t", "d", "q", "p")
    return level.select("g", "n", F.log10("p").alias("logp"))


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    `held_out` is a boolean column; the other rows train the model. A null text is an empty one,
    which still has its end to predict. Rows with equal ids are scored each for itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held"), raw(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("id", "t"), F.lit(max(1, -(-size // chunk_bytes)))).cast("int")
    dealt = rows.withColumn("chunk", chunk)

    def tell(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        texts = [x.as_py().lower() for x in part["t"]]
        w, wn, g, gn = report(texts, part["held"].to_pylist(), order)
        n = len(w) + len(g)
        return pa.table({
            "chunk": pa.array(np.full(n, key[0].as_py()), pa.int32()),
            "w": pa.concat_arrays([pa.array(w, pa.binary()), pa.nulls(len(g), pa.binary())]),
            "g": pa.concat_arrays([pa.nulls(len(w), pa.int64()), pa.array(g, pa.int64())]),
            "n": pa.array(np.r_[np.array(wn, np.int64), gn], pa.int64()),
        })

    told = stored(dealt.groupBy("chunk").applyInArrow(tell, "chunk int, w binary, g long, n long"))

    counts = stored(told.where("w is not null").groupBy("w").agg(F.sum("n").alias("n")))
    n, v = (x or 0 for x in counts.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first())
    lengths = stored(code_lengths(cut(told.where("g is not null").groupBy("g").agg(F.sum("n").alias("n"))), order))
    words, grams_ = told.where("w is not null").select("chunk", "w"), told.where("g is not null").select("chunk", "g")
    often_w, often_g = frequent(counts, HEAD_WORDS), frequent(lengths, HEAD_GRAMS)
    common_w, common_g = counts.where(often_w), lengths.where(often_g)
    rare_w = words.join(F.broadcast(common_w.select("w")), "w", "left_anti").join(counts.where(~often_w).hint("shuffle_hash"), "w").select("chunk", "w", F.col("n").cast("double").alias("x"))
    rare_g = grams_.join(F.broadcast(common_g.select("g")), "g", "left_anti").join(lengths.where(~often_g).hint("shuffle_hash"), "g").select("chunk", "g", F.col("logp").alias("x"))
    answers = stored(rare_w.unionByName(rare_g, allowMissingColumns=True))

    head = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, packed(common_w.select("w", "n")), packed(common_g.select("g", "logp"))))

    def judge(key: tuple[pa.Scalar, ...], part: pa.Table, answer: pa.Table) -> pa.Table:
        often, table_ = lookups(head.value)
        is_word = answer["w"].is_valid()
        word, gram = answer.filter(is_word), answer.filter(pa.compute.invert(is_word))
        total = dict(zip(word["w"].to_pylist(), word["x"].to_pylist(), strict=True))
        g, p = gram["g"].to_numpy(), gram["x"].to_numpy()
        by = np.argsort(g)
        g, p = g[by], p[by]
        out = []
        for x in part["t"]:
            t = x.as_py().lower()
            own = [*t.split(), END]
            c = np.fromiter((often[w] if w in often else total[w] for w in own), float, len(own))
            score, rare = table_.total(grams([t], order))
            score += p[np.searchsorted(g, rare)].sum()
            out.append((len(c), int((c > 0).sum()), float(np.log10(c + 1).sum()), float(score)))
        cols = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([part["id"], part["held"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "held", "n_tokens", "n_known", "hits", "score"])

    found = stored(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, "id long, held boolean, n_tokens long, n_known long, hits double, score double"))
    head.destroy()
    return found.select(
        "id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hits") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score",
    )


def frequent(counted: DataFrame, most: int) -> Column:
    """Whether a row is above a count that `most` of them pass at most; equal counts stay together.

    The count is found from a histogram over eighths of powers of two.
    """
    step = F.floor(F.log2(F.col("n") + 1) * 8)
    total, least = 0, None
    for row in counted.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
        total += row["count"]
        if total > most:
            break
        least = row["s"]
    return step >= F.lit(least) if least is not None else F.lit(False)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: base and model score of every document, held out where crc32 mod 7 is 2."""
    from quillgrain.llm.common import table

    return score(table(spark, sf_dir, "documents"), id_crc("doc_id") % 7 == 2).withColumnRenamed("id", "doc_id")
