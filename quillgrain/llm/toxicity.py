"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a probability p = sigmoid(bias + sum of the
weights of its distinct words); the bag is toxic with the noisy-or 1 - prod(1 - p). Only document labels are needed to
train the weights; afterwards the sentences with a high p are the places of offence.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from quillgrain.llm.common import id_crc, stored

SENTENCE = re.compile(r"[^.!?\n]+")
EDGE = "\"'()[]{}<>,;:|#*$%&-_“”‘’«»…/\\"
#: Bounds of the labelled sample that the classifier is fitted on: documents and bytes of each label.
SAMPLE, SAMPLE_BYTES = 3000, 24 << 20


@dataclass
class Model:
    """Weights of words and beginnings (bounded by the sample's vocabulary), the bias, and the offence threshold."""

    bias: float
    weights: dict[str, float]
    offence: float = 0.5


def tokens(sentence: str) -> list[str]:
    """The words of a lower-cased sentence without marks at their edges."""
    return [w for w in (x.strip(EDGE) for x in sentence.split()) if w]


def features(word: str) -> list[str]:
    """A word and its first four and five letters, which stand for its inflections."""
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


def fit(texts: list[str], labels: np.ndarray, least: int = 8, rounds: int = 100, l1: float = 2e-4, rate: float = 0.1) -> Model:
    """Full-batch Adam on the noisy-or likelihood, with an L1 step that clears useless words."""
    known: dict[str, list[str]] = {}

    def bag(text: str) -> list[list[str]]:
        """Distinct features of each sentence; equal strings are one object."""
        out = []
        for s in SENTENCE.findall(text.lower()):
            if own := tokens(s):
                out.append(list(dict.fromkeys(f for w in own for f in (known.get(w) or known.setdefault(w, features(w))))))
        return out or [[]]

    spread: Counter = Counter()
    for t in texts:
        spread.update({f for s in bag(t) for f in s})
    number = {w: i for i, w in enumerate(sorted(w for w, n in spread.items() if n >= least))}
    del spread
    sizes, counts, columns = [], [], array("i")
    for t in texts:  # read twice, so that only numbers of the features kept are held
        own = [[number[f] for f in s if f in number] for s in bag(t)]
        sizes.append(len(own))
        for s in own:
            counts.append(len(s))
            columns.extend(s)
    bag_of = np.repeat(np.arange(len(texts)), sizes)
    word = np.array(columns, np.int64)
    del columns, known
    row = np.repeat(np.arange(len(counts)), counts)
    y = labels.astype(float)
    weight_of = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w, b = np.zeros(len(number)), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[word], len(counts))
        s = np.bincount(bag_of, np.logaddexp(0, z), len(y))
        stay = np.exp(-np.maximum(s, 1e-9))
        slope = weight_of * ((1 - y) - y * stay / np.maximum(1 - stay, 1e-9))
        g = slope[bag_of] * np.exp(-np.logaddexp(0, -z)) / len(y)
        gw, gb = np.bincount(word, g[row], len(w)), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        step = rate / (np.sqrt(v / c2) + 1e-4)
        w = w - step * m / c1
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-4)
    return Model(float(b), {x: float(w[i]) for x, i in number.items() if w[i]})


def sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", per_label: int = SAMPLE, per_bytes: int = SAMPLE_BYTES, folds: int = 5
) -> tuple[list[str], np.ndarray]:
    """At most `per_label` whole texts and `per_bytes` bytes of each label, by a hash of the id, none of them held out.

    Only ids are ordered; the chosen ones, 2 * per_label at most, are joined to the texts by
    broadcast, and texts come to the driver only after their sizes have been added up. A document
    that is labelled both ways counts as toxic; null labels are left out. Of several texts under
    one id the least is taken, so the sample is the same at every run.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (id_crc(id_col) % folds != 0))
    chosen = chosen.groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    parts = [chosen.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_label) for y in (0, 1)]
    few = parts[0].unionByName(parts[1]).select(F.col(id_col).alias("_i"), "_y")
    rows = docs.select(F.col(id_col).alias("_i"), F.coalesce("text", F.lit("")).alias("_x")).join(F.broadcast(few), "_i")
    texts = stored(rows.groupBy("_i", "_y").agg(F.min("_x").alias("_x")))
    sizes = texts.select("_i", "_y", F.xxhash64("_i").alias("_h"), F.octet_length("_x").alias("_n")).toPandas().sort_values(["_h", "_i"])
    fit_in = sizes[sizes.groupby("_y")["_n"].cumsum() <= per_bytes]
    got = texts.where(F.col("_i").isin(fit_in["_i"].tolist())) if len(fit_in) < len(sizes) else texts
    got = got.toArrow().sort_by("_i")
    return got["_x"].to_pylist(), got["_y"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Fits on the bounded sample; without any label the model says 0 for every text."""
    texts, y = sample(docs, labels, **options)
    if not len(y):
        return Model(-20.0, {})
    return fit(texts, y)


class Scorer:
    """Scores texts; remembers the weighty features of raw words, for a bounded number of them."""

    def __init__(self, model: Model, room: int = 200_000):
        self.model, self.room, self.seen = model, room, {}

    def weighty(self, word: str) -> tuple[str, ...]:
        if len(self.seen) >= self.room:
            self.seen.clear()
        return self.seen.setdefault(word, tuple(f for f in features(word.strip(EDGE)) if f in self.model.weights))

    def __call__(self, text: str) -> tuple[float, list[dict]]:
        seen, weighty, weights, bias = self.seen, self.weighty, self.model.weights, self.model.bias
        places, z = [], []
        for s in SENTENCE.finditer(text.lower()):
            own: set[str] = set()  # as in training, each feature of a sentence counts once
            for word in set(s.group().split()):
                f = seen.get(word)
                if f is None:
                    f = weighty(word)
                if f:
                    own.update(f)
            total = bias + sum([weights[f] for f in sorted(own)])
            z.append(total)
            if total > 0:
                places.append({"start": s.start(), "end": s.end(), "p": 1 / (1 + np.exp(-total))})
        z = np.array(z or [bias])
        return float(-np.expm1(-np.logaddexp(0, z).sum())), [p for p in places if p["p"] >= self.model.offence]


_SPAN = StructType().add("start", IntegerType()).add("end", IntegerType()).add("p", DoubleType())
_FOUND = StructType().add("score", DoubleType()).add("offences", ArrayType(_SPAN))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with `score` and `offences` (added or replaced), the character spans and p of offending sentences.

    Null, empty and wordless texts are one empty sentence; repeated rows and null ids are scored each
    for itself; an empty table stays empty. All other columns stay, whatever their names. Lower-casing
    keeps the length of all but a few letters, so spans are those of the lower-cased text.
    """
    x = f"x_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Scorer(model)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for b in batches:
            found = [one(t.as_py() or "") for t in b.column(x)]
            rest = b.drop_columns([x])
            cols = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], kind)]
            yield pa.record_batch([*rest.columns, *cols], [*rest.schema.names, "score", "offences"])

    rest = docs.drop("score", "offences")
    schema = StructType([*rest.schema.fields, *_FOUND.fields])
    return rest.withColumn(x, F.col(text_col)).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the toxicity of every document."""
    from quillgrain.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = score(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", (id_crc("doc_id") % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offences").alias("n_offences"),
    )
