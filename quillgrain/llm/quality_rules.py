"""Quality rules: cross-document line frequency per host, beside per-document counts.

Every line with a word is normalised (lower case, white space collapsed) and hashed. A line is
*frequent* on a host when it stands in more distinct documents of the host than the limit, a share
of the host's distinct documents but a few documents at least. Copies of one text count as
one document, so that a clean document with copies isn't taken for boilerplate. Frequent lines are
removed, and a document that keeps less than a share of its words is rejected as depleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrain.llm.common import cut, doc_key, raw

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
FLOOR, SHARE, KEEP = 3, 0.02, 0.5
_LINES = "array<struct<h:bigint,n:int>>"


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    marks = np.frombuffer(text.translate(None, SPACES), dtype=np.uint8)
    chars = int(np.count_nonzero((marks & 0xC0) != 0x80))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeats = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        number: dict[tuple, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, len(windows))
        twice = np.bincount(ids)[ids] > 1
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[i : len(words) - 2 + i] |= twice
        repeats = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def line_hashes(text: bytes) -> list[dict]:
    """Distinct normalised lines of a text: 64-bit hash and words (of all its occurrences)."""
    found: dict[int, int] = {}
    for line in text.lower().split(b"\n"):
        if words := line.split():
            h = xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63
            found[h] = found.get(h, 0) + len(words)
    return [{"h": h, "n": n} for h, n in found.items()]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, host, the identity `_d`, `_t`, the five counts and its distinct lines."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(4)]
            counts = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, 5)
            lines = pa.array([line_hashes(t) for t in texts], pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())])))
            yield pa.record_batch([*b.columns[:4], *(pa.array(counts[:, i]) for i in range(5)), lines], ["id", "host", "_d", "_t", *names, "lines"])

    keyed = doc_key(docs, id_col, text_col)
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    return keyed.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), "_d", "_t", raw(text_col).alias("t")).mapInArrow(
        run, f"id long, host string, _d long, _t long, {', '.join(f'{n} long' for n in names)}, lines {_LINES}"
    )


def frequent_lines(measured: DataFrame, floor: int = FLOOR, share: float = SHARE) -> DataFrame:
    """(host, h, n_docs): lines in more distinct documents of a host than the limit allows."""
    texts = measured.groupBy("host", "_t").agg(F.first("lines").alias("lines"))
    sizes = measured.select("host", "_t").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    counts = texts.select("host", F.explode("lines.h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_docs"))
    counts = counts.where(F.col("n_docs") > floor)  # most lines end here, before the join
    return counts.join(sizes, "host").where(F.col("n_docs") > share * F.col("host_docs")).select("host", "h", "n_docs")


def line_frequency(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    floor: int = FLOOR, share: float = SHARE, keep: float = KEEP,
) -> DataFrame:
    """The counts of every row with `n_removed` (words on frequent lines) and `depleted`.

    A null host is the empty host; a null or empty text has no lines and is depleted.
    """
    measured = cut(measure(docs, id_col, text_col, host_col))
    frequent = frequent_lines(measured, floor, share)
    gone = (
        measured.dropDuplicates(["host", "_d", "_t"])
        .select("host", "_d", "_t", F.inline("lines"))
        .join(frequent, ["host", "h"])
        .groupBy("host", "_d", "_t")
        .agg(F.sum("n").alias("n_removed"))
    )
    out = measured.drop("lines").join(gone, ["host", "_d", "_t"], "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    return out.withColumn("depleted", F.col("n_words") - F.col("n_removed") < F.greatest(F.lit(1), keep * F.col("n_words")))


def remove_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    floor: int = FLOOR, share: float = SHARE, keep: float | None = KEEP,
) -> DataFrame:
    """The documents with their frequent lines taken out of the text; depleted ones go, unless `keep` is None.

    A row meets only those frequent lines that stand in it, so no host's lines are gathered. A null host
    is the empty host. A text without a word is depleted; where it stays, it stays as it is, null or empty.
    Repeated rows are treated alike, an empty table stays empty; other columns stay, whatever their names.
    A text in which no line is frequent isn't touched.
    """
    h_, d_, t_, bad_, gone_ = (f"{x}_{uuid.uuid4().hex}" for x in ("h", "d", "t", "bad", "gone"))
    measured = cut(measure(docs, id_col, text_col, host_col))
    rows = measured.dropDuplicates(["host", "_d", "_t"])
    hits = rows.select("host", "_d", "_t", "n_words", F.inline("lines")).join(frequent_lines(measured, floor, share), ["host", "h"])
    own = hits.groupBy("host", "_d", "_t").agg(F.sum("n").alias("n_removed"), F.first("n_words").alias("n_words"), F.collect_list("h").alias("bad"))
    left = F.col("n_words") - F.col("n_removed")
    depleted = F.lit(False) if keep is None else left < F.greatest(F.lit(1), keep * F.col("n_words"))
    verdict = own.select(F.col("host").alias(h_), F.col("_d").alias(d_), F.col("_t").alias(t_), F.col("bad").alias(bad_), depleted.alias(gone_))

    @F.pandas_udf("string")
    def clean(texts: pd.Series, bad: pd.Series) -> pd.Series:
        def one(text: str | None, drop) -> str | None:
            if text is None or drop is None:
                return text
            drop = set(drop.tolist())
            return "\n".join(x for x in text.split("\n") if not any(d["h"] in drop for d in line_hashes(x.encode())))

        return pd.Series([one(*x) for x in zip(texts, bad, strict=True)], dtype=object)

    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    met = doc_key(docs, id_col, text_col, d_, t_).withColumn(h_, host).join(verdict, [h_, d_, t_], "left").where(~F.coalesce(gone_, F.lit(False)))
    if keep is not None:  # texts without a word have no lines to meet
        met = met.where(F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return met.withColumn(text_col, F.when(F.col(bad_).isNull(), F.col(text_col)).otherwise(clean(text_col, bad_))).select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the counts, the base verdict and the verdict of line frequency for every document."""
    from quillgrain.llm.common import table

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = line_frequency(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.col("depleted")).alias("kept"), F.col("n_removed").alias("n_frequent_words"),
    )
