"""Preparation of a training corpus in five stages over the `documents` table.

Each stage takes the documents that its predecessor kept. All but the last return the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrain.llm import best_fit, line_dedup, pii, simhash_dedup, toxicity
from quillgrain.llm.common import doc_key, stored, table


#: What the stages read and write; all other columns are the caller's own.
OURS = ["doc_id", "text", "lang", "source", "n_chars"]


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stage with the caller's own columns under names that no operator uses, whatever theirs are."""
    own = {c: c if c in OURS else f"own_{i}_{uuid.uuid4().hex}" for i, c in enumerate(docs.columns)}
    return stage(docs.toDF(*own.values())).select(*own.values()).toDF(*own)


def _rewritten(docs: DataFrame, out: DataFrame) -> DataFrame:
    """Rows with new texts; n_chars, where there is one, follows them."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of at least 0.5 go; the rest stay as they are.

    A null text is an empty one, repeated rows and null ids are judged each for itself, very long texts
    as a whole; an empty table stays empty.
    """
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _apart(docs, lambda own: toxicity.score(own, model).where("score < 0.5"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, to the letter or nearly, go; no document does.

    A null text has no line and stays null or empty, of repeated rows the first keeps its lines; an
    empty table stays empty.
    """
    return _apart(docs, lambda own: _rewritten(own, line_dedup.drop_lines(own)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that of the smallest id (null last), then of the least text hash.

    Texts without a word are copies of each other, repeated rows of one another; an empty table stays empty.
    """
    d, t = (f"{x}_{uuid.uuid4().hex}" for x in "dt")
    groups = simhash_dedup.near_copies(docs)
    kept = groups.groupBy("root").agg(F.min(F.struct("_d", "_t")).alias("k")).select(F.col("k._d").alias(d), F.col("k._t").alias(t))
    # rows equal in id and text are one document; they lie together after the join
    rows = doc_key(docs, d=d, t=t).join(kept.hint("shuffle_hash"), [d, t], "left_semi")
    return rows.dropDuplicates([d, t]).drop(d, t)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format.

    Equal values become equal pseudonyms in repeated rows, too; null texts stay null, an empty table empty.
    """
    return _apart(docs, lambda own: _rewritten(own, pii.pseudonymise(own, pii.KEY, count_col=None)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence.

    A text without a word is one empty piece, a longer one than the longest sequence several; repeated
    rows and null ids are packed each for itself; an empty table gives no piece.
    """
    return best_fit.pack(docs.select("doc_id", best_fit.n_words().alias("n_words")), "n_words").withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("best_fit", pack_sequences),
]

#: The stages learn, hash and pack; SQL doesn't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages the documents are a Parquet table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
