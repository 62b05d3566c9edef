"""The given tables in the shapes that the operators take: memories, recall queries, evidence, beliefs, stories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrain.functions import text as T

#: Rows of a table for each bank, so that banks stay as small as they are in the smallest tables, and the banks of those.
PER_BANK, EVENTS_PER_BANK, LEAST_BANKS = 250, 2500, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def banks(spark: SparkSession, sf_dir: str, name: str, rows: int = PER_BANK) -> int:
    """How many banks the rows of a table are dealt to; four at least."""
    return max(LEAST_BANKS, table(spark, sf_dir, name).count() // rows)


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as raw memories; turn_idx counts on inside a bank."""
    c = table(spark, sf_dir, "conversations")
    bank = F.col("conv_id") % banks(spark, sf_dir, "conversations")
    return c.select(
        bank.alias("bank_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"),
        F.col("turn").alias("turn"),
        F.row_number().over(Window.partitionBy(bank).orderBy("conv_id", "turn")).cast("long").alias("turn_idx"),
        F.when(F.col("role") == "user", "dialogue").when(F.col("role") == "assistant", "episodic").otherwise("semantic").alias("kind"),
        F.when(F.col("role") == "user", "told").when(F.col("role") == "assistant", "witnessed").otherwise("remembered").alias("provenance"),
        F.col("text").alias("content"), F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("event_key"),
    )


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories that were read; some are inferences, commitments, archived or retired."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    inferred = i % 7 == 0
    return d.select(
        (i % banks(spark, sf_dir, "documents")).alias("bank_id"), i.alias("id"), F.when(i % 11 != 0, i).alias("turn_idx"),
        F.when(inferred, "inference").when(i % 19 == 0, "commitment").otherwise("semantic").alias("kind"),
        F.when(inferred, "inferred").otherwise("read").alias("provenance"), F.col("text").alias("content"), "source",
        F.when(inferred, (i % 10) / 10).otherwise(0.8).alias("confidence"), T.salience("text").alias("salience"),
        (i % 13 == 0).alias("archived"), F.when(i % 17 == 0, F.concat(F.lit("b"), (i % 3).cast("string"))).alias("retired_batch"),
        F.concat(F.lit("doc:"), i.cast("string")).alias("event_key"),
    )


def paced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`document_rows` whose turns go on by four from one row of a bank to the next, as in four banks, however many there are.

    So what a cutoff leaves of a bank, and which rows are next to each other, doesn't hang on the size of the table.
    """
    pace = F.expr(f"turn_idx * {LEAST_BANKS} div {banks(spark, sf_dir, 'documents')}")
    return document_rows(spark, sf_dir).withColumn("turn_idx", pace)


def recall_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every benchmark item, one bank each, with a turn as cutoff."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"), (F.col("item_id") % banks(spark, sf_dir, "documents")).alias("bank_id"),
        F.col("text").alias("query_text"), (F.lit(500) + F.col("item_id") * 7).cast("long").alias("cutoff_turn"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as an ordered stream of evidence on hypotheses of twenty documents and five addresses each."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select(
        F.floor(F.col("doc_id") / 20).alias("hypothesis_id"), F.col("doc_id").alias("seq"),
        F.concat(F.lit("https://source.example/"), F.floor(F.col("doc_id") / 20).cast("string"), F.lit("/"), (F.col("doc_id") % 5).cast("string")).alias("url"),
        F.when(F.col("toxic") == 1, "contradicts").when(F.col("quality") == 1, "supports").otherwise("context").alias("stance"),
        F.col("text").alias("body"),
    )


def belief_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as belief updates: one subject for each user, claims in five buckets, odd ones negated."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = {"click": "observation", "view": "stated_fact", "signup": "preference", "purchase": "goal", "error": "trait"}
    kind = F.lit("identity")
    for name, v in kinds.items():
        kind = F.when(F.col("event_type") == name, v).otherwise(kind)
    bank = F.col("user_id") % banks(spark, sf_dir, "events", EVENTS_PER_BANK)
    return e.select(
        bank.alias("bank_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("about"), kind.alias("kind"),
        F.concat(F.when(k % 2 == 1, "not ").otherwise(""), F.col("event_type"), F.lit(" bucket"), (k % 5).cast("string")).alias("claim"),
        F.least(F.lit(1.0), F.abs("value") / 50).alias("confidence"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("turn"), F.col("event_id").alias("seq"),
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as graded runs of one hypothesis for each user; some are marks of a proposed fix."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    bad = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("hypothesis_id"), F.concat_ws(":", "event_type", k.cast("string")).alias("digest"),
        F.when(k % 50 == 1, "fix-marker").when(bad, "refuted").when(k % 10 == 0, "inconclusive").otherwise("confirmed").alias("outcome"),
        F.concat(F.lit("exit "), F.when(bad, "1").otherwise("0"), F.lit(" in 1s")).alias("observation"),
        (k % 25 == 3).alias("reproduces"), "ts", "event_type", k.alias("k"),
    )


def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources of an index: newlines doubled, every other one with a heading."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("doc_id").alias("modified"),
        F.concat(F.when(F.col("doc_id") % 2 == 0, "# ").otherwise(""), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("body"),
    )
