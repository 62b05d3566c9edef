"""Helpers shared by the corpus operators: tables, checkpoints, word splitting, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and all runs on one
    machine (tests) a temporary folder is taken.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-cp-"))
    return sc.getCheckpointDir()


#: While a step runs: its shuffle files go when it ends, and batches of whole texts stay small in Python.
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextmanager
def _step(spark: SparkSession) -> Iterator[None]:
    """Runs a step whose result goes to the shared folder under the options above."""
    before = {k: spark.conf.get(k) for k in _STEP}
    for k, v in _STEP.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once and keep it in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    with _step(df.sparkSession):
        return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Compute `df` once into a Parquet table of the shared folder; smaller than a checkpoint."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with _step(spark):
        df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def raw(text: Column | str) -> Column:
    """The UTF-8 bytes of a text, null as empty: what the Python tasks read."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col, F.lit("")).cast("binary")


def id_crc(col: str) -> Column:
    """CRC32 of an id written as text; it fixes the folds. A null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("null")).cast("binary"))


def doc_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", d: str = "_d", t: str = "_t") -> DataFrame:
    """Adds the identity of a document: `d`, its id (null last) and `t`, a hash of its text.

    Repeated rows share an identity and are treated alike; two texts under one id stay apart.
    """
    return docs.withColumns({
        d: F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)),
        t: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
    })


def keyed(key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """(key, id) rows."""
    return pa.record_batch([pa.array(key), pa.array(ids)], ["key", "id"])


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task over (key, id) rows by key: those of keys with two rows or more. One row is held back."""
    key, ids, kept = np.empty(0, np.int64), np.empty(0, np.int64), False
    for b in batches:
        key, ids = (np.concatenate([held, b.column(c).to_numpy()]) for held, c in ((key, "key"), (ids, "id")))
        if len(key) > 1:
            same = key[1:] == key[:-1]
            take = np.r_[kept, same] | np.r_[same, False]
            if take[:-1].any():
                yield keyed(key[:-1][take[:-1]], ids[:-1][take[:-1]])
            key, ids, kept = key[-1:], ids[-1:], bool(same[-1])
    if len(key) and kept:
        yield keyed(key, ids)


def in_cells(dealt: DataFrame, size: int) -> DataFrame:
    """(key, id) -> (key, side, id): the rows of each key in cells of about 2 * `size` rows at most, in which any two of them meet.

    A key of `size` rows or fewer is one cell, of side null. The rows of a larger one are dealt into blocks by
    their hash, and every two blocks are a cell (sides 0 and 1), every block one more (side null): no bucket has
    to fit into a task, and what meets doesn't hang on the bounds of batches or partitions. A cell's key is
    a hash; where two collide, rows meet that need not.
    """
    many = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > size).select("key", F.ceil(F.col("n") / size).alias("g"))
    own, other = F.pmod(F.xxhash64("id"), F.col("g")), F.explode(F.when(F.col("g").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    rows = dealt.join(many, "key", "left").select("key", "id", own.alias("own"), other.alias("other"))
    cell = F.when(F.col("other").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return rows.select(cell.alias("key"), F.when(F.col("own") != F.col("other"), (F.col("own") > F.col("other")).cast("int")).alias("side"), "id")


def whole_keys(batches: Iterator[pd.DataFrame], room: int = 20_000) -> Iterator[pd.DataFrame]:
    """A task's rows by key in frames of `room` rows or more that end where a key ends, whatever its batches were."""
    held, n, most = [], 0, room
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= most:
            rows = pd.concat(held, ignore_index=True)
            key = rows["key"].to_numpy(np.int64)
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if last:
                yield rows[:last]
            held, n = [rows[last:]], n - last
            most = max(room, 2 * n)
    if sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph: edges (u, v) long -> (node, root).

    Alternates large-star and small-star steps, which need a number of rounds that is
    logarithmic in practice and keep at most one row per edge. The root is the smallest node.
    Nothing is gathered on the driver but one count and one checksum per round.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
