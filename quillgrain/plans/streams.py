"""Queries that run a stream to its end and return what it keeps: its state, its table or what it put out.

A stream reads a table that Spark derives from the given ones, in two micro-batches: the first half of
its order, then the rest, with the same checkpoint, so that state is carried from one to the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrain.plans import sql as S
from quillgrain.plans.catalog import Catalog
from quillgrain.plans.folds import _FOLD, _L6, _bank_turns
from quillgrain.plans.investigation import _STALL
from quillgrain.sources import adapters as A
from quillgrain.sources.buckets import BucketTable
from quillgrain.sources.scratch import shared_folder, stored
from quillgrain.streaming import stateful as St

C = Catalog()
query = C.query
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession):
    """The state store that list, map and value states need, while a stream runs or is read."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def replayed(rows: DataFrame, late: Column, start: Callable[[DataFrame, str], object]) -> str:
    """Runs a stream over the rows that aren't `late`, then over those that are; its checkpoint's folder."""
    spark = rows.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = stored(rows)
    with _rocks(spark):
        for half in (~late, late):
            rows.where(half).write.mode("append").parquet(f"{place}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
            start(stream, f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{place}/checkpoint"


def _kept(rows: DataFrame, late: Column, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream of new rows has written."""
    out = f"{shared_folder(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    replayed(rows, late, lambda s, cp: stream(s).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", cp))
    return rows.sparkSession.read.parquet(out)


def _nowhere(out: DataFrame, checkpoint: str):
    """A stream of which only the state is wanted."""
    return out.writeStream.outputMode("update").foreachBatch(lambda batch, _: batch.write.format("noop").mode("overwrite").save()).option("checkpointLocation", checkpoint)


@query("st2_belief_store")
def st2(spark, d):
    """The belief store, read from the list state of the stream of updates."""
    cp = replayed(A.belief_updates(spark, d), F.col("turn") > 5, lambda s, cp: _nowhere(St.belief_stream(s), cp))
    with _rocks(spark):
        return stored(St.belief_store(spark, cp))


@query("st3_evidence_state", _FOLD.replace(", fl as n_flips from f", " from f"))
def st3(spark, d):
    """Confidences of hypotheses, read from the value state of the stream of observations."""
    obs = A.observations(spark, d)
    half = obs.agg(F.max("seq")).first()[0] or 0
    cp = replayed(obs, F.col("seq") > half // 2, lambda s, cp: _nowhere(St.evidence_stream(s), cp))
    with _rocks(spark):
        return stored(St.evidence_state(spark, cp))


@query("st4_idempotent_ingest", f"with {S.CONV} select bank_id, event_key, id, case when id % 3 = 0 then 'again: ' || content else content end as content from conv")
def st4(spark, d):
    """Turns that come once or twice: one row of each key, the newer text."""
    rows = A.conversation_rows(spark, d).select("bank_id", "event_key", "id", "content", F.lit(0).alias("version"))
    again = rows.where("id % 3 = 0").withColumns({"content": F.concat(F.lit("again: "), "content"), "version": F.lit(1)})
    keys, place = ["bank_id", "event_key"], f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    both = rows.unionByName(again)
    replayed(both, F.col("version") == 1, lambda s, cp: St.upsert_stream(s, place, cp, keys, "version"))
    return BucketTable(spark, place, keys, both.schema).read().select("bank_id", "event_key", "id", "content")


@query("st6_window_stream", _L6)
def st6(spark, d):
    """Consolidation windows of the same rows as in the batch query, as the stream closes them."""
    return _kept(_bank_turns(spark, d), F.col("turn_idx") > 20, St.window_stream)


@query("st7_stall_stream", f"with n as (select event_id as id, row_number() over (partition by user_id order by ts, event_id) as seq from events), r as ({_STALL}) select ex.user_id as run, n.seq, r.stalls, r.stalled from r join n using (id) join events ex on ex.event_id = r.id")
def st7(spark, d):
    """Stalls of each run, counted on across micro-batches."""
    e = A.experiments(spark, d)
    n = F.row_number().over(Window.partitionBy("hypothesis_id").orderBy("ts", "id")).cast("long")
    rows = e.select(F.col("hypothesis_id").alias("run"), n.alias("seq"), F.col("event_type").alias("step"), (F.col("id") % 3 > 1).alias("progress"))
    return _kept(rows, F.col("seq") > 30, St.stall_stream)


QUERIES, ORACLES = C.queries, C.oracles
