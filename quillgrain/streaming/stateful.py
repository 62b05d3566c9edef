"""Streams: state kept for each key, equal in the end to the batch folds.

Rows carry their turn or sequence number. A micro-batch is put in order inside a key; a row that
comes late in a later batch is applied as of the state's last turn and is never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillgrain.operators import beliefs as H
from quillgrain.operators import chunks as N
from quillgrain.operators import evidence as E
from quillgrain.operators import lifecycle as L
from quillgrain.operators.bank import upsert
from quillgrain.sources.buckets import BUCKETS, BucketTable

HELD = "kind string, claim string, confidence double, first_seen_turn long, last_updated_turn long, words array<string>, polarity int"
_NAMES = [c.split()[0] for c in HELD.split(", ")]
_GIVEN = ["turn", "seq", "kind", "claim", "confidence", "polarity", "words"]


class BeliefState(StatefulProcessor):
    """What is held about one (bank, subject): a list state of thirty claims at most."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [dict(zip(_NAMES, row, strict=True)) for row in self.held.get()]
        for h in held:
            h["words"] = frozenset(h["words"])
        told: dict[str, frozenset] = {}
        new = []
        for turn, _, *rest, words in sorted(x for b in rows for x in zip(*(b[c].tolist() for c in _GIVEN), strict=True)):
            if (said := told.get(words)) is None:
                said = told[words] = frozenset(words.split())
            new.append(dict(zip(_GIVEN[2:-1], rest, strict=True)) | {"turn": turn, "words": said})
        s = H.Subject(held)
        s.run(new)
        self.held.put([tuple(sorted(h[n]) if n == "words" else h[n] for n in _NAMES) for h in s.held])
        yield pd.DataFrame({"bank_id": [key[0]] * len(s.held), "about": [key[1]] * len(s.held)} | {c: [h[c] for h in s.held] for c in H.COLUMNS[2:]})

    def close(self) -> None:
        pass


def belief_stream(updates: DataFrame) -> DataFrame:
    """The changed subjects of each micro-batch with all they hold; the last of each is the batch result.

    `belief_store` reads what is held back from the checkpoint. Needs the RocksDB state store.
    """
    claims = H.read_claims(updates).withColumn("words", F.array_join("words", " "))
    return claims.groupBy("bank_id", "about").transformWithStateInPandas(BeliefState(), H.STORE, "Update", "None")


def belief_store(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The whole belief store as the state of a stopped or running `belief_stream` holds it."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    return state.select("key.bank_id", "key.about", *[F.col(f"list_element.{c}").alias(c) for c in H.COLUMNS[2:]])


class EvidenceState(StatefulProcessor):
    """Confidence of one hypothesis, and the last stance of each of its sources."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "c double, s int, k int, d boolean, f int")
        self.stances = handle.getMapState("stances", "url string", "stance string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        c, s, k, d, f = self.total.get() if self.total.exists() else (E.PRIOR, 0, 0, False, 0)
        pin = lambda x: max(E.BAND[0], min(E.BAND[1], x))
        new = pd.concat(list(rows)).sort_values("seq")
        seen: dict[str, str] = {}  # of this batch; each address is read and written once
        for url, said in zip(new["url"].tolist(), new["stance"].tolist(), strict=True):
            stance = said if said in ("supports", "contradicts") else "context"
            if url in seen:
                before = seen[url]
            else:
                before = self.stances.getValue((url,))[0] if self.stances.containsKey((url,)) else None
            s += (stance == "supports") - (before == "supports")
            k += (stance == "contradicts") - (before == "contradicts")
            if before is None:
                c += min(E.MAX_STEP, E.SUPPORT * (1 - c)) if stance == "supports" else -min(E.MAX_STEP, E.CONTRADICT * c) if stance == "contradicts" else 0
                d = d or False
                c = round(pin(c) if d else c, 4)
                if s > 0 and k > 0:
                    c, d = round(pin(c), 4), True
            elif {before, stance} == {"supports", "contradicts"}:
                c, d, f = round(pin(c), 4), True, f + 1
            seen[url] = stance
        for url, stance in seen.items():
            self.stances.updateValue((url,), (stance,))
        self.total.update((float(c), int(s), int(k), bool(d), int(f)))
        yield pd.DataFrame({"hypothesis_id": [key[0]], "confidence": [c], "status": ["disputed" if d else "open"], "n_supports": [s], "n_contradicts": [k]})

    def close(self) -> None:
        pass


def evidence_stream(observations: DataFrame) -> DataFrame:
    """Hypotheses touched by each micro-batch with their confidence so far.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass), as all streams here.
    """
    return observations.groupBy("hypothesis_id").transformWithStateInPandas(EvidenceState(), "hypothesis_id long, confidence double, status string, n_supports int, n_contradicts int", "Update", "None")


def evidence_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All hypotheses with their confidence, as the state of an `evidence_stream` holds them."""
    state = spark.read.format("statestore").option("stateVarName", "total").load(checkpoint)
    status = F.when(F.col("value.d"), "disputed").otherwise("open")
    return state.select("key.hypothesis_id", F.col("value.c").alias("confidence"), status.alias("status"), F.col("value.s").alias("n_supports"), F.col("value.k").alias("n_contradicts"))


class WindowState(StatefulProcessor):
    """The turn of a bank's last window and its rows since."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getValueState("since", "turn long, rows long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, n = self.since.get() if self.since.exists() else (0, 0)
        turns, counts = np.unique(np.concatenate([b["turn_idx"].to_numpy() for b in rows]), return_counts=True)
        ends = []
        for turn, more in zip(turns.tolist(), counts.tolist(), strict=True):
            n += more
            if turn - at >= L.EVERY_TURNS or n >= L.ROW_PRESSURE:
                ends.append(turn)
                at, n = turn, 0
        self.since.update((int(at), int(n)))
        yield pd.DataFrame({"bank_id": [key[0]] * len(ends), "end_turn": ends})

    def close(self) -> None:
        pass


def window_stream(rows: DataFrame) -> DataFrame:
    """(bank_id, end_turn) of each consolidation window as it closes: ten turns or forty rows after the last."""
    turns = rows.select("bank_id", "turn_idx").where("turn_idx is not null")
    return turns.groupBy("bank_id").transformWithStateInPandas(WindowState(), "bank_id long, end_turn long", "Append", "None")


class StallState(StatefulProcessor):
    """A run's last step and how often it came again without progress."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "step string, stalls long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.last.get() if self.last.exists() else (None, 0)
        new = pd.concat(list(rows)).sort_values("seq")
        stalls = []
        for step, progress in zip(new["step"].tolist(), new["progress"].tolist(), strict=True):
            n = n + 1 if not progress and step == last else 0
            last = step
            stalls.append(n)
        self.last.update((last, int(n)))
        yield pd.DataFrame({"run": key[0], "seq": new["seq"], "stalls": stalls, "stalled": [x >= self.limit for x in stalls]})

    def close(self) -> None:
        pass


def stall_stream(rows: DataFrame, limit: int = 2) -> DataFrame:
    """(run, seq, stalls, stalled) of each row: repeats of a step without progress, counted on across batches."""
    return rows.groupBy("run").transformWithStateInPandas(StallState(limit), "run long, seq long, stalls long, stalled boolean", "Append", "None")


def upsert_stream(rows: DataFrame, place: str, checkpoint: str, keys: list[str], version: str, buckets: int = BUCKETS):
    """Keeps a table of the latest row of each key below `place`.

    A micro-batch rewrites only the hash buckets that its keys lie in, and a replayed one is a no-op.
    `BucketTable(spark, place, keys, rows.schema, buckets).read()` is the table.
    """
    schema = rows.schema

    def put(batch: DataFrame, number: int) -> None:
        held = BucketTable(batch.sparkSession, place, keys, schema, buckets)
        held.change(number, batch, lambda old: upsert(old, batch, keys, version))

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def index_table(spark: SparkSession, place: str, buckets: int = BUCKETS) -> BucketTable:
    """The chunk index that `reindex_stream` keeps."""
    return BucketTable(spark, f"{place}/chunks", ["path"], N.CHUNK, buckets)


def reindex_stream(ticks: DataFrame, folder: str, place: str, checkpoint: str, pattern: str = "*", buckets: int = BUCKETS):
    """Keeps the chunk index of the files below a folder; every micro-batch of `ticks` compares listings.

    `ticks` says when to look: a `binaryFile` stream of the folder, which has a batch when a file is
    new, or a rate stream, which also sees that files changed or vanished while none was added. A
    batch's listing (path, bytes, time) is stored under its number before it is compared with the one
    before, so a replay sees the same difference. Only changed files are read and cut, and only the
    buckets of changed and vanished ones are rewritten.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = index_table(spark, place, buckets)
        done = table.numbers()
        if number in done:
            return
        at = f"{place}/listing/{number}"
        N.listing(spark, folder, pattern).select("path", "bytes", "modified").write.mode("ignore").parquet(at)
        now = spark.read.parquet(at)
        before = spark.read.parquet(f"{place}/listing/{done[-1]}") if done else now.limit(0)
        found = N.listing_difference(before, now).where("change <> 'same'")
        fresh = found.where("change <> 'vanished'")
        since = fresh.agg(F.min("modified")).first()[0]
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
        texts = whole.where(F.col("modificationTime") >= F.lit(since)).join(fresh.select("path"), "path", "left_semi").select("path", F.col("content").cast("string").alias("body"))
        table.change(number, found, lambda old: old.join(found.select("path"), "path", "left_anti").unionByName(N.chunk(texts)))

    return ticks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def drain(stream: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is and returns all it has put out, for tests and small jobs."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
