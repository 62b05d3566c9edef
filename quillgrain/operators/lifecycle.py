"""What becomes of stored memories: importance, disputes, retirement, archive, consolidation, threads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillgrain.operators import bank as K
from quillgrain.operators import evidence as E
from quillgrain.sources.scratch import stored

FIRST_HAND = "autobiographical"
# Steps, ceilings, floors and the triggers of consolidation.
STEP, CEILING, DISPUTE_STEP = 0.12, 0.97, 0.2
READING = 300
#: Bytes of the run by which a part of a text is looked for; bits of the bitmap of asked runs.
GRAM, BITS = 8, 20
#: Texts whose runs are in a task's memory at once.
SLICE = 128
KEEP_RECENT, SALIENCE_FLOOR, EVERY_TURNS, ROW_PRESSURE = 12, 0.72, 10, 40


def raise_importance(rows: DataFrame, hits: DataFrame, only_unrevised: bool = False) -> DataFrame:
    """Rows whose key was hit n times come closer to the ceiling by n asymptotic steps."""
    n = hits.groupBy("event_key").agg(F.count("*").alias("_n"))
    base = K.effective_importance(F.col("importance"), F.col("salience"))
    lifted = F.greatest(base, F.least(F.lit(CEILING), 1 - (1 - base) * F.pow(F.lit(1 - STEP), F.col("_n"))))
    may = F.col("_n").isNotNull() & (F.col("importance").isNull() if only_unrevised else F.lit(True))
    return rows.join(n, "event_key", "left").withColumn("importance", F.when(may, lifted).otherwise(F.col("importance"))).drop("_n")


def _gram_keys(text: bytes, size: int) -> np.ndarray:
    """The runs of `size` bytes of a text, each as one mixed number."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(b) - size + 1
    if n < 1:
        return np.empty(0, np.int64)
    run = b[:n].copy()
    for j in range(1, size):
        run |= b[j : n + j] << np.uint64(8 * j)
    return ((run + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _with_grams(rows: DataFrame, text: str, sizes: list[int] | None = None, asked: np.ndarray | None = None) -> DataFrame:
    """The rows without `text`, one for each of its grams: `gram`, the text's own size or those of `sizes`, if `asked` may hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, len(whole), SLICE)):
            found = []
            for x in b.column(text):
                t = x.as_buffer().to_pybytes()
                keys = [_gram_keys(t, g) for g in (sizes or [min(GRAM, len(t))])]
                k = np.concatenate(keys) if keys else np.empty(0, np.int64)
                if asked is not None:
                    bit = k.view(np.uint64) >> np.uint64(64 - BITS)
                    k = k[asked[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) == 1]
                found.append(np.unique(k))
            rest = b.drop_columns([text]).take(pa.array(np.repeat(np.arange(len(b)), [len(k) for k in found])))
            yield rest.append_column("gram", pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))

    schema = StructType([*rows.drop(text).schema.fields, StructField("gram", LongType())])
    return rows.withColumn(text, F.coalesce(F.col(text), F.lit("")).cast("binary")).mapInArrow(run, schema)


def containing(needles: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(needle_id, *keys): the texts that hold a needle as a part, by an equi-join.

    A needle (needle_id, needle) is looked for by the rarest of its runs of `GRAM` bytes, or by itself
    if it is shorter, as counted over the texts (*keys, text); only texts that hold this run are
    compared in full. Texts leave out runs that no needle has, as a bitmap of 2^`BITS` bits tells
    them. A needle with a run that no text holds ends before the join. Empty needles match nothing.
    """
    n = stored(needles.where("needle <> ''"))
    own = stored(_with_grams(n, "needle"))
    sizes = sorted(r.g for r in n.select(F.least(F.octet_length("needle"), F.lit(GRAM)).alias("g")).distinct().collect())  # at most GRAM
    bit = F.shiftrightunsigned("gram", 64 - BITS)
    words = own.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - BITS}) & 63 as int))")).alias("m"))
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    for r in words.collect():  # at most 2^(BITS - 6) rows
        bitmap[r.w] = r.m
    held = stored(_with_grams(texts, "text", sizes, bitmap.view(np.uint64)))
    counts = held.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy("needle_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    near = held.join(rarest.where("r.n > 0").select("needle_id", "r.gram"), "gram").select("needle_id", *keys).distinct()
    return near.join(n, "needle_id").join(texts, keys).where(F.contains("text", F.col("needle"))).select("needle_id", *keys)


def dispute(rows: DataFrame, disputes: DataFrame) -> DataFrame:
    """(dispute_id, bank_id, id, tier): the rows that each dispute is about.

    Disputes (dispute_id, memory_ref, gist) match by reference; those without such a row by an equal
    gist; those without one, too, by being a part of a gist or content. Case and spaces don't count.
    """
    fold = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    d = disputes.select("dispute_id", F.coalesce("memory_ref", F.lit("")).alias("memory_ref"), fold("gist").alias("needle"))
    # gist and content are one text with a character between them that no needle holds
    r = stored(rows.select("bank_id", "id", "event_key", fold("gist").alias("g"), F.concat_ws("\0", fold("gist"), fold("content")).alias("text")))
    by_ref = d.where("memory_ref <> ''").join(r, F.col("memory_ref") == F.col("event_key")).select("dispute_id", "bank_id", "id", F.lit(1).alias("tier"))
    left = d.where("needle <> ''").join(by_ref.select("dispute_id").distinct(), "dispute_id", "left_anti")
    by_gist = left.join(r, F.col("needle") == F.col("g")).select("dispute_id", "bank_id", "id", F.lit(2).alias("tier"))
    left = left.join(by_gist.select("dispute_id").distinct(), "dispute_id", "left_anti")
    needles = left.select(F.col("dispute_id").alias("needle_id"), "needle").where(~F.contains("needle", F.lit("\0")))
    part = containing(stored(needles), r.select("bank_id", "id", "text"), ["bank_id", "id"])
    return by_ref.unionByName(by_gist).unionByName(part.select(F.col("needle_id").alias("dispute_id"), "bank_id", "id", F.lit(3).alias("tier")))


def apply_disputes(rows: DataFrame, disputes: DataFrame) -> DataFrame:
    """All rows, disputed ones with `disputed` (turn_idx, reading, count) and a raised importance.

    Disputes (dispute_id, turn_idx, reading, memory_ref, gist) without a reading count for nothing.
    Each that hits a row adds one to its count and 0.2 to its importance, up to the ceiling; the
    reading that stays is that of the last.
    """
    said = F.substring(F.trim(F.regexp_replace(F.coalesce("reading", F.lit("")), r"\s+", " ")), 1, READING)
    d = disputes.withColumn("reading", said).where("reading <> ''")
    hits = dispute(rows, d).join(d.select("dispute_id", "turn_idx", "reading"), "dispute_id")
    last = hits.groupBy("bank_id", "id").agg(F.max(F.struct("dispute_id", "turn_idx", "reading")).alias("_last"), F.count("*").alias("_n"))
    before = F.coalesce(F.col("disputed.count"), F.lit(0)) if "disputed" in rows.columns else F.lit(0)
    now = F.struct(F.col("_last.turn_idx").alias("turn_idx"), F.col("_last.reading").alias("reading"), (before + F.col("_n")).cast("long").alias("count"))
    base = K.effective_importance(F.col("importance"), F.col("salience"))
    old = F.col("disputed") if "disputed" in rows.columns else F.lit(None)
    hit = F.col("_n").isNotNull()
    raised = F.when(hit, F.least(F.lit(CEILING), base + DISPUTE_STEP * F.col("_n"))).otherwise(F.col("importance"))
    return rows.join(last, ["bank_id", "id"], "left").withColumns({"disputed": F.when(hit, now).otherwise(old), "importance": raised}).drop("_last", "_n")


def retire(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """The outcome of each asked key: 'retired', or why not."""
    found = keys.join(rows.select("event_key", "kind", "retired_batch", "disputed", "content", F.lit(True).alias("_f")), "event_key", "left")
    why = (
        F.when(F.col("_f").isNull(), "no such memory").when(F.col("retired_batch").isNotNull(), "already retired").when(F.col("kind") == "commitment", "a commitment")
        .when(F.col("disputed"), "carries a dispute").when(F.startswith("content", F.lit("Set aside")), "a note on a retirement").otherwise("retired")
    )
    return found.select("event_key", why.alias("outcome"))


def restore(rows: DataFrame, batch: str) -> DataFrame:
    """All rows, those of a batch no longer retired."""
    return rows.withColumn("retired_batch", F.when(F.col("retired_batch") != batch, F.col("retired_batch")))


def purge(rows: DataFrame, cited: DataFrame, batch: str) -> DataFrame:
    """What becomes of a batch's rows: 'purged', or 'kept' because a summary cites them."""
    own = rows.where(F.col("retired_batch") == batch)
    return own.join(cited.select(F.col("ref").alias("event_key")).distinct().withColumn("_c", F.lit(True)), "event_key", "left").select("event_key", F.when(F.col("_c"), "kept").otherwise("purged").alias("outcome"))


def archivable(end_turn: Column) -> Column:
    """Whether a row falls out of the working set: old, not a commitment, never important."""
    weight = F.greatest(F.col("salience"), K.effective_importance(F.col("importance"), F.col("salience")))
    return ~F.col("archived") & F.coalesce(F.col("turn_idx") < end_turn - KEEP_RECENT, F.lit(False)) & (end_turn > KEEP_RECENT) & (F.col("kind") != "commitment") & (weight < SALIENCE_FLOOR)


@dataclass
class Consolidation:
    """The outputs of one step: what is written, refused and archived, and where each bank's cursor is then."""

    summaries: DataFrame
    support: DataFrame
    refused: DataFrame
    archived: DataFrame
    cursors: DataFrame


def joined_gists(window: DataFrame) -> DataFrame:
    """(bank_id, scope, summary): the gists of a scope in chronological order, as a stand-in for a summarizer."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", "id", "gist"))), lambda x: x.gist), " ")
    return window.groupBy("bank_id", "scope").agg(text.alias("summary"))


def consolidate(rows: DataFrame, cursor: DataFrame, now: DataFrame, summarize: Callable[[DataFrame], DataFrame] = joined_gists, seen: Observation | None = None) -> Consolidation:
    """One window a bank, from its cursor to `now`: summaries by scope, their support, refusals and the archive sweep.

    `summarize` gets the window's rows with their scope and gives (bank_id, scope, summary). The
    first-hand scope is always written, as its end is the cursor; the others if they have text or rows.
    A bank whose window has first-hand rows but no first-hand text is refused: nothing of it is written
    or archived and its cursor stays. `seen`, an Observation, gets the numbers of windows and refusals
    when the cursors are written, so that a job can stop there. Windows without a row move nothing.
    """
    w = rows.join(cursor, "bank_id", "left").join(now, "bank_id").where("turn_idx > coalesce(cursor, 0) and turn_idx <= now and not archived and trim(content) <> ''")
    w = w.withColumn("scope", K.provenance_scope(F.col("provenance")))
    present = w.groupBy("bank_id", "scope").agg(F.count("*").alias("n_rows"), F.min("turn_idx").alias("a"), F.max("turn_idx").alias("b"))
    span = present.groupBy("bank_id").agg(F.min("a").alias("start_turn"), F.max("b").alias("end_turn"), F.sum(F.when(F.col("scope") == FIRST_HAND, F.col("n_rows")).otherwise(0)).alias("n_first_hand"))
    texts = summarize(w).select("bank_id", "scope", F.trim(F.coalesce("summary", F.lit(""))).alias("summary"))
    first = texts.where((F.col("scope") == FIRST_HAND) & (F.col("summary") != "")).select("bank_id", F.lit(True).alias("told"))
    judged = span.join(first, "bank_id", "left").withColumn("refused", (F.col("n_first_hand") > 0) & F.col("told").isNull())
    judged = stored(judged.select("bank_id", "start_turn", "end_turn", "n_first_hand", "refused"))
    good = judged.where("not refused").select("bank_id", "start_turn", "end_turn")
    slots = good.withColumn("scope", F.explode(F.array(*[F.lit(s) for s in (FIRST_HAND, "received", "surmise")])))
    written = slots.join(texts, ["bank_id", "scope"], "left").join(present.select("bank_id", "scope", "n_rows"), ["bank_id", "scope"], "left")
    written = written.where((F.col("scope") == FIRST_HAND) | (F.coalesce("summary", F.lit("")) != "") | F.col("n_rows").isNotNull())
    summaries = written.select("bank_id", "scope", "start_turn", "end_turn", F.coalesce("summary", F.lit("")).alias("summary"))
    place = F.concat_ws(":", F.col("bank_id").cast("string"), "scope")
    support = E.support_sets(summaries.select(place.alias("summary_id"), place.alias("scope"), "summary"), w.select(place.alias("scope"), F.col("event_key").alias("ref"), "content"))
    stale = rows.join(good.select("bank_id", "end_turn"), "bank_id").where(archivable(F.col("end_turn")))
    cursors = now.select("bank_id").join(cursor, "bank_id", "left").join(judged.select("bank_id", "end_turn", "refused"), "bank_id", "left")
    if seen is not None:
        cursors = cursors.observe(seen, F.count("end_turn").alias("windows"), F.count_if("refused").alias("refused"))
    return Consolidation(
        summaries, support, judged.where("refused").select("bank_id", "start_turn", "end_turn", "n_first_hand"), stale.select("bank_id", "id"),
        cursors.select("bank_id", F.coalesce(F.when(~F.col("refused"), F.col("end_turn")), "cursor", F.lit(0)).cast("long").alias("cursor")),
    )


def windows(rows: DataFrame) -> DataFrame:
    """Replay of the trigger over a bank's history: (bank_id, turn_idx) of each closing turn.

    A window closes after ten turns or forty rows since the last; the fold over a bank's per-turn
    counts is ordered, and one bank's turns are one row's array.
    """
    n = rows.groupBy("bank_id", "turn_idx").agg(F.count("*").alias("n"))
    t = n.groupBy("bank_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "n"))).alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        rows_ = s.n + x.n
        due = (x.turn_idx - s["at"] >= EVERY_TURNS) | (rows_ >= ROW_PRESSURE)
        return F.struct(F.when(due, x.turn_idx).otherwise(s["at"]).alias("at"), F.when(due, 0).otherwise(rows_).cast("long").alias("n"), F.when(due, F.concat(s.out, F.array(x.turn_idx))).otherwise(s.out).alias("out"))

    return t.select("bank_id", F.explode(F.aggregate("t", start, step)["out"]).alias("end_turn"))


def fold_threads(windows_: DataFrame) -> DataFrame:
    """Threads (bank_id, window_no, thread): the window where each was first opened, while carried on without a gap."""
    w = Window.partitionBy("bank_id", "thread").orderBy("window_no")
    gap = F.coalesce(F.col("window_no") - F.lag("window_no").over(w) > 1, F.lit(True)).cast("int")
    runs = windows_.distinct().withColumn("_g", gap).withColumn("_i", F.sum("_g").over(w))
    return runs.withColumn("since", F.min("window_no").over(Window.partitionBy("bank_id", "thread", "_i"))).drop("_g", "_i")


def close_threads(open_: DataFrame, answered: DataFrame) -> DataFrame:
    """Answered texts against the delivered list: position, opening and length of the list, or 'unknown'."""
    fold = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    n = Window.partitionBy("bank_id")
    listed = open_.select("bank_id", fold("thread").alias("thread"), "since", "pos", F.count("*").over(n).alias("of"))
    asked = answered.select("bank_id", fold("thread").alias("thread")).where("thread <> ''").distinct()
    return asked.join(listed, ["bank_id", "thread"], "left").withColumn("outcome", F.when(F.col("pos").isNull(), "unknown").otherwise("closed"))
