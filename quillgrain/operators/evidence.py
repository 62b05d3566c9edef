"""Evidence on hypotheses: readings, bounded confidence, disputes, citations and conclusions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The prior, the steps and the band of a dispute.
PRIOR, MAX_STEP, SUPPORT, CONTRADICT, BAND = 0.3, 0.4, 0.35, 0.45, (0.35, 0.65)


def readings(observations: DataFrame) -> DataFrame:
    """Marks each observation of a (hypothesis, url): `fresh` for the first, `flipped` for a reversal."""
    w = Window.partitionBy("hypothesis_id", "url").orderBy("seq")
    before = F.lag("stance").over(w)
    sides = ["supports", "contradicts"]
    stance = F.when(F.col("stance").isin(*sides), F.col("stance")).otherwise("context")
    rows = observations.withColumn("stance", stance)
    return rows.withColumns({
        "reading": F.row_number().over(w), "before": before, "fresh": before.isNull(),
        "flipped": F.coalesce(before.isin(*sides) & F.col("stance").isin(*sides) & (before != F.col("stance")), F.lit(False)),
    })


def _pin(c: Column) -> Column:
    return F.greatest(F.lit(BAND[0]), F.least(F.lit(BAND[1]), c))


def confidence(observations: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Per hypothesis: confidence, status, current supports and contradictions, reversals.

    A fold over the ordered readings of one hypothesis. A fresh reading moves the confidence by a
    bounded step; both sides present, or one source that reversed itself, is a dispute, which pins
    the confidence into the middle from then on. The array of one hypothesis is one row's value.
    """
    rows = readings(observations).groupBy("hypothesis_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stance", "before", "fresh", "flipped"))).alias("x"))
    zero = F.lit(0)
    start = F.struct(F.lit(prior).alias("c"), zero.alias("s"), zero.alias("k"), F.lit(False).alias("d"), zero.alias("f"))

    def step(st: Column, x: Column) -> Column:
        n = lambda side: F.when(x.stance == side, 1).otherwise(0) - F.when(F.coalesce(x.before == side, F.lit(False)), 1).otherwise(0)
        moved = F.when(x.stance == "supports", st.c + F.least(F.lit(MAX_STEP), SUPPORT * (1 - st.c))).when(x.stance == "contradicts", st.c - F.least(F.lit(MAX_STEP), CONTRADICT * st.c)).otherwise(st.c)
        c = F.round(F.when(st.d, _pin(moved)).otherwise(moved), 4)
        both = (st.s + n("supports") > 0) & (st.k + n("contradicts") > 0)
        on_fresh = F.when(both, F.round(_pin(c), 4)).otherwise(c)
        new_c = F.when(x.fresh, on_fresh).when(x.flipped, F.round(_pin(st.c), 4)).otherwise(st.c)
        disputed = st.d | (x.fresh & both) | x.flipped
        return F.struct(new_c.alias("c"), (st.s + n("supports")).alias("s"), (st.k + n("contradicts")).alias("k"), disputed.alias("d"), (st.f + x.flipped.cast("int")).alias("f"))

    out = rows.select("hypothesis_id", F.aggregate("x", start, step).alias("z"))
    return out.select("hypothesis_id", F.col("z.c").alias("confidence"), F.when(F.col("z.d"), "disputed").otherwise("open").alias("status"), F.col("z.s").alias("n_supports"), F.col("z.k").alias("n_contradicts"), F.col("z.f").alias("n_flips"))


def current(observations: DataFrame) -> DataFrame:
    """The latest reading of each source; its id is that of the first."""
    w = Window.partitionBy("hypothesis_id", "url").orderBy(F.desc("seq"))
    return observations.withColumns({"first_seq": F.min("seq").over(Window.partitionBy("hypothesis_id", "url")), "_r": F.row_number().over(w)}).where("_r = 1").drop("_r")


def tally(observations: DataFrame) -> DataFrame:
    """Numbers of current readings by stance."""
    return current(observations).groupBy("hypothesis_id").pivot("stance", ["supports", "contradicts", "context"]).count().fillna(0)


def grounded(citations: DataFrame, delivered: DataFrame, key: str = "answer_id") -> DataFrame:
    """Each distinct citation in order, with whether it was delivered; others are to be dropped with a warning."""
    refs = citations.select(key, F.posexplode(F.array_distinct("refs")).alias("pos", "ref")).where(F.trim("ref") != "")
    return refs.join(delivered.select(key, "ref").distinct().withColumn("delivered", F.lit(True)), [key, "ref"], "left").fillna(False, ["delivered"])


def grounding_status(refs: DataFrame, delivered: DataFrame, bank: DataFrame) -> DataFrame:
    """'delivered', 'in_bank' (recall missed it) or 'invented' for each cited reference."""
    seen = delivered.select("answer_id", "ref").distinct().withColumn("_d", F.lit(1))
    held = bank.select("ref").distinct().withColumn("_b", F.lit(1))
    rows = refs.withColumn("ref", F.regexp_replace("ref", "^event:", "")).join(seen, ["answer_id", "ref"], "left").join(held, "ref", "left")
    return rows.withColumn("status", F.when(F.col("_d").isNotNull() | (F.col("ref") == "current"), "delivered").when(F.col("_b").isNotNull(), "in_bank").otherwise("invented")).drop("_d", "_b")


def hedge(hypotheses: DataFrame, observations: DataFrame, n: int = 3) -> DataFrame:
    """A drily honest answer out of the evidence: a status line, then up to n readings of each side."""
    rows = current(observations).where("stance in ('supports', 'contradicts')")
    w = Window.partitionBy("hypothesis_id", "stance").orderBy("first_seq")
    top = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    line = F.concat(F.lit("- "), "stance", F.lit(" [ev:"), F.col("first_seq").cast("string"), F.lit("] ("), "url", F.lit(")"))
    side = F.when(F.col("stance") == "supports", 0).otherwise(1)
    lines = top.groupBy("hypothesis_id").agg(F.array_sort(F.collect_list(F.struct(side.alias("side"), "r", line.alias("line")))).alias("l"), F.count_if(F.col("stance") == "supports").alias("n_s"))
    status = F.when(F.col("status") == "disputed", "Sources disagree on this.").when(F.coalesce("n_s", F.lit(0)) > 0, "Best supported reading so far.").otherwise("No well-supported answer was established.")
    return hypotheses.join(lines, "hypothesis_id", "left").select("hypothesis_id", F.concat_ws("\n", status, F.array_join(F.transform("l", lambda x: x.line), "\n")).alias("answer"), "confidence")


def accepted(hypotheses: DataFrame, grounding: DataFrame) -> DataFrame:
    """Whether a conclusion may stand: grounded, and confident, disputed or wholly from testimony."""
    g = grounding.groupBy("hypothesis_id").agg(F.count_if("delivered").alias("n_refs"), F.every(F.col("testimony")).alias("told"))
    ok = (F.col("n_refs") > 0) & ((F.col("confidence") >= 0.6) | (F.col("status") == "disputed") | ((F.col("n_supports") + F.col("n_contradicts") == 0) & F.coalesce("told", F.lit(False))))
    return hypotheses.join(g, "hypothesis_id", "left").withColumn("accepted", F.coalesce(ok, F.lit(False)))


def support_sets(summaries: DataFrame, memories: DataFrame, least: int = 3, refs: int = 3) -> DataFrame:
    """Per clause of a summary the rows of its scope that share at least `least` content words, best first.

    Texts of summaries and word sets of rows are dealt by scope, once; words meet inside the tasks, so neither words nor
    pairs are shuffled. A scope's rows lie in one task: callers keep scopes small. A clause without support stays,
    which is a finding.
    """
    from quillgrain.functions import text as T

    known = memories.where("scope is not null").select("scope", F.lit(False).alias("own"), "ref", T.content_words("content").alias("held"))
    rows = known.unionByName(summaries.select("scope", F.lit(True).alias("own"), "summary_id", "summary"), allowMissingColumns=True)
    dealt = rows.repartition("scope").sortWithinPartitions("scope", "own")
    each = dealt.select("scope", "own", "summary_id", "ref", "held", F.posexplode_outer(F.when(F.col("own"), T.clauses("summary"))).alias("pos", "claim")).where("not own or pos is not null")
    words = F.when(F.col("own"), T.content_words("claim")).otherwise(F.col("held"))
    schema = each.select("summary_id", "pos", "claim", F.array("ref").alias("support_refs")).schema
    return each.select("scope", "own", "summary_id", "pos", "claim", "ref", words.alias("words")).mapInArrow(_supported(least, refs), schema)


def _supported(least: int, refs: int, room: int = 20_000):
    """A task over rows by scope, a scope's memories before its clauses: each clause with the `refs` best memories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, room
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= most:
                t = pa.Table.from_batches(held).combine_chunks()
                last = _starts(t)[-1]  # the last scope may go on
                if last:
                    yield from answers(t[:last])
                held, n = t[last:].to_batches(), len(t) - last
                most = max(room, 2 * n)
        if n:
            yield from answers(pa.Table.from_batches(held).combine_chunks())

    def answers(t: pa.Table) -> Iterator[pa.RecordBatch]:
        own, starts = _column(t, "own").to_numpy(zero_copy_only=False), _starts(t)
        words, names, ids = _column(t, "words"), _column(t, "ref").dictionary_encode(), _column(t, "summary_id").dictionary_encode().indices
        size = words.value_lengths().to_numpy(zero_copy_only=False)
        at = np.r_[0, np.cumsum(size)]
        codes = words.flatten().dictionary_encode()
        place, codes = np.full(len(codes.dictionary), -1), codes.indices.to_numpy()
        ref = names.indices.fill_null(len(names.dictionary)).to_numpy()
        spelled = [*names.dictionary.to_pylist(), None]
        pos, told = _column(t, "pos").fill_null(0).to_numpy().astype(np.int64), ids.fill_null(-1).to_numpy().astype(np.int64)
        found, count = [], np.zeros(len(t), np.int64)
        for s, e in zip(starts, [*starts[1:], len(t)], strict=True):
            mid = s + int((~own[s:e]).sum())
            if mid == s or mid == e:
                continue
            # words and rows of the scope by number, rows by their names
            known = np.unique(codes[at[s] : at[mid]])
            place[known] = np.arange(len(known))
            order = sorted(set(ref[s:mid].tolist()), key=lambda r: (spelled[r] is not None, spelled[r]))
            rank = {r: k for k, r in enumerate(order)}
            has = (place[codes[at[s] : at[mid]]], np.repeat([rank[r] for r in ref[s:mid].tolist()], size[s:mid]))
            # rows of one summary and place are one clause
            _, clause = np.unique(np.stack([told[mid:e], pos[mid:e]]), axis=1, return_inverse=True) if e - mid > 1 else (None, np.zeros(1, np.int64))
            asked, word = np.repeat(clause.ravel(), size[mid:e]), place[codes[at[mid] : at[e]]]
            place[known] = -1
            asked, word = asked[word >= 0], word[word >= 0]
            if len(word):
                turn = np.argsort(asked, kind="stable")
                asked, word = asked[turn], word[turn]
                first = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]])
                best = _best(len(known), len(order), has, word, first, least, refs)
                to = np.full(int(clause.max()) + 1, len(first))
                to[asked[first]] = np.arange(len(first))
                best = np.r_[best, np.full((1, refs), -1)][to[clause.ravel()]]
                best[told[mid:e] < 0] = -1
                count[mid:e] = (best >= 0).sum(axis=1)
                found.append(np.array(order)[best[best >= 0]])
        rows = np.flatnonzero(own)
        taken = np.concatenate([np.empty(0, np.int64), *found])
        name = pa.array(np.where(taken == len(spelled) - 1, 0, taken), mask=taken == len(spelled) - 1)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count[rows])].astype(np.int32)), names.dictionary.take(name))
        if len(rows):
            yield pa.record_batch([*(_column(t, c).take(pa.array(rows)) for c in ("summary_id", "pos", "claim")), lists], ["summary_id", "pos", "claim", "support_refs"])

    return run


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _starts(t: pa.Table) -> list[int]:
    """Where a scope starts; no scope is one, too."""
    code = _column(t, "scope").dictionary_encode().indices.fill_null(-1).to_numpy()
    return np.flatnonzero(np.r_[True, code[1:] != code[:-1]]).tolist()


def _best(n_words: int, n_rows: int, has: tuple[np.ndarray, np.ndarray], word: np.ndarray, first: np.ndarray, least: int, refs: int) -> np.ndarray:
    """Per clause, whose words start at `first`, the `refs` rows that share most, at least `least`; -1 where there are fewer."""
    best = np.full((len(first), refs), -1)
    wide = max(1, min(n_rows, (1 << 22) // max(len(word), n_words)))
    for low in range(0, n_rows, wide):
        here = (has[1] >= low) & (has[1] < low + wide)
        held = np.bincount(has[0][here] * wide + has[1][here] - low, minlength=n_words * wide).reshape(n_words, wide)
        n = np.add.reduceat(held[word], first)
        score = np.where(n >= least, n * n_rows + n_rows - 1 - low - np.arange(wide), -1)
        best = np.sort(np.concatenate([best, score], axis=1), axis=1)[:, : -refs - 1 : -1]
    return np.where(best >= 0, n_rows - 1 - best % n_rows, -1)
