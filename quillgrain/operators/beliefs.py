"""The belief store: ordered merging of claims with competition, decay and pruning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrain.functions import belief as B
from quillgrain.functions.text import bind

STORE = "bank_id long, about string, kind string, claim string, confidence double, first_seen_turn long, last_updated_turn long"
COLUMNS = [c.split()[0] for c in STORE.split(", ")]
FOLDED = ["bank_id", "about", "kind", "claim", "confidence", "turn", "polarity", "words"]
HELD = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (c.split() for c in STORE.split(", "))])


class Subject:
    """What is held about one subject; updates come in the order of their turns."""

    def __init__(self, held: list[dict]):
        self.held = held

    def live(self, h: dict, turn: int) -> float:
        gone = turn - h["last_updated_turn"]
        return h["confidence"] * 0.5 ** (gone / B.HALF_LIFE[h["kind"]]) if gone > 0 else h["confidence"]

    def similarity(self, a: dict, b: dict) -> float:
        x, y = a["words"], b["words"]
        if a["polarity"] != b["polarity"]:
            return 0.0
        if x <= y or y <= x:
            return 1.0 if x and y else float(x == y)
        return len(x & y) / min(len(x), len(y))

    def update(self, u: dict) -> None:
        """A claim that matches one of its kind is blended into it; another competes and dampens its siblings."""
        kind, turn, seen = u["kind"], u["turn"], u["confidence"]
        cap, pull = B.CAPS[kind], B.PLASTICITY[kind]
        group = [h for h in self.held if h["kind"] == kind]
        best, most = None, 0.0
        for h in group:
            if (s := self.similarity(u, h)) > most:
                best, most = h, s
                if s == 1.0:  # none is more alike
                    break
        if best is not None and most >= B.MATCH:
            old = self.live(best, turn)
            best |= {k: u[k] for k in ("claim", "words", "polarity")}
            best["confidence"] = max(0.0, min(max(cap, old), old + (seen - old) * pull))
            best["last_updated_turn"] = max(turn, best["last_updated_turn"])
        else:
            damp = 1 - min(B.MAX_SUPPRESSION, pull * seen)
            for h in group:
                h["confidence"] = max(0.0, self.live(h, turn) * damp)
                h["last_updated_turn"] = max(turn, h["last_updated_turn"])
            self.held.append({k: u[k] for k in ("kind", "claim", "words", "polarity")} | {"confidence": max(0.0, min(cap, seen)), "first_seen_turn": turn, "last_updated_turn": turn})

    def sweep(self, turn: int) -> None:
        """Faded claims go, and beyond thirty the weakest."""
        ranked = sorted(((self.live(h, turn), -i) for i, h in enumerate(self.held)), reverse=True)
        self.held = [self.held[-i] for c, i in ranked if c >= B.FLOOR][: B.PER_SUBJECT]

    def run(self, updates: list[dict]) -> None:
        for i, u in enumerate(updates):
            self.update(u)
            if i + 1 == len(updates) or updates[i + 1]["turn"] != u["turn"]:
                self.sweep(u["turn"])


def read_claims(updates: DataFrame) -> DataFrame:
    """Updates with the effective kind, the polarity and the words that say something about the subject."""
    def telling(words):
        return bind(F.array_except(words, B.claim_tokens(F.col("about"))), lambda rest: F.when(F.size(rest) > 0, rest).otherwise(words))

    return updates.where("trim(claim) <> ''").select(
        "bank_id", F.coalesce(F.nullif(F.trim("about"), F.lit("")), F.lit("unknown")).alias("about"), B.effective_kind(F.col("kind"), F.col("claim")).alias("kind"),
        F.trim("claim").alias("claim"), F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")), F.lit(0.5)).alias("confidence"), "turn", "seq",
        B.polarity(F.col("claim")).alias("polarity"), bind(B.claim_tokens(F.col("claim")), telling).alias("words"),
    )


def fold_subjects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds updates in the order of (bank, subject, turn, seq) as they stream in.

    One subject's claims are held, thirty at most, and its updates of the last turn; batches may end anywhere.
    """
    key, s, pending = None, Subject([]), []
    told: dict[str, frozenset] = {}  # of one batch

    def rows() -> list[dict]:
        s.run(pending)
        return [{"bank_id": key[0], "about": key[1]} | {k: h[k] for k in COLUMNS[2:]} for h in s.held]

    for b in batches:
        done = []
        told.clear()
        for *own, kind, claim, confidence, turn, polarity, words in zip(*(b.column(c).to_pylist() for c in FOLDED), strict=True):
            if own != key:
                done += rows() if key else []
                key, s, pending = own, Subject([]), []
            elif pending and pending[-1]["turn"] != turn:
                s.run(pending)
                pending = []
            if (said := told.get(words)) is None:
                said = told[words] = frozenset(words.split())
            pending.append({"kind": kind, "claim": claim, "confidence": confidence, "turn": turn, "polarity": polarity, "words": said})
        if done:
            yield pa.RecordBatch.from_pylist(done, HELD)
    if key:
        yield pa.RecordBatch.from_pylist(rows(), HELD)


def merge(updates: DataFrame) -> DataFrame:
    """The belief store after all updates, folded for each (bank, subject) in the order of (turn, seq).

    Subjects follow each other in a task and no group is collected; words of a claim hold no space and go as one text.
    """
    own = ["bank_id", "about"]
    rows = read_claims(updates).withColumn("words", F.array_join("words", " "))
    return rows.repartition(*own).sortWithinPartitions(*own, "turn", "seq").select(*FOLDED).mapInArrow(fold_subjects, STORE)


def live(turn) -> object:
    return B.decayed(F.col("confidence"), F.col("kind"), turn - F.col("last_updated_turn"))


def sweep(store: DataFrame, turn) -> DataFrame:
    """What stays at a turn: live confidence of 0.05 or more, thirty of a subject at most."""
    w = Window.partitionBy("bank_id", "about").orderBy(F.desc("live"), "kind", "claim")
    return store.withColumn("live", F.round(live(turn), 9)).where(F.col("live") >= B.FLOOR).withColumn("r", F.row_number().over(w)).where(F.col("r") <= B.PER_SUBJECT).drop("r")


def active_sheet(store: DataFrame, incumbents: DataFrame, turn, size: int = 5, margin: float = 0.08) -> DataFrame:
    """The few hypotheses in mind: incumbents keep their place unless beaten by the margin."""
    k = B.hypothesis_key(F.col("about"), F.col("kind"), F.col("claim"))
    rows = store.withColumns({"key": k, "live": F.round(live(turn), 9)}).join(incumbents.select("bank_id", "key").distinct().withColumn("held", F.lit(True)), ["bank_id", "key"], "left")
    score = F.round(F.col("live") + F.when(F.col("held"), margin).otherwise(0.0), 9)
    w = Window.partitionBy("bank_id").orderBy(F.desc("score"), "key")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).select("bank_id", "rank", "key", "live")


def leading(store: DataFrame, turn, competitors: int = 2) -> DataFrame:
    """Per (subject, kind) the leading claim and its competitors."""
    w = Window.partitionBy("bank_id", "about", "kind").orderBy(F.desc("c"), "claim", "last_updated_turn")
    # nine places first, as everywhere in the store: a half then goes up, whatever the last bits of the power are
    rows = store.withColumn("c", F.round(F.round(live(turn), 9), 3)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= competitors + 1)
    return rows.select("bank_id", "about", "kind", "rank", "claim", F.col("c").alias("confidence"))


def credence(asked: DataFrame, store: DataFrame, turn) -> DataFrame:
    """Asked (bank_id, about, asked_id, claim): the live confidence of the best match of 0.4 or more, else null.

    Each different claim of a subject is looked up once, and its words are worked out before it meets
    what the subject holds.
    """
    parts = B.claim_parts(F.col("claim"), F.col("about"))
    key = ["bank_id", "about", "claim"]
    s = store.select("bank_id", "about", F.col("claim").alias("held_claim"), live(turn).alias("live"), parts.alias("held"))
    pairs = asked.select(*key).distinct().withColumn("own", parts).join(s, ["bank_id", "about"], "left")
    sim = F.when(F.col("held_claim").isNotNull(), B.parts_similarity(F.col("own"), F.col("held")))
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last("sim"), "held_claim", F.desc("live"))
    best = pairs.withColumn("sim", sim).withColumn("r", F.row_number().over(w)).where("r = 1")
    found = best.select(*key, F.when(F.col("sim") >= B.MATCH, F.col("live")).alias("credence"))
    return asked.join(found, key, "left").select("asked_id", *key, "credence")


def reconcile(inferences: DataFrame, credences: DataFrame) -> DataFrame:
    """Confidence of inferences moved to current belief; without one it rests at the abandoned value."""
    rest = B.abandoned_confidence(F.col("salience"))
    rows = inferences.join(credences.select(F.col("asked_id").alias("id"), "credence"), "id", "left")
    new = F.round(F.greatest(F.coalesce("credence", rest), rest), 4)
    return rows.withColumn("revised", new).withColumn("changed", F.abs(F.col("revised") - F.col("confidence")) > 1e-6)
