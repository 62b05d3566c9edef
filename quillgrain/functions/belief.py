"""Arithmetic of confidences and the reading of claims."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrain.functions.text import bind, clamp, words_list

# Ceilings, plasticities, half-lives and cues of the kinds of belief.
CAPS = {"observation": 1.0, "stated_fact": 0.9, "preference": 0.8, "goal": 0.65, "trait": 0.45, "identity": 0.35}
PLASTICITY = {"observation": 0.75, "stated_fact": 0.85, "preference": 0.45, "goal": 0.5, "trait": 0.25, "identity": 0.2}
HALF_LIFE = {"observation": 5, "stated_fact": 18, "preference": 300, "goal": 45, "trait": 400, "identity": 400}
DEFAULT_KIND, MATCH, MAX_SUPPRESSION, FLOOR, PER_SUBJECT = "goal", 0.4, 0.6, 0.05, 30
STOPWORDS = (
    "a an the is are was were be been being seems seem appears appear of to about that this these those they them their "
    "he she him her his hers it its and or but with for on in at as has have had will would may might can could from by "
    "so not than then into up out if no there around near toward when while very just still"
).split()
KIND_CUES = {
    "stated_fact": r"\b(?:said|told|stated|claimed|admitted|confirmed|announced)\b",
    "identity": r"\b(?:is really|is actually|must be the|is the one who|goes by)\b",
    "trait": r"\b(?:always|never|(?:kind|sort|type) of person|by nature|tends to)\b",
    "preference": r"\b(?:prefers?|likes?|dislikes?|hates?|favou?rite|rather (?:than|have|use))\b|\bwants? (?:it|things|answers|responses) \b",
    "goal": r"\b(?:wants? to|intends?|plans? to|trying to|means to|hopes? to|aims? to|is going to|working (?:on|toward))\b",
}
NEGATIONS = [
    r"\bnot\b", r"\bno longer\b", r"\bnever\b", r"\bn't\b", r"\bnone\b", r"\bstopped\b", r"\bceased\b", r"\bdenies\b",
    r"\bdenied\b", r"\bdoesn'?t\b", r"\bdidn'?t\b", r"\bisn'?t\b", r"\bwasn'?t\b", r"\bwon'?t\b", r"\bcan'?t\b",
    r"\bcannot\b", r"\bwithout\b", r"\bdis(?:likes?|agrees?|prefers?)\b", r"\bun(?:like|willing)\b", r"\brather than\b",
    r"\binstead of\b", r"\bopposed to\b",
]


def by_kind(values: dict, kind: Column) -> Column:
    """A value looked up by kind; an unknown kind takes the default kind's."""
    out = F.lit(float(values[DEFAULT_KIND]))
    for name, v in values.items():
        out = F.when(kind == name, F.lit(float(v))).otherwise(out)
    return out


def known_kind(kind: Column) -> Column:
    return F.when(kind.isin(list(CAPS)), kind).otherwise(DEFAULT_KIND)


def mint_salience(confidence: Column) -> Column:
    return F.round(0.45 + 0.3 * clamp(confidence), 4)


def mint_confidence(salience: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (salience - 0.45) / 0.3))


def abandoned_confidence(salience: Column) -> Column:
    """Where an inference rests that no live belief carries; a function of salience alone."""
    mint = mint_confidence(salience)
    return F.least(mint, F.greatest(F.lit(0.08), mint * 0.55))


def decayed(confidence: Column, kind: Column, elapsed: Column) -> Column:
    """Halved once in each half-life of the kind."""
    return clamp(confidence) * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), elapsed.cast("double")) / by_kind(HALF_LIFE, kind))


def claim_tokens(text: Column) -> Column:
    """Distinct words of a claim without stop words; if it has no others, all of them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0)))
    kept = lambda w: bind(F.array_except(w, words_list(STOPWORDS)), lambda k: F.when(F.size(k) > 0, k).otherwise(w))
    return bind(words, kept)


def _start(cue: str) -> str:
    """The letters that a cue begins with, so that a text without them isn't searched for it."""
    letters, optional = re.match(r"\\b([a-z' ]+)([?*{|]?)", cue).groups()
    return letters[:-1] if optional else letters


def polarity(claim: Column) -> Column:
    """1, or -1 for an odd number of matching negation cues."""
    def sign(low: Column) -> Column:
        hits = sum(((F.contains(low, F.lit(_start(c))) & low.rlike(f"(?U){c}")).cast("int") for c in NEGATIONS), F.lit(0))
        return F.when(hits % 2 == 1, -1).otherwise(1)

    return bind(F.lower(F.coalesce(claim, F.lit(""))), sign)


def claim_parts(claim: Column, subject: Column) -> Column:
    """What is compared of a claim: its polarity, and its words without those of the subject, if any are left."""
    def own(words: Column) -> Column:
        rest = F.array_except(words, claim_tokens(subject))
        return bind(rest, lambda r: F.when((F.coalesce(subject, F.lit("")) != "") & (F.size(r) > 0), r).otherwise(words))

    return F.struct(polarity(claim).alias("polarity"), bind(claim_tokens(claim), own).alias("words"))


def parts_similarity(a: Column, b: Column) -> Column:
    """0 for opposite polarity, 1 for a subset, else shared words over those of the smaller claim."""
    ta, tb = a["words"], b["words"]
    both, least = F.size(F.array_intersect(ta, tb)), F.least(F.size(ta), F.size(tb))
    over = F.when(least == 0, F.when(F.size(ta) == F.size(tb), 1.0).otherwise(0.0)).when(both == least, 1.0).otherwise(both / least)
    return F.when(a["polarity"] != b["polarity"], 0.0).otherwise(over)


def claim_similarity(a: Column, b: Column, subject: Column) -> Column:
    """How alike two claims on a subject are, by their parts."""
    return parts_similarity(claim_parts(a, subject), claim_parts(b, subject))


def inferred_kind(claim: Column) -> Column:
    """The kind that the claim's own words suggest, by the first group of cues that matches; else null."""
    low = F.lower(F.coalesce(claim, F.lit("")))
    out = F.lit(None).cast("string")
    for kind, cues in reversed(KIND_CUES.items()):
        out = F.when(low.rlike(f"(?U){cues}"), kind).otherwise(out)
    # one search for all cues, wherever in a word they lie, spares most claims the others
    return F.when(low.rlike("|".join(KIND_CUES.values()).replace(r"\b", "")), out)


def effective_kind(declared: Column, claim: Column) -> Column:
    """Of the declared and the inferred kind the one with the lower ceiling."""
    own = known_kind(declared)
    return bind(inferred_kind(claim), lambda seen: F.when(seen.isNotNull() & (by_kind(CAPS, seen) < by_kind(CAPS, own)), seen).otherwise(own))


def hypothesis_key(about: Column, kind: Column, claim: Column) -> Column:
    return F.concat_ws("|", F.trim(about), known_kind(kind), F.trim(claim))
