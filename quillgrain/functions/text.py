"""Text functions on columns: gists, entities, cue scores, token sets, cuts and saliences."""

from __future__ import annotations

import heapq
import itertools
import operator
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Word lists, patterns and limits that the results depend on.
STOPWORDS = (
    "about after again against because before being could does from have into itself might other should "
    "something their there these they this through under what when where which while with would your said "
    "says then that were been"
).split()
SUPPORT_STOPWORDS = (
    "a an and are as at be been but by for from had has have he her him his i in into is it its me my not of on "
    "or she that the their them then there they this to was were what when where which who will with you your"
).split()
BLOCKED_ENTITIES = ["You", "The", "This", "That", "Then", "Your", "They", "Something", "What", "When", "Where"]
OLD_CUES = r"\b(?:long ago|weeks? ago|months? ago|back then|earliest|first time|originally)\b"
RECENT_CUES = r"\b(?:recently|just now|a moment ago|last time|just happened)\b"
SALIENCE_MARKERS = [
    "deadline", "decided", "decision", "prefer", "always", "never", "important", "remember", "budget", "name is",
    "birthday", "project", "launch", "wrong", "correct", "instead", "moved", "cancel", "promise",
]
PHRASE_TOKEN = re.compile(r"[a-z0-9'-]{3,}")
GIST, EXCERPT, OBSERVATION, OBSERVATION_HEAD, EPISODE, CELL = 240, 600, 4000, 1200, 1200, 2000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f mentions it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words_list(words: list[str]) -> Column:
    """An array of fixed words."""
    return F.array(*[F.lit(w) for w in words])


def clamp(value: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    """A number held in [lo, hi]; what isn't a number is lo."""
    v = F.expr(f"try_cast({value} as double)") if isinstance(value, str) else value.try_cast("double")
    return F.coalesce(F.when(~F.isnan(v), F.greatest(F.lit(lo), F.least(F.lit(hi), v))), F.lit(lo))


def squeeze(text: Column | str) -> Column:
    """White space collapsed to single spaces, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space at both ends; a text that has none there isn't searched for it."""
    outer = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(outer.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def gist(text: Column | str, limit: int = GIST) -> Column:
    """The whole sentences that fit in `limit` characters, else the words that do.

    Sentences past the limit can't fit, so only the first limit + 2 characters are split.
    """
    t = squeeze(text)
    start = F.struct(F.lit("").alias("o"), F.lit(False).alias("full"))

    def take(s: Column, part: Column) -> Column:
        longer = F.trim(F.concat(s.o, F.lit(" "), part))
        fits = ~s.full & (F.length(longer) <= limit)
        return F.struct(F.when(fits, longer).otherwise(s.o).alias("o"), (~fits).alias("full"))

    parts = F.split(F.substring(t, 1, limit + 2), r"(?<=[.!?])\s+")
    whole = F.aggregate(parts, start, take, lambda s: s.o)
    return F.when(F.length(t) <= limit, t).when(whole != "", whole).otherwise(F.regexp_replace(F.substring(t, 1, limit), " [^ ]*$", ""))


def entities(text: Column | str, limit: int = 12) -> Column:
    """Runs of one to three capitalised words, without the blocked ones, in the order of first sight."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"(?U)\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b"), F.lit(0))
    return F.slice(F.filter(F.array_distinct(found), lambda x: ~x.isin(BLOCKED_ENTITIES)), 1, limit)


def phrase_tokens(text: Column | str) -> Column:
    """Lower-case tokens of three characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("[a-z0-9'-]{3,}"), F.lit(0))


def _weighted(text: str | None, stop: set[str], limit: int) -> list[tuple[str, float]]:
    """The best words (weight 1) and pairs of neighbours (1.5) without stop words: by weight, then pairs first, then by letters."""
    words = PHRASE_TOKEN.findall((text or "").lower())
    fit = [w not in stop for w in words]
    weight = Counter({w: float(n) for w, n in Counter(itertools.compress(words, fit)).items()})
    for pair, n in Counter(zip(itertools.compress(words, map(operator.and_, fit, fit[1:])), itertools.compress(words[1:], map(operator.and_, fit, fit[1:])), strict=True)).items():
        weight[" ".join(pair)] = 1.5 * n
    return heapq.nsmallest(limit, weight.items(), key=lambda x: (-x[1], " " not in x[0], x[0]))


@F.pandas_udf(ArrayType(StringType()))
def ranked_phrases(texts: pd.Series, stop: pd.Series) -> pd.Series:
    """The 24 best phrases of each text."""
    known = set(stop.iloc[0]) if len(stop) else set()
    return texts.map(lambda t: [p for p, _ in _weighted(t, known, 24)])


def weighted_phrases(text: Column | str, limit: int) -> Column:
    """The best phrases of a text with their weights, best first; counted inside the row, without a shuffle."""

    @F.pandas_udf("array<struct<phrase:string,weight:double>>")
    def best(texts: pd.Series, stop: pd.Series) -> pd.Series:
        known = set(stop.iloc[0]) if len(stop) else set()
        return texts.map(lambda t: [{"phrase": p, "weight": w} for p, w in _weighted(t, known, limit)])

    return best(_col(text), words_list(STOPWORDS))


def key_phrases(text: Column | str, names: Column, limit: int = 12) -> Column:
    """Quoted spans, then names, then the best words and pairs; each once whatever its case, `limit` in all.

    At most `limit` - 1 ranked phrases can be spoken for already, so 24 of them are enough.
    """
    t = F.coalesce(_col(text), F.lit(""))
    quoted = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r'(?d)["“](.{3,100}?)[”"]'), F.lit(1)), squeeze), lambda q: q != "")
    ranked = ranked_phrases(t, words_list(STOPWORDS))

    def once(every: Column) -> Column:
        return bind(F.transform(every, F.lower), lambda low: F.filter(every, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))

    first = bind(F.concat(quoted, F.coalesce(names, F.array().cast("array<string>"))), lambda x: F.slice(once(x), 1, limit))
    return F.slice(bind(F.concat(first, ranked), once), 1, limit)


def query_terms(text: Column | str, limit: int = 16) -> Column:
    """Distinct tokens of a query without stop words, at most `limit`."""
    return F.slice(F.array_distinct(F.filter(phrase_tokens(text), lambda x: ~x.isin(STOPWORDS))), 1, limit)


def temporal_mode(text: Column | str) -> Column:
    """'old', 'recent' or 'neutral' by the cue words of a query; old is looked for first."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    return F.when(t.rlike(OLD_CUES), "old").when(t.rlike(RECENT_CUES), "recent").otherwise("neutral")


def exact_cue_score(phrases: Column, names: Column, query: Column) -> Column:
    """1.0 for a phrase inside the query, 0.8 for a query inside a phrase, 0.7 for a name inside it."""
    q = F.lower(F.coalesce(query, F.lit("")))
    by_phrase = F.transform(phrases, lambda p: F.when((F.trim(p) != "") & F.contains(q, F.lower(F.trim(p))), 1.0).when((F.trim(p) != "") & F.contains(F.lower(F.trim(p)), q) & (F.length(q) >= 4), 0.8).otherwise(0.0))
    by_name = F.transform(names, lambda n: F.when(F.contains(q, F.lower(n)), 0.7).otherwise(0.0))
    best = F.array_max(F.concat(F.array(F.lit(0.0)), F.coalesce(by_phrase, F.array().cast("array<double>")), F.coalesce(by_name, F.array().cast("array<double>"))))
    return F.when(q == "", 0.0).otherwise(best)


def token_set(text: Column | str) -> Column:
    """Distinct lower-case tokens of letters, digits and apostrophes, three or longer."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("[a-z0-9']{3,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def content_words(text: Column | str) -> Column:
    """Token set without the words that carry no content."""
    return F.array_except(token_set(text), words_list(SUPPORT_STOPWORDS))


def clauses(text: Column | str) -> Column:
    """Parts that end in a sentence mark and are followed by a capital or a quote."""
    return F.filter(F.transform(F.split(squeeze(text), "(?<=[.!?])\\s+(?=[A-Z\"'“‘])"), lambda c: F.trim(c)), lambda c: c != "")


def first_sentence(text: Column | str, limit: int = GIST) -> Column:
    """The first sentence, cut with an ellipsis at the limit.

    What follows limit + 1 words, each of a character and a space at least, can't be in it.
    """
    head = F.regexp_extract(F.coalesce(_col(text), F.lit("")), rf"(?U)\A\s*+(?:\S++\s++){{0,{limit}}}+\S*+\s?", 0)
    cut = lambda s: F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…"))).otherwise(s)
    return bind(F.element_at(F.split(squeeze(head), r"(?<=[.!?])\s+", 2), 1), cut)


def identifier_tokens(text: Column | str, stop: list[str] | None = None) -> Column:
    """Token set of identifiers: whole names and their snake and camel parts, lower case, longer than two characters."""
    names = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))
    parts = F.filter(F.flatten(F.transform(names, lambda t: F.split(t, "_+|(?<=[a-z0-9])(?=[A-Z])"))), lambda x: F.length(x) > 2)
    out = F.array_distinct(F.transform(F.concat(names, parts), F.lower))
    return F.array_except(out, words_list(stop)) if stop else out


def normal_question(text: Column | str) -> Column:
    """Lower case, collapsed, letters, digits and spaces only; not fuzzy on purpose."""
    return F.trim(F.regexp_replace(F.lower(squeeze(text)), "[^a-z0-9 ]", ""))


def excerpt(text: Column | str, limit: int = EXCERPT) -> Column:
    """Collapsed and cut with a mark that tells the true length."""
    t = squeeze(text)
    mark = F.concat(F.lit(" …[cut: "), F.length(t).cast("string"), F.lit(" chars total]"))
    return F.when(F.length(t) > limit, F.concat(F.substr(t, F.lit(1), F.lit(limit) - F.length(mark)), mark)).otherwise(t)


def fit_both_ends(text: Column | str, limit: int = OBSERVATION) -> Column:
    """Head of at most a third, a mark of what fell out, and the tail."""
    t = F.coalesce(_col(text), F.lit(""))
    mark = F.concat(F.lit("\n… ["), F.format_number(F.length(t) - limit, 0), F.lit(" chars elided from the middle] …\n"))
    head = F.least(F.lit(OBSERVATION_HEAD), F.floor((F.lit(limit) - F.length(mark)) / 3)).cast("int")
    tail = F.lit(limit) - head - F.length(mark)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substr(t, F.lit(1), head), mark, F.substr(t, F.length(t) - tail + 1)))


def episode_half(text: Column | str, limit: int = EPISODE) -> Column:
    """One side of an exchange with a declared cut."""
    t = F.coalesce(_col(text), F.lit(""))
    mark = F.concat(F.lit(" …[cut: "), F.length(t).cast("string"), F.lit(" chars total]"))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substr(t, F.lit(1), F.lit(limit) - F.length(mark))), mark))


def salience(text: Column | str) -> Column:
    """0.45, up to 0.25 for length, 0.08 for each marker, 0.95 at most."""
    t = F.coalesce(_col(text), F.lit(""))
    hits = bind(F.lower(t), lambda low: F.aggregate(words_list(SALIENCE_MARKERS), F.lit(0), lambda s, m: s + F.contains(low, m).cast("int")))
    return F.round(F.least(F.lit(0.95), 0.45 + F.least(F.length(t), F.lit(400)) / 1600.0 + 0.08 * hits), 3)


def cell(value: Column, limit: int = CELL) -> Column:
    """A value as shown to people: long texts are cut with their length."""
    t = value.cast("string")
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("… [cell truncated, "), F.length(t).cast("string"), F.lit(" chars total]"))).otherwise(t)


def memory_document(kind, turn, people, phrases, gist_, content, provenance, url) -> Column:
    """Labelled lines for an embedding; lines without a value are left out."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = F.array(
        F.concat(F.lit("kind: "), s(kind)), F.concat(F.lit("turn: "), s(turn)), F.concat(F.lit("people: "), F.array_join(people, ", ")),
        F.concat(F.lit("key phrases: "), F.array_join(phrases, ", ")), F.concat(F.lit("gist: "), s(gist_)), F.concat(F.lit("details: "), s(content)),
        F.concat(F.lit("source: "), s(provenance)), F.concat(F.lit("url: "), s(url)),
    )
    return F.array_join(F.filter(lines, lambda x: ~x.endswith(": ")), "\n")


def memory_cues(gist_, phrases, people, kind) -> Column:
    """Short cue lines: gist, phrases, names, kind; empty ones are left out."""
    parts = F.array(F.coalesce(gist_, F.lit("")), F.array_join(phrases, ", "), F.array_join(people, ", "), F.coalesce(kind, F.lit("")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def dot(a: Column, b: Column) -> Column:
    """Inner product of unit vectors; 0 for null vectors or unequal lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.coalesce(total, F.lit(0.0))).otherwise(0.0)
