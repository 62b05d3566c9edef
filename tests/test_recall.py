"""Hybrid recall against plain Python, and stored postings."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillgrain.functions import text as T
from quillgrain.operators import retrieval as R
from quillgrain.plans import recall

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def index_tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower().translate(FOLD))


def cue_score(phrases, names, query):
    q, best = query.lower(), 0.0
    for p in phrases:
        p = p.strip().lower()
        if p:
            best = max(best, 1.0 if p in q else 0.8 if q in p and len(q) >= 4 else 0.0)
    return max([best, *(0.7 for e in names if e.lower() in q)])


def mode_of(query):
    q = query.lower()
    if re.search(r"\b(?:long ago|weeks? ago|months? ago|back then|earliest|first time|originally)\b", q):
        return "old"
    return "recent" if re.search(r"\b(?:recently|just now|a moment ago|last time|just happened)\b", q) else "neutral"


def ranks(scores, descending_ids, most):
    order = sorted((i for i, s in scores.items() if s > 0), key=lambda i: (-round(scores[i], 9), -i if descending_ids else i))
    return {i: r + 1 for r, i in enumerate(order[:most])}


def dot(a, b):
    return sum(float(x) * float(y) for x, y in zip(a, b)) if a is not None and b is not None and len(a) == len(b) else 0.0


def plain_recall(q, rows, k):
    """[(id, place, score, neighbour)] of one query over all rows."""
    lists = {r.id: index_tokens(r.content) for r in rows}
    n, mean = len(rows), sum(map(len, lists.values())) / len(rows)
    terms = {t for w in q.terms for t in index_tokens(w)}
    df = Counter(t for w in lists.values() for t in set(w) if t in terms)
    own = {r.id: r for r in rows if r.bank_id == q.bank_id and r.retired_batch is None and (r.turn_idx is None or r.turn_idx < q.cutoff_turn)}
    lexical = {}
    for i in own:
        tf = Counter(lists[i])
        lexical[i] = sum(max(1e-6, math.log((n - df[t] + 0.5) / (df[t] + 0.5))) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(lists[i]) / mean)) for t in terms if tf[t])
    exact = {i: cue_score(r.key_phrases, r.entities, q.query_text) for i, r in own.items()}
    same = {i: r.stamp == q.query_stamp for i, r in own.items()}
    lanes = [(1.1, ranks(lexical, False, 60)), (1.25, ranks(exact, False, None))]
    lanes += [(w, ranks({i: dot(getattr(r, c), q.query_vector) if same[i] else 0.0 for i, r in own.items()}, True, 60)) for w, c in ((1.0, "vector"), (1.15, "cue_vector"))]
    fused = {i: round(sum(w * 12 / (60 + lane[i]) for w, lane in lanes if i in lane), 9) for i in own}
    # importance by mid-rank, respaced between the 10th and 90th percentile
    values = sorted(r.importance for r in own.values())
    count, below = Counter(values), {v: values.index(v) for v in set(values)}
    lo, hi = values[int(len(values) * 0.1)], values[int(len(values) * 0.9)]
    flat = len(values) < 2 or hi - lo <= 1e-9
    spaced = lambda v: v if flat else lo + (2 * below[v] + count[v] - 1) / 2 / (len(values) - 1) * (hi - lo)
    mode, score = mode_of(q.query_text), {}
    for i, r in own.items():
        age = 0.0 if r.turn_idx is None or not q.cutoff_turn else max(0.0, min(1.0, (q.cutoff_turn - r.turn_idx) / max(q.cutoff_turn, 1)))
        when = 0.0 if r.turn_idx is None or not q.cutoff_turn or mode == "neutral" else 0.12 * (age if mode == "old" else 1 - age)
        belief = 0.10 * (r.confidence - 0.5) if r.kind == "inference" else 0.0
        score[i] = round(fused[i] + 0.08 * spaced(r.importance) + 0.04 * r.confidence + belief + 0.08 * exact[i] + when, 9)
    order = sorted(own, key=lambda i: (-score[i], i))
    worth = sum(score[i] >= 0.45 * score[order[0]] for i in order)
    take = max(min(6, len(order), k), min(k, worth))
    pool, picks = order[: max(8 * take, 40)], []
    words = {i: set(own[i].words) for i in pool}
    near = dict.fromkeys(pool, 0.0)
    while len(picks) < min(take, len(pool)):
        left = [i for i in pool if i not in picks]
        best = max(left, key=lambda i: (0.82 * score[i] - 0.18 * near[i], -pool.index(i)))
        picks.append(best)
        for i in left:
            a, b = own[i].vector, own[best].vector
            if a is not None and b is not None and len(a) == len(b):
                like = max(0.0, dot(a, b))
            else:
                like = len(words[i] & words[best]) / len(words[i] | words[best]) if words[i] and words[best] else 0.0
            near[i] = max(near[i], like)
    line = sorted((i for i, r in own.items() if r.turn_idx is not None), key=lambda i: (own[i].turn_idx, i))
    extra = []
    for i in picks[:3]:
        if own[i].kind == "episodic" and i in line:
            at = line.index(i)
            extra += [j for j in (line[at - 1] if at else None, line[at + 1] if at + 1 < len(line) else None) if j is not None and abs(own[j].turn_idx - own[i].turn_idx) <= 1 and j not in picks and j not in extra]
    extra = extra[:2]
    out = sorted(picks + extra, key=lambda i: (own[i].turn_idx is None, own[i].turn_idx or 0, i))
    return [(i, p + 1, round(score[i], 6), i in extra) for p, i in enumerate(out)]


@pytest.mark.parametrize("episodes", [False, True])
def test_recall_is_that_of_plain_python(spark, episodes):
    rows, queries = recall.rows(spark, SF), recall.queries(spark, SF)
    if episodes:  # close turns, so that neighbours are found; queries about old and recent things, and of an empty text
        rows = rows.withColumns({"kind": F.when(F.col("kind") == "semantic", "episodic").otherwise(F.col("kind")), "turn_idx": F.floor(F.col("turn_idx") / 5)})
        said = F.when(F.col("query_id") % 4 == 0, F.concat("query_text", F.lit(" long ago"))).when(F.col("query_id") % 4 == 1, F.concat("query_text", F.lit(" recently"))).when(F.col("query_id") == 7, "").otherwise(F.col("query_text"))
        queries = queries.withColumns({"query_text": said, "cutoff_turn": (20 + F.col("query_id")).cast("long")})
    got = defaultdict(list)
    for r in R.hybrid_search(queries, rows, 16).orderBy("query_id", "place").collect():
        got[r.query_id].append((r.id, r.place, round(r.score, 6), r.neighbour))
    plain = rows.withColumn("words", T.token_set("content")).collect()
    asked = queries.withColumn("terms", T.query_terms("query_text")).collect()
    for q in asked:
        want = plain_recall(q, plain, 16)
        assert [x[:2] + x[3:] for x in got[q.query_id]] == [x[:2] + x[3:] for x in want], q.query_id
        assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got[q.query_id], want))
    assert not episodes or any(x[3] for found in got.values() for x in found)


def test_renewed_postings_are_those_of_all_rows(spark):
    rows = recall.A.document_rows(spark, SF).select("bank_id", "id", "content")
    new = rows.where("id in (1, 5, 9)").withColumn("content", F.when(F.col("id") == 5, "").otherwise("entirely new words here")).unionByName(spark.createDataFrame([(1, 99_999, "one more")], rows.schema))
    known = R.replaced(R.lexicon(rows), new)
    whole = R.lexicon(rows.join(new.select("id"), "id", "left_anti").select(rows.columns).unionByName(new))
    cols = ["bank_id", "id", "token", "tf", "doc_len"]
    assert known.postings.select(cols).exceptAll(whole.postings.select(cols)).count() == 0 == whole.postings.select(cols).exceptAll(known.postings.select(cols)).count()
    assert known.frequencies.exceptAll(whole.frequencies).count() == 0
    assert tuple(known.totals.first()) == pytest.approx(tuple(whole.totals.first()))
