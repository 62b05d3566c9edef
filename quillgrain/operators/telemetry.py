"""Runs and experiments: grading of predictions, failures, fixes and logs."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Signs that the harness failed, not the hypothesis.
HARNESS_CUES = [
    "no module named", "can't open file", "cannot open file", "permission denied", "command not found", "no such file or directory",
    "is not recognized as an internal", "could not start the command", "could not write ", "no such interpreter",
]
HARNESS_EXITS = {2: "interrupted before it finished collecting", 3: "an internal error", 4: "invoked wrongly", 5: "no tests were collected"}


def observation_text(exit_code: Column, seconds: Column, timed_out: Column, stdout: Column, stderr: Column) -> Column:
    """What happened, in the form that is kept: a head, then the streams, the errors first if it failed."""
    ok = F.coalesce(exit_code == 0, F.lit(False)) & ~timed_out
    head = F.when(timed_out, F.concat(F.lit("TIMED OUT after "), seconds.cast("string"), F.lit("s"))).when(exit_code.isNull(), "DID NOT RUN").otherwise(F.concat(F.lit("exit "), exit_code.cast("string"), F.lit(" in "), seconds.cast("string"), F.lit("s")))
    err = F.when(F.coalesce(stderr, F.lit("")) != "", F.concat(F.lit("stderr: "), stderr))
    out = F.when(F.coalesce(stdout, F.lit("")) != "", F.concat(F.lit("stdout: "), stdout))
    streams = F.concat_ws(" | ", F.when(~ok, err), out, F.when(ok, err))
    return F.when(streams == "", head).otherwise(F.concat(head, F.lit(" — "), streams))


def observation_failed(observation: Column) -> Column:
    """Whether a kept observation tells of a failed run."""
    code = F.regexp_extract(observation, r"^exit (-?\d+)", 1)
    return observation.startswith("TIMED OUT") | observation.startswith("DID NOT RUN") | ((code != "") & (code != "0"))


def harness_failed(exit_code: Column, stdout: Column, stderr: Column) -> Column:
    low = F.lower(F.coalesce(stderr, F.lit("")))
    hit = lambda t: F.exists(F.array(*[F.lit(c) for c in HARNESS_CUES]), lambda c: F.contains(t, c))
    last = F.try_element_at(F.filter(F.split(low, "\n"), lambda x: F.trim(x) != ""), F.lit(-1))
    failed = F.coalesce(exit_code != 0, F.lit(False))
    return (failed & F.coalesce(hit(F.coalesce(last, F.lit(""))), F.lit(False))) | ((F.coalesce(exit_code, F.lit(1)) != 0) & (F.trim(F.coalesce(stdout, F.lit(""))) == "") & hit(low))


@F.pandas_udf(StringType())
def _matches(patterns: pd.Series, texts: pd.Series) -> pd.Series:
    """'yes', 'no' or 'bad pattern' for patterns that differ from row to row."""

    def one(p: str | None, t: str | None) -> str | None:
        if p is None:
            return None
        try:
            return "yes" if re.search(p, t or "") else "no"
        except re.error:
            return "bad pattern"

    return pd.Series([one(p, t) for p, t in zip(patterns, texts, strict=True)])


def stale_anchor(stdout: Column, precondition: Column) -> Column:
    """Whether a file that a prediction rests on has another digest now, or none was reported.

    The run prints `PRECONDITION path digest`; digests are compared by the shorter one.
    """
    lines = F.regexp_extract_all(F.coalesce(stdout, F.lit("")), F.lit(r"(?m)^\s*PRECONDITION +(.+?) +(\S+)\s*$"), F.lit(0))
    seen = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"PRECONDITION +(.+?) +(\S+)\s*$", 1), F.lower(F.regexp_extract(x, r"PRECONDITION +(.+?) +(\S+)\s*$", 2)))))

    def odd(path: Column, want: Column) -> Column:
        got, want = F.element_at(seen, path), F.lower(F.trim(want))
        return got.isNull() | ~(F.startswith(got, want) | F.startswith(want, got))

    return F.coalesce(F.size(F.map_filter(precondition, odd)) > 0, F.lit(False))


def judge(runs: DataFrame) -> DataFrame:
    """Grades runs: inconclusive if the harness failed or nothing was predicted, else whether all predicates hold.

    Takes exit_code, timed_out, stdout, stderr, harness, and a struct `expect` of optional fields
    exit_zero, exit_code, stdout_has, stdout_lacks, stderr_has, stderr_lacks, stdout_matches,
    output_equals, precondition (map) and file_contains (map), with the files left in `files` (map).
    """
    e = lambda f: F.col(f"expect.{f}")
    out, err = F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit(""))
    ok = F.coalesce(F.col("exit_code") == 0, F.lit(False)) & ~F.col("timed_out")
    regex = _matches(e("stdout_matches"), out)
    file_ok = F.size(F.map_filter(e("file_contains"), lambda p, w: ~F.coalesce(F.contains(F.element_at("files", p), w), F.lit(False)))) == 0
    file_missing = F.coalesce(F.size(F.map_filter(e("file_contains"), lambda p, w: F.element_at("files", p).isNull())) > 0, F.lit(False))
    checks = F.array_compact(F.array(
        F.when(e("exit_zero").isNotNull(), ok == e("exit_zero")), F.when(e("exit_code").isNotNull(), F.coalesce(F.col("exit_code") == e("exit_code"), F.lit(False))),
        F.when(e("stdout_has").isNotNull(), F.contains(out, e("stdout_has"))), F.when(e("stdout_lacks").isNotNull(), ~F.contains(out, e("stdout_lacks"))),
        F.when(e("stderr_has").isNotNull(), F.contains(err, e("stderr_has"))), F.when(e("stderr_lacks").isNotNull(), ~F.contains(err, e("stderr_lacks"))),
        F.when(e("stdout_matches").isNotNull(), regex == "yes"), F.when(e("output_equals").isNotNull(), F.trim(out) == F.trim(e("output_equals"))),
        F.when(e("file_contains").isNotNull(), file_ok),
    ))
    outcome = (
        F.when(F.col("exit_code").isNull() & ~F.col("timed_out"), "inconclusive").when((F.col("harness") == "pytest") & F.col("exit_code").isin(list(HARNESS_EXITS)), "inconclusive")
        .when(harness_failed(F.col("exit_code"), out, err), "inconclusive").when(stale_anchor(out, e("precondition")), "inconclusive")
        .when(F.coalesce(regex == "bad pattern", F.lit(False)) | file_missing, "inconclusive").when(F.size(checks) == 0, "inconclusive")
        .when(F.forall(checks, lambda c: c), "confirmed").otherwise("refuted")
    )
    return runs.withColumn("outcome", outcome)


def shows_failure() -> Column:
    """Whether a graded row observed a failure of what was tested, by itself or by declaration."""
    return ((F.col("outcome") == "refuted") & observation_failed(F.col("observation"))) | ((F.col("outcome") == "confirmed") & F.col("reproduces"))


def failing(rows: DataFrame, limit: int = 6) -> DataFrame:
    """Hypotheses that were seen failing, the most recent first."""
    last = rows.where(shows_failure()).groupBy("hypothesis_id").agg(F.max("id").alias("last_failure"))
    return last.orderBy(F.desc("last_failure")).limit(limit)


def failing_since_fix(rows: DataFrame) -> DataFrame:
    """Per hypothesis: whether it ever failed, and whether since its last fix mark, so that a fix may be proposed."""
    mark = F.max(F.when(F.col("outcome") == "fix-marker", F.col("id"))).over(Window.partitionBy("hypothesis_id"))
    r = rows.withColumns({"_m": F.coalesce(mark, F.lit(-1)), "_f": shows_failure()})
    return r.groupBy("hypothesis_id").agg(F.bool_or("_f").alias("ever"), F.bool_or(F.col("_f") & (F.col("id") > F.col("_m"))).alias("since_fix"))


def unstable(rows: DataFrame) -> DataFrame:
    """Experiments (same digest) that came out differently."""
    return rows.where("outcome <> 'fix-marker'").groupBy("hypothesis_id", "digest").agg(F.countDistinct("outcome").alias("n_outcomes"), F.count("*").alias("n_runs")).where("n_outcomes > 1")


def moved_anchor(rows: DataFrame) -> DataFrame:
    """Experiments that pin another version of a path than an earlier one of their hypothesis, with the earliest such.

    A run meets the first run of each version only, not every run before it.
    """
    pins = rows.select("hypothesis_id", "id", F.explode("precondition").alias("path", "sha"))
    first = pins.groupBy("hypothesis_id", "path", F.col("sha").alias("earlier_sha")).agg(F.min("id").alias("earlier_id"))
    n = F.least(F.length("sha"), F.length("earlier_sha"))
    moved = pins.join(first, ["hypothesis_id", "path"]).where("earlier_id < id").where(F.substr("sha", F.lit(1), n) != F.substr("earlier_sha", F.lit(1), n))
    return moved.groupBy("hypothesis_id", "path", "id").agg(F.min("earlier_id").alias("earlier_id"))


@dataclass
class Appended:
    """The outputs of an append: the log as it is then, evidence of the new runs, hypotheses with confidence and version, notes, refusals."""

    log: DataFrame
    evidence: DataFrame
    hypotheses: DataFrame
    notes: DataFrame
    refused: DataFrame


def append_experiments(log: DataFrame, arriving: DataFrame, hypotheses: DataFrame, observations: DataFrame) -> Appended:
    """Graded runs added to the log under a version guard, as evidence on their hypotheses.

    Runs are (id, hypothesis_id, digest, outcome, precondition); arriving ones also say the
    `seen_version` of their hypothesis (hypothesis_id, version) and are refused if it has another now
    or isn't there. A batch is one step: runs that saw the same version are added together, and it
    then rises by one. An outcome is evidence for, against or context; a run that pins another version
    of a file than an earlier run of its hypothesis measured something else and is context. A run that
    comes out differently than the first one of its digest gets a note. The new evidence goes after
    the `observations` (hypothesis_id, seq, url, stance) and the confidences are folded anew.
    """
    from quillgrain.operators import evidence as E

    known = arriving.join(hypotheses.select("hypothesis_id", F.col("version").alias("_v")), "hypothesis_id", "left")
    refused = known.where(F.col("_v").isNull() | ~F.col("_v").eqNullSafe(F.col("seen_version"))).select("id", "hypothesis_id", F.when(F.col("_v").isNull(), "no such hypothesis").otherwise("stale version").alias("why"))
    new = arriving.join(refused.select("id"), "id", "left_anti").select(*log.columns)
    whole = log.unionByName(new)
    first = whole.groupBy("digest").agg(F.min(F.struct("id", "outcome")).alias("_f"))
    notes = new.join(first, "digest").where("id > _f.id and outcome <> _f.outcome").select("id", "hypothesis_id", "digest", F.col("_f.outcome").alias("earlier"), "outcome")
    moved = moved_anchor(whole).select("id").distinct().withColumn("_moved", F.lit(True))
    stance = F.when(F.col("_moved"), "context").when(F.col("outcome") == "confirmed", "supports").when(F.col("outcome") == "refuted", "contradicts").otherwise("context")
    evidence = new.join(moved, "id", "left").select("hypothesis_id", F.col("id").alias("seq"), F.concat(F.lit("experiment:"), "digest").alias("url"), stance.alias("stance"))
    folded = E.confidence(observations.select("hypothesis_id", "seq", "url", "stance").unionByName(evidence))
    raised = new.select("hypothesis_id").distinct().withColumn("_up", F.lit(1))
    after = hypotheses.select("hypothesis_id", "version").join(raised, "hypothesis_id", "left").join(folded, "hypothesis_id", "left")
    after = after.select("hypothesis_id", (F.col("version") + F.coalesce("_up", F.lit(0))).alias("version"), F.coalesce("confidence", F.lit(E.PRIOR)).alias("confidence"), F.coalesce("status", F.lit("open")).alias("status"))
    return Appended(whole, evidence, after, notes, refused)


def event_log(rows: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Rows with a gap-free index inside their run."""
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(run).orderBy(*order)) - 1)


def replay(log: DataFrame, cursors: DataFrame, run: str) -> DataFrame:
    """Rows from each run's cursor on; a cursor n was seen, an absent or unreadable one is the start."""
    at = F.coalesce(F.col("cursor").try_cast("long") + 1, F.lit(0))
    return log.join(cursors, run, "left").where(F.col("i") >= at).drop("cursor")
