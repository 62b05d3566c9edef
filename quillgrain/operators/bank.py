"""The memory bank: preparing, upserting, reading and auditing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrain.functions import text as T
from quillgrain.sources.scratch import stored

# Kinds, provenances, scopes and their labels.
KINDS = ["episodic", "dialogue", "inference", "semantic", "commitment"]
PROVENANCES = ["witnessed", "told", "read", "inferred", "remembered"]
SCOPES = {"witnessed": "autobiographical", "remembered": "autobiographical", "told": "received", "read": "received", "inferred": "surmise"}
SCOPE_LABELS = {"autobiographical": "what_happened_between_us", "received": "what_i_was_told_or_read", "surmise": "what_i_concluded"}
ORIGINS = {"witnessed": "what_i_experienced", "remembered": "what_i_experienced", "told": "what_i_was_told", "read": "what_i_read", "inferred": "what_i_concluded"}


def look_up(values: dict, key: Column, default: Column | str) -> Column:
    """A fixed map applied to a column."""
    out = F.lit(default) if isinstance(default, str) else default
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def provenance_scope(provenance: Column) -> Column:
    """The scope of a provenance; an unknown one claims the least."""
    return look_up(SCOPES, F.coalesce(provenance, F.lit("")), "received")


def scope_label(scope: Column) -> Column:
    return look_up(SCOPE_LABELS, scope, scope)


def effective_importance(importance: Column, salience: Column) -> Column:
    """The revised importance, or the salience a row was minted with."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(importance, salience)))


def prepare(rows: DataFrame) -> DataFrame:
    """Raw rows made valid: known kinds, clamped numbers, gist, names and an empty list for none.

    Takes bank_id, id, kind, provenance, content, event_key; salience, confidence and gist are
    filled where they are missing.
    """
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    content = T.squeeze("content")
    return rows.withColumns({
        "kind": F.when(F.col("kind").isin(KINDS), F.col("kind")).otherwise("episodic"),
        "provenance": F.when(F.col("provenance").isin(PROVENANCES), F.col("provenance")).otherwise("witnessed"),
        "salience": T.clamp(F.coalesce(has("salience").cast("double"), T.salience("content"))),
        "confidence": T.clamp(F.coalesce(has("confidence").cast("double"), F.lit(1.0))),
        "content": content,
        "gist": F.coalesce(F.nullif(T.squeeze(has("gist").cast("string")), F.lit("")), T.gist(content)),
        "entities": T.entities("content"), "key_phrases": T.key_phrases("content", T.entities("content")),
        "event_key": F.coalesce("event_key", F.lit("")),
    })


def embedding_texts(rows: DataFrame) -> DataFrame:
    """The two texts of a row that are embedded; an empty cue falls back to the document."""
    phrases = F.col("key_phrases")
    doc = T.memory_document(F.col("kind"), F.col("turn_idx"), F.col("entities"), phrases, F.col("gist"), F.col("content"), F.col("provenance"), F.lit(""))
    cue = T.memory_cues(F.col("gist"), phrases, F.col("entities"), F.col("kind"))
    return rows.select("bank_id", "id", doc.alias("document"), F.coalesce(F.nullif(cue, F.lit("")), doc).alias("cue"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key; rows whose last key is empty are all kept.

    One shuffle on the keys; `new` wins over `old`, then the newest version; of rows equal in both the
    one of the least hash, so that the result doesn't hang on their order.
    """
    rest = [F.col(f.name) for f in sorted(new.schema, key=lambda f: f.name) if f.name in old.columns and f.dataType.typeName() != "map"]
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy(*keys).orderBy(F.desc("_n"), F.desc(version), F.xxhash64(*rest))
    keyed = both.where(F.col(keys[-1]).cast("string") != "").withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
    return keyed.unionByName(both.where(F.coalesce(F.col(keys[-1]).cast("string"), F.lit("")) == "")).drop("_n")


def replace_by_source(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """All rows of a source that comes anew give way to the new ones."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def reserve_turns(existing: DataFrame, arriving: DataFrame, order: list[str]) -> DataFrame:
    """Ordinals that go on after each bank's largest."""
    top = existing.groupBy("bank_id").agg(F.max("turn_idx").alias("_top"))
    n = F.row_number().over(Window.partitionBy("bank_id").orderBy(*order))
    return arriving.join(top, "bank_id", "left").withColumn("turn_idx", F.coalesce("_top", F.lit(0)) + n).drop("_top")


def visible(rows: DataFrame, *, before: Column | None, include_archived: bool, include_retired: bool = False, since: Column | None = None, need_turn: bool = False) -> DataFrame:
    """The read seam: what a reader at a turn may see. It comes before any ranking.

    `before` is strict and keeps rows without a turn; None is a reader outside of any turn.
    """
    turn = F.col("turn_idx")
    if not include_archived:
        rows = rows.where(~F.col("archived"))
    if not include_retired:
        rows = rows.where(F.col("retired_batch").isNull())
    if before is not None:
        rows = rows.where(turn.isNull() | (turn < before))
    if since is not None:
        rows = rows.where(turn >= since)
    return rows.where(turn.isNotNull()) if need_turn else rows


def beats_ago(current: Column, turn: Column) -> Column:
    """How long ago in words."""
    ago = F.greatest(F.lit(0), current - turn)
    about = F.concat(F.lit("about "), ago.cast("string"), F.lit(" turns ago"))
    return (
        F.when(current.isNull() | turn.isNull(), "at some earlier point").when(ago <= 1, "last turn").when(ago <= 4, "a few turns ago")
        .when(ago <= 12, about).otherwise(F.concat(about, F.lit(", some while back")))
    )


def project(rows: DataFrame, current: Column) -> DataFrame:
    """The fields that a consumer may see, under its names."""
    return rows.select(
        "bank_id", F.col("event_key").alias("memory_ref"), beats_ago(current, F.col("turn_idx")).alias("when_seen"), "kind",
        look_up(ORIGINS, F.coalesce("provenance", F.lit("")), "what_i_was_told").alias("epistemic_origin"),
        "gist", F.round("confidence", 3).alias("confidence"),
    )


def recent(rows: DataFrame, queries: DataFrame, turns: int = 4, limit: int = 12) -> DataFrame:
    """The last rows of the last turns before each query's cutoff, in order."""
    q = queries.select("query_id", "bank_id", "cutoff_turn")
    near = rows.join(q, "bank_id").where("turn_idx < cutoff_turn and turn_idx >= greatest(0, cutoff_turn - {})".format(turns))
    w = Window.partitionBy("query_id").orderBy(F.desc("turn_idx"), F.desc("id"))
    return near.withColumn("back", F.row_number().over(w)).where(F.col("back") <= limit)


def stranded(rows: DataFrame, model: str, dim: int) -> Column:
    """Whether a row's vector can't be compared: none, another model's or another length."""
    return F.col("embedding").isNull() | (F.col("embedding_model") != model) | (F.col("embedding_dim") != dim)


def violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that should be unique and aren't."""
    return rows.where(F.col(keys[-1]).isNotNull() & (F.col(keys[-1]).cast("string") != "")).groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children without a parent."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def blank_fields(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One row for each required field that is null or blank."""
    audit = F.array(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in fields])
    return rows.select(id_col, F.explode(F.array_compact(audit)).alias("field"))


def references(rows: DataFrame, table: str, key: str, column: str, parent: str, action: str) -> DataFrame:
    """A declared reference as rows: what `column` of each row of `table` points at, and what its deletion does (cascade or set null)."""
    return rows.where(F.col(column).isNotNull()).select(
        F.lit(table).alias("tab"), F.col(key).cast("long").alias("id"), F.lit(column).alias("col"), F.lit(parent).alias("parent"), F.col(column).cast("long").alias("parent_id"), F.lit(action).alias("action"),
    )


def carried(deleted: DataFrame, refs: DataFrame, levels: int = 50) -> DataFrame:
    """(tab, id, outcome, col): all rows that go with the `deleted` (tab, id), and the references that become null.

    A recursive query follows the cascades to their end, `levels` at most; references in a circle are
    an error. A row that goes has no reference set to null.
    """
    spark = deleted.sparkSession
    gone = spark.sql(
        f"""with recursive gone(tab, id) max recursion level {levels} as (
              select tab, cast(id as bigint) from {{deleted}}
              union all select r.tab, r.id from gone join {{refs}} r on r.parent = gone.tab and r.parent_id = gone.id where r.action = 'cascade')
            select distinct tab, id from gone""",
        deleted=deleted, refs=refs,
    )
    gone = stored(gone)
    lost = refs.where("action = 'set null'").join(gone.select(F.col("tab").alias("parent"), F.col("id").alias("parent_id")), ["parent", "parent_id"], "left_semi")
    lost = lost.join(gone, ["tab", "id"], "left_anti").select("tab", "id", F.lit("set null").alias("outcome"), "col")
    return gone.select("tab", "id", F.lit("deleted").alias("outcome"), F.lit("").alias("col")).unionByName(lost)


def after_delete(rows: DataFrame, table: str, key: str, outcomes: DataFrame) -> DataFrame:
    """The rows of a table that are left, with the references that became null."""
    own = outcomes.where(F.col("tab") == table)
    kept = rows.join(own.where("outcome = 'deleted'").select(F.col("id").alias(key)), key, "left_anti")
    nulls = own.where("outcome = 'set null'").groupBy(F.col("id").alias(key)).agg(F.collect_set("col").alias("_null"))
    kept = kept.join(nulls, key, "left")
    null = lambda c: F.when(~F.coalesce(F.array_contains("_null", c), F.lit(False)), F.col(c)).alias(c)
    return kept.select(*[F.col(c) if c == key else null(c) for c in rows.columns])
