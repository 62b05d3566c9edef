"""Secrets in table cells: found by column, by row key or by value, and replaced whole."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of names, row keys and values of secrets.
NAME = r"(?i)(^|_)(api_?key|apikey|secret|password|passwd|token|credential|private_key|access_key|refresh_token)(_|$)|(^|_)(pw|password|passwd|secret)_(hash|salt)(_|$)"
ROW_KEY = r"(?i)(^|_)(api_?key|apikey|secret|password|passwd|token|credential)(_|$)|_key$|_hash$|_salt$"
VALUE = r"^(sk-|sk_live|pk_live|ghp_|gho_|ghu_|ghs_|github_pat_|xox[baprs]-|AKIA|ASIA|AIza|glpat-|hf_|-----BEGIN)"
INSIDE = r"(sk-|sk_live|pk_live|ghp_|gho_|ghu_|ghs_|github_pat_|xox[baprs]-|AKIA|ASIA|AIza|glpat-|hf_)[A-Za-z0-9_\-]{8,}|-----BEGIN[A-Z ]*PRIVATE KEY"
KEY_COLUMNS = ("key", "name", "setting", "option")


def reason(name: str, value: Column, row_key: Column | None) -> Column:
    """Why a cell is a secret (null: it isn't); a column or row key is named before the value's look."""
    why = F.when(value.rlike(VALUE), "credential-shaped value").when(value.rlike(INSIDE), "credential inside the value")
    if row_key is not None and name.lower() not in KEY_COLUMNS:
        why = F.when((row_key != "") & row_key.rlike(ROW_KEY), row_key).otherwise(why)
    if re.search(NAME, name):
        why = F.lit(name)
    return F.when(value != "", why)


def redact(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns as text with secrets replaced, and `redacted`, the names of the columns hit."""
    names = [c for c in df.columns if c not in keep]
    key = next((F.col(c).cast("string") for c in names if c.lower() in KEY_COLUMNS), None)
    key = F.coalesce(key, F.lit("")) if key is not None else None
    whys = {c: reason(c, F.coalesce(F.col(c).cast("string"), F.lit("")), key) for c in names}
    shown = [
        F.when(w.isNotNull(), F.concat(F.lit("<redacted: "), F.substring(w, 1, 60), F.lit(", "), F.length(F.col(c).cast("string")).cast("string"), F.lit(" chars>"))).otherwise(F.col(c).cast("string")).alias(c)
        for c, w in whys.items()
    ]
    hits = F.array_compact(F.array(*[F.when(w.isNotNull(), F.lit(c)) for c, w in whys.items()])).alias("redacted")
    return df.select(*keep, *shown, hits)
