"""Names of the library's text functions for use in SQL text: `register(spark)`, then `spark.sql("select html_text(html) ...")`.

What columns can express is a SQL function and stays in the JVM; the rest are Arrow functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillgrain.functions import web


def _literal(text: str) -> str:
    """A text as a literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_ENDS, _PLACE = _literal(r"(?U)^\s+|\s+$"), _literal(r"^[^:/?#]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?")
_TRACKING = ", ".join(map(_literal, web.TRACKING))

#: Each name with its parameter and what it gives; a null is what an empty text gives.
SQL = {
    "html_text": ("markup string", "string", f"""regexp_replace(regexp_replace(regexp_replace(html_unescape(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(coalesce(markup, ''), {_literal(web.COMMENT)}, ' '), {_literal(web.DROPPED)}, ' '), {_literal(web.BREAKS)}, '\\n'), {_literal(web.TAG)}, ' ')),
        '[ \\t]+', ' '), {_literal(r"(?U)\n\s*\n+")}, '\\n'), {_ENDS}, '')"""),
    "url_escapes": ("t string", "string", f"""array_join(transform(split(t, '%', -1), (part, i) -> case when i = 0 then part
        when not substring(part, 1, 2) rlike '^[0-9A-Fa-f]{{2}}$' then concat('%', part)
        when char(cast(conv(substring(part, 1, 2), 16, 10) as bigint)) rlike {_literal(f"^{web.UNRESERVED}$")} then concat(char(cast(conv(substring(part, 1, 2), 16, 10) as bigint)), substr(part, 3))
        else concat('%', upper(substring(part, 1, 2)), substr(part, 3)) end), '')"""),
    "url_parameters": ("t string", "string", f"""array_join(transform(array_sort(filter(transform(filter(split(t, '&'), x -> x <> ''),
        x -> struct(url_decode(regexp_replace(regexp_extract(x, '^[^=]*', 0), '%(?![0-9A-Fa-f]{{2}})', '%25')) as k, url_decode(regexp_replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '%(?![0-9A-Fa-f]{{2}})', '%25')) as v)),
        p -> not lower(p.k) in ({_TRACKING}))), p -> replace(replace(concat(url_encode(p.k), '=', url_encode(p.v)), '*', '%2A'), '%7E', '~')), '&')"""),
    "url_full": ("t string", "string", "translate(case when contains(t, '://') then t else concat('https://', t) end, '\\n\\r\\t', '')"),
    "url_place": ("f string", "string", f"regexp_replace(regexp_extract(f, {_PLACE}, 1), '^.*@', '')"),
    "url_port": ("place string", "string", rf"regexp_extract(place, {_literal(r'^(?:\[[^\]]*\]|[^:]*):(.*)$')}, 1)"),
    "url_host": ("place string", "string", rf"""regexp_replace(ascii_host(rtrim('.', lower(regexp_replace(regexp_extract(place, {_literal(r'^(?:\[[^\]]*\]|[^:]*)')}, 0), {_literal(r'[\[\]]')}, '')))), {_literal(r'^www\.')}, '')"""),
    "url_whole": ("f string", "string", f"""concat('https://', url_host(url_place(f)),
        case when coalesce(try_cast(url_port(url_place(f)) as int), 0) in (0, 80, 443) then '' else concat(':', cast(try_cast(url_port(url_place(f)) as int) as string)) end,
        coalesce(nullif(rtrim('/', url_escapes(regexp_extract(f, {_PLACE}, 2))), ''), '/'),
        case when url_parameters(regexp_extract(f, {_PLACE}, 3)) = '' then '' else concat('?', url_parameters(regexp_extract(f, {_PLACE}, 3))) end)"""),
    "url_trimmed": ("t string", "string", f"""case when t = '' or (contains(t, ':') and not lower(substring_index(t, ':', 1)) in ('', 'http', 'https')) then t
        when url_port(url_place(url_full(t))) <> '' and (not url_port(url_place(url_full(t))) rlike '^[0-9]{{1,5}}$' or try_cast(url_port(url_place(url_full(t))) as int) > 65535) then url_full(t)
        else url_whole(url_full(t)) end"""),
    "canonical_url": ("url string", "string", f"url_trimmed(regexp_replace(coalesce(url, ''), {_ENDS}, ''))"),
}


@F.pandas_udf(ArrayType(FloatType()))
def hashed_embedding(texts: pd.Series) -> pd.Series:
    """The hashed lexical embedding of each text."""
    from quillgrain.operators.vectors import hashed_embeddings

    return pd.Series(list(hashed_embeddings(texts.tolist())), index=texts.index, dtype=object)


def register(spark: SparkSession) -> list[str]:
    """Makes html_text, canonical_url, reply_json and hashed_embedding known to the session's SQL; gives their names."""
    from quillgrain.operators.pages import reply_json

    for name, f in (("html_unescape", web.unescape), ("ascii_host", web.ascii_host), ("reply_json", reply_json), ("hashed_embedding", hashed_embedding)):
        spark.udf.register(name, f)
    for name, (parameters, kind, body) in SQL.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    return ["html_text", "canonical_url", "reply_json", "hashed_embedding"]
