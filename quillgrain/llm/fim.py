"""Fill-in-middle: texts cut in three at code points and reordered by markers.

Cuts are counted in code points but taken in bytes. A batch's UTF-8 bytes are viewed as 64-bit words.
A byte ends a code point where the next one is no continuation byte, which word arithmetic marks for
eight bytes at once; the marks of each word are counted (`bitwise_count`) and added up over the batch.
The position of the k-th end is then a binary search among the sums for the word, and a select inside
that word, by multiplication, for the byte. No text is decoded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrain.llm.common import raw

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain, and so many of the rest put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of text that are marked at once; a longer text is a part of its own.
PART = 4 << 20

_LOW, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


class Units:
    """Where code points end in joined UTF-8 texts; `bounds` are the texts' ends, from 0."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        room = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
        room[: len(data)] = data
        words = room.view("<u8")
        following = (words >> np.uint64(8)) | (np.r_[words[1:], np.uint64(0)] << np.uint64(56))
        # a continuation byte is 10xxxxxx: its top bit is set, the next one isn't
        self.marks = ((following >> np.uint64(7)) & ~(following >> np.uint64(6)) & _LOW) ^ _LOW
        last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        self.marks.view(np.uint8)[last] = 1  # a text ends a unit, whatever follows
        self.sums = np.r_[0, np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)]

    def before(self, at: np.ndarray) -> np.ndarray:
        """How many units end in the first `at` bytes."""
        inside = (np.uint64(1) << ((at & 7) << 3).astype(np.uint64)) - np.uint64(1)
        return self.sums[at >> 3] + np.bitwise_count(self.marks[at >> 3] & inside)

    def end(self, k: np.ndarray) -> np.ndarray:
        """The byte after the end of the k-th unit, counted from 1; 0 for k = 0."""
        word = np.searchsorted(self.sums[1:], k)
        inside = (k - self.sums[word]).astype(np.uint64)
        upto = self.marks[word] * _LOW  # byte i: marks in bytes 0 to i
        reached = ((upto | _TOP) - inside * _LOW) & _TOP
        return np.where(k > 0, word * 8 + 9 - np.bitwise_count(reached), 0)


def cut(data: np.ndarray, bounds: np.ndarray, ends: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Units of each text, and for each array of fractions h the byte after its h % (n + 1) units."""
    units = Units(data, bounds)
    first = units.before(bounds[:-1])
    n = units.before(bounds[1:]) - first
    at = []
    for h in ends:
        k = h % (n + 1)
        at.append((k, np.where(k > 0, units.end(first + k), bounds[:-1])))
    return n, at


def parts(bounds: np.ndarray, most: int = PART) -> list[tuple[int, int]]:
    """Runs of texts of at most `most` bytes, a longer text alone."""
    out, at = [], 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        out.append((at, to))
        at = to
    return out


_KIND = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])


def reorder(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, form: list[str]) -> pa.Array:
    """A struct for each text: units, form, units of prefix and middle, the reordered bytes."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    n_all, prefix, middle, out = np.empty(len(texts), np.int64), [], [], []
    for a, b in parts(bounds):
        base = bounds[a : b + 1] - bounds[a]
        own = data[bounds[a] : bounds[b]]
        n, ((k1, at1), (k2, at2)) = cut(own, base, [h1[a:b], h2[a:b]])
        n_all[a:b] = n
        whole = own.tobytes()
        low, high = np.minimum(k1, k2), np.maximum(k1, k2)
        rows = zip(base[:-1].tolist(), np.minimum(at1, at2).tolist(), np.maximum(at1, at2).tolist(), base[1:].tolist(), low.tolist(), (high - low).tolist(), form[a:b], strict=True)
        for start, one, two, end, first, second, kind in rows:
            plain = kind == "plain"
            prefix.append(None if plain else first)
            middle.append(None if plain else second)
            if plain:
                out.append(whole[start:end])
            elif kind == "psm":
                out.append(b"".join((p, whole[start:one], s, whole[two:end], m, whole[one:two])))
            else:
                out.append(b"".join((s, whole[two:end], p, whole[start:one], m, whole[one:two])))
    return pa.StructArray.from_arrays([pa.array(n_all), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())], fields=list(_KIND))


def fractions(id_col: str, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32 that the seed and the id fix: the first groups of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "fim", seed: int = 1) -> DataFrame:
    """The rows with a struct `into`: n (code points), form, prefix_chars, middle_chars, output.

    The form is plain (the text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix,
    middle). Empty texts and texts that hold a marker stay plain, so `restore` is exact. A null text
    is an empty one, a null id counts as the text 'null'; repeated rows come out alike, an empty
    table stays empty. A text of any length is cut whole. All other columns stay, whatever their
    names; a column named as `into` is replaced. Rows neither move nor meet: there is no shuffle.
    """
    h1, h2, h3, h4 = fractions(id_col, seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h3 % 100 >= 100 - PLAIN), "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")

    def run(texts: pa.Array, a: pa.Array, b: pa.Array, kinds: pa.Array) -> pa.Array:
        return reorder(texts, a.to_numpy(), b.to_numpy(), kinds.to_pylist())

    made = F.arrow_udf(run, "n long, form string, prefix_chars long, middle_chars long, output binary")(raw(text), h1, h2, form)
    return docs.withColumn(into, made).withColumn(into, F.col(into).withField("output", F.col(f"{into}.output").cast("string")))


def restore(output: Column, form: Column) -> Column:
    """The text that `fill_in_middle` reordered.

    No text that was reordered holds a marker, and no end of one marker begins another, so the first
    occurrence of each is the one that was put in.
    """
    part = lambda start, end: F.substring(output, start + len(PREFIX), end - start - len(PREFIX))
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    end = F.length(output) + 1
    psm = F.concat(part(p, s), part(m, end), part(s, m))
    spm = F.concat(part(p, m), part(m, end), part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the three parts of every document, digests of the output and of the text rebuilt from it."""
    from quillgrain.llm.common import table

    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restore(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, 'null')) as h from documents),
u as (select *, length(t) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {100 - PLAIN} then 'plain' when h4 % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from u),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end::bigint as prefix_chars, case when form <> 'plain' then b - a end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid else '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""
