"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints at Hamming distance 2 or
less have a segment in which they differ by one bit at most, so they share one of its 32 variants
with one bit wild. The 64 variants of each *distinct* fingerprint are dealt out by value; in each
bucket a search that shrinks the set of unreached members finds a spanning forest of the verified
links, so a dense bucket costs about its size and never emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrain.llm.common import components, cut, doc_key, in_cells, keyed, raw, shared, stored, whole_keys

SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a lower-cased text; no word gives 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of every row; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), width) for t in b.column(1)], pa.int64())
            yield pa.record_batch([b.column(0), fp], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), raw(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def spanning(f: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links (distance <= limit) among distinct fingerprints."""
    out, rest, queue = [], f, []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        x = queue.pop()
        near = np.bitwise_count(rest ^ x) <= limit
        if near.any():
            hit = rest[near]
            out.append((np.full(len(hit), x), hit))
            queue.extend(hit)
            rest = rest[~near]
    return out


def bucket_links(limit: int):
    """A task over (key, fp) rows in order that yields spanning links (u, v) of every bucket."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def settle(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[start, len(key)])
            two = start[length == 2]
            a, b = fp[two], fp[two + 1]
            near = np.bitwise_count(a ^ b) <= limit
            found = [(a[near], b[near])]
            for s, n in zip(start[length > 2], length[length > 2], strict=True):
                found += spanning(fp[s : s + n], limit)
            u, v = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1))
            return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)}).drop_duplicates()

        for pdf in batches:  # a bucket may go on in the next batch
            key = np.concatenate([key, pdf["key"].to_numpy(np.int64)])
            fp = np.concatenate([fp, pdf["fp"].to_numpy(np.int64).view(np.uint64)])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield settle(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield settle(key, fp)

    return run


def near_duplicates(fps: DataFrame, limit: int = 2) -> DataFrame:
    """(id, fp) -> (id, fp, component): the smallest id reachable over links of `limit` bits or fewer.

    Exact for limits up to 3 (two segments, one wild bit each). Equal fingerprints are one node,
    so copies cost nothing; a null id never names a component unless it has no other member.
    """
    if not 0 <= limit <= 3:
        raise ValueError("two segments with one wild bit find distances of 3 bits at most")
    fps = cut(fps)
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("low")))
    v = F.col("v")
    segment = F.when(v < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    variants = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(
        (segment.bitwiseAND(F.expr("~shiftleft(1L, v % 32)")) + F.expr("shiftleft(cast(v as bigint), 32)")).alias("key"), "fp"
    )
    dealt = variants.repartition("key").sortWithinPartitions("key", "fp")
    found = dealt.mapInPandas(bucket_links(limit), "u long, v long")
    roots = components(found)
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    return fps.join(named.join(lows, "root").select("fp", "component"), "fp").select("id", "fp", "component")


#: Near copies: sixteen segments of 24 bits and SPARE bits besides; SAME of them all differ at most, which is a
#: shingle similarity of about 0.8. An id holds ID_BITS of the spare bits, of which ID_SAME differ at most.
SEGMENTS, BITS, SPARE, SAME, ID_BITS, ID_SAME = 16, 24, 64, 70, 40, 12
#: Rows of a bucket that are compared in one task; a larger bucket is as many cells as it has pairs of such blocks.
CELL = 4096
#: For a byte the eight bits, first the highest, as eight one-byte counters in a 64-bit word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_MIXERS = np.random.default_rng(SEED).integers(0, 2**64, (SEGMENTS * BITS + SPARE) // 64, dtype=np.uint64) | np.uint64(1)


def wide_fingerprint(text: bytes, width: int) -> bytes:
    """SimHash of 448 bits of the word shingles of a lower-cased text; no word gives zeros."""
    words = text.lower().split()
    if not words:
        return bytes(8 * len(_MIXERS))
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(w, SEED) for w in words]), np.uint64)
    width = min(width, len(words))
    shingle = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        shingle = (shingle * np.uint64(0x9E3779B97F4A7C15)) ^ h[i : len(shingle) + i]
        shingle ^= shingle >> np.uint64(31)
    ones = np.zeros(64 * len(_MIXERS), np.int64)
    for at in range(0, len(shingle), 255):  # one-byte counters hold 255 shingles
        mixed = shingle[at : at + 255, None] * _MIXERS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        ones += np.add.reduce(_LANES[mixed.view(np.uint8)], axis=0).view(np.uint8)
    return np.packbits(ones * 2 > len(shingle)).tobytes()


def wild_keys(prints: np.ndarray) -> np.ndarray:
    """For each fingerprint (a row of bytes) the keys of its segments with one bit wild, all numbered apart."""
    parts = prints[:, : SEGMENTS * BITS // 8].reshape(len(prints), SEGMENTS, BITS // 8).astype(np.int64)
    segment = (parts[:, :, 0] << 16) | (parts[:, :, 1] << 8) | parts[:, :, 2]
    wild = np.arange(BITS)
    number = np.arange(SEGMENTS)[:, None] * BITS + wild
    return ((segment[:, :, None] & ~(1 << wild)) | (number << BITS)).reshape(len(prints), -1)


def number_of(fp: bytes) -> int:
    """The id of a fingerprint: ID_BITS of its spare bits, then bits of a hash that tell fingerprints apart."""
    free = 64 - ID_BITS
    lead = int.from_bytes(fp[-SPARE // 8 :], "big") >> (SPARE - ID_BITS)
    x = lead << free | xxhash.xxh3_64_intdigest(fp) >> ID_BITS
    return x - (x >> 63 << 64)


def alike(most: int = ID_SAME, room: int = 20_000):
    """A task over (key, id) rows by key: those whose ids are near to another one's of their bucket.

    Buckets that unlike fingerprints share by chance end here, before fingerprints are fetched.
    """

    def settle(key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        bits = ids.view(np.uint64) >> np.uint64(64 - ID_BITS)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        keep = np.ones(len(key), bool)
        two = start[size == 2]
        keep[two] = keep[two + 1] = np.bitwise_count(bits[two] ^ bits[two + 1]) <= most
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if n <= 2000:  # larger ones go on whole
                far = np.bitwise_count(bits[s : s + n, None] ^ bits[None, s : s + n])
                np.fill_diagonal(far, 64)
                keep[s : s + n] = far.min(axis=1) <= most
        return keyed(key[keep], ids[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in shared(batches):
            key, ids = np.concatenate([key, b.column("key").to_numpy()]), np.concatenate([ids, b.column("id").to_numpy()])
            if len(key) >= room:
                last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                if last:
                    yield settle(key[:last], ids[:last])
                    key, ids = key[last:], ids[last:]
                else:
                    yield keyed(key, ids)
                    key, ids = key[:0], ids[:0]
        if len(key):
            yield settle(key, ids)

    return run


def forest(prints: np.ndarray, same: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of linked prints (rows of words, `same` bits or fewer apart): a spanning forest of all links.

    Each print reached is compared with those not reached yet, so many near prints cost about their number.
    """
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rest, queue = np.arange(len(prints)), []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        x = queue.pop()
        near = np.bitwise_count(prints[rest] ^ prints[x]).sum(axis=1, dtype=np.int64) <= same
        if near.any():
            hit = rest[near]
            us.append(hit)
            vs.append(np.full(len(hit), x))
            queue.extend(hit)
            rest = rest[~near]
    return np.concatenate(us), np.concatenate(vs)


def cell_links(same: int = SAME):
    """A task over (key, id, fp) rows by key: spanning links (u, v) of the fingerprints of every key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_keys(batches):
            key, ids = pdf["key"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64)
            fp = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(len(pdf), -1)
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            two = start[size == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]).sum(axis=1, dtype=np.int64) <= same
            us, vs = [two[near]], [two[near] + 1]
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                u, v = forest(fp[s : s + n], same)
                us.append(s + u)
                vs.append(s + v)
            u, v = ids[np.concatenate(us)], ids[np.concatenate(vs)]
            yield pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)}).drop_duplicates()

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, same: int = SAME) -> DataFrame:
    """(_d, _t, root): the identity of every document with the number of its group of near copies.

    Fingerprints of word shingles are linked where `same` bits or fewer differ, as estimates of a
    similarity of 0.8; they are found through segments with one wild bit, and groups are connected
    components. Wordless texts have fingerprint zero and are copies of each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [wide_fingerprint(t.as_py(), width) for t in b.column("t")]
            yield pa.record_batch([b.column("_d"), b.column("_t"), pa.array(fp, pa.binary()), pa.array(map(number_of, fp), pa.int64())], ["_d", "_t", "fp", "id"])

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, len(b), 500)):
                keys = wild_keys(np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(len(part), -1))
                yield pa.record_batch([pa.array(keys.ravel()), part.column("id").take(pa.array(np.repeat(np.arange(len(part)), keys.shape[1])))], ["key", "id"])

    rows = doc_key(docs.select(id_col, text_col), id_col, text_col).select("_d", "_t", raw(text_col).alias("t"))
    prints = stored(rows.mapInArrow(run, "_d long, _t long, fp binary, id long"))
    nodes = stored(prints.select("id", "fp").dropDuplicates(["id"]))
    dealt = nodes.mapInArrow(variants, "key long, id long")
    dealt = stored(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(alike(), "key long, id long"))
    cells = in_cells(dealt, CELL).join(nodes, "id").repartition("key").sortWithinPartitions("key", "id").select("key", "id", "fp")
    links = cells.mapInPandas(cell_links(same), "u long, v long")
    roots = components(links).withColumnRenamed("node", "id")
    return prints.select("_d", "_t", "id").join(roots, "id", "left").select("_d", "_t", F.coalesce("root", "id").alias("root"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: fingerprint and component of every document."""
    from quillgrain.llm.common import table

    found = near_duplicates(fingerprints(table(spark, sf_dir, "documents")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
