"""Variable-capacity best-fit packing of documents into training sequences.

Documents are dealt by a hash of their id into shards of a bounded number of documents. In a shard
the pieces are placed in falling length, each into the open bin that it leaves fullest. Where none
fits, a bin is opened at the permitted length of least cost: for each length the pieces still to come
fill it in falling order, and the cost of the bin over the contents decides. Finally every bin is
downsized to the least permitted length that holds its contents. Plans that open all bins at one
length are made too, and the cheapest plan of a shard is kept, so mixing lengths never costs more.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrain.llm.common import WORD

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD_DOCS = 2000
#: Rows alike in id and length that go to a shard together.
COPIES = 500


class Remaining:
    """The pieces still to come, in falling size: how far they would fill a space."""

    def __init__(self, sizes: np.ndarray):
        values, counts = np.unique(sizes, return_counts=True)
        self.sizes, self.counts = values[::-1].tolist(), counts[::-1].tolist()
        self.negative = [-x for x in self.sizes]

    def take(self, size: int) -> None:
        self.counts[bisect_left(self.negative, -size)] -= 1

    def fill(self, space: int) -> int:
        """The sum of the pieces that are taken, largest first, as far as they fit."""
        filled, at = 0, 0
        while space - filled > 0:
            at = bisect_left(self.negative, filled - space, at)
            if at == len(self.sizes) or self.sizes[at] == 0:
                break
            filled += self.sizes[at] * min(self.counts[at], (space - filled) // self.sizes[at])
            at += 1
        return filled


def plan(sizes: np.ndarray, opening: int | None, capacities: tuple[int, ...], overhead: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Best fit of falling sizes: bin of each piece, contents of each bin, offset of each piece.

    A bin is opened at `opening`, or the least length above it that holds the piece; with no
    `opening`, at the length whose cost over its contents is least.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    used: list[int] = []
    spaces: list[int] = []  # free spaces in order, each with its bins
    free: dict[int, list[int]] = {}
    coming = Remaining(sizes) if opening is None else None
    for i, size in enumerate(sizes.tolist()):
        if coming:
            coming.take(size)
        at = bisect_left(spaces, size)
        if at < len(spaces):
            space = spaces[at]
            b = free[space].pop()
            if not free[space]:
                del free[space], spaces[at]
        else:
            b = len(used)
            used.append(0)
            able = [c for c in capacities if c >= max(size, opening or 0)]
            if coming and len(able) > 1:  # at equal cost the longer one
                space = min(able, key=lambda c: ((c + overhead) / max(1, size + coming.fill(c - size)), -c))
            else:
                space = able[0]
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if left := space - size:
            if left not in free:
                insort(spaces, left)
            free.setdefault(left, []).append(b)
    return bins, used, offsets


def pack_shard(sizes: np.ndarray, capacities: tuple[int, ...], overhead: int) -> pd.DataFrame:
    """The least-cost plan of one shard of falling sizes; a sequence costs its length and a fixed overhead."""
    top, caps = capacities[-1], np.array(capacities)
    pieces = np.maximum(1, -(-sizes // top))
    doc = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.minimum(top, sizes[doc] - number * top)
    order = np.lexsort((number, doc, -length))
    best = None
    for opening in (None, *capacities):
        bins, used, offsets = plan(length[order], opening, capacities, overhead)
        final = caps[np.searchsorted(caps, used)] if used else caps[:0]
        cost = int(final.sum()) + overhead * len(final)
        if best is None or cost < best[0]:
            best = cost, bins, offsets, final
    _, bins, offsets, final = best
    return pd.DataFrame({"row": doc[order], "piece": number[order], "start": number[order] * top, "length": length[order], "bin": bins, "offset": offsets, "capacity": final[bins]})


def pack(
    docs: DataFrame,
    length_col: str,
    id_col: str = "doc_id",
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = 16,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row per piece: id, piece, start, length, bin_id, offset, capacity.

    A document longer than the largest permitted length is cut into full pieces and a rest; a
    negative or null length counts as 0, and a document of length 0 is one empty piece. Rows with
    equal ids, null ones too, are packed each for itself; an empty table gives no piece. Only ids
    and lengths are shuffled, and what an id repeats is dealt in blocks to many shards. No other
    column is looked at.
    """
    capacities = tuple(sorted(capacities))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    shards = max(1, -(-docs.count() // shard_docs))
    # rows that are alike go in blocks of COPIES, which a hash of the block spreads
    counted = rows.groupBy("id", "size").agg(F.count("*").alias("n"))
    blocks = counted.select("id", "size", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("block"))
    dealt = blocks.select("id", "size", F.least(F.lit(COPIES), F.col("n") - COPIES * F.col("block")).alias("copies"), F.pmod(F.xxhash64("id", "size", "block"), F.lit(shards)).alias("shard"))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.repeat(np.arange(len(rows)), rows["copies"].to_numpy())))
        rows = rows.sort_by([("size", "descending"), ("id", "ascending")])
        out = pack_shard(rows["size"].to_numpy(), capacities, overhead)
        out["bin"] += key[0].as_py() * 2**31
        ids = rows["id"].take(pa.array(out["row"]))
        names = ["piece", "start", "length", "bin", "offset", "capacity"]
        return pa.table([ids, *(pa.array(out[n], pa.int64()) for n in names)], ["id", *(n.replace("bin", "bin_id") for n in names)])

    return dealt.groupBy("shard").applyInArrow(run, "id long, piece long, start long, length long, bin_id long, offset long, capacity long")


def n_words(text: str = "text"):
    """Words of a text, null 0: the length that the query packs by."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every piece of every document with its bin."""
    from quillgrain.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", n_words().alias("n_words"))
    return pack(docs, "n_words").withColumnRenamed("id", "doc_id")
