"""Best-fit-decreasing packing of indivisible groups into shards.

A group is all rows of one key (for documents: of one text), and stays whole. Groups are taken in
falling size, and each enters the shard of the least space that holds it, which a balanced tree of
spaces finds; where none does, the next shard of the capacity is opened. For a given number of shards
the least capacity at which that many are enough is looked for.

Groups of one size are alike to the packing: the first takes the tightest shard, which then is still
the tightest for the next, until it is full. So only (size, number of groups) goes to the one task
that packs; different sizes that sum up to T bytes are at most sqrt(2 T), 14 million for 100 TB. Its
runs (from the i-th group of that size on, shard, how many to a shard) are joined back to the groups,
which are ranked inside their size in buckets. The result is that of packing group by group.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrain.llm.common import raw, stored

SHARDS = 40
#: Bytes that a row costs besides its text.
ROW = 16
#: Rows of a rank bucket, or the square root of all rows where that is more.
BUCKET = 1024


class Tree:
    """A weight-balanced tree of keys; each node is (key, left, right, size)."""

    def __init__(self):
        self.root = None

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def take_least(self, low: tuple[int, int]) -> tuple[int, int] | None:
        """Takes out the least key that is not below `low`."""
        best, node = None, self.root
        while node:
            if node[0] >= low:
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best is not None:
            self.root = self._drop(self.root, best)
        return best

    def _add(self, node, key):
        if node is None:
            return (key, None, None, 1)
        if key < node[0]:
            return _joined(node[0], self._add(node[1], key), node[2])
        return _joined(node[0], node[1], self._add(node[2], key))

    def _drop(self, node, key):
        if key < node[0]:
            return _joined(node[0], self._drop(node[1], key), node[2])
        if key > node[0]:
            return _joined(node[0], node[1], self._drop(node[2], key))
        if node[1] is None or node[2] is None:
            return node[1] or node[2]
        least = node[2]
        while least[1]:
            least = least[1]
        return _joined(least[0], node[1], self._drop(node[2], least[0]))


def _size(node) -> int:
    return node[3] if node else 0


def _node(key, left, right):
    return (key, left, right, _size(left) + _size(right) + 1)


def _joined(key, left, right):
    """A node over two trees of which one may be heavier by one key more than allowed."""
    a, b = _size(left), _size(right)
    if a + b > 1 and b > 3 * a:  # turn left, twice if the inner part is the heavy one
        k, inner, outer, _ = right
        if _size(inner) < 2 * _size(outer):
            return _node(k, _node(key, left, inner), outer)
        return _node(inner[0], _node(key, left, inner[1]), _node(k, inner[2], outer))
    if a + b > 1 and a > 3 * b:
        k, outer, inner, _ = left
        if _size(inner) < 2 * _size(outer):
            return _node(k, outer, _node(key, inner, right))
        return _node(inner[0], _node(k, outer, inner[1]), _node(key, inner[2], right))
    return _node(key, left, right)


Runs = list[list[tuple[int, int, int]]]


def best_fit_decreasing(sizes: list[int], counts: list[int], capacity: int, most: int | None = None) -> tuple[Runs, int] | None:
    """Runs (from, shard, each) of every falling size, and the number of shards; None if over `most`.

    From the from-th group of a size on, `each` go to `shard`, the next `each` to the one after it,
    and so on up to the next run. Spaces that are equal are taken by shard number. A group over the
    capacity has a shard of its own.
    """
    spaces, opened, out = Tree(), 0, []
    for size, count in zip(sizes, counts, strict=True):
        at, runs = 0, []
        while at < count:
            best = spaces.take_least((size, -1))
            if best is None:
                break
            space, shard = best
            fit = min(count - at, space // size if size else count)
            runs.append((at, shard, fit))
            at += fit
            spaces.add((space - fit * size, shard))
        if at < count:
            each = max(1, capacity // size) if size else count - at
            new = -(-(count - at) // each)
            if most is not None and opened + new > most:
                return None
            runs.append((at, opened, each))
            for i in range(new):
                held = min(each, count - at - i * each)
                spaces.add((max(0, capacity - held * size), opened + i))
            opened += new
        out.append(runs)
    return out, opened


def near_equal(sizes: list[int], counts: list[int], shards: int) -> Runs:
    """Runs over a given number of shards, by the least capacity found at which they are enough.

    A group of at least the mean of what is left is alone in its shard; it can't be split, and a
    capacity that holds it would leave other shards empty.
    """
    counts, alone = list(counts), [0] * len(sizes)
    total, left, at, used = sum(s * c for s, c in zip(sizes, counts, strict=True)), shards, 0, 0
    own: list[int] = []
    while at < len(sizes) and left > 1 and sizes[at] * left >= total:
        own.append(at)
        alone[at] += 1
        total, left, used = total - sizes[at], left - 1, used + 1
        counts[at] -= 1
        at += counts[at] == 0
    rest = [i for i, c in enumerate(counts) if c]
    runs: Runs = [[] for _ in sizes]
    for shard, i in enumerate(own):
        runs[i].append((len(runs[i]), shard, 1))
    if not rest:
        return runs
    s, c = [sizes[i] for i in rest], [counts[i] for i in rest]
    least = max(-(-total // left), s[0])
    low, more = least - 1, 0
    while not (found := best_fit_decreasing(s, c, least + more, left)):
        low, more = least + more, max(1, least >> 20) if not more else 4 * more
    high = least + more
    for _ in range(6):
        if high - low <= 1 + (least >> 22):
            break
        mid = (low + high) // 2
        if better := best_fit_decreasing(s, c, mid, left):
            found, high = better, mid
        else:
            low = mid
    for i, part in zip(rest, found[0], strict=True):
        runs[i] += [(alone[i] + at, used + shard, each) for at, shard, each in part]
    return runs


_RUN = "array<struct<at:long,shard:long,each:long>>"
_RUN_TYPE = pa.list_(pa.struct([("at", pa.int64()), ("shard", pa.int64()), ("each", pa.int64())]))


def _bucket(key: Column, rows: Column) -> Column:
    """A bucket of a row among `rows`."""
    return F.pmod(F.xxhash64(key), F.ceil(rows / F.greatest(F.lit(float(BUCKET)), F.sqrt(rows))))


def place(rows: DataFrame, key: str, size: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """(key, shard) of every group of `rows`: near-equal `shards`, or as few as best fit needs of a `capacity`.

    A null size counts as 0; null keys are one group. An empty table has no group.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("either shards or capacity")
    groups = stored(rows.groupBy(F.col(key).alias("k")).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).cast("long").alias("g")))

    def run(_: tuple[pa.Scalar, ...], sizes: pa.Table) -> pa.Table:
        sizes = sizes.sort_by([("g", "descending")])
        g, n = sizes["g"].to_pylist(), sizes["n"].to_pylist()
        runs = near_equal(g, n, shards) if shards else best_fit_decreasing(g, n, capacity)[0]
        ends = np.cumsum([0, *map(len, runs)])
        flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
        inner = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN_TYPE.value_type))
        return pa.table([pa.array(g), pa.array(n), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)], ["g", "n", "runs"])

    packed = stored(groups.groupBy("g").agg(F.count("*").alias("n")).groupBy(F.lit("all")).applyInArrow(run, f"g long, n long, runs {_RUN}"))
    dealt = stored(groups.join(packed.select("g", "n"), "g").select("k", "g", _bucket(F.col("k"), F.col("n")).alias("b")))
    before = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("g", "b").agg(F.count("*").alias("c")).select("g", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
    ranked = dealt.join(offsets, ["g", "b"]).select("k", "g", (F.col("o") + F.row_number().over(Window.partitionBy("g", "b").orderBy("k")) - 1).alias("i"))
    last = F.element_at(F.filter("runs", lambda x: x["at"] <= F.col("i")), -1)
    found = ranked.join(packed.select("g", "runs"), "g").withColumn("r", last)
    return found.select(F.col("k").alias(key), (F.col("r.shard") + F.expr("(i - r.at) div r.each")).cast("int").alias("shard"))


def _text_key(text_col: str) -> Column:
    """A text's identity, of 128 bits; null is the empty text."""
    return F.unhex(F.md5(raw(text_col)))


def _text_size(text_col: str) -> Column:
    return (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + ROW).cast("long")


def assign(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, size, text_crc32, shard, slot (from 0 without gaps in a shard).

    Documents of equal text share a shard, null and empty texts too. Sizes of shards are near equal,
    or at most `capacity`, but for texts whose copies take more, which have a shard of their own.
    Repeated rows and null ids each get a slot of their own; an empty table gives no row. No other
    column is looked at, and texts are read once and never shuffled. Slots are counted in buckets, so
    a shard with a third of all rows is no single task; rows alike in id and text share a bucket.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), _text_key(text_col).alias("key"), _text_size(text_col).alias("size"), F.crc32(raw(text_col)).alias("text_crc32"))
    own = stored(own)
    placed = stored(own.join(place(own, "key", "size", shards, capacity), "key"))
    placed = placed.withColumn("b", _bucket(F.struct("id", "key"), F.lit(float(placed.count()))))
    before = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "b").agg(F.count("*").alias("c")).select("shard", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
    slot = F.col("o") + F.row_number().over(Window.partitionBy("shard", "b").orderBy("id", "key")) - 1
    return placed.join(offsets, ["shard", "b"]).select("id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int | None = SHARDS, capacity: int | None = None, text_col: str = "text", rows_per_file: int = 1_000_000) -> None:
    """Writes whole rows into a Parquet folder `shard=N` for each shard, many tasks to a large shard.

    A column named `shard` is an error, as the folder's name stands for it.
    """
    if "shard" in docs.columns:
        raise ValueError("rename the column shard")
    key, size = (f"{x}_{uuid.uuid4().hex}" for x in ("key", "size"))
    rows = docs.withColumns({key: _text_key(text_col), size: _text_size(text_col)})
    where = stored(place(rows.select(key, size), key, size, shards, capacity))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if not docs.schema[c].dataType.typeName() == "map"]), F.lit(max(1, docs.count() // rows_per_file)))
    rows.join(where, key).drop(key, size).repartition("shard", salt).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the shard and slot of every document; equal texts stay together and sizes are near equal."""
    from quillgrain.llm.common import table

    placed = assign(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
