"""Vectors: hashed embeddings and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrain.sources.scratch import stored

# The hashed embedding and its stamp.
DIM, STAMP = 256, "cheap:crc32:256"
#: Vectors of a block and queries of a product; vectors that deal rows to tasks; rows that a task groups; blocks whose bounds a task works out.
BLOCK, PIVOTS, TASK_ROWS, HEADS = 2000, 256, 50_000, 4096
#: What rounding may take from a bound.
SLACK = 1e-6


def _crc_table() -> np.ndarray:
    """The 256 steps of CRC-32, from its reversed polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def hashed_embeddings(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """For each text the signed counts of hashed character 3- and 4-grams, padded and in lower case, as a unit vector.

    The last gram of each size is left out. All grams of a batch are hashed at once, byte by byte.
    """
    padded = [f" {(t or '').lower()} ".encode("utf-8", "ignore") for t in texts]
    flat = np.frombuffer(b"".join(padded), np.uint8)
    first = np.flatnonzero((flat & 0xC0) != 0x80)  # where characters start
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, padded), np.int64, len(padded)))[first]
    flat, edge = np.concatenate([flat, np.zeros(16, np.uint8)]), np.r_[first, len(flat)]
    out = np.zeros((len(texts), dim))
    for n in (3, 4):
        whole = np.flatnonzero(owner[n:] == owner[:-n]) if len(owner) > n else np.empty(0, np.int64)
        start, size = edge[whole], edge[whole + n] - edge[whole]
        crc = np.full(len(whole), 0xFFFFFFFF, np.uint32)
        for i in range(int(size.max(initial=0))):
            step = _CRC[(crc ^ flat[start + i]) & np.uint32(255)] ^ (crc >> np.uint32(8))
            crc = np.where(i < size, step, crc) if i >= n else step
        h = ~crc
        sign = np.where((h >> np.uint32(16)) & np.uint32(1), 1.0, -1.0)
        out += np.bincount(owner[whole] * dim + (h % dim).astype(np.int64), sign, out.size).reshape(out.shape)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def embed(rows: DataFrame, text_col: str = "content", id_col: str = "id") -> DataFrame:
    """(id, embedding, embedding_model, embedding_dim) by the hashed embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):  # a few texts at a time stay in the processor's cache
                part = b.slice(at, 64)
                v = hashed_embeddings(part.column("t").to_pylist())
                ends = pa.array(np.arange(0, v.size + 1, DIM, dtype=np.int32))
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["id", "embedding"])

    out = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, "id long, embedding array<float>")
    return out.withColumns({"embedding_model": F.lit(STAMP), "embedding_dim": F.lit(DIM)})


def _joined(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy().astype(float).reshape(-1, dim)


def _closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the centre nearest to each point."""
    norms = (centres**2).sum(axis=1)
    return np.concatenate([(norms - 2 * points[i : i + 1024] @ centres.T).argmin(axis=1) for i in range(0, len(points), 1024)])


def _dense_groups(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Groups of at most `most` points that lie near each other, around points picked among them."""
    if len(points) <= most:
        return [np.arange(len(points))]
    picks = np.random.default_rng(len(points)).choice(len(points), -(-2 * len(points) // most), replace=False)
    near = _closest(points, points[picks])
    order = np.argsort(near, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(near[order])) + 1)
    return [g[i : i + most] for g in groups for i in range(0, len(g), most)]


def _renamed(df: DataFrame, *names: str) -> DataFrame:
    """The columns under new names, so that two sides of one origin can be grouped together."""
    return df.select(*[F.col(c).alias(f"{c}_" if c in names else c) for c in df.columns])


_BLOCK_ROW = "stamp string, dim int, block long, n int, ids binary, vectors binary, centre binary, radius double, norm double"


def blocks_of(rows: DataFrame, size: int = BLOCK, pivots: int = PIVOTS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Vectors (id, stamp, vector) as blocks of at most `size` near ones, each with its centre, radius and largest norm.

    Rows go to the nearest of at most `pivots` vectors, those of the least id hashes (fewer for few rows), and a task
    groups at most about `task_rows` rows of one pivot, so a dense region is many tasks. The blocks are
    a table with one row each.
    """
    rows = rows.where("id is not null and vector is not null and size(vector) > 0").select(F.col("id").cast("long").alias("id"), F.coalesce("stamp", F.lit("")).alias("stamp"), "vector", F.size("vector").alias("dim"))
    few = max(1, min(pivots, 4 * rows.count() // size))
    first = rows.select("dim", "vector").orderBy(F.xxhash64("id"), "id").limit(few).collect()
    centres = {d: np.array([r.vector for r in first if r.dim == d], float) for d in {r.dim for r in first}}

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            cell = np.zeros(len(b), np.int64)
            for d in np.unique(dims).tolist():
                if d in centres:
                    own = np.flatnonzero(dims == d)
                    cell[own] = _closest(_joined(pa.chunked_array([b.column("vector").take(pa.array(own))]), d), centres[d])
            yield b.append_column("cell", pa.array(cell))

    near = stored(rows.mapInArrow(locate, "id long, stamp string, vector array<float>, dim int, cell long"))
    counts = near.groupBy("stamp", "dim", "cell").agg(F.count("*").alias("n"))
    dealt = near.join(counts, ["stamp", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / task_rows)))

    def group(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        stamp, dim, cell, part = (k.as_py() for k in key)
        own = own.sort_by("id")
        x, ids = _joined(own["vector"], dim), own["id"].to_numpy()
        out = []
        for i, g in enumerate(_dense_groups(x, size)):
            c = x[g].mean(axis=0)
            radius = np.sqrt(((x[g] - c) ** 2).sum(axis=1).max())
            out.append((stamp, dim, (cell << 40) + (part << 20) + i, len(g), ids[g].tobytes(), x[g].astype("<f4").tobytes(), c.tobytes(), float(radius), float(np.sqrt((x[g] ** 2).sum(axis=1).max()))))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _BLOCK_ROW.split(", ")])

    return stored(dealt.groupBy("stamp", "dim", "cell", "part").applyInArrow(group, _BLOCK_ROW))


def block_pairs(blocks: DataFrame, asked: DataFrame, floors: DataFrame | None = None, enough: int = 0) -> DataFrame:
    """Pairs (query_id, block, qb) that may hold a better row than a query's floor.

    A block's score is at most that of its centre plus the query's norm times the radius, and at most
    the product of norms. Without floors, the best blocks by this bound that hold `enough` rows.
    """
    heads = blocks.select("stamp", "dim", "block", "n", "centre", "radius", "norm").withColumn("hb", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-blocks.count() // HEADS)))))
    parts = heads.select("stamp", "dim", "hb").distinct()
    q = asked.join(floors, "query_id", "left") if floors is not None else asked.withColumn("floor", F.lit(None).cast("double"))
    sent = q.join(parts, ["stamp", "dim"])

    def bound(key: tuple[pa.Scalar, ...], h: pa.Table, q: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        if len(h) and len(q):
            dim = key[1].as_py()
            c = np.frombuffer(b"".join(x.as_buffer() for x in h["centre"]), float).reshape(-1, dim)
            x = _joined(q["vector"], dim)
            own = np.sqrt((x**2).sum(axis=1))[:, None]
            most = np.minimum(x @ c.T + own * h["radius"].to_numpy(), own * h["norm"].to_numpy()) + SLACK
            floor = np.nan_to_num(q["floor"].to_numpy(zero_copy_only=False).astype(float), nan=0.0)[:, None]
            good, n = most >= floor, h["n"].to_numpy()
            if enough:  # the best ones that hold enough rows, of these heads alone
                order = np.argsort(-most, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1) - n[order]
                keep = np.zeros_like(good)
                np.put_along_axis(keep, order, held < enough, axis=1)
                good &= keep
            a, b = np.nonzero(good)
            out = [q["query_id"].to_numpy()[a], h["block"].to_numpy()[b], q["qb_"].to_numpy()[a], most[a, b], n[b].astype(np.int64)]
        names = ["query_id", "block", "qb", "most", "n"]
        return pa.table([pa.array(v) for v in out], names)

    qbs = sent.select("stamp", "dim", "hb", "qb").distinct()
    sent = _renamed(sent, "stamp", "dim", "hb", "qb")
    found = heads.join(qbs, ["stamp", "dim", "hb"]).groupBy("stamp", "dim", "hb", "qb").cogroup(sent.groupBy("stamp_", "dim_", "hb_", "qb_")).applyInArrow(bound, "query_id long, block long, qb long, most double, n long")
    if enough:
        w = Window.partitionBy("query_id").orderBy(F.desc("most"), "block").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < enough)
    return found.select("query_id", "block", "qb")


def _scored(blocks: DataFrame, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k best of each pair's block, as one product for a block and a block of queries."""
    own = blocks.select("block", "stamp", "dim", "ids", "vectors").join(pairs.join(asked.select("query_id", "stamp", "dim"), "query_id").select("block", "stamp", "dim", "qb").distinct(), ["block", "stamp", "dim"])
    keys = ["stamp", "dim", "block", "qb"]
    q = _renamed(pairs.join(asked.drop("qb"), "query_id"), *keys)

    def product(key: tuple[pa.Scalar, ...], b: pa.Table, q: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if len(b) and len(q):
            dim = key[1].as_py()
            ids = np.frombuffer(b["ids"][0].as_buffer(), np.int64)
            x = np.frombuffer(b["vectors"][0].as_buffer(), "<f4").astype(float).reshape(-1, dim)
            scores = _joined(q["vector"], dim) @ x.T
            best = np.lexsort((np.broadcast_to(-ids, scores.shape), -np.round(scores, 9)), axis=1)[:, :k]
            top = np.take_along_axis(scores, best, 1)
            a, c = np.nonzero(top > 0)
            out = [q["query_id"].to_numpy()[a], ids[best[a, c]], top[a, c]]
        return pa.table([pa.array(v) for v in out], ["query_id", "id", "score"])

    return own.groupBy(*keys).cogroup(q.groupBy(*(f"{c}_" for c in keys))).applyInArrow(product, "query_id long, id long, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 60, size: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k rows of a query's stamp with the largest positive dot product.

    Exact; ties go to the larger id. Vectors lie in blocks of near ones. A query first meets the few
    blocks of the highest bounds that hold k rows; the k-th score found there is its floor, and then it
    meets just the blocks whose bound reaches it. Only vectors of a query's own stamp and length count;
    null ids and null or empty vectors take no part. A query that comes repeatedly is answered once.
    """
    blocks = blocks_of(rows, size)
    asked = queries.where("query_id is not null and vector is not null and size(vector) > 0").select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("stamp", F.lit("")).alias("stamp"), F.size("vector").alias("dim"), "vector").dropDuplicates(["query_id"])
    asked = stored(asked)
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // BLOCK)))))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc("id"))
    best = lambda found: found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    early = stored(block_pairs(blocks, asked, enough=k))
    known = stored(best(_scored(blocks, asked, early, k)))
    floors = known.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    late = block_pairs(blocks, asked, floors).join(early.select("query_id", "block"), ["query_id", "block"], "left_anti")
    return best(known.drop("rank").unionByName(_scored(blocks, asked, stored(late), k)))


@dataclass
class Migration:
    """Rows that got a vector of the target model, and per table how many needed one and how many still do."""

    rebuilt: DataFrame
    remaining: DataFrame


def migrate(memories: DataFrame, summaries: DataFrame, model: str, dim: int, embed_rows: Callable[[DataFrame], DataFrame], limit: int | None = None, parts: int = 64) -> Migration:
    """Embeds anew what another model embedded: memories first, then summaries, at most `limit` rows in all.

    Both tables are (id, content, embedding, embedding_model, embedding_dim); blank summaries need no
    vector. `embed_rows` gets (id, content) and gives (id, embedding). A local fallback model is
    refused, as it would destroy vectors. What was rebuilt is no longer stranded, so another run goes
    on where one ended, and one after the last has nothing to do. The limit is kept without a global
    order: rows lie in ranges of (table, id), and the counts of the ranges before say where one begins.
    """
    if model.startswith("cheap:"):
        raise ValueError("a fallback model would replace real vectors")
    own = lambda df, tab: df.where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(model) | ~F.col("embedding_dim").eqNullSafe(dim)).select(F.lit(tab).alias("tab"), F.col("id").cast("long").alias("id"), F.coalesce("content", F.lit("")).alias("content"))
    need = own(memories, "memories").unionByName(own(summaries.where(F.trim(F.coalesce("content", F.lit(""))) != ""), "summaries"))
    ranged = stored(need.select("tab", "id").repartitionByRange(parts, "tab", "id").withColumn("part", F.spark_partition_id()))
    counts = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most `parts` rows
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    at = ranged.join(F.broadcast(ranged.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, before long")), "part")
    ranked = at.select("tab", "id", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("tab", "id"))).alias("rank"))
    now = stored(ranked.where(F.col("rank") <= (before if limit is None else max(0, limit))).select("tab", "id"))
    todo = need.join(now, ["tab", "id"])
    made = [embed_rows(todo.where(F.col("tab") == t).select("id", "content")).select(F.lit(t).alias("tab"), "id", "embedding") for t in ("memories", "summaries")]
    rebuilt = made[0].unionByName(made[1]).withColumns({"embedding_model": F.lit(model), "embedding_dim": F.lit(dim)})
    names = ranged.sparkSession.createDataFrame([("memories",), ("summaries",)], "tab string")
    done = now.groupBy("tab").agg(F.count("*").alias("done"))
    left = names.join(ranged.groupBy("tab").agg(F.count("*").alias("needed")), "tab", "left").join(done, "tab", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return Migration(rebuilt, left.select("tab", zero("needed").alias("needed"), (zero("needed") - zero("done")).alias("remaining")))
