"""Exact top-k search by best-first traversal of M-trees.

Scores are integer inner products. With one more coordinate, sqrt(M^2 - |x|^2) for the largest norm
M of a tree, the Euclidean distance to a query orders vectors as the inner product does, so a
metric tree applies. Vectors are dealt by a hash into shards of a bounded number; a shard bulk-loads
a tree of pages. Each entry of a page stores its distance to the page's routing vector and, above
the leaves, a covering radius. A query takes pages in the order of their least possible distance,
and the stored distances exclude entries by the triangle inequality before theirs is computed.
Scores themselves are computed in integers. Queries meet the shards in blocks of a bounded number.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, FANOUT, SHARD, QUERY_BLOCK = 128, 16, 8192, 4096


@dataclass
class Page:
    """Entries with one routing vector: rows of the points (leaf) or child pages."""

    route: np.ndarray
    entries: np.ndarray
    to_route: np.ndarray
    children: list[Page] | None = None
    radii: np.ndarray | None = None

    @property
    def radius(self) -> float:
        reach = self.to_route if self.radii is None else self.to_route + self.radii
        return float(reach.max(initial=0.0))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _deal(points: np.ndarray, size: int, seed: int) -> list[np.ndarray]:
    """Groups of at most `size` points around routing points picked among them."""
    picks = np.random.default_rng(seed).choice(len(points), max(1, -(-len(points) // (size // 2))), replace=False)
    norms = (points[picks] ** 2).sum(axis=1)
    near = np.concatenate([(norms - 2 * points[i : i + 1024] @ points[picks].T).argmin(axis=1) for i in range(0, len(points), 1024)])
    order = np.argsort(near, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(near[order])) + 1)
    return [g[i : i + size] for g in groups for i in range(0, len(g), size)]


def build(points: np.ndarray) -> Page:
    """Bulk-loads the tree bottom-up."""
    pages = []
    for g in _deal(points, PAGE, 7):
        route = points[g].mean(axis=0)
        pages.append(Page(route, g, _far(points[g], route)))
    while len(pages) > 1:
        routes = np.array([p.route for p in pages])
        groups = _deal(routes, FANOUT, 7) if len(pages) > FANOUT else [np.arange(len(pages))]
        level = []
        for g in groups:
            route, own = routes[g].mean(axis=0), [pages[i] for i in g]
            level.append(Page(route, routes[g], _far(routes[g], route), own, np.array([p.radius for p in own])))
        pages = level
    return pages[0]


class Tree:
    """A shard's distinct vectors (a copy beyond the k + 1 smallest ids can't be an answer)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.flatnonzero(np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)])
        self.ids = [ids[s : s + min(n, k + 1)].tolist() for s, n in zip(new, np.diff(np.r_[new, len(ids)]), strict=True)]
        self.vectors, self.k = vectors[new], k
        real = self.vectors.astype(float)
        squares = (real**2).sum(axis=1)
        self.top = float(squares.max())
        self.root = build(np.c_[real, np.sqrt(np.maximum(self.top - squares, 0))])
        self.computed = 0

    def search(self, query_id: int, q: np.ndarray) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id; the query's own id takes no part."""
        real = np.r_[q.astype(float), 0.0]
        whole = float(real @ real) + self.top
        slack = 1e-7 * (1 + whole**0.5)
        limit, best = np.inf, []
        start = float(np.sqrt(((real - self.root.route) ** 2).sum()))
        heap, count = [(max(0.0, start - self.root.radius), 0, start, self.root)], 0
        while heap:
            bound, _, at, page = heappop(heap)
            if bound > limit + slack:
                break
            if page.children is None:
                rows = page.entries[np.abs(at - page.to_route) <= limit + slack]
                self.computed += len(rows)
                scores = self.vectors[rows] @ q
                hits = np.flatnonzero(scores >= best[-1][0]) if len(best) == self.k else np.arange(len(rows))
                if len(hits):
                    best += [(int(scores[i]), x) for i in hits for x in self.ids[rows[i]] if x != query_id]
                    best = sorted(best, key=lambda b: (-b[0], b[1]))[: self.k]
                    if len(best) == self.k:
                        limit = max(0.0, whole - 2 * best[-1][0]) ** 0.5
            else:
                near = np.flatnonzero(np.abs(at - page.to_route) - page.radii <= limit + slack)
                self.computed += len(near)
                far = _far(page.entries[near], real)
                for i, d, r in zip(near.tolist(), far.tolist(), page.radii[near].tolist(), strict=True):
                    if d - r <= limit + slack:
                        count += 1
                        heappush(heap, (max(0.0, d - r), count, d, page.children[i]))
        return best


def usable(vector: Column) -> Column:
    """Neither null nor empty nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) over frames of (id long, v array<long>).

    Only vectors of a query's own length are its candidates; rows with its id are not. A null id
    takes no part, and a query id that comes repeatedly is answered once, for its least vector.
    """
    vectors = vectors.where("id is not null").select("id", "v", F.size("v").alias("dim"))
    queries = queries.where("id is not null").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    shards = max(1, -(-vectors.count() // shard))
    blocks = max(1, -(-queries.count() // block))
    part = vectors.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def search(key: tuple[pa.Scalar, ...], own: pa.Table, q: pa.Table) -> pa.Table:
        out = []
        if len(own) and len(q):
            dim = key[0].as_py()
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            tree = Tree(own["id"].to_numpy(), matrix(own), k)
            for query_id, v in zip(q["id"].to_pylist(), matrix(q), strict=True):
                out += [(query_id, vec_id, score) for score, vec_id in tree.search(query_id, v)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    found = part.groupBy("dim", "s", "b").cogroup(asked.groupBy("dim", "s", "b")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the five best vectors of every 50th vector, on components floored at 1/256."""
    from quillgrain.llm.common import table

    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))
    return top_k(rows, rows.where("id % 50 = 0"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
