"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Queries and vectors are dealt into groups of bounded size, and every pair of a
query group and a vector group meets in one task. There the vectors are
quantised to int8 with a scale each; a product of two tiles of codes (exact, as
whole numbers in floats) gives the distance between the quantised vectors, and
the norms of what quantisation took away bound the true distance from below and
above. Pairs whose lower bound is beyond the k-th best upper bound, of this tile
or of the tiles before it, are dropped; the others are computed in double
precision and merged into a heap for each query. The heaps of all groups meet in
a top-k per query. So the result is exact; the bounds only spare work, the more
the larger a group is, so a group has thousands of vectors where there are so
many.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither do rows without an id. Vectors meet only
vectors of their own dimension. A query row does not meet itself, but other rows
that repeat its id; a repeated query row is answered once for each row. Ties go
to the smaller id. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledgerflow.llm import text as X

K = 10
#: Rows of a query group and of a vector group at most, on average; columns of a tile.
QUERY_GROUP, VECTOR_GROUP, TILE = 1024, 2048, 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of the rests."""
    scale = np.abs(x).max(axis=1) / 127
    code = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    return code, scale, np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1))


class Search:
    """The k least (distance, id) of each query over the vectors shown so far."""

    def __init__(self, q: np.ndarray, q_rows: np.ndarray, k: int):
        # whole numbers up to dimension * 127 * 127 are exact in this kind of float
        self.kind = np.float32 if q.shape[1] <= 1000 else np.float64
        self.q, self.rows, self.k = q, q_rows, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in q]
        #: Pairs met, and those of them that were computed in double precision.
        self.met = self.computed = 0
        with np.errstate(all="ignore"):
            code, self.scale, self.rest = quantise(q)
            self.tile = code.astype(self.kind)
            self.square = (code.astype(np.int64) ** 2).sum(axis=1) * self.scale**2

    def show(self, part: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Meet a tile of vectors, with their ids and row numbers."""
        k = self.k
        with np.errstate(all="ignore"):
            code, scale, rest = quantise(part)
            product = (self.tile @ code.astype(self.kind).T).astype(np.float64)
            square = self.square[:, None] + (code.astype(np.int64) ** 2).sum(axis=1) * scale**2 - 2 * product * self.scale[:, None] * scale
            near = np.sqrt(np.maximum(square, 0))
            slack = (self.rest[:, None] + rest) * (1 + 1e-9) + 1e-6 * (np.sqrt(self.square)[:, None] + near)
            own = self.rows[:, None] == rows
            upper = np.where(own, np.inf, near + slack)
            limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(self.q), np.inf)
            held = np.array([-h[0][0] if len(h) == k else np.inf for h in self.heaps])
            keep = ~(near - slack > np.minimum(limit, held)[:, None]) & ~own
            self.met += keep.size
            self.computed += int(keep.sum())
            for row in np.flatnonzero(keep.any(axis=1)):
                cols = np.flatnonzero(keep[row])
                exact = np.sqrt(np.cumsum((part[cols] - self.q[row]) ** 2, axis=1)[:, -1])  # summed in order, one component after another
                best = np.lexsort((ids[cols], exact))[:k]
                heap = self.heaps[row]
                for distance, other in zip(exact[best].tolist(), ids[cols[best]].tolist()):
                    # a max-heap by negation: its head is the worst of the k
                    if len(heap) < k:
                        heapq.heappush(heap, (-distance, -other))
                    elif (-distance, -other) > heap[0]:
                        heapq.heapreplace(heap, (-distance, -other))

    def best(self) -> list[list[tuple[float, int]]]:
        return [sorted((-d, -i) for d, i in h) for h in self.heaps]


def search(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, x_ids: np.ndarray, x_rows: np.ndarray, k: int) -> Search:
    found = Search(q, q_rows, k)
    for at in range(0, len(x), TILE):
        found.show(x[at : at + TILE], x_ids[at : at + TILE], x_rows[at : at + TILE])
    return found


def nearest(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query row: query_id, rank (from 1), the neighbour's id as `vec_id`, and score (Euclidean distance)."""
    own = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v"), is_query.alias("is_query"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = own.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0.0))
    own = own.withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("v"))
    rows, asked = own.agg(F.count("*"), F.count_if("is_query")).first()
    vector_groups = max(1, -(-rows // VECTOR_GROUP))
    query_groups = max(1, -(-asked // QUERY_GROUP))
    dealt = F.xxhash64("uid")
    asking = own.filter("is_query").withColumn("gq", F.pmod(dealt, F.lit(query_groups)).cast("int")).withColumn("gv", F.explode(F.sequence(F.lit(0), F.lit(vector_groups - 1))))
    held = own.withColumn("gv", F.pmod(dealt, F.lit(vector_groups)).cast("int")).withColumn("gq", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))

    def tiles(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float, int]] = []
        if len(left) and len(right):
            q, x = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            found = search(q, left["uid"].to_numpy(), x, right["id"].to_numpy(), right["uid"].to_numpy(), k).best()
            for uid, query, best in zip(left["uid"], left["id"], found):
                out += [(uid, query, d, i) for d, i in best]
        return pd.DataFrame(out, columns=["uid", "query_id", "score", "vec_id"])

    keys = ["dim", "gq", "gv"]
    met = asking.groupBy(*keys).cogroup(held.select("id", "uid", "v", *keys).groupBy(*keys)).applyInPandas(tiles, "uid long, query_id long, score double, vec_id long")
    rank = F.row_number().over(W.partitionBy("uid").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_block_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(X.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.place, q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i])), lambda a, b: a + b)) AS score FROM v AS q JOIN v ON q.place <> v.place AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
"""
