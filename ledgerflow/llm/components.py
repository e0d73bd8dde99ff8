"""Connected components by alternating large and small stars.

Every step is a minimum per node and a join, so no task holds a component. The
edges are written to the shared folder after every step. Up to FEW edges, 16 bytes
each, are joined on the driver instead, as each step costs several jobs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerflow.runtime import cut, drop

FEW = 1 << 17


def _minimum(edges: DataFrame) -> DataFrame:
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-min")


def _joined(edges: pa.Table) -> pa.Table:
    """The same as components(), of a table of edges with u > v."""
    u, v = (edges.column(k).to_numpy() for k in ("u", "v"))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while (least[u] != least[v]).any():
        # roots go to the least root that an edge leads to, then all nodes to their roots
        low = np.minimum(least[u], least[v])
        up = least.copy()
        np.minimum.at(up, least[u], low)
        np.minimum.at(up, least[v], low)
        while (up[up] != up).any():
            up = up[up]
        least = up[least]
    more = np.flatnonzero(least != np.arange(len(nodes)))
    return pa.table({"u": nodes[more], "v": nodes[least[more]]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def components(edges: DataFrame) -> DataFrame:
    """For edges (u, v) of numbers: (u, v) for each node u of an edge but the roots, v the least node of its component."""
    spark = edges.sparkSession
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    if now.count() <= FEW:
        small = cut(spark.createDataFrame(_joined(now.toArrow()), "u long, v long").coalesce(1), "cc")
        drop(spark, now)
        return small
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            return now
        mark = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minimum(both)
        # each larger neighbour goes to the least of the neighbourhood
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "cc")
        drop(spark, now, least)
        least = _minimum(large)
        # a node and its smaller neighbours go to the least of these
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = cut(small.distinct(), "cc")
        drop(spark, large, least)
