"""Foreign-key graphs: components, and orders in which parents come first. Graphs have one node per table and live on the driver."""

from __future__ import annotations

from collections.abc import Iterable
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, functions as F


def dependencies(edges: DataFrame) -> DataFrame:
    """Distinct (child, parent) pairs of different tables."""
    return edges.select("child", "parent").distinct().filter("child <> parent")


def missing_parents(edges: DataFrame, registered: DataFrame) -> DataFrame:
    """Per child the parents that are not registered, sorted and joined by `; `."""
    open_ = edges.select("child", "parent").distinct().join(registered.select(F.col("table_name").alias("parent")), "parent", "left_anti")
    return open_.groupBy("child").agg(F.array_join(F.array_sort(F.collect_set("parent")), "; ").alias("missing"))


def with_overrides(edges: DataFrame, overrides: dict[str, list[str]]) -> DataFrame:
    """Edges and configured ones; overrides shape the order only."""
    extra = [(c, p) for c, parents in sorted(overrides.items()) for p in parents]
    more = edges.sparkSession.createDataFrame(extra, "child string, parent string")
    return dependencies(edges.select("child", "parent").union(more))


def strong_components(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components, each sorted, in the order of their least members.

    Two passes of depth-first search: by finishing time, and then backwards.
    """
    nodes = sorted(set(nodes))
    ahead: dict[str, list[str]] = {n: [] for n in nodes}
    back: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in sorted(set(edges)):
        ahead[a].append(b)
        back[b].append(a)
    finished: list[str] = []
    seen: set[str] = set()
    for start in nodes:
        if start in seen:
            continue
        seen.add(start)
        path = [(start, iter(ahead[start]))]
        while path:
            node, rest = path[-1]
            if (following := next((x for x in rest if x not in seen), None)) is None:
                finished.append(node)
                path.pop()
            else:
                seen.add(following)
                path.append((following, iter(ahead[following])))
    groups, placed = [], set()
    for start in reversed(finished):
        if start in placed:
            continue
        group, open_ = [], [start]
        placed.add(start)
        while open_:
            node = open_.pop()
            group.append(node)
            for x in back[node]:
                if x not in placed:
                    placed.add(x)
                    open_.append(x)
        groups.append(sorted(group))
    return sorted(groups)


def parents_first(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[str]:
    """Tables such that parents stand before children (child, parent); members of a cycle together and sorted, ties by least member."""
    edges = {(c, p) for c, p in edges if c != p}
    groups = strong_components(nodes, edges)
    group_of = {n: k for k, g in enumerate(groups) for n in g}
    waits: list[set[int]] = [set() for _ in groups]
    frees: list[set[int]] = [set() for _ in groups]
    for c, p in edges:
        a, b = group_of[c], group_of[p]
        if a != b:
            waits[a].add(b)
            frees[b].add(a)
    ready = [(groups[k][0], k) for k in range(len(groups)) if not waits[k]]
    heapify(ready)
    out: list[str] = []
    while ready:
        _, k = heappop(ready)
        out += groups[k]
        for x in frees[k]:
            waits[x].discard(k)
            if not waits[x]:
                heappush(ready, (groups[x][0], x))
    return out


def declared_order(declared: list[str], edges: Iterable[tuple[str, str]]) -> list[str]:
    """A follower's order: parents first, ties as declared; what a cycle holds back follows as declared."""
    waits = {n: {p for c, p in edges if c == n and p != n and p in declared} for n in declared}
    out: list[str] = []
    while True:
        following = next((n for n in declared if n not in out and waits[n] <= set(out)), None)
        if following is None:
            return out + [n for n in declared if n not in out]
        out.append(following)


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For graphs without cycles: how far each table is from the tables without parents, by a recursive query."""
    edges.createOrReplaceTempView("_fk_edges")
    nodes.createOrReplaceTempView("_fk_nodes")
    return edges.sparkSession.sql("""
        WITH RECURSIVE reach(table_name, depth) AS (
          SELECT table_name, 0 FROM _fk_nodes
          UNION ALL
          SELECT e.child, r.depth + 1 FROM reach r JOIN _fk_edges e ON e.parent = r.table_name AND e.child <> e.parent
        )
        SELECT table_name, CAST(max(depth) AS INT) AS level FROM reach GROUP BY table_name
    """)
