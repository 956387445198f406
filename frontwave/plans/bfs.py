"""Breadth-first search levels: the exact least number of hops.

A round joins the frontier to the edges, keeps destinations not seen before (an anti-join), and makes them the next
frontier. The edges are cached by source, once, a hub's apart (``hubs``); each round shuffles the frontier only. While the frontier
is thin, a job makes several hops before it looks at the visited vertices: what it reaches first at hop k and was not
visited before is k hops away, since the way there leads over such vertices only. Visited vertices are kept in tables
of falling size; a table is merged into its predecessor once it is half as large, so each vertex is rewritten a
logarithmic number of times, however deep the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import RunStats
from ..graph import Graph
from .fixpoint import cut, drop
from .hubs import deal

#: A frontier of at most so many vertices makes ``HOPS`` hops in one job.
THIN, HOPS = 20_000, 4


def bfs(graph: Graph, source: int = 0, directed: bool = True, most: int | None = None, stats: RunStats | None = None) -> DataFrame:
    """id, distance (0 at the source) of every vertex that is reached. A source that is no vertex reaches nothing."""
    stats = stats or RunStats()
    pairs = (graph.edges if directed else graph.symmetrize().edges).where("src <> dst").select("src", "dst").distinct()
    edges = deal(pairs)
    frontier, seen = cut(graph.vertices.where(F.col("id") == source).select("id", F.lit(0).alias("distance")), {"n": F.count(F.lit(1))})
    tables, count, depth = [(frontier, seen["n"])], seen["n"], 0
    while count and (most is None or depth < most):
        hops = HOPS if count <= THIN else 1
        hops = hops if most is None else min(hops, most - depth)
        now, found = frontier.select("id"), None
        for hop in range(1, hops + 1):
            now = edges.join(now.select(F.col("id").alias("src"))).select(F.col("dst").alias("id")).distinct()
            at = now.select("id", F.lit(depth + hop).alias("distance"))
            found = at if found is None else found.unionByName(at)
        if hops > 1:
            found = found.groupBy("id").agg(F.min("distance").alias("distance"))
        for table, _ in tables:
            found = found.join(table, "id", "left_anti")
        new, seen = cut(found, {f"n{k}": F.count(F.when(F.col("distance") == depth + k, 1)) for k in range(1, hops + 1)})
        sizes = [seen[f"n{k}"] for k in range(1, hops + 1)]
        for n in sizes:
            stats.add_datapoint("frontier", n)
            depth += 1
            if not n:
                break
        count, total = sizes[-1], sum(sizes)
        frontier = new.where(F.col("distance") == depth)
        if not total:
            drop(new)
            break
        tables.append((new, total))
        while len(tables) > 1 and 2 * tables[-1][1] > tables[-2][1]:
            (small, n), (large, m) = tables.pop(), tables.pop()
            merged, _ = cut(large.unionByName(small))
            for table in (small, large):
                drop(table)
            tables.append((merged, n + m))
            frontier = merged.where(F.col("distance") == depth)
    edges.unpersist()
    stats.add_stat("iterations", depth)
    visited = tables[0][0]
    for table, _ in tables[1:]:
        visited = visited.unionByName(table)
    return visited.select("id", F.col("distance").cast("int").alias("distance"))


def distances(graph: Graph, source: int = 0, directed: bool = True) -> DataFrame:
    """Reached vertices only, 0 at the source."""
    return bfs(graph, source, directed)


def levels(graph: Graph, source: int = 0, directed: bool = True, stats: RunStats | None = None) -> DataFrame:
    """Every vertex: 1 at the source, 0 if not reached."""
    found = bfs(graph, source, directed, stats=stats)
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce(F.col("distance") + 1, F.lit(0)).cast("int").alias("level"))


def frontier_sizes(graph: Graph, source: int = 0, directed: bool = True) -> DataFrame:
    """level, vertices: how many are on each level."""
    return bfs(graph, source, directed).groupBy((F.col("distance") + 1).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("vertices"))


def unreached(graph: Graph, source: int = 0, directed: bool = True) -> DataFrame:
    """The number of vertices that are not reached."""
    return levels(graph, source, directed).agg(F.count(F.when(F.col("level") == 0, 1)).alias("unreached"))


def level_lines(found: DataFrame, first: int) -> DataFrame:
    """The ``first`` rows of levels in the order in which a search prints them: by level, then by id; not reached ones are left out."""
    return found.where("level > 0").orderBy("level", "id").limit(first)
