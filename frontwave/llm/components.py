"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two aggregations with map-side minima and two joins that Spark can split where a node is hot; its table
is written to the shared folder, so the plan stays short and lost executors cost one round. Nothing is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b), as few as span them all."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    pairs = np.unique(at[: len(a)] * len(nodes) + at[len(a) :])
    root, keep = list(range(len(nodes))), []
    for k, (i, j) in enumerate(zip((pairs // len(nodes)).tolist(), (pairs % len(nodes)).tolist(), strict=True)):
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        if i != j:
            root[max(i, j)] = min(i, j)
            keep.append(k)
    return nodes[pairs[keep] // len(nodes)], nodes[pairs[keep] % len(nodes)]


def _to_least(edges: DataFrame, only_larger: bool) -> DataFrame:
    """Connect the neighbours of each node (its larger ones, or its smaller ones and itself) to the least of its neighbourhood."""
    if only_larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node that has a link; the label is the least node of its component. ``links`` has long columns a, b."""
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), "links")
    spark, before = links.sparkSession, None
    for _ in range(most_rounds):
        after = written(_to_least(_to_least(edges, True), False), "links")
        drop_scratch(spark, edges)
        edges = after
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct(), "labels")
    drop_scratch(spark, edges)
    return out
