"""Seeded random graphs of three shapes. No self-loops, and no pair in both directions before :meth:`Graph.symmetrize`.

Random choices are hashes of (seed, vertex, try), so a graph is the same on any cluster and is made without a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def _pick(n: int, *parts):
    return F.pmod(F.xxhash64(*parts), F.lit(n))


def _once(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair, self-loops gone."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min_by("src", F.col("turn")).alias("src")).select("src", F.when(F.col("src") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("dst"))


def complete_graph(spark: SparkSession, n: int) -> Graph:
    """Every pair once, from the smaller id to the larger."""
    return Graph.of(spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n))).alias("dst")).where(f"dst < {n}"), num_nodes=n)


def uniform_graph(spark: SparkSession, n: int, out_edges: int, seed: int = 0) -> Graph:
    """Up to ``out_edges`` new random neighbours for each vertex; a choice that repeats a pair adds nothing."""
    tries = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(out_edges - 1))).alias("turn"))
    return Graph.of(_once(tries.withColumn("dst", _pick(n, F.lit(seed), "src", "turn"))), num_nodes=n)


def focus_graph(spark: SparkSession, n: int, focus: int, seed: int = 0) -> Graph:
    """One random out-edge for each vertex, and ``focus`` hubs with from n/(2 focus) to n/focus random in-edges each."""
    ring = spark.range(n).select(F.col("id").alias("src"), F.lit(0).alias("turn"), _pick(n, F.lit(seed), "id").alias("dst"))
    least, most = max(1, n // focus // 2), max(1, n // focus)
    hubs = spark.range(focus).select(_pick(n, F.lit(seed + 1), "id").alias("dst"), (least + _pick(most - least + 1, F.lit(seed + 2), "id")).alias("k"))
    into = hubs.select("dst", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("turn")).select(_pick(n, F.lit(seed + 3), "dst", "turn").alias("src"), F.col("turn").cast("int").alias("turn"), "dst")
    return Graph.of(_once(ring.unionByName(into)), num_nodes=n)
