"""Endpoints, degrees, transpose, symmetric closure, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def endpoints(edges: DataFrame) -> DataFrame:
    """Each vertex that an edge touches, once. One scan: both ends come from the same row."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degree(edges: DataFrame, vertices: DataFrame, end: str, name: str) -> DataFrame:
    """Edges at each vertex's ``end``; vertices without have 0."""
    counts = edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(name))
    return vertices.join(counts, "id", "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))


def max_out_degree(edges: DataFrame) -> DataFrame:
    """One row; 0 for no edges."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).cast("long").alias("max_outdegree"))


def summary(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """num_nodes, num_edges, max_outdegree in one row."""
    sizes = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("num_edges"), F.coalesce(F.max("d"), F.lit(0)).cast("long").alias("max_outdegree"))
    return vertices.agg(F.count(F.lit(1)).alias("num_nodes")).crossJoin(F.broadcast(sizes))


def flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each pair once. One scan of the edges."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(both).alias("e")).select("e.src", "e.dst").distinct()


def duplicates(edges: DataFrame) -> DataFrame:
    """Pairs with more than one edge, and how many."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def transition(edges: DataFrame) -> DataFrame:
    """src, dst, p: the share of src's rank that its edges to dst carry. Parallel edges become one row of their joint share."""
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    total = pairs.groupBy("src").agg(F.sum("w").alias("deg"))
    return pairs.join(total, "src").select("src", "dst", "w", "deg", (F.col("w") / F.col("deg")).alias("p"))
