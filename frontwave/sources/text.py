"""Text edge lists.

``read_edge_list``: the first line that is not blank is ``numNodes numEdges``; each further line is a pair of ids. Parallel edges and the
file's counts are kept, and the counts are checked against the pairs on demand. ``read_golden_list``: no header, ids are strings, which
may be quoted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from .binary import read_binary


def load(spark: SparkSession, path: str) -> Graph:
    """By suffix, case-sensitive: ``.txt`` with a header, ``.gr`` binary."""
    if path.endswith(".txt"):
        return read_edge_list(spark, path)
    if path.endswith(".gr"):
        return read_binary(spark, path)
    raise ValueError(f"{path}: not .txt or .gr")


def _pairs(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return lines.select(parts.alias("p"))


def read_edge_list(spark: SparkSession, path: str, header: str = "counts", validate: bool = False) -> Graph:
    """A headered (``counts``) or headerless (``none``) list of integer pairs.

    The header is told from the pairs by its place: it is the first line of the file, read by the driver alone; the file
    itself is scanned in splits. ``validate`` counts the edges and checks the ids' range.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    if header == "none":
        return Graph.of(_longs(_pairs(lines)))
    if header != "counts":
        raise ValueError(f"header: {header}")
    top = lines.limit(1).collect()
    try:
        nodes, edges = map(int, top[0].value.split())
    except (IndexError, ValueError) as e:
        raise ValueError(f"{path}: the first line must be the numbers of nodes and edges") from e
    # the header's own line is the one at the start of the file
    numbered = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).where("trim(value) <> ''")
    first = numbered.where("block = 0").agg(F.min("line").alias("head"))
    rest = numbered.crossJoin(F.broadcast(first)).where("line <> head").select("value")
    graph = Graph.of(_longs(_pairs(rest)), num_nodes=nodes, header=(nodes, edges))
    if validate:
        n, low, high = graph.edges.agg(F.count(F.lit(1)), F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
        if n != edges or n and (low < 0 or high >= nodes):
            raise ValueError(f"{path}: the header says {nodes} nodes and {edges} edges; found {n} edges of ids {low} to {high}")
    return graph


def write_pairs(graph: Graph, path: str) -> None:
    """The edges as lines ``src dst`` without a header, in as many files as there are partitions."""
    graph.edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")).write.text(path)


def _longs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"))


def read_golden_list(spark: SparkSession, path: str, directed: bool = True) -> tuple[DataFrame, DataFrame]:
    """String edges (src, dst), each pair once, and string vertices (id). Undirected: both directions of each."""
    clean = lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")
    parts = _pairs(spark.read.text(path).where("trim(value) <> ''"))
    edges = parts.select(clean(F.col("p")[0]).alias("src"), clean(F.col("p")[1]).alias("dst"))
    if not directed:
        both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        edges = edges.select(F.explode(both).alias("e")).select("e.src", "e.dst")
    edges = edges.distinct()
    return edges, edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def digits(column):
    """The digits of a string as a number."""
    return F.regexp_replace(column, r"\D", "").cast("long")
