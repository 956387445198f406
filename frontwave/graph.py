"""The graph: a DataFrame of edges and one of vertices.

Directed and unweighted; parallel edges and self-loops are kept unless :meth:`Graph.dedupe` is called. Vertices are the
distinct endpoints, or a given table (isolated vertices exist then), or ``0 .. num_nodes - 1``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import layout, structure


@dataclass(frozen=True)
class Graph:
    """``edges`` has long columns src, dst; ``vertices`` has a long column id, each id once."""

    edges: DataFrame
    vertices: DataFrame
    header: tuple[int, int] | None = None

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None, num_nodes: int | None = None, header: tuple[int, int] | None = None) -> Graph:
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        if vertices is not None:
            vertices = vertices.select(F.col("id").cast("long").alias("id")).distinct()
        elif num_nodes is not None:
            vertices = edges.sparkSession.range(num_nodes)
        else:
            vertices = structure.endpoints(edges)
        return Graph(edges, vertices, header)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def cache(self) -> Graph:
        """Keep edges and vertices in memory, spilling to disk."""
        return Graph(self.edges.persist(StorageLevel.MEMORY_AND_DISK), self.vertices.persist(StorageLevel.MEMORY_AND_DISK), self.header)

    # sizes
    def num_nodes(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def summary(self) -> DataFrame:
        return structure.summary(self.edges, self.vertices)

    def max_out_degree(self) -> DataFrame:
        return structure.max_out_degree(self.edges)

    # transforms
    def out_degree(self) -> DataFrame:
        return structure.degree(self.edges, self.vertices, "src", "out_degree")

    def in_degree(self) -> DataFrame:
        return structure.degree(self.edges, self.vertices, "dst", "in_degree")

    def flip(self) -> Graph:
        return Graph(structure.flip(self.edges), self.vertices, self.header)

    def symmetrize(self) -> Graph:
        return Graph(structure.symmetrize(self.edges), self.vertices)

    def dedupe(self) -> Graph:
        return Graph(self.edges.distinct(), self.vertices)

    def duplicate_edges(self) -> DataFrame:
        return structure.duplicates(self.edges)

    def without_self_loops(self) -> Graph:
        return Graph(self.edges.where("src <> dst"), self.vertices)

    # layout
    def adjacency(self) -> DataFrame:
        return layout.adjacency(self.edges)

    def neighbours(self, node: int) -> DataFrame:
        return self.edges.where(F.col("src") == node)

    def csr_offsets(self, end: bool = False) -> DataFrame:
        return layout.csr_offsets(self.out_degree(), end)

    def row_blocks(self, block_size: int) -> DataFrame:
        return layout.row_blocks(self.out_degree(), block_size)

    def preview(self, each: int = 5) -> DataFrame:
        return layout.preview(self.edges, self.vertices, each)

    def node_info(self, node: int) -> DataFrame:
        return layout.node_info(self.edges, self.vertices, node)
