"""Iterative plans: the fixpoint driver, breadth-first search and PageRank."""

from .bfs import bfs, distances, frontier_sizes, level_lines, levels, unreached
from .pagerank import deltas, normalize, pagerank, residual_pagerank, top_ranked

__all__ = ["bfs", "deltas", "distances", "frontier_sizes", "level_lines", "levels", "normalize", "pagerank", "residual_pagerank", "top_ranked", "unreached"]
