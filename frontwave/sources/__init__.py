"""Where graphs come from: text edge lists, binary adjacency files, tables, generators."""

from .binary import read_binary, write_binary
from .generate import complete_graph, focus_graph, uniform_graph
from .text import load, read_edge_list, read_golden_list, write_pairs

__all__ = ["complete_graph", "focus_graph", "load", "read_binary", "read_edge_list", "read_golden_list", "uniform_graph", "write_binary", "write_pairs"]
