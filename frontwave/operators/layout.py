"""Compressed-row views: offsets, adjacency lists, row blocks, previews."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def adjacency(edges: DataFrame) -> DataFrame:
    """src and its destinations in rising order."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def _running(rows: DataFrame, value: str, key: str, name: str, rows_each: int = 65_536) -> DataFrame:
    """The sum of ``value`` over all rows of smaller key, without putting all rows in one task.

    Keys are cut into ranges, whose number follows the rows; sums run within a range, and the ranges' totals (one row each,
    at most 4096) are summed before them.
    """
    placed = rows.withColumn("_range", ranges.number(F.col(key), ranges.bounds(rows, key, rows_each)))
    before = placed.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = before.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    own = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumn("_own", F.sum(value).over(own) - F.col(value))
    return run.join(F.broadcast(before), "_range").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")


def csr_offsets(degrees: DataFrame, end: bool = False) -> DataFrame:
    """id, out_degree, offset; with ``end``, a last row of id null and the number of edges."""
    offsets = _running(degrees, "out_degree", "id", "offset").select("id", "out_degree", "offset")
    if not end:
        return offsets
    total = degrees.agg(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("out_degree"), F.coalesce(F.sum("out_degree"), F.lit(0)).cast("long").alias("offset"))
    return offsets.unionByName(total)


def row_blocks(degrees: DataFrame, block_size: int) -> DataFrame:
    """block, first_row: the boundaries of greedy blocks of consecutive rows with at most ``block_size`` edges.

    A row opens a new block when it would overfill the running one, so an oversized row ends up alone. The end of the
    rows is the last boundary. Rows are numbered by id from 0. A greedy cut depends on all cuts before it, so one task walks
    the sorted rows; it holds one batch, and finds each cut by a search in the batch's running sums.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, block = 0, 0, 1  # rows before the batch, the open block's edges, the next block's number
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int64())], ["block", "first_row"])
        for batch in batches:
            upto = np.cumsum(batch.column(1).to_numpy())
            begin, before, cuts = 0, -size, []  # the open block began at this row of the batch, with this sum before it
            while begin < len(upto):
                # the first row that overfills the block; the row that opens one always fits
                end = max(int(np.searchsorted(upto, before + block_size, side="right")), begin + 1 if cuts or at + begin == 0 else begin)
                if end >= len(upto):
                    break
                cuts.append(at + end)
                begin, before = end, int(upto[end - 1]) if end else 0
            size, at = (int(upto[-1]) - before if len(upto) else size), at + len(upto)
            yield pa.RecordBatch.from_arrays([pa.array(range(block, block + len(cuts)), pa.int32()), pa.array(cuts, pa.int64())], ["block", "first_row"])
            block += len(cuts)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at], pa.int64())], ["block", "first_row"])

    rows = degrees.select("id", "out_degree").repartition(1).sortWithinPartitions("id")
    return rows.mapInArrow(over, "block int, first_row long")


def preview(edges: DataFrame, vertices: DataFrame, each: int = 5) -> DataFrame:
    """id, out_degree, neighbours (comma-separated) of the first and last vertices. Only their edges are gathered."""
    ends = vertices.orderBy("id").limit(each).unionByName(vertices.orderBy(F.desc("id")).limit(each)).distinct()
    near = edges.join(F.broadcast(ends), edges.src == ends.id, "left_semi")
    lists = adjacency(near)
    return ends.join(lists, ends.id == lists.src, "left").select("id", F.coalesce(F.size("neighbours"), F.lit(0)).cast("long").alias("out_degree"), F.coalesce(F.array_join("neighbours", ","), F.lit("")).alias("neighbours"))


def preview_text(rows: DataFrame, each: int = 5) -> str:
    """The preview as printed lines: all of up to ``each`` vertices, else the first and last with an ellipsis between."""
    got = [f"{r.id}: {r.neighbours.replace(',', ' ')}".rstrip() for r in rows.orderBy("id").collect()]
    return "\n".join(got if len(got) <= each else [*got[:each], " . . .", *got[each:]])


def head_tail(values: DataFrame, column: str, head: int = 6, tail: int = 4) -> DataFrame:
    """id and ``column`` of the first and last vertices."""
    return values.orderBy("id").limit(head).unionByName(values.orderBy(F.desc("id")).limit(tail)).distinct().select("id", column)


def node_info(edges: DataFrame, vertices: DataFrame, node: int) -> DataFrame:
    """id, out_degree, first_edge, end_edge, neighbours of one vertex; no row if it does not exist."""
    before = edges.agg(F.count(F.when(F.col("src") < node, 1)).alias("first_edge"), F.count(F.when(F.col("src") <= node, 1)).alias("end_edge"))
    own = edges.where(F.col("src") == node).agg(F.array_join(F.sort_array(F.collect_list("dst")), ",").alias("neighbours"))
    there = vertices.where(F.col("id") == node)
    return there.crossJoin(F.broadcast(before)).crossJoin(F.broadcast(own)).select("id", (F.col("end_edge") - F.col("first_edge")).alias("out_degree"), "first_edge", "end_edge", "neighbours")
