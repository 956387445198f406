"""Binary adjacency files: little-endian, versions 1 and 2.

Layout: four uint64 (version, an unused word, nodes, edges), a uint64 end offset per node, then the destinations, uint32 in version 1 and
uint64 in version 2. Anything after them (edge payload) is not read.

The driver reads the 32-byte header only. Node ranges become partitions; each reads its slice of offsets and its slice of
destinations, so no task holds more than its share. Files are opened through Arrow's file systems.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph

HEADER = 32


def _store(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _open(path: str):
    store, inner = _store(path)
    return store.open_input_file(inner)


def read_header(path: str) -> tuple[int, int, int]:
    """version, nodes, edges; the file's size is checked against them."""
    with _open(path) as f:
        raw = f.read(HEADER)
        if len(raw) < HEADER:
            raise ValueError(f"{path}: shorter than its header")
        version, _, nodes, edges = struct.unpack("<4Q", raw)
        if version not in (1, 2):
            raise ValueError(f"{path}: version {version}, not 1 or 2")
        if f.size() < HEADER + 8 * nodes + (4 if version == 1 else 8) * edges:
            raise ValueError(f"{path}: too short for {nodes} nodes and {edges} edges")
    return version, nodes, edges


def read_binary(spark: SparkSession, path: str, nodes_per_task: int = 1 << 20, edges_per_batch: int = 1 << 20) -> Graph:
    version, nodes, edges = read_header(path)
    kind = np.dtype("<u4" if version == 1 else "<u8")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            for batch in batches:
                for begin in batch.column(0).to_pylist():
                    end = min(nodes, begin + nodes_per_task)
                    f.seek(HEADER + 8 * max(0, begin - 1))
                    stops = np.frombuffer(f.read(8 * (end - max(0, begin - 1))), "<u8").astype(np.int64)
                    stops = np.concatenate([[0], stops]) if begin == 0 else stops
                    if (np.diff(stops) < 0).any() or stops[-1] > edges:
                        raise ValueError(f"{path}: offsets are not in order")
                    for lo in range(int(stops[0]), int(stops[-1]), edges_per_batch):
                        hi = min(lo + edges_per_batch, int(stops[-1]))
                        f.seek(HEADER + 8 * nodes + kind.itemsize * lo)
                        dst = np.frombuffer(f.read(kind.itemsize * (hi - lo)), kind).astype(np.int64)
                        src = begin + np.searchsorted(stops[1:], np.arange(lo, hi), side="right")
                        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    tasks = -(-nodes // nodes_per_task)
    starts = spark.range(0, nodes, nodes_per_task, max(1, tasks)).select("id")
    return Graph.of(starts.mapInArrow(read, "src long, dst long"), num_nodes=nodes, header=(nodes, edges))


def write_binary(graph: Graph, path: str, version: int = 1, chunk: int = 8 << 20) -> None:
    """Write a graph with vertices 0 .. n-1 as one file, destinations in rising order.

    Tasks write sorted pieces of the offsets and of the destinations beside the file; the driver puts them together by
    copying ``chunk`` bytes at a time, and holds one row a piece. The path must be one that driver and executors share.
    """
    if version not in (1, 2):
        raise ValueError(f"version {version}, not 1 or 2")
    low, high, nodes = graph.vertices.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    if nodes and (low, high) != (0, nodes - 1):
        raise ValueError(f"vertices are {low} to {high}, {nodes} in number, not 0 to n - 1")
    if version == 1 and nodes > 1 << 32:
        raise ValueError("version 1 holds destinations below 2**32")
    store, inner = _store(path)
    folder = f"{inner}.pieces-{uuid.uuid4().hex}"
    store.create_dir(folder)
    try:
        offsets = graph.csr_offsets().select("id", (F.col("offset") + F.col("out_degree")).alias("end"))
        ends = _pieces(offsets.orderBy("id"), "end", np.dtype("<u8"), path, folder)
        dsts = _pieces(graph.edges.orderBy("src", "dst"), "dst", np.dtype("<u4" if version == 1 else "<u8"), path, folder)
        with store.open_output_stream(inner) as out:
            out.write(struct.pack("<4Q", version, 0, nodes, sum(n for _, n in dsts)))
            for name, _ in ends + dsts:
                with store.open_input_stream(f"{folder}/{name}") as piece:
                    while data := piece.read(chunk):
                        out.write(data)
    finally:
        store.delete_dir(folder)


def _pieces(rows: DataFrame, value: str, kind: np.dtype, path: str, folder: str) -> list[tuple[str, int]]:
    """Write a sorted table's values, a file each partition; their names and numbers of values, in order. A task that runs again writes a file of its own."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, name, out = TaskContext.get().partitionId(), 0, uuid.uuid4().hex, None
        for batch in batches:
            if batch.num_rows:
                out = out or _store(path)[0].open_output_stream(f"{folder}/{name}")
                out.write(batch.column(0).to_numpy().astype(kind).tobytes())
                count += batch.num_rows
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([count], pa.int64())], ["part", "name", "n"])

    got = rows.select(value).mapInArrow(over, "part long, name string, n long").collect()
    return [(r.name, r.n) for r in sorted(got)]
