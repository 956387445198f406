"""Residual push in blocks: ranges of vertices with their out-edges, each drained in one task before anything moves.

A block holds about ``BLOCK`` edges and vertices, so the number of blocks follows the graph and one that fits a block is done
in one round. A round is one exchange: a block meets its vertices' rows and what other blocks pushed to them, pushes the residuals
of its active vertices along its edges until none is active or what is left is little beside what goes out, and hands on its vertices' rows and, per vertex of another block, the sum
pushed there. A residual is pushed on at least as far as in rounds over the whole graph, so there are no more rounds than these, and
fewer the more edges stay within ranges of ids. The edges of a source with more than half a block of them are not in its block: what it
passes on in a round is handed on as one row, and pushed along its edges, which are dealt round-robin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import RunStats
from ..graph import Graph
from ..operators import ranges
from .fixpoint import fixpoint

#: Edges and vertices of a block: 5 bytes an edge in a row of the cached table, some 65 in a worker that prepares it, 40 in one that drains it.
BLOCK = 2**23
_PARTS = "block int, ids binary, hubs binary, n_edges binary, deg binary, dst binary, w binary, away binary, away_block binary"
#: ``kind``: 0 a vertex of the block, 1 a sum pushed to a vertex of another block, 2 what a hub passed on.
_ROWS = "block int, id long, weight double, residual double, kind int"


def _preparing():
    """The function of a block's edges and vertices. Made here, so that workers get it by value and need not import this module."""

    def prepare(key, edges, vertices):
        """One row of arrays: vertices by id with their numbers of edges and degrees, places and numbers of copies of the edges' ends by source. Other blocks' vertices follow the own ones."""
        import numpy as np
        import pyarrow as pa

        own, names = key[0].as_py(), ("block", "ids", "hubs", "n_edges", "deg", "dst", "w", "away", "away_block")
        types = [pa.int32()] + [pa.binary()] * 8
        ids = vertices["id"].to_numpy()
        order = np.argsort(ids)
        ids, hub, n = ids[order], vertices["hub"].to_numpy()[order], len(ids)
        if not n:
            return pa.table([pa.array([], t) for t in types], names=names)

        def places(of):
            at = np.searchsorted(ids, of)
            np.minimum(at, n - 1, out=at)
            return at.astype("i4"), ids[at] == of

        at, kept = places(edges["src"].to_numpy())
        deg = np.bincount(at[kept], edges["w"].to_numpy()[kept], n)
        end, there = places(edges["dst"].to_numpy())
        to = edges["to"].to_numpy()
        apart = np.flatnonzero(kept & (to != own) & (to >= 0))
        away, first, place = np.unique(edges["dst"].to_numpy()[apart], return_index=True, return_inverse=True)
        away_block = to[apart[first]]
        kept &= there & (to == own)
        kept[apart] = True
        end[apart] = n + place
        del there, apart, place
        kept = np.flatnonzero(kept)
        kept = kept[np.argsort(at[kept])]
        n_edges, end, w = np.bincount(at[kept], minlength=n), end[kept], edges["w"].to_numpy()[kept]
        w = w.astype(np.min_scalar_type(w.max(initial=0)))
        arrays = ids.astype("i8"), np.flatnonzero(hub).astype("i4"), n_edges.astype("i4"), deg, end, w, away.astype("i8"), away_block.astype("i4")
        return pa.table([pa.array([own], types[0])] + [pa.array([a.tobytes()], pa.binary()) for a in arrays], names=names)

    return prepare


def _draining(alpha: float, epsilon: float, most: int, once: bool):
    """The function of a block and its rows; with ``once`` each vertex is active in the first push. Made here as above."""

    def drain(key, parts, rows):
        """The block after at most ``most`` pushes of all its active vertices."""
        import numpy as np
        import pyarrow as pa

        types = {"block": pa.int32(), "id": pa.int64(), "weight": pa.float64(), "residual": pa.float64(), "kind": pa.int32()}
        if not parts.num_rows:
            return pa.table([pa.array([], t) for t in types.values()], names=list(types))
        kinds = {"ids": "i8", "hubs": "i4", "n_edges": "i4", "deg": "f8", "dst": "i4", "away": "i8", "away_block": "i4"}
        ids, hubs, n_edges, deg, dst, away, away_block = (np.frombuffer(parts[c][0].as_buffer(), t) for c, t in kinds.items())
        w = parts["w"][0].as_buffer()
        w = np.frombuffer(w, f"u{len(w) // max(1, len(dst))}" if len(dst) else "u1")
        w = None if (w == 1).all() else w.astype("f8")
        n, dst, share = len(ids), dst.astype(np.intp), alpha / np.maximum(deg, 1)
        of = rows["id"].to_numpy()
        at = np.minimum(np.searchsorted(ids, of), n - 1)
        known = ids[at] == of
        weight, residual = (np.bincount(at[known], rows[c].to_numpy()[known], n) for c in ("weight", "residual"))
        out, passed = np.zeros(len(away)), np.zeros(len(hubs))
        for i in range(most):
            active = np.ones(n, bool) if once and i == 0 else residual >= epsilon
            if not active.any():
                break
            drained = np.where(active, residual, 0.0)
            weight += drained
            passed += drained[hubs]
            along = np.repeat(share * drained, n_edges)
            got = np.bincount(dst, along if w is None else along * w, n + len(away))
            residual = np.where(active, 0.0, residual) + got[:n]
            out += got[n:]
            if 10 * residual[residual >= epsilon].sum() < out.sum() + passed.sum():
                break  # what is left can wait for what other blocks push
        sent, spread = np.flatnonzero(out), np.flatnonzero(passed)
        none = np.zeros(len(sent) + len(spread))
        columns = (
            np.concatenate([np.full(n, parts["block"][0].as_py()), away_block[sent], np.full(len(spread), -1)]),
            np.concatenate([ids, away[sent], ids[hubs[spread]]]),
            np.concatenate([weight, none]),
            np.concatenate([residual, out[sent], passed[spread]]),
            np.repeat([0, 1, 2], [n, len(sent), len(spread)]),
        )
        return pa.table([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))

    return drain


def _placing(edges: DataFrame, ends: DataFrame, block: int) -> Callable[[str], Column]:
    """The block number of a column of ids: ranges by size, and parts of these by hash where there are too few."""
    keys = edges.select(F.col("src").alias("id")).unionByName(ends.select("id"))
    limits = ranges.bounds(keys, "id", rows_each=block)
    parts = -(-keys.count() // (block * (len(limits) + 1) * 2))

    def place(name: str) -> Column:
        at = ranges.number(F.col(name), limits)
        return (at if parts < 2 else at * parts + F.pmod(F.hash(name), F.lit(parts))).cast("int")

    return place


def drained(graph: Graph, alpha: float, epsilon: float, most: int, stats: RunStats, block: int | None = None) -> DataFrame:
    """id, weight: when no residual is ``epsilon`` or more, or after ``most`` rounds."""
    block = block or BLOCK
    keep = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)
    tasks = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))
    graph = graph.cache()
    pairs = keep(graph.edges.where("src is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    by_source = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("deg"))
    total, top = by_source.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    vertices, named = graph.vertices.agg(F.count(F.lit(1)), F.count("id")).first()
    place = lambda _: F.lit(0)
    light, heavy, ends = pairs, None, graph.vertices.where("id is not null").withColumn("hub", F.lit(False))
    if top > block // 2:
        hubs = keep(by_source.where(F.col("n") > block // 2))
        heavy = keep(pairs.where("dst is not null").join(F.broadcast(hubs), "src").select("src", "dst", (F.col("w") / F.col("deg")).alias("p")).repartition(tasks))
        light = pairs.join(F.broadcast(hubs), "src", "left_anti")
        ends = ends.drop("hub").join(F.broadcast(hubs.select(F.col("src").alias("id"), F.lit(True).alias("hub"))), "id", "left").select("id", F.coalesce("hub", F.lit(False)).alias("hub"))
    if total + vertices > block:
        place = _placing(light, ends, block)
    ends = ends.withColumn("block", place("id"))
    # an edge to no vertex counts for the shares of its source
    edges = light.select(place("src").alias("block"), "src", F.coalesce("dst", F.lit(0)).alias("dst"), "w", F.when(F.col("dst").isNull(), -1).otherwise(place("dst")).alias("to"))
    parts = keep(edges.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(_preparing(), _PARTS).repartition(tasks, "block").sortWithinPartitions("block"))
    start = ends.select("block", "id", F.lit(0.0).alias("weight"), F.lit(1 - alpha).alias("residual"), F.lit(0).alias("kind"))

    def step(now: DataFrame, done: int) -> DataFrame:
        rows = now.where("kind < 2").select("block", "id", "weight", "residual")
        if heavy is not None:
            spread = heavy.join(F.broadcast(now.where("kind = 2").select(F.col("id").alias("src"), "residual")), "src")
            sums = spread.groupBy(F.col("dst").alias("id")).agg(F.sum(alpha * F.col("p") * F.col("residual")).alias("residual"))
            rows = rows.unionByName(sums.select(place("id").alias("block"), "id", F.lit(0.0).alias("weight"), "residual"))
        return parts.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(_draining(alpha, epsilon, most, done == 1), _ROWS)

    def stop(seen: dict, done: int) -> bool:
        stats.add_datapoint("wl_size", seen["waiting"] or 0)
        return not seen["waiting"]

    waiting = F.count(F.when((F.col("kind") > 0) | (F.col("residual") >= epsilon), 1))
    state, done, _ = fixpoint(start, step, {"waiting": waiting}, stop, most)
    stats.add_stat("iterations", done)
    for kept in (parts, pairs, graph.vertices, graph.edges, *((heavy, hubs) if heavy is not None else ())):
        kept.unpersist()
    found = state.where("kind = 0").select("id", "weight")
    # a vertex without an id meets no edge
    return found if vertices == named else found.unionByName(graph.spark.range(1).select(F.lit(None).cast("long").alias("id"), F.lit(1 - alpha).alias("weight")))
